"""How often rows are shuffled, and results at the edges of the steps that work a chapter or group at a time."""

import re

from folioscope.functions.groups import by_group
from folioscope.operators import extraction, ingest, passages, registry, scorecard
from folioscope.schemas import CHAPTERS


def shuffles(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def chapters_of(spark, *texts):
    return spark.createDataFrame([("b", k, None, t, None) for k, t in enumerate(texts)], CHAPTERS)


def test_groups_come_whole_and_in_order(spark):
    rows = spark.createDataFrame([(k % 3, -k, "x") for k in range(9000)], "g int, k int, s string")
    found = by_group(rows, ["g"], ["k"], lambda key, group: iter([(key[0], [k for k, _ in group])]), "g int, ks array<int>").collect()
    assert {r.g: r.ks for r in found} == {g: sorted(-k for k in range(9000) if k % 3 == g) for g in range(3)}
    assert len(found) == 3


def test_groups_of_a_long_book(spark):
    """One pass over numbers: no array grows with the book."""
    table = chapters_of(spark, *["w " * (k % 5) for k in range(12_000)])
    found = ingest.fragment_groups(table, 7)
    group, held, wanted = 0, 0, []
    for k in range(12_000):
        wanted.append((k, group))
        held += k % 5
        if held >= 7:
            group, held = group + 1, 0
    assert sorted((r["index"], r["merged_index"]) for r in found.collect()) == wanted
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()


def test_extraction_needs_no_shuffle(spark):
    table = chapters_of(spark, "Zoe met Ann. The fox. Zoe ran?  Bob Ann saw ÉZoe Élé Ab1.", "", None)
    found = extraction.fake_extract(table)
    assert [(r.chapter_index, r.seq, r.entity_name, r.statement) for r in found.collect()] == [(0, 1, "Zoe", "Zoe met Ann."), (0, 2, "Ann", "Zoe met Ann."), (0, 3, "Bob", "Bob Ann saw ÉZoe Élé Ab1.")]
    assert shuffles(found) == 0


def test_a_name_is_looked_for_as_it_is_first(spark):
    rows = spark.createDataFrame([("Moss", "character", "the Moss grew"), ("Moss", "character", "Mosses"), ("Moss", "character", "moss"), ("Moss", "character", "aMoss"), ("moss", "theme", "MOSS"), ("Ann", "character", "Anna Ann's")], "n string, t string, x string")
    found = rows.select(extraction.is_grounded(rows.n, rows.t, rows.x).alias("g"))
    assert [r.g for r in found.collect()] == [True, False, False, False, True, True]
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()


def test_statements_and_texts_are_shuffled_once(spark):
    table = chapters_of(spark, "Ann fled. Then Will came.\n\nWill slept", "", None)
    said = spark.createDataFrame([("1", "b", 0, "Will slept"), ("2", "b", 0, "nothing"), ("3", "b", 1, "Ann"), ("4", "b", 2, "Ann"), ("5", "b", 9, "Ann"), ("6", None, 0, "Ann"), ("7", "b", 0, None)], "statement_id string, book_id string, chapter_index int, statement string")
    books = spark.createDataFrame([("b", "Book", None)], "book_id string, title string, volumes array<struct<title:string,label:string,start:int,end:int>>")
    found = passages.passages(said, table)
    assert [(r.statement_id, r.quote, r.start, r.end) for r in found.collect()] == [("1", "Will slept", 27, 37)] and shuffles(found) == 1
    cited = passages.citations(said, table, books)
    assert {r.statement_id: r["where"] for r in cited.collect()} == {"1": "Book, chapter 0, 73% in", "2": "Book, chapter 0", "3": "Book, chapter 1", "4": "Book, chapter 2", "7": "Book, chapter 0"}
    assert shuffles(cited) == 1


def test_words_of_a_chapter_need_no_shuffle(spark):
    found = passages.word_weights(chapters_of(spark, "Ann fled. Ann, Ann! The fox", "", None))
    assert {r.word: r.idf for r in found.collect()} == {"ann": 0.5, "fled": 1.0, "fox": 1.0} and shuffles(found) == 0


def test_near_duplicates_are_shuffled_once(spark):
    facts = spark.createDataFrame([("b", 0, k, s) for k, s in enumerate(["golden lantern here", "GOLDEN lantern here", "a to", None, "lantern"])] + [(None, 0, 9, "golden lantern here"), (None, 0, 10, "golden lantern here")], "book_id string, chapter_index int, seq long, statement string")
    found = scorecard.near_duplicate_pairs(facts, ["book_id", "chapter_index"])
    assert [tuple(r) for r in found.collect()] == [("b", 0, 0, 1)] and shuffles(found) == 1


def test_groundedness_of_many_is_that_of_each(spark):
    said = ["Ann found GOLD, rather!", "a to", "", "\"'''' Nothing", "found? found"]
    facts = spark.createDataFrame([("b", 0, k, s) for k, s in enumerate(said)] + [("b", 1, 9, "Ann found"), ("b", 7, 10, "Ann found")], "book_id string, chapter_index int, seq long, statement string")
    table = chapters_of(spark, "Ann FOUND golden things, not nothings.", "")
    found = scorecard.grounded_facts(facts, table)
    joined = facts.join(table.withColumnRenamed("index", "chapter_index"), ["book_id", "chapter_index"])
    wanted = {r.seq: r.g for r in joined.select("seq", scorecard.groundedness(joined.statement, joined.text).alias("g")).collect()}
    assert {r.seq: r.g for r in found.collect()} == wanted and len(wanted) == 6 and shuffles(found) == 1


def test_stated_variants_look_around_phrases_only(spark):
    """No name meets a whole text: the texts that the plan joins are what stands around a phrase."""
    names = ["Robin", "Rob", "Al", "Alfie", "Alf", "Kit", "Kitty", "Saul", "Sauls", "O'Ned", "O'Neddy"]
    rows = spark.createDataFrame([("b", k, f"e{k}", n, "character") for k, n in enumerate(names)], "book_id string, ord long, entity_id string, name string, type string")
    texts = ["x" * 5000 + " Robin, who was called rob by all. " + "y " * 3000, "Alfie. He was known as Alf", "ALF-called-alfie", "Kitty goes by Kit", "Saul went by nobody. Sauls", "(O'Neddy) or simply O'Ned!", "Kitty " + "z" * 60 + " nicknamed Kit", None, ""]
    chapters = chapters_of(spark, *texts)
    naming = r"\b[^.!?]{0,40}?\b(?:called|nicknamed|known as|goes by|went by|short for|or just|or simply)\b[^.!?]{0,25}?\b"
    fold = lambda t: (t or "").replace("K", "K")
    states = lambda x, y: any(re.search(rf"(?i)\b{re.escape(x)}{naming}{re.escape(y)}\b", fold(t)) for t in texts)
    wanted = {(f"e{i}", f"e{j}") for i, a in enumerate(names) for j, b in enumerate(names) if len(a) >= 3 and len(b) > len(a) and b.lower().startswith(a.lower()) and (states(a, b) or states(b, a))}
    found = registry.stated_variants(rows, chapters)
    assert {(r.a, r.b) for r in found.collect()} == wanted and len(wanted) == 4
    assert "text#" not in "".join(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
