"""No fact of a later chapter or book reaches a reader, by any path a question can take."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import context, extraction, reading, relevance
from folioscope.schemas import ENTITIES, FACTS, INDEX

PADDING = "then the road went on and on through the quiet hills and nobody said a word about it for days."
SENTINELS = ["Abel", "Bryn", "Cleo", "Dara", "Edda", "Finn", "Gwen", "Hugo", "Iris", "Jory"]
EVENTS = ["flooding", "harvest", "wedding", "eclipse", "robbery", "voyage", "tempest", "festival", "betrayal", "reunion"]
QUESTIONS = ("What of Maren?", "who remembers the eclipse or the harvest", "why is it so")


def library(spark, chapters, later_book=False):
    rows = [("one", k, None, f"Maren and {SENTINELS[k]} saw the {EVENTS[k]}. {PADDING}", None) for k in range(chapters)]
    index = [("one", "One", None, ("S", 1), 0)]
    if later_book:
        rows += [("two", 0, None, f"Maren met Zelda at the coronation. {PADDING}", None)]
        index += [("two", "Two", None, ("S", 2), 1)]
    chapters = spark.createDataFrame(rows, "book_id string, index int, title string, text string, pages array<int>")
    index = spark.createDataFrame([(b, t, a, s, o) for b, t, a, s, o in index], "book_id string, title string, author string, series struct<name:string,position:int>, ord long")
    scopes = index.select("book_id", F.array(F.lit("one"), F.lit("two")).alias("scope"), F.lit("S").alias("scope_id"))
    found = extraction.resolve(extraction.fake_extract(chapters), spark.createDataFrame([], ENTITIES), scopes)
    facts = found.select("book_id", (F.col("chapter_index") * 1000 + F.col("seq")).alias("seq"), "entity_id", "entity_name", "chapter_index", "category", "statement", "when", "time_phrase")
    entities = extraction.registry_after(found, spark.createDataFrame([], ENTITIES))
    return index, *(spark.createDataFrame(t.collect(), t.schema) for t in (facts, entities))


def ask(lib, position, question):
    index, facts, entities = lib
    visible = reading.ranked(reading.facts_as_of(facts, index, "one", position))
    return context.format_context(relevance.relevant_facts(question, visible, entities), entities)


@pytest.mark.parametrize("position", [0, 4])
def test_later_text_changes_nothing(spark, position):
    whole, cut, series = library(spark, 10), library(spark, position + 1), library(spark, 10, later_book=True)
    for question in QUESTIONS:
        text = ask(whole, position, question)
        assert text and not any(s in text for s in SENTINELS[position + 1 :]) and not any(e in text for e in EVENTS[position + 1 :])
        assert text == ask(cut, position, question) == ask(series, position, question)
    unseen = ask(whole, 0, f"tell me about {SENTINELS[8]}")
    assert SENTINELS[8] not in unseen


def test_many_positions_are_single_ones(spark):
    index, facts, _ = library(spark, 10, later_book=True)
    positions = spark.createDataFrame([("a", "one", 3), ("b", "two", 0), ("c", "unknown", 5)], "position_id string, book_id string, chapter_index int")
    found = {r.position_id: r["count"] for r in reading.facts_at_positions(facts, index, positions).groupBy("position_id").count().collect()}
    assert found == {"a": reading.facts_as_of(facts, index, "one", 3).count(), "b": reading.facts_as_of(facts, index, "two", 0).count()}
    assert reading.facts_as_of(facts, index, "unknown", 5).count() == 0
    with pytest.raises(ValueError):
        reading.check_position(10, 10)


def test_plan_prunes_and_pushes_down(spark, tmp_path):
    index, facts, _ = library(spark, 10, later_book=True)
    facts.write.partitionBy("book_id").parquet(f"{tmp_path}/facts")
    stored = spark.read.parquet(f"{tmp_path}/facts")
    plan = reading.facts_as_of(stored, index, "two", 0)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(chapter_index,0)" in plan and "book_id" in plan.split("PartitionFilters")[1]


def rare_words(question, facts, limit=80):
    """A plain loop over (rank, chapter, words)."""
    df = {}
    for _, _, words in facts:
        for w in words:
            df[w] = df.get(w, 0) + 1
    ceiling = max(1, len(facts) // 10)
    rare = {w for w in question if 0 < df.get(w, 0) <= ceiling}
    scored = [(-round(sum(1 / df[w] for w in sorted(words & rare)), 12), chapter, rank) for rank, chapter, words in facts if words & rare]
    return [rank for _, _, rank in sorted(scored)][:limit]


@pytest.mark.parametrize("seed", range(4))
def test_rare_words_against_a_loop(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300 if seed else 40)]
    rows, plain = [], []
    for k in range(rng.randint(5, 700)):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        chapter = rng.randint(0, 20)
        rows.append(("b", k, f"e{k % 7}", "N", chapter, "status", " ".join(words), "present", None))
        plain.append((k, chapter, set(words)))
    question = " ".join(rng.choice(vocabulary) for _ in range(12))
    facts = reading.ranked(spark.createDataFrame(rows, FACTS).withColumn("book_rank", F.lit(1)))
    assert [r.seq for r in relevance.facts_by_rare_words(question, facts).collect()] == rare_words(set(question.split()), plain)


def test_names_in_questions(spark):
    entities = spark.createDataFrame([("c1", "The Baron", "character", ["Arald"], ["Wolf"], ["b"], 0), ("c2", "Ranger Halt", "character", [], [], ["b"], 1), ("c3", "Evanlyn", "character", [], [], ["b"], 2)], ENTITIES)
    facts = spark.createDataFrame([("b", k, e, "N", 0, "status", "x", "present", None) for k, e in enumerate(("c1", "c2", "c3", "gone-1"))], FACTS)
    ask = lambda q: {r.entity_id for r in relevance.entities_in_question(q, facts, entities).collect()}
    assert ask("what did barons do") == {"c1"} and ask("is arald well") == {"c1"}
    assert ask("who is the wolf") == set() and ask("where is evanlin?") == {"c3"} and ask("about gone-1") == {"gone-1"}
    assert ask("ranger") == set() and ask("ranger halt!") == {"c2"}


def test_context_text(spark):
    rows = [
        ("b", 1, "c1", "A", 2, "status", "Left home", "present", "in spring"),
        ("b", 2, "c2", "B", 1, "appearance", "Is tall", "present", "never shown"),
        ("b", 3, "c1", "A", 1, "status", "Was born", "past", None),
        ("b", 4, "c1", "A", 1, "appearance", "Is old", "present", None),
        ("b", 5, "c1", "A", 0, "personality", "Is kind", None, None),
        ("b", 6, "c1", "A", 0, "appearance", "Was young", "present", None),
        ("b", 7, "c1", "A", 3, "status", "Will go", "future", ""),
    ]
    index = spark.createDataFrame([], INDEX)
    entities = spark.createDataFrame([("c1", "Ann", "character", [], [], ["b"], 0)], ENTITIES)
    facts = reading.ranked(reading.facts_as_of(spark.createDataFrame(rows, FACTS), index, "b", 9))
    head = context.HEADINGS
    expected = "\n".join(["Ann", head[0], "    [ch 1] (status) Was born", head[1], "    [ch 2 - in spring] (status) Left home", head[2], "    [ch 3] (status) Will go", head[3], "    appearance:", "      [ch 0] Was young", "      [ch 1] Is old", "    personality:", "      [ch 0] Is kind", "", "c2", head[3], "    appearance:", "      [ch 1] Is tall"])
    assert context.format_context(facts, entities) == expected
    assert context.format_context(facts.limit(0), entities) == ""
    assert "(status)" not in context.format_context(facts.where("`when` = 'present'"), entities, "nonfiction")
