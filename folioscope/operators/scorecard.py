"""Comparing extractors on the same chapters. Reads only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.groups import by_group
from folioscope.operators.passages import located
from folioscope.schemas import MAX_FACTS, NEAR_DUPLICATE


def groundedness(statement: Column, text: Column) -> Column:
    """The share of the statement's words over three characters that the chapter has somewhere; 1 without any."""
    kept = grounded_words(statement)
    low = F.lower(text)
    found = F.size(F.filter(kept, lambda w: F.contains(low, w)))
    return F.when(F.size(kept) == 0, 1.0).otherwise(found / F.size(kept))


def grounded_words(statement: Column) -> Column:
    return F.transform(F.filter(T.words(statement), lambda w: F.length(w) > 3), lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'")))


def near_duplicate_pairs(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): facts (by, seq, statement) of a group whose word sets have a Jaccard similarity of 0.6 or more.

    Pairs meet on a shared word: one among the rarest of the group that a set of its size must share with any
    similar one, so common words pair nothing. A group's word sets are held by one worker at a time.
    """
    rows = facts.select(*by, "seq", F.array_join(T.scorecard_words("statement"), " ").alias("w")).where("w <> ''")
    types = dict(rows.dtypes)

    def work(key, facts_in_order):
        import math

        if any(k is None for k in key):
            for _ in facts_in_order:
                pass
            return
        seqs, sets = [], []
        df: dict = {}
        for seq, w in facts_in_order:
            words = w.split(" ")
            seqs.append(seq)
            sets.append(words)
            for word in words:
                df[word] = df.get(word, 0) + 1
        rank = {word: k for k, (_, word) in enumerate(sorted((n, word) for word, n in df.items()))}
        ranked = [sorted(rank[word] for word in words) for words in sets]
        whole = [frozenset(words) for words in ranked]
        met: dict = {}
        for b, words in enumerate(ranked):
            n = len(words)
            prefix = words[: n - math.ceil(n * least - 1e-9) + 1]
            candidates = {a for word in prefix if word in met for a in met[word]}
            for a in candidates:
                m = len(ranked[a])
                if m >= n * least - 1e-9 and n >= m * least - 1e-9 and seqs[a] != seqs[b]:
                    shared = len(whole[a] & whole[b])
                    if shared / (m + n - shared) >= least:
                        yield *key, min(seqs[a], seqs[b]), max(seqs[a], seqs[b])
            for word in prefix:
                met.setdefault(word, []).append(b)

    least = NEAR_DUPLICATE
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), f"a {types['seq']}", f"b {types['seq']}"])
    return by_group(rows, by, ["seq"], work, schema)


def grounded_facts(facts: DataFrame, chapters: DataFrame, at: str = "chapter_index", carry: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(book_id, at, carry, g): `groundedness` of facts in the chapter that their column `at` names, if there is one.

    A chapter's text meets its facts once, and each of their words once.
    """
    key = ["book_id", at]
    kept = grounded_words(F.col("statement"))
    # words hold no white space, so they go as one text; null where there is none
    rows = facts.select(*key, F.lit(1).alias("kind"), F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("body"), *carry)
    types = dict(rows.dtypes)
    texts = chapters.select("book_id", F.col("index").cast(types[at]).alias(at), F.lit(0).alias("kind"), F.lower("text").alias("body"), *(F.lit(None).cast(types[c]).alias(c) for c in carry))

    def work(key, rows_in_order):
        there_is, low, whole, known = False, None, frozenset(), {}
        for kind, body, *rest in rows_in_order:
            if kind == 0:
                there_is, low, whole, known = True, body, frozenset((body or "").split()), {}
            elif there_is and None not in key:
                score = 1.0
                if body is not None:
                    words = body.split(" ")
                    found = 0
                    for w in words:
                        there = known.get(w)
                        if there is None:
                            there = known[w] = low is not None and (w in whole or w in low)
                        found += there
                    score = found / len(words)
                yield *key, *rest, score

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*key, *carry)), "g double"])
    return by_group(texts.union(rows), key, ["kind"], work, schema)


def scorecard(results: DataFrame, facts: DataFrame, chapters: DataFrame, cap: int = MAX_FACTS, samples: int = 2) -> DataFrame:
    """A row for each provider.

    results: (provider, book_id, chapter_index, parse_ok, seconds, prompt_tokens, output_tokens, prompt_seconds),
    the last four null where unknown; facts: (provider, book_id, chapter_index, seq, entity_name, statement).
    Average groundedness is NaN without facts, sums are null without a known part, coverage is 0 then.
    """
    key = ["book_id", "chapter_index"]
    scored = grounded_facts(facts, chapters, carry=("provider", "entity_name"))
    by_fact = scored.groupBy("provider").agg(F.count("*").alias("facts"), F.count_distinct("entity_name").alias("distinct_entities"), F.avg("g").alias("groundedness"))
    # a statement is told by its provider: here the places are only counted
    quoted = located(facts.select(F.col("provider").alias("statement_id"), *key, "statement"), chapters)
    quoted = quoted.groupBy(F.col("statement_id").alias("provider")).agg(F.count("*").alias("quoted"))
    by_fact = by_fact.join(quoted, "provider", "left").na.fill(0, ["quoted"])
    pairs = near_duplicate_pairs(facts, ["provider", *key]).groupBy("provider").agg(F.count("*").alias("near_duplicate_pairs"))
    first = F.array_sort(F.collect_list(F.struct("seq", F.left("statement", F.lit(60)).alias("s"))))
    by_chapter = facts.groupBy("provider", *key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(first, 1, samples), lambda x: x["s"]), " | ").alias("sample"))
    runs = results.join(by_chapter, ["provider", *key], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = runs.groupBy("provider").agg(
        F.count("*").alias("chapters"),
        F.count_if(~F.col("parse_ok")).alias("parse_failures"),
        F.count_if(F.col("n") >= cap).alias("cap_hits"),
        *(F.sum(c).alias(c) for c in ("seconds", "prompt_tokens", "output_tokens", "prompt_seconds")),
        F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", F.coalesce("sample", F.lit("")).alias("sample")))), lambda x: x).alias("samples"),
    )
    rows = rows.join(by_fact, "provider", "left").join(pairs, "provider", "left").na.fill(0, ["facts", "distinct_entities", "quoted", "near_duplicate_pairs"])
    return rows.withColumn("groundedness", F.coalesce("groundedness", F.lit(float("nan")))).withColumn("citation_coverage", F.coalesce(F.try_divide("quoted", "facts"), F.lit(0.0)))


def scorecard_lines(row) -> list[str]:
    """A provider's row as text."""
    lines = [
        f"[{row.provider}] {row.facts} facts across {row.chapters} chapter(s), {row.parse_failures} parse failure(s), avg groundedness {row.groundedness:.2f}",
        f"  quality: {row.distinct_entities} distinct entities, {row.citation_coverage:.0%} citable, {row.near_duplicate_pairs} near-duplicate pair(s), {row.cap_hits}/{row.chapters} chapter(s) at the {MAX_FACTS}-fact ceiling",
    ]
    if row.seconds is not None:
        cost = f"  cost: {row.seconds:.0f}s total, {row.seconds / max(1, row.chapters):.0f}s/chapter"
        cost += f", {row.output_tokens} output tokens" if row.output_tokens is not None else ""
        cost += f", {row.prompt_tokens} prompt tokens" if row.prompt_tokens is not None else ""
        cost += f" ({row.prompt_seconds:.0f}s to evaluate)" if row.prompt_tokens is not None and row.prompt_seconds is not None else ""
        lines.append(cost)
    return lines + [f"  ch{s.chapter_index}: {s.sample or '(no facts)'}" for s in row.samples]


def runs_to_make(chapters: DataFrame, providers: list[str], indexes: list[int]) -> DataFrame:
    """(provider, book_id, chapter_index): each chapter asked for with each provider."""
    wanted = chapters.where(F.col("index").isin(*indexes)).select("book_id", F.col("index").alias("chapter_index"))
    return wanted.select(F.explode(T.literals(providers)).alias("provider"), "book_id", "chapter_index")
