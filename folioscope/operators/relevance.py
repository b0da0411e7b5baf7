"""Facts that bear on a question: by name, else by rare words, else all."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folioscope.functions import text as T
from folioscope.functions.lineage import settle
from folioscope.schemas import FUZZY_RATIO, MAX_STATEMENT_MATCHES, RARITY_DIVISOR


@F.pandas_udf(BooleanType())
def _reads_like(words: pd.Series, names: pd.Series) -> pd.Series:
    """Whether some word is nearly the name; for single-word names of three letters or more."""
    return pd.Series([any(SequenceMatcher(None, w, n).ratio() >= FUZZY_RATIO for w in ws) for ws, n in zip(words, names, strict=True)], dtype=bool)


def names_for_questions(entities: DataFrame) -> DataFrame:
    """(entity_id, name): canonical names and aliases. Epithets belong to resolution only."""
    return entities.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))


def name_in_question(name: Column, question: Column) -> Column:
    """The name, or its match key, within the question; whatever stands around it."""
    low = F.lower(question)
    key = T.match_key(name)
    return F.contains(low, F.lower(name)) | ((key != "") & F.contains(low, key))


def entities_in_question(question: str, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id) of those facts that the question names, exactly or nearly. An unknown entity's name is its id."""
    ids = facts.select("entity_id").distinct()
    names = ids.join(names_for_questions(entities), "entity_id", "left").withColumn("name", F.coalesce("name", "entity_id"))
    plain = name_in_question(F.col("name"), F.lit(question))
    low = F.lower("name")
    near = ~F.contains(low, F.lit(" ")) & (F.length(low) >= 3)
    names = settle(names.withColumn("plain", plain))
    fuzzy = names.where(~F.col("plain") & near).where(_reads_like(T.raw_question_words(F.lit(question)), F.lower("name")))
    return names.where("plain").select("entity_id").union(fuzzy.select("entity_id")).distinct()


def statement_frequencies(facts: DataFrame) -> DataFrame:
    """(word, df): in how many of the visible facts a word occurs. To be taken of filtered facts only."""
    return facts.select(F.explode(T.question_words("statement")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def facts_by_rare_words(question: str, facts: DataFrame, limit: int = MAX_STATEMENT_MATCHES) -> DataFrame:
    """The `limit` facts that share most of the question's rare words: (facts' columns, score).

    Rare are words in a tenth of the facts at most, or in one. A shared word scores 1/df, added in the order
    of the words; ties keep the facts' order after the chapter's.
    """
    wanted = F.filter(T.question_words(F.lit(question)), lambda w: w.isNotNull())
    ceiling = max(1, facts.count() // RARITY_DIVISOR)
    rows = facts.withColumn("word", F.explode(F.array_intersect(T.question_words("statement"), wanted)))
    frequencies = rows.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= ceiling)
    shared = rows.join(F.broadcast(frequencies), "word")
    score = F.aggregate(F.array_sort(F.collect_list(F.struct("word", "df"))), F.lit(0.0), lambda total, x: total + 1.0 / x["df"])
    keep = [c for c in facts.columns if c != "rank"]
    found = shared.groupBy("rank").agg(*(F.first(c, ignorenulls=False).alias(c) for c in keep), score.alias("score"))
    return found.orderBy(F.round("score", 12).desc(), "chapter_index", "rank").limit(limit)


def relevant_facts(question: str, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of entities that the question names; else those by rare words; else all. facts: ranked."""
    named = settle(entities_in_question(question, facts, entities))
    if not named.isEmpty():
        return facts.join(F.broadcast(named), "entity_id", "left_semi")
    rare = facts_by_rare_words(question, facts)
    if not rare.isEmpty():
        first = Window.orderBy(F.round("score", 12).desc(), "chapter_index", "rank")  # at most the limit's rows
        return rare.withColumn("place", F.row_number().over(first)).withColumn("rank", F.struct(F.col("place").alias("book_rank"), F.col("seq").alias("seq"))).select(*facts.columns)
    return facts
