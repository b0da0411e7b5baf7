"""Names mined from a book's own capitals: decorated forms of a name that it uses far more often on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.schemas import AUTOLINK_RATIO, CONJUNCTIONS, DETERMINERS, MAX_DETERMINER_SHARE, MIN_BARE, MIN_DECORATED, MIN_LOWERCASE, MIN_SPEECH_SIGHTINGS, PERSON_SPEECH_VERBS, PROPOSE_RATIO

# Fixed value: what counts as a run of capitalised words.
RUN = r"([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,4})"


def capitalised_runs(chapters: DataFrame) -> DataFrame:
    """(book_id, run, n, first): longest runs of capitalised words, five at most, with count and first place."""
    rows = chapters.select("book_id", "index", F.posexplode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("k", "run"))
    rows = rows.select("book_id", F.regexp_replace("run", "[ \t]+", " ").alias("run"), F.struct("index", "k").alias("at"))
    return rows.groupBy("book_id", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def lowercase_words(chapters: DataFrame) -> DataFrame:
    rows = chapters.select("book_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word"))
    return rows.where(F.regexp_like("word", F.lit("^[a-z]+$"))).groupBy("book_id", "word").agg(F.count("*").alias("n"))


def inside_runs(runs: DataFrame) -> DataFrame:
    """(book_id, token, n): sightings of a token within runs of several words."""
    rows = runs.where(F.contains("run", F.lit(" "))).select("book_id", F.explode(F.array_distinct(F.split("run", " "))).alias("token"), "n")
    return rows.groupBy("book_id", "token").agg(F.sum("n").alias("n"))


def residues(names: DataFrame, runs: DataFrame, lowercase: DataFrame, ratio: float = PROPOSE_RATIO) -> DataFrame:
    """(book_id, name, residue, sightings): for decorated names the end of the name that the book uses on its own.

    The name must be seen 10 times; the residue 100 times, `ratio` times as often as the name, and, if it is
    one word, seldom in lower case and more often alone than within longer runs. The most frequent residue
    wins, of equals the longest. A conjunction after the first word makes no decorated name.
    """
    tokens = T.words("name")
    spoilt = F.exists(F.slice(tokens, F.lit(2), F.size(tokens)), lambda t: F.lower(F.regexp_replace(t, "^[.,]+|[.,]+$", "")).isin(*CONJUNCTIONS))
    rows = names.select("book_id", "name").distinct().withColumn("tokens", tokens).where((F.size("tokens") >= 2) & ~spoilt)
    rows = rows.withColumn("whole", F.array_join("tokens", " ")).join(runs.select("book_id", F.col("run").alias("whole"), F.col("n").alias("decorated")), ["book_id", "whole"])
    rows = rows.where(F.col("decorated") >= MIN_DECORATED)
    ends = F.transform(F.sequence(F.lit(2), F.size("tokens")), lambda k: F.array_join(F.slice(F.col("tokens"), k, F.size("tokens")), " "))
    rows = rows.select("book_id", "name", "decorated", F.posexplode(ends).alias("k", "residue"))
    rows = rows.join(runs.select("book_id", F.col("run").alias("residue"), F.col("n").alias("sightings")), ["book_id", "residue"]).where((F.col("sightings") >= MIN_BARE) & (F.col("sightings") >= F.col("decorated") * ratio))
    rows = rows.withColumn("low", F.lower("residue")).join(lowercase.select("book_id", F.col("word").alias("low"), F.col("n").alias("low_n")), ["book_id", "low"], "left")
    inside = inside_runs(runs)
    rows = rows.join(inside.select("book_id", F.col("token").alias("residue"), F.col("n").alias("inside_n")), ["book_id", "residue"], "left")
    alone = F.contains("residue", F.lit(" ")) | ((F.coalesce("low_n", F.lit(0)) < MIN_LOWERCASE) & (F.col("sightings") > F.coalesce("inside_n", F.lit(0))))
    best = F.max_by(F.struct("residue", "sightings"), F.struct("sightings", -F.col("k")))
    return rows.where(alone).groupBy("book_id", "name").agg(best.alias("b")).select("book_id", "name", "b.residue", "b.sightings")


def person_like(names: DataFrame, chapters: DataFrame, runs: DataFrame) -> DataFrame:
    """(book_id, name) that read as persons: seldom after a determiner, and three times next to a verb of speech.

    Chapters are matched one by one, so a book's text is never gathered.
    """
    determiners = "|".join([w.capitalize() for w in DETERMINERS] + list(DETERMINERS))
    verbs = "|".join(PERSON_SPEECH_VERBS)
    quoted = T.quoted("name")
    rows = names.select("book_id", "name").distinct().join(chapters.select("book_id", "text"), "book_id").where(F.contains("text", F.col("name")))
    count = lambda *parts: F.regexp_count("text", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    rows = rows.groupBy("book_id", "name").agg(
        F.sum(count(rf"(?U)\b(?:{determiners})\s+", quoted, r"\b")).alias("determined"),
        F.sum(count(r"(?U)\b", quoted, rf"\s+(?:{verbs})\b") + count(rf"(?U)\b(?:{verbs})\s+", quoted, r"\b")).alias("speaking"),
    )
    rows = rows.join(runs.select("book_id", F.col("run").alias("name"), "n"), ["book_id", "name"])
    return rows.where((F.col("determined") / F.col("n") < MAX_DETERMINER_SHARE) & (F.col("speaking") >= MIN_SPEECH_SIGHTINGS)).select("book_id", "name")


def person_link_groups(chapters: DataFrame, ratio: float = AUTOLINK_RATIO) -> DataFrame:
    """(book_id, name, decorated, sightings, place): persons with their decorated forms, the most seen first."""
    runs, lowercase = capitalised_runs(chapters), lowercase_words(chapters)
    many = runs.where(F.contains("run", F.lit(" "))).select("book_id", F.col("run").alias("name"), "first")
    found = residues(many, runs, lowercase, ratio).join(many, ["book_id", "name"])
    groups = found.groupBy("book_id", "residue").agg(F.array_sort(F.collect_list("name")).alias("decorated"), F.first("sightings").alias("sightings"), F.min("first").alias("first"))
    groups = groups.withColumnRenamed("residue", "name")
    groups = groups.join(person_like(groups, chapters, runs), ["book_id", "name"], "left_semi")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("sightings").desc(), "first"))
    return groups.select("book_id", "name", "decorated", "sightings", place.alias("place"))
