"""The domain's tables drawn from the driver's: books from sources, chapters from documents, facts from chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import extraction

#: Ids of one ranking window: a source of any size is numbered window by window.
ID_RANGE = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """srcN is a book: of series N div 5, at position N mod 5 + 1."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    n = F.substring("book_id", 4, 9).cast("int")
    series = F.struct(F.concat(F.lit("S"), (n / 5).cast("int")).alias("name"), (n % 5 + 1).alias("position"))
    return sources.select("book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.lit(None).cast("string").alias("author"), series.alias("series"), n.cast("long").alias("ord"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, index, title, text, pages): a source's documents by id, numbered from 0.

    The number is that of earlier ranges of ids, plus the place within the own range, so no window holds a
    whole source.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", "text", F.expr(f"doc_id div {ID_RANGE}").alias("r"))
    before = Window.partitionBy("book_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy("book_id", "r").count().select("book_id", "r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("book_id", "r").orderBy("doc_id"))
    rows = docs.withColumn("place", place).join(counts, ["book_id", "r"])
    return rows.select("book_id", (F.col("before") + F.col("place") - 1).cast("int").alias("index"), F.lit(None).cast("string").alias("title"), "text", F.lit(None).cast("array<int>").alias("pages"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third book is an omnibus of two volumes, cut in the middle."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count("*").cast("int").alias("chapter_count"))
    half = F.expr("chapter_count div 2")
    spans = F.array(F.struct(F.lit("First").alias("title"), F.lit("Book One").alias("label"), F.lit(0).alias("start"), (half - 1).cast("int").alias("end")), F.struct(F.lit("Second").alias("title"), F.lit("Book Two").alias("label"), half.cast("int").alias("start"), (F.col("chapter_count") - 1).alias("end")))
    rows = index(spark, sf_dir).join(counts, "book_id")
    return rows.select("book_id", "title", "author", "series", F.lit("fiction").alias("content_type"), "chapter_count", F.when(F.col("ord") % 3 == 0, spans).alias("volumes"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.fake_extract(chapters(spark, sf_dir))


def no_entities(spark: SparkSession) -> DataFrame:
    from folioscope.schemas import ENTITIES

    return spark.createDataFrame([], ENTITIES).where(F.lit(False))  # known to be empty when a plan is made


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, scope, scope_id): books of one series share entities."""
    rows = index(spark, sf_dir).select("book_id", F.col("series.name").alias("scope_id"))
    return rows.join(rows.groupBy("scope_id").agg(F.array_sort(F.collect_list("book_id")).alias("scope")), "scope_id").select("book_id", "scope", "scope_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.resolve(extracted(spark, sf_dir), no_entities(spark), scopes(spark, sf_dir))
    # facts of every third chapter are of the past, of every fifth of the future, categories go round
    when = F.when(F.col("chapter_index") % 3 == 2, "past").when(F.col("chapter_index") % 5 == 4, "future").otherwise("present")
    category = F.element_at(F.array(*map(F.lit, ("status", "appearance", "development", "personality"))), (F.col("seq") % 4 + 1).cast("int"))
    return rows.select("book_id", (F.col("chapter_index").cast("long") * 1_000_000_000 + F.col("seq")).alias("seq"), "entity_id", "entity_name", "chapter_index", category.alias("category"), "statement", when.alias("when"), F.when(F.col("seq") % 6 == 0, F.concat(F.lit("day "), "seq")).alias("time_phrase"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry that the facts make: named as first met in the series, in the order of names."""
    at = F.col("chapter_index").cast("long") * 1_000_000_000 + F.col("seq")
    named = extracted(spark, sf_dir).groupBy("book_id", "entity_name", "entity_type").agg(F.min(at).alias("at"))
    rows = extraction.resolve(named, no_entities(spark), scopes(spark, sf_dir))
    at = F.struct(F.substring("book_id", 4, 9).cast("int"), "at")
    none = F.array().cast("array<string>")
    first = rows.groupBy("entity_id").agg(F.min_by("entity_name", at).alias("canonical_name"), F.first("entity_type").alias("type"), F.array_sort(F.collect_set("book_id")).alias("book_ids"), F.min("scope_id").alias("scope_id"))
    return first.select("entity_id", "canonical_name", "type", none.alias("aliases"), none.alias("epithets"), "book_ids", F.xxhash64("entity_id").alias("ord"))


#: The same tables as common table expressions for DuckDB, each after those that it needs.
SQL = {
    "books": """books AS (SELECT book_id, 'Book ' || book_id AS title, 'S' || (n // 5) AS series, n % 5 + 1 AS position, n AS ord, chapter_count
        FROM (SELECT source AS book_id, CAST(substr(source, 4) AS INT) AS n, count(*) AS chapter_count FROM documents GROUP BY source))""",
    "chapters": """chapters AS (SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS chapter_index, text FROM documents)""",
    "counted": r"""counted AS (SELECT book_id, chapter_index, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM chapters)""",
    "parts": r"""parts AS (SELECT book_id, chapter_index, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS s
        FROM (SELECT book_id, chapter_index, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM chapters))""",
    "extracted": r"""extracted AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY s, t) AS seq FROM (
        SELECT book_id, chapter_index, s, t, name AS entity_name, trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) AS statement FROM (
          SELECT *, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS t
          FROM (SELECT *, regexp_extract_all(regexp_replace(sentence, '[À-ÖØ-öø-ÿ]', '_', 'g'), '\b([A-Z][a-z]+)\b', 1) AS ns FROM parts))
        WHERE name NOT IN ('The', 'A', 'An', 'I', 'He', 'She', 'They', 'It', 'We', 'You')
        QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, name ORDER BY s, t) = 1))""",
    "facts": r"""facts AS (SELECT e.book_id, chapter_index::BIGINT * 1000000000 + seq AS seq, seq AS own_seq, entity_name, chapter_index, statement,
        'character-' || substr(sha256(series || chr(1) || 'character' || chr(1) || key), 1, 16) AS entity_id,
        list_extract(['status', 'appearance', 'development', 'personality'], seq % 4 + 1) AS category,
        CASE WHEN chapter_index % 3 = 2 THEN 'past' WHEN chapter_index % 5 = 4 THEN 'future' ELSE 'present' END AS "when",
        CASE WHEN seq % 6 = 0 THEN 'day ' || seq END AS time_phrase, ord AS book_ord
        FROM (SELECT *, CASE WHEN length(k) > 1 AND k LIKE '%s' THEN left(k, length(k) - 1) ELSE k END AS key FROM (SELECT *, lower(entity_name) AS k FROM extracted)) e JOIN books USING (book_id))""",
    "entities": """entities AS (SELECT entity_id, arg_min(entity_name, struct_pack(a := book_ord, b := chapter_index, c := seq)) AS canonical_name,
        'character' AS type, list_sort(list(DISTINCT book_id)) AS book_ids FROM facts GROUP BY entity_id)""",
    "orders": """orders AS (SELECT a.book_id, b.book_id AS read_id, row_number() OVER (PARTITION BY a.book_id ORDER BY b.position) AS book_rank
        FROM books a JOIN books b ON a.series = b.series AND (b.position < a.position OR a.book_id = b.book_id))""",
}


def with_tables(names: str, select: str) -> str:
    """A query after the common table expressions named, in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + select
