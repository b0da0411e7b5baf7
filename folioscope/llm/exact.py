"""Exact dedup by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.joins import spread_join
from folioscope.llm.common import body, cut

#: Tables of equal texts' groups with at most so many rows are broadcast (under 150 bytes a row).
BROADCAST_ROWS = 300_000
#: Rows, of 64 bits each, of the filter that says which keys may repeat: never more, whatever the input.
FILTER_ROWS = 1 << 20


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A filter (at, bits) of the keys that several rows have: the bit of each such key's hash is set."""
    found = rows.groupBy(*keys).count().where("count > 1").select(F.xxhash64(*keys).alias("h"))
    return cut(found.groupBy(_at(F.col("h")).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63L)))").alias("bits")))


def _at(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_ROWS))


def _marked(rows: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """Adds `again`: whether the filter has the row's keys. A few that don't repeat may be among them."""
    rows = rows.withColumn("h", F.xxhash64(*keys)).withColumn("at", _at(F.col("h")))
    return rows.join(F.broadcast(repeated), "at", "left").withColumn("again", F.expr("coalesce(shiftright(bits, int(h & 63L)) & 1L, 0L) = 1L")).drop("at", "h", "bits")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = 256, digest: bool = False) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row for each row given.

    Lengths that occur once are settled first; rows of shared lengths are grouped by a hash of their first
    `prefix` characters; only what may still share both is hashed whole, once. Which lengths and prefixes
    are shared reaches the scans as a broadcast bit filter of at most FILTER_ROWS rows; a row that it lets
    through wrongly is told apart by its full hash. Each step aggregates partially before its shuffle, so a
    group of any size is a few rows there; no text is ever shuffled, only ids and hashes are, and a group
    with very many rows meets them by broadcast. text_sha256 is null for rows settled before the last step
    unless `digest` asks for all.

    Null texts count as empty; empty texts are equal to each other. The largest doc_id of a group stays;
    a null doc_id is below all others, and rows that repeat the largest one are all kept. Columns of any
    other name are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("t"))
    rows = rows.withColumns({"len": F.octet_length("t"), "ph": F.xxhash64(F.substring("t", 1, prefix))})
    lengths = _repeated(rows, ["len"])
    marked = _marked(rows, ["len", "ph"], _repeated(_marked(rows, ["len"], lengths).where("again"), ["len", "ph"]))
    whole = cut(marked.where("again").select("doc_id", "len", "ph", F.unhex(F.sha2("t", 256)).alias("sha")))
    groups = whole.groupBy("len", "ph", "sha").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    grouped = spread_join(whole, groups.withColumn("weight", F.col("n")), ["len", "ph", "sha"], "weight", "left", BROADCAST_ROWS)
    alone = marked.where("not again").select("doc_id", (F.sha2("t", 256) if digest else F.lit(None).cast("string")).alias("sha"), F.lit(None).cast(docs.schema[doc_id].dataType).alias("keep"), F.lit(None).cast("long").alias("n"))
    return alone.unionByName(grouped.select("doc_id", F.lower(F.hex("sha")).alias("sha"), "keep", "n")).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
