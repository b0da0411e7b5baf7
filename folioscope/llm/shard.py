"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import body, cut

#: Rows of one ranking window at most, about; a source has MIN_WINDOWS of them at least.
WINDOW_ROWS, MIN_WINDOWS = 20_000, 256


def offset(source: Column, seed: int) -> Column:
    """Between 0 and 1, by the source: an odd multiple of 2**-21."""
    return (F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 20)) + 0.5) / float(1 << 20)


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple = ()) -> DataFrame:
    """Deals rows into shards that all have the sources in the proportions of the whole.

    Rows of a source are put in a seeded random order; rank r of n becomes the fraction (r-1+u)/n, where u, from
    0 to 1, is a hash of the source, so that small sources, of one row even, are dealt all over; all rows
    are sorted by that fraction and cut into `shards` runs whose row counts are at most one apart, so each
    shard gets n/shards rows of a source, within two. No window holds a whole source or table: ranks
    are counts of earlier hash ranges plus a row number within a range of about WINDOW_ROWS rows, as are the
    places by fraction. Only rows that repeat source, id and text are never parted.

    Returns (doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard null) and the `carry` columns as
    a struct `row`, if any are named. Null and empty texts have size 1 and checksum 0; a null source is a
    source of its own; null and repeated doc_ids are rows like any other. An empty table gives no rows.
    """
    chosen = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"), (F.octet_length(body(text)) + 1).cast("long").alias("size"), F.crc32(body(text)).alias("crc")]
    chosen += [F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(body(text))).alias("h")] + ([F.struct(*carry).alias("row")] if carry else [])
    rows = cut(docs.select(*chosen))
    total = rows.count()
    bits = max(MIN_WINDOWS, total // WINDOW_ROWS).bit_length() - 1
    ranges = 1 << bits
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - bits))
    cells = rows.groupBy("source", "b").count()
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("source")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "b").orderBy("h", "doc_id", "crc", "size"))
    ranked = rows.withColumn("rank", rank).join(cells, ["source", "b"]).withColumn("f", (F.col("before") + F.col("rank") - 1 + offset(F.col("source"), seed)) / F.col("n"))
    # multiplied by a power of two, so ranges are in the fractions' order
    ranked = ranked.select("doc_id", "size", "crc", "h", *(["row"] if carry else []), "f", F.floor(F.col("f") * ranges).alias("b"))
    ranked = cut(ranked)
    spans = ranked.groupBy("b").count()
    spans = spans.select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("f", "h", "doc_id", "crc", "size"))
    placed = ranked.withColumn("place", place).join(spans, "b").withColumn("pos", F.col("before") + F.col("place") - 1)
    placed = placed.withColumn("shard", F.expr(f"(pos * {shards}L) div {max(total, 1)}L"))
    return placed.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"pos - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
