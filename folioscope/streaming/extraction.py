"""Extraction as chapters arrive: a stream over an append-only chapter table, idempotent batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.extraction import check_resume, drop_repeats, fake_extract
from folioscope.operators.ingest import narrative
from folioscope.schemas import CHAPTERS


def extract_stream(spark: SparkSession, chapters_path: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = fake_extract, identity: str = "fake", files_per_batch: int = 16) -> StreamingQuery:
    """Extracts what chapters_path has gained since the last run, and stops; run it again to go on.

    Each batch writes its facts to a folder of its own, which a repeated batch replaces, and then, last, the
    chapters it has done, with the extractor's identity. A crash in between repeats the batch and doubles
    nothing. Chapters too short for a story are done without facts, and counted. Going on with another
    extractor is refused. Order within the stream plays no part: resolution is a later step over all facts.
    """
    recorded = done_identity(spark, out)
    check_resume(recorded, identity, 1 if recorded else 0)

    def batch(rows: DataFrame, number: int) -> None:
        rows = narrative(rows).persist()
        try:
            facts = drop_repeats(extract(rows.where("not skipped").drop("n_words", "skipped")))
            facts.write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
            done = rows.select("book_id", "index", "skipped", F.lit(identity).alias("provider"))
            done.write.mode("overwrite").parquet(f"{out}/done/batch={number}")
        finally:
            rows.unpersist()

    source = spark.readStream.schema(CHAPTERS).option("maxFilesPerTrigger", files_per_batch).parquet(chapters_path)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def done_chapters(spark: SparkSession, out: str) -> DataFrame:
    """(book_id, index, skipped, provider, batch) of the chapters that batches have finished."""
    if not _exists(spark, f"{out}/done"):
        return spark.createDataFrame([], "book_id string, index int, skipped boolean, provider string, batch int")
    return spark.read.parquet(f"{out}/done")


def done_identity(spark: SparkSession, out: str) -> str | None:
    row = done_chapters(spark, out).agg(F.max("provider")).first()
    return row[0]


def extracted_facts(spark: SparkSession, out: str) -> DataFrame:
    """Facts of finished batches; a batch without its mark counts for nothing."""
    batches = done_chapters(spark, out).select("batch").distinct()
    return spark.read.parquet(f"{out}/facts").join(batches, "batch", "left_semi").where("not repeated").drop("repeated", "batch")


def progress(spark: SparkSession, out: str, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_count, done, skipped)"""
    seen = done_chapters(spark, out).groupBy("book_id").agg(F.count("*").alias("done"), F.count_if("skipped").alias("skipped"))
    return chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count")).join(seen, "book_id", "left").na.fill(0)


def eta_seconds(elapsed: float, processed: int, remaining: int) -> float | None:
    """What remains at the pace so far; of a resumed run only what it has processed itself counts."""
    return elapsed / processed * remaining if processed else None


def format_duration(seconds: float) -> str:
    minutes, seconds = divmod(round(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes:02d}m" if hours else f"{minutes}m {seconds:02d}s" if minutes else f"{seconds}s"
