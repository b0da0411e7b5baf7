"""The corpus pipeline: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all the documents that the one before kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import bounded, cut, document_key
from folioscope.llm.decontaminate import without_passages
from folioscope.llm.minhash import near_classes
from folioscope.llm.mixing import mix
from folioscope.llm.quality import fit_table, grade, select_documents
from folioscope.llm.shard import stratified_shards

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled ones among them."""
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", grade().alias("grade"))
    return select_documents(docs, fit_table(docs, ratings, 3), keep_at=2)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, once; one without an id only if its class has none."""
    gone = near_classes(docs).where("node <> class").select("node").distinct()
    docs = docs.select(document_key().alias("node"), *COLUMNS)
    kept = docs.join(bounded(gone, BROADCAST_IDS), "node", "left_anti")
    repeated = cut(docs.groupBy("node").count().where("count > 1").select("node"))
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    repeated = bounded(repeated, BROADCAST_IDS)
    return kept.join(repeated, "node", "left_anti").unionByName(kept.join(repeated, "node", "left_semi").dropDuplicates(["node"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights."""
    return mix(docs, carry=COLUMNS).where("kept").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot in it."""
    return stratified_shards(docs)


STAGES = [("quality classifier", classify), ("MinHash near-dedup", dedup), ("benchmark decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]
#: Trained weights, sketches and alignments are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
