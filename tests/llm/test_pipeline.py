"""The stages, each on its own input and against a brute-force version."""

import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_decontaminate import brute as best_similarity
from test_minhash import brute as classes_of
from test_native import check_shards

import corpus_pipeline
from folioscope.llm import mixing
from folioscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) rows of each stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((given, docs.collect()))
        assert k == len(corpus_pipeline.STAGES) - 1 or set(docs.columns) == set(corpus_pipeline.COLUMNS)
    return out


def ids(rows):
    return [r.doc_id for r in rows]


def test_stages_are_those_asked_for():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["classify", "dedup", "decontaminate", "mix_sources", "shard"]


def test_every_stage_keeps_whole_rows(stages):
    for given, kept in stages[:-1]:
        rows = Counter(map(tuple, ([getattr(r, c) for c in corpus_pipeline.COLUMNS] for r in given)))
        assert not Counter(tuple(getattr(r, c) for c in corpus_pipeline.COLUMNS) for r in kept) - rows


def test_classifier_rejects_junk_and_keeps_clean(spark):
    """On the larger tables: a hundred labels are too few to learn from."""
    large = SF.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, large).select("doc_id", "text").collect()
    junk = re.compile(r"(\$\$\$|%%%|###|&&&|\*\*\*) |!! | \| ")
    marked = {r.doc_id for r in docs.select("doc_id", "text").collect() if junk.search(r.text)}
    assert len(marked & set(ids(kept))) <= 0.02 * len(marked)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    clean = {d for d, x in labels.items() if x == (1, 0)}
    assert len(clean & set(ids(kept))) > 0.99 * len(clean)


def test_one_of_each_class_stays(stages):
    given, kept = stages[1]
    assert sorted(ids(kept)) == sorted(set(classes_of([(r.doc_id, r.text) for r in given]).values()))


def test_no_benchmark_passage_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given, kept = stages[2]
    hit = {r.doc_id for r in given if any(t.split()[0].lower() in r.text.lower() and best_similarity(r.text, t) >= 0.8 for t in items)}
    assert set(ids(kept)) == set(ids(given)) - hit and hit


def test_mixing_fits_topics_on_all_documents(spark, monkeypatch):
    docs = spark.range(5400).selectExpr("id as doc_id", "concat_ws(' ', split(hex(xxhash64(id)), '')) as text", "'en' as lang", "'a' as source", "10L as n_chars")
    fitted, plain = [], mixing.centroid_weights
    monkeypatch.setattr(mixing, "centroid_weights", lambda counts, **more: fitted.append(counts.count() if hasattr(counts, "count") else len(counts)) or plain(counts, **more))
    kept = corpus_pipeline.mix_sources(spark, docs, SF)
    assert fitted == [5400] and kept.columns == list(corpus_pipeline.COLUMNS) and 0.5 < kept.count() / 5400 < 1


def test_shards(stages):
    given, dealt = stages[4]
    check_shards([(r.doc_id, r.text, r.source) for r in given], dealt, 8)


def test_run_is_the_stages_in_a_row(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.shard, r.slot) for r in found.collect()} == {(r.doc_id, r.shard, r.slot) for r in stages[4][1]}


def test_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "good words here", "en", None, 3), (1, "", "en", "a", 0), (2, "x " * 60_000, "de", "a", 1), (2, "x " * 60_000, "de", "a", 1), (3, None, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).count() >= 2
    assert corpus_pipeline.dedup(spark, docs, str(tmp_path)).where("doc_id = 2").count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}{'/*' if os.path.isdir(f'{SF}/{file}') else ''}')")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = lambda f: sorted(tuple(None if x is None or x != x else str(x) for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(ours.columns) == sorted(theirs.columns) and key(ours) == key(theirs)
    assert zlib.crc32(b"") == 0
