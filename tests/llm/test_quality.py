import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

from folioscope.llm.quality import BUCKETS, SHARE, features, fit, fit_table, grade, op1, rate, select_documents


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        if g == 0:
            text = [t + "&&&" for t in text]
        if g == 1:
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty"]))
        texts.append(" ".join(text))
        grades.append(g)
    return texts, np.array(grades)


def test_held_out_grades_and_order_of_thresholds():
    texts, grades = made(1, 1500)
    model = fit([features(t) for t in texts], grades, 3)
    assert model.thresholds[0] < model.thresholds[1] and (model.weights < 0).any() and (model.weights > 0).any()
    texts, grades = made(2, 600)
    tails = model.tails(texts)
    assert (tails[:, 0] >= tails[:, 1]).all()
    kept = tails[:, 1] >= 0.75
    assert kept[grades == 2].mean() > 0.99 and kept[grades == 1].mean() < 0.05 and kept[grades == 0].mean() < 0.01


def test_ratings_of_one_grade_alone():
    for only in (0, 1, 2):
        model = fit([features("some words here")] * 30, np.full(30, only), 3)
        assert np.isfinite(model.thresholds).all() and model.thresholds[0] < model.thresholds[1]
        assert (np.round(model.tails(["some words here"]))[0] == [only > 0, only > 1]).all()


def test_gradient_reaches_the_likelihood_of_a_plain_search():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 400)
    grades = np.where(rng.random(400) < 0.2 + 0.5 * x, 0, np.where(rng.random(400) < 0.5, 1, 2))
    none = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16)
    model = fit([(np.array([7], dtype=np.int32), np.array([5], dtype=np.int16)) if v else none for v in x], grades, 3, rounds=2000, l2=0.0)

    def loss(w, a, b):
        tail = lambda c: 1 / (1 + np.exp(c - w * x))
        p = np.select([grades == 0, grades == 1], [1 - tail(a), tail(a) - tail(b)], tail(b))
        return -np.log(np.maximum(p, 1e-12)).mean()

    at = (float(model.weights[7]), *model.thresholds)
    assert all(loss(*at) <= loss(*(np.array(at) + d)) + 1e-6 for d in rng.normal(0, 0.05, (300, 3)))


def test_driver_table_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", grade().alias("grade"))
    model = fit_table(docs, labels.where("doc_id % 2 = 0"), 3)
    rated = rate(docs, model, 2).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("grade", "kept").count().collect()
    share = lambda g: sum(r["count"] for r in rated if r.grade == g and r.kept) / sum(r["count"] for r in rated if r.grade == g)
    assert share(2) > 0.98 and share(1) < 0.15 and share(0) < 0.02


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "good"), (1, None), (2, ""), (3, "x " * 100_000), (3, "vile")], "doc_id long, text string").selectExpr("*", "1 as kept")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = fit_table(docs, none, 3)
    assert [round(r.tail, 2) for r in rate(docs, model, 2).orderBy("doc_id").collect()] == [0.5, 0, 0, 0.5, 0.5]
    some = spark.createDataFrame([(3, 2), (None, 1), (2, None), (99, 0)], "doc_id long, grade int")
    model = fit_table(docs, some, 3)
    assert select_documents(docs, model, 2).columns == docs.columns
    assert rate(docs.limit(0), model, 2).collect() == []


def test_unknown_text_is_not_the_best():
    texts, grades = made(3, 800)
    model = fit([features(t) for t in texts], grades, 3)
    good = " ".join(f"w{k}" for k in range(40))
    unknown = ["", "  \n", "zxqv zxqv zxqv", "Καλημέρα κόσμε", "你好 世界", "ω" * 100_000]
    assert model.tails([good])[0, 1] > 0.9 and model.tails(unknown)[:, 1].max() < 0.75
    assert (model.tails(["", " \n\t"]) == 0).all() and np.abs(model.tails(["zz qq " * 50])).max() < 0.1


def test_length_earns_nothing():
    """The same words, more often in another order, have the same tail."""
    texts, grades = made(4, 800)
    model = fit([features(t) for t in texts], grades, 3)
    words = [f"w{k}" for k in range(60)]
    assert np.allclose(model.tails([" ".join(words)]), model.tails([" ".join(words * 50)]))
    assert np.allclose(model.tails([" ".join([*words, "vile"])])[0, 1], model.tails([" ".join([*words, "vile"] * 40)])[0, 1])


def test_scores_are_those_of_the_features():
    texts, grades = made(5, 600)
    rows = [features(t) for t in texts]
    model = fit(rows, grades, 3)
    for text, (buckets, shares) in zip(texts[:50], rows, strict=False):
        weights = model.weights[buckets].astype(float)
        assert abs(model.score(text)[0] - np.where(weights < 0, weights, weights * shares / SHARE).sum()) < 1e-2


def test_null_and_repeated_ratings(spark):
    docs = spark.createDataFrame([(k, f"w{k % 5} x{k}" + (" bad" if k % 3 == 0 else "")) for k in range(300)] + [(0, "another text"), (None, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 0, 0), (5, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.g for r in extra.select(grade().alias("g")).collect()] == [None, None, 0, 1, 2]
    ratings = labels.select("doc_id", grade().alias("grade"))
    a = fit_table(docs, ratings.where("doc_id <> 5").union(spark.createDataFrame([(5, 1)], "doc_id long, grade int")), 3)
    b = fit_table(docs.repartition(7), ratings.union(extra.select("doc_id", grade().alias("grade"))).repartition(5), 3)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all() and (a.weights < 0).any()
    few = fit_table(docs, ratings, 3, fit_rows=20)
    assert few.seen.sum() < a.seen.sum() or (few.seen != a.seen).any()


def test_driver_holds_no_more_than_the_model(spark):
    """Whatever is rated is fitted on in a worker, with the weights that the driver would find."""
    texts, grades = made(6, 600)
    docs = spark.createDataFrame([(k, t, int(g)) for k, (t, g) in enumerate(zip(texts, grades, strict=True))], "doc_id long, text string, grade int")
    tracemalloc.start()
    try:
        model = fit_table(docs, docs.select("doc_id", "grade"), 3)
        assert tracemalloc.get_traced_memory()[1] < 4 * BUCKETS + (8 << 20)
    finally:
        tracemalloc.stop()
    here = fit([features(t) for t in texts], grades, 3)
    assert np.abs(model.weights - here.weights).max() < 1e-4 and (model.weights != 0).any() and (model.seen == here.seen).all()
    assert np.abs(model.thresholds - here.thresholds).max() < 1e-4


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    rows = op1(spark, f"/root/testdata/{sf}").collect()
    assert sorted(r.doc_id for r in rows) == sorted(pq.read_table(f"/root/testdata/{sf}/documents.parquet").column("doc_id").to_pylist())
