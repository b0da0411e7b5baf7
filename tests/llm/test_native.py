"""Exact dedup, sharding, URL judgement and mixing, against plain loops and on awkward rows."""

import hashlib
import math
import random
import re
import warnings
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import joins
from folioscope.llm import exact, mixing, shard, urls
from folioscope.llm.exact import exact_duplicates
from folioscope.llm.mixing import Targets, mix, probabilities, rake, target_shares
from folioscope.llm.shard import stratified_shards
from folioscope.llm.urls import RULES, host_reputation, judge_urls

LONG = "é" * 70_000
ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (6, "x" * 300 + "1"), (7, "x" * 300 + "2"), (8, "x" * 300 + "1"), (9, LONG), (10, LONG), (3, "a"), (11, "ab"), (12, "only")]


@pytest.mark.parametrize(("bound", "filter_rows", "hot"), [(300_000, 1 << 20, 20_000), (3, 1 << 20, 1), (2, 1, 20_000)])  # few: groups are joined by a shuffle, every length passes the filter
@pytest.mark.parametrize("digest", [True, False])
def test_exact_duplicates(spark, monkeypatch, bound, filter_rows, hot, digest):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(exact, "FILTER_ROWS", filter_rows)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, len int")
    found = exact_duplicates(docs, digest=digest)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    keep = {t: max(i for i in ids if i is not None) for t, ids in groups.items()}
    wanted = Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""]) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()) == wanted
    shas = {r.doc_id: r.text_sha256 for r in found.collect()}
    assert shas[9] == hashlib.sha256(LONG.encode()).hexdigest() and (filter_rows == 1 or (shas[11] is not None) == digest)
    assert exact_duplicates(docs.limit(0)).collect() == []


def check_shards(rows, found, shards):
    n = len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n and {r.law for r in found} <= {"rows"}


@pytest.mark.parametrize(("n", "window"), [(1000, 20_000), (1003, 2), (3, 20_000)])
def test_shards_match_the_mixture(spark, monkeypatch, n, window):
    monkeypatch.setattr(shard, "WINDOW_ROWS", window)
    rng = random.Random(n)
    rows = [(k if k % 50 else None, rng.choice(["t", "u", None, "é"]) if k % 3 else f"t{k}", rng.choice(["a", "a", "a", "b", "c", None])) for k in range(n)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, shard int")
    found = stratified_shards(docs, carry=("source",)).collect()
    check_shards(rows, found, 8)
    counts, totals = Counter((r.shard, r.row.source) for r in found), Counter(s for *_, s in rows)
    assert all(abs(counts[k, s] - totals[s] / 8) <= 2 for k in range(8) for s in totals)
    assert {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in stratified_shards(docs.repartition(7)).collect() if r.doc_id is not None} == {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in found if r.doc_id is not None}
    assert stratified_shards(docs.limit(0)).collect() == []


def test_shards_by_brute_force(spark):
    """The order is that of the fractional ranks of a seeded shuffle."""
    rng = random.Random(3)
    rows = [(k, f"t{k}", rng.choice("aaabbc")) for k in range(700)] + [(k, f"t{k}", f"only{k}") for k in range(700, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", F.crc32("text")).alias("h"), shard.offset(F.col("source"), 17).alias("u")).collect()
    by = defaultdict(list)
    for r in hashed:
        by[r.source].append(r)
    order = []
    for own in by.values():
        own.sort(key=lambda r: r.h % 2**64)
        order += [((k + r.u) / len(own), r.h, r.doc_id) for k, r in enumerate(own)]
    order.sort()
    n = len(rows)
    expected = {}
    for pos, (_, _, doc) in enumerate(order):
        k = pos * 8 // n
        expected[doc] = (k, pos - -(-k * n // 8))
    assert {r.doc_id: (r.shard, r.slot) for r in stratified_shards(docs).collect()} == expected


def test_shards_of_sources_with_one_row(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    fractions = docs.select(F.floor(shard.offset(F.col("source"), 17) * 256).alias("b")).groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert fractions[0] < 140 and fractions[1] == 256  # ranges of about 78 rows
    assert stratified_shards(docs).groupBy("shard").count().where("count <> 2500").isEmpty()


def plain_url(url, rules=RULES):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = lambda s, stops: s[: min((s.find(c) for c in stops if c in s), default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), w, h + p) for w, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://A.Example.com/en/7x?q", "x://example.com/en/8#y", "https://com/en/", "http://acom/en/", "http://b.net/de/", "http://example.net/de/81", "ftp://q.org/es/1", "http://q.org/esp", None, "no scheme", "://", "a://É.Org?x/es/", "http://u@h:80/p://q", "http://h.com//en/", "http://bad.example.org/fr/1", "http://new.example.org/fr/2"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.example.org", 1)] * 60 + [("ok.example.org", 0)] * 60 + [("ok.example.com", 0)] * 20 + [("one.example.com", 1), ("x", None)], "host string, bad int")
    found = {r.page_id: r for r in judge_urls(pages, outcomes).collect()}
    assert len(found) == len(URLS) + 1
    for k, u in enumerate([*URLS, URLS[0]]):
        host, path, verdict, rule = plain_url(u)
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == (verdict or ("block" if host == "bad.example.org" else "allow"))
    none = judge_urls(pages, outcomes.limit(0))
    assert all(r.verdict == "allow" for r in none.collect() if r.rule is None) and judge_urls(pages.limit(0), outcomes).collect() == []


def test_verdicts_of_the_contract(spark):
    """Each rule's word as the contract lists it, not as RULES does, beside a host that is bad by its outcomes."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: w for w, h, p in RULES} == contract
    outcomes = spark.createDataFrame([(h, 1) for h in ("com", "a.net", "example.com") for _ in range(60)] + [("ok.org", 0)] * 60, "host string, bad int")
    given = ["x://com/en/1", "x://b.com/en/", "x://example.com/en/71", "x://a.net/de/1", "x://net/de/", "x://example.net/de/7", "x://a.example.net/de/88", "x://ok.org/es/"]
    found = judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), outcomes).orderBy("page_id").collect()
    assert [r.verdict for r in found] == [contract[r.rule] for r in found] == ["block", "block", "allow", "allow", "allow", "allow", "block", "block"]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_urls_of_more_hosts_than_a_broadcast_takes(spark, monkeypatch, hot):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*URLS, *URLS[-2:] * 5])], "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.example.org", 1)] * 60 + [("ok.example.org", 0)] * 60 + [(f"h{k}.com", k % 2) for k in range(9)], "host string, bad int")
    expected = sorted(map(tuple, judge_urls(pages, outcomes).collect()), key=str)
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    assert sorted(map(tuple, judge_urls(pages, outcomes).collect()), key=str) == expected


def test_host_levels(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "shop.co.uk": ("shop.co.uk", "co.uk"), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u:p@h.example.com:80": ("example.com", "com"), "10.1.2.3:99": ("10.1.2.3", "ip"), "[::1]:80": ("[::1]", "ip"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.com.": ("a.com", "com")}
    rows = urls._levels(spark.createDataFrame([(h,) for h in hosts], "host string"), urls.SUFFIXES).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == hosts


def test_outcomes_of_labels_without_a_value(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.com/en/{k}", None) for k in range(5)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (2, 0, None), (3, 0, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.page_outcomes(pages, labels).collect())) == [("h0.com", 0), ("h3.com", 1), ("h3.com", 1)]


def test_shrinkage(spark):
    """More outcomes move a host further from its domain's rate."""
    rows = [(f"h{k}.a.com", int(j < 6 + k)) for k in range(9) for j in range(20)] + [("few.a.com", 1)] * 2 + [("more.a.com", 1)] * 20
    bounds, strengths = host_reputation(spark.createDataFrame(rows, "host string, bad int"), z=0.0)
    found = {r.host: r.bound for r in bounds.collect()}
    assert 0.5 < found["few.a.com"] < found["more.a.com"] < 1 and 6 / 20 < found["h0.a.com"] < found["h8.a.com"] < 14 / 20
    assert abs(strengths[""] - strengths["rate"]) < 1e-12


def test_raking_meets_the_targets():
    rng = np.random.default_rng(1)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    counts = rng.integers(1, 500, len(codes)).astype(float)
    targets = [rng.dirichlet(np.ones(k)) for k in (4, 3, 2)]
    weights = rake(counts, codes, targets)
    for d, target in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], weights=weights), target, atol=1e-6)
    for budget in (0.1, 0.6, 0.99):
        p = probabilities(counts, weights, budget)
        assert (p <= 1 + 1e-12).all() and math.isclose((p * counts).sum(), budget * counts.sum(), rel_tol=1e-9)
        part = p < 1 - 1e-9
        if part.sum() > 1:
            assert np.ptp((p * counts / weights)[part]) < 1e-6 * (p * counts / weights)[part].mean()
    assert target_shares({"a": 10, "b": 30, "c": 0}, {"a": 0.4, "z": 0.3}, 1.0) == {"a": 0.4, "b": 0.6}


@pytest.mark.parametrize("cells", [200_000, 0])  # 0: raked as a table
def test_mixture(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    rng = random.Random(5)
    rows = [(k, " ".join(["word"] * rng.randint(1, 60)), rng.choice("aaaab"), rng.choice(["en", "en", "de"]), 1) for k in range(4000)]
    rows += [(None, "x y", None, None, 1), (5000, None, "a", "en", 1), (5001, "", "b", None, 1), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int")
    targets = Targets({"source": {"a": 0.6, "b": 0.4}, "lang": {"de": 0.5}}, {}, 0.4)
    found = mix(docs, targets).collect()
    assert len(found) == len(rows) and len({(r.chance, r.kept) for r in found if r.doc_id == 7}) == 1
    assert all(r.kept and r.chance == 1 for r in found if r.tokens == 0)
    total, share = sum(r.tokens for r in found), lambda f: sum(r.tokens for r in found if r.kept and f(r)) / sum(r.tokens for r in found if r.kept)
    assert abs(sum(r.chance * r.tokens for r in found) / total - 0.4) < 1e-3
    assert abs(share(lambda r: r.source == "b") - 0.4) < 0.05 and abs(share(lambda r: r.lang == "de") - 0.5) < 0.05
    assert abs(sum(r.tokens for r in found if r.kept) / total - 0.4) < 0.03
    assert mix(docs.limit(0), targets).collect() == []


def test_both_rakings_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = docs.select(F.col("source"), "lang", mixing.topic(mixing.fit_topics(docs)).alias("topic"), mixing.tokens().alias("tokens")).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    a, b = ({(r.source, r.lang, r.topic): r.chance for r in f(cells, mixing.PRODUCTION).collect()} for f in (mixing._driver_cells, mixing._table_cells))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 0.02
    assert urls.OP7_SQL


@pytest.mark.parametrize("cells", [200_000, 0])  # 0: raked as a table
@pytest.mark.parametrize("listed", [("en", "de", "fr", "es"), ("en", "de", "fr")])
def test_unlisted_and_null_languages_keep_their_part(spark, monkeypatch, cells, listed):
    """Under the targets of production, whether or not all the listed languages occur."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    langs = [*listed, None, "it"]
    rows = [(k, "some words to be weighed here", "ab"[k // len(langs) % 2], langs[k % len(langs)]) for k in range(200 * len(langs))]
    targets = replace(mixing.PRODUCTION, budget=0.3)  # low enough that no cell is kept whole
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), targets).collect()
    assert all(0.1 < r.chance < 1 for r in found) and {r.lang for r in found if r.kept} == {*listed, "", "it"}
    expected = Counter()
    for r in found:
        expected[r.lang] += r.chance * r.tokens
    for lang in ("", "it"):
        assert math.isclose(expected[lang], sum(expected.values()) / len(langs), rel_tol=1e-3)
    shares = target_shares({"en": 50, "de": 20, "": 20, "it": 10}, mixing.PRODUCTION.shares["lang"], 1.0)
    assert math.isclose(shares[""], 0.2) and math.isclose(shares["it"], 0.1) and math.isclose(shares["en"] / shares["de"], 0.55 / 0.17) and math.isclose(sum(shares.values()), 1)


def sparse_cells(sources, rest):
    """Sources that are each mostly in one language, as hosts are; `rest` bounds a cell of another language."""
    rng, cells = np.random.default_rng(7), []
    for s in range(sources):
        main = rng.choice(4, p=[0.5, 0.2, 0.2, 0.1])
        for lang in {int(main), int(rng.integers(4))}:
            for topic in rng.choice(6, 2, replace=False):
                cells.append((f"s{s}", ("en", "de", "fr", "es")[lang], f"t{topic}", int(rng.integers(200, 3000) if lang == main else rng.integers(*rest))))
    return cells


@pytest.mark.parametrize(("rest", "met"), [((300, 1500), True), ((1, 20), False)])
def test_both_rakings_agree_on_sparse_cells(spark, rest, met):
    cells = spark.createDataFrame(sparse_cells(2000, rest), "source string, lang string, topic string, tokens long")
    chances, told = [], []
    for f in (mixing._driver_cells, mixing._table_cells):
        with warnings.catch_warnings(record=True) as caught:
            warnings.simplefilter("always")
            chances.append({(r.source, r.lang, r.topic): r.chance for r in f(cells, mixing.PRODUCTION).collect()})
        told.append(any("off its target" in str(w.message) for w in caught))
    a, b = chances
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert told == [not met] * 2


def test_topics_by_brute_force(spark):
    rng = random.Random(11)
    lists = [[f"{chr(97 + t)}{''.join(rng.choices('bcdfgh', k=5))}" for _ in range(40)] for t in range(3)]
    rows = [(k, " ".join(rng.choices(lists[k % 3], k=rng.randint(20, 200)))) for k in range(300)] + [(400, None), (401, ""), (402, "12 ."), (403, "\u00c9t\u00e9 b"), (404, "\u00e9t\u00e9 B b"), (None, "x"), (5, "again"), (405, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = mixing.fit_topics(docs, rows=200)
    assert weights.shape == (mixing.TOPICS, mixing.DIMS) and (weights == mixing.fit_topics(docs.repartition(7), rows=200)).all()
    found = [r.topic for r in docs.coalesce(1).select(mixing.topic(weights).alias("topic")).collect()]
    of = lambda text: sorted(set(re.findall(r"[^\W\d_]+", (text or "").lower())))
    words = sorted({w for _, t in rows for w in of(t)})
    classes = {r.w: r.c for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.hash("w"), F.lit(mixing.DIMS)).alias("c")).collect()}
    for topic, (_, text) in zip(found, rows, strict=True):
        counts = np.bincount([classes[w] for w in of(text)], minlength=mixing.DIMS)
        if not of(text):
            assert topic == "none"
        else:
            scores = weights @ counts
            assert scores[int(topic[1:])] >= scores.max() - 1e-9
    majority = [Counter(found[k] for k in range(300) if k % 3 == t).most_common(1)[0] for t in range(3)]
    assert len({m[0] for m in majority}) == 3 and min(m[1] for m in majority) > 60  # six topics for three: one is split
    assert not len(mixing.fit_topics(docs.limit(0))) and docs.limit(3).select(mixing.topic(mixing.fit_topics(docs.limit(0)))).distinct().collect()[0][0] == "none"


def k_means(counts, seed=31, rounds=30):
    """Spherical k-means on class shares, around their mean, by a plain loop."""
    shares = [np.array(c) / sum(c) for c in counts if sum(c)]
    mean = sum(shares) / len(shares)
    points = np.array([(s - mean) / max(np.linalg.norm(s - mean), 1e-12) for s in shares])
    centers = np.random.default_rng(seed).normal(size=(mixing.TOPICS, mixing.DIMS))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    for _ in range(rounds):
        own = (points @ centers.T).argmax(axis=1)
        sums = [points[own == t].sum(axis=0) for t in range(mixing.TOPICS)]
        centers = np.array([s / np.linalg.norm(s) if np.linalg.norm(s) > 1e-9 else c for s, c in zip(sums, centers, strict=True)])
    return centers - (centers @ mean)[:, None]


def test_topics_are_fitted_on_every_row(spark):
    """Also on rows without an id and on repeated ones, in any order."""
    rng = random.Random(13)
    rows = [(k if k % 5 else None, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 12)))) for k in range(6500)] + [(9, "a b c")] * 50 + [(10, None), (11, "1 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = mixing.fit_topics(docs)
    wanted = k_means([r.n for r in docs.select(mixing.word_classes().alias("n")).collect()])
    assert np.abs(weights - wanted).max() < 1e-6
    assert (weights == mixing.fit_topics(docs.repartition(9).sortWithinPartitions("text"))).all()
    ours = {r.text: r.topic for r in docs.select("text", mixing.topic(weights).alias("topic")).collect()}
    found = mix(docs.selectExpr("doc_id", "text", "'s' as source", "'en' as lang"), carry=("text",)).collect()
    assert len(found) == len(rows) and all(r.topic == ours[r.row.text] for r in found) and len(set(ours.values())) == mixing.TOPICS + 1


def test_topics_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, t) for _, t in ROWS * 3], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert all((r.topic == "none") == (not r.tokens) for r in mix(docs).collect())


def test_topic_is_of_the_whole_text(spark):
    """One word in front moves few of the texts, also where all begin with the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 500")
    weights = mixing.fit_topics(docs)
    found = docs.select(mixing.topic(weights).alias("a"), F.concat(F.lit("Same "), "text").alias("text")).select("a", mixing.topic(weights).alias("b"))
    assert found.agg(F.avg((F.col("a") != F.col("b")).cast("int"))).first()[0] < 0.1 and found.select("b").distinct().count() == mixing.TOPICS


def test_token_estimate(spark):
    """Against the encoder, on documents that it wasn't fitted on."""
    from folioscope.llm.tokens import section_tokens

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("real"))
    both = docs.select("doc_id", "lang", mixing.tokens().alias("guess")).join(real, "doc_id")
    assert both.agg(F.sum(F.abs(F.col("real") - F.col("guess"))) / F.sum("real")).first()[0] < 0.05
    by = both.groupBy("lang").agg(F.sum("real").alias("real"), F.sum("guess").alias("guess")).collect()
    assert all(abs(r.guess / r.real - 1) < 0.06 for r in by)
    edge = spark.createDataFrame([(None,), ("",), (" \n",), ("a",), ("\u00e9",)], "text string").coalesce(1).select(mixing.tokens()).collect()
    assert [r[0] for r in edge] == [0, 0, 0, 1, 1]


def test_mixture_by_brute_force(spark):
    """Chances from a plain fitting over the rows, draws from their hashes."""
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit"], k=rng.randint(1, 60))), rng.choice("aaaab"), rng.choice(["en", "en", "de", None])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = Targets({"source": {"a": 0.6, "b": 0.4}, "lang": {"de": 0.3}}, {"topic": 0.5}, 0.4)
    found = mix(docs, targets).collect()
    weight = defaultdict(float)
    for r in found:
        weight[r.source, r.lang, r.topic] += r.tokens
    total = sum(weight.values())
    held = dict(weight)
    goals = []
    for d, (fixed, temper) in enumerate((({"a": 0.6, "b": 0.4}, 1), ({"de": 0.3}, 1), ({}, 0.5))):
        own = defaultdict(float)
        for cell, w in held.items():
            own[cell[d]] += w
        free = {v: w**temper for v, w in own.items() if v not in fixed}
        goals.append({v: fixed[v] if v in fixed else (1 - sum(fixed.values())) * free[v] / sum(free.values()) for v in own})
    weight = {c: w / total for c, w in weight.items()}
    for _ in range(300):
        for d, goal in enumerate(goals):
            have = defaultdict(float)
            for c, w in weight.items():
                have[c[d]] += w
            weight = {c: w * goal[c[d]] / have[c[d]] for c, w in weight.items()}
    low, high = 0.0, 1e9  # the scale at which the expected tokens are the budget
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (scale, high) if sum(min(1.0, scale * weight[c] / held[c]) * held[c] for c in weight) < 0.4 * total else (low, scale)
    draws = {r.doc_id: (r.h % 2**64 >> 11) / 2**53 for r in docs.select("doc_id", F.xxhash64(F.lit(23), "doc_id", "text").alias("h")).collect()}
    for r in found:
        chance = min(1.0, scale * weight[r.source, r.lang, r.topic] / held[r.source, r.lang, r.topic])
        assert abs(r.chance - chance) < 1e-6 and r.kept == (draws[r.doc_id] < r.chance)
