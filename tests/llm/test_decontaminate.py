import random
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import decontaminate
from folioscope.llm.decontaminate import RADIUS, ItemIndex, benchmark_passages, fingerprints, without_passages


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(text, item):
    """Best similarity of any item-sized window."""
    words, want = words_of(text), words_of(item)
    size = min(5, len(want))
    if not want or len(words) < size:
        return 0.0
    b, best = shingles(want, size), 0.0
    for i in range(max(1, len(words) - len(want) + 1)):
        a = shingles(words[i : i + len(want)], size)
        best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 70)))) for k in range(40)]
    items += [(98, "same " * 30), (99, items[3][1]), (60, "w1 w2"), (61, "W3, w4 w5 w6"), (62, "zz"), (63, ""), (64, None), (65, "w7 w8 w9 w10 w11")]
    docs = []
    for k in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if k % 2:
            passage = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, 3) if passage else 0):
                passage[rng.randrange(len(passage))] = "zz"
            at = rng.randint(0, len(text))
            text[at:at] = passage
        docs.append((k, " ".join(text).upper() if k % 3 else ", ".join(text)))
    docs += [(200, None), (201, ""), (202, "same " * 2000), (None, items[20][1]), (5, docs[1][1]), (5, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("chunk", [16_000_000, 2_000])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    docs, items = made(4)
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    found = benchmark_passages(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = Counter((d, i, round(s, 9)) for d, t in docs for i, w in items if (s := brute(t, w)) >= 0.8 - 1e-12)
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in found) == expected and len(expected) > 10
    clean = without_passages(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    hit = {(d, t) for d, t in docs for _, w in items if brute(t, w) >= 0.8}
    assert Counter((r.doc_id, r.text) for r in clean) == Counter(d for d in docs if d not in hit)


def test_search_returns_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(3)
    index = ItemIndex([(k, " ".join(map(str, rng.integers(0, 9999, 30)))) for k in range(300)], 0.8)
    for _ in range(40):
        probe = index.prints[rng.integers(300)].copy()
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            probe[bit // 16] ^= 1 << (bit % 16)
        distance = np.bitwise_count(index.prints ^ probe).sum(axis=1)
        assert index.within(probe).tolist() == np.flatnonzero(distance <= RADIUS).tolist()


def test_fingerprints_of_similar_windows_are_near():
    rng = np.random.default_rng(5)
    worst = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 45, dtype=np.uint64)
        b = a.copy()
        b[:5] = rng.integers(0, 2**63, 5, dtype=np.uint64)  # similarity 0.8
        worst = max(worst, int(np.bitwise_count(fingerprints(a[None]) ^ fingerprints(b[None])).sum()))
    assert worst <= RADIUS


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert benchmark_passages(docs, empty).collect() == [] and without_passages(docs, empty).count() == 1
    assert benchmark_passages(docs.limit(0), empty).collect() == []


def test_sql_on_short_items(spark):
    import duckdb
    import pandas as pd

    docs, items = made(9)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    expected = {(r[0], r[1], r[2], r[3], round(r[4], 9)) for r in con.execute(decontaminate.OP3_SQL).fetchall()}
    found = benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in found} == expected and any(r[1] in (60, 61) for r in expected)
