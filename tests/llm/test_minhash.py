import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions import joins
from folioscope.llm import minhash
from folioscope.llm.common import labelled_shingles
from folioscope.llm.minhash import aligned, link_group, near_duplicates, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.permutations(range(12)), st.permutations(range(12)), st.integers(0, 12), st.integers(0, 12))
def test_alignment_is_the_longest_common_subsequence(a, b, na, nb):
    a, b = np.array(a[:na], dtype=np.uint64), np.array(b[:nb], dtype=np.uint64)
    assert aligned(a, b, 100) == lcs(a.tolist(), b.tolist())
    common = len(set(a.tolist()) & set(b.tolist()))
    if na + nb:
        wanted = common / (na + nb - common) >= 0.8 and lcs(a.tolist(), b.tolist()) >= 0.8 * common
        assert similar(a, b, common, 0.8) == wanted


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        up[b] = a
    return {n: top(n) for n in nodes}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).capitalize())
    return out


def distinct(text):
    shingles, new = labelled_shingles(text)
    return shingles[new]


def brute(rows):
    docs = {d: distinct(t).tolist() for d, t in rows}
    sets = {d: set(s) for d, s in docs.items()}
    same = {d: re.findall(r"\w+", (t or "").lower()) for d, t in rows}
    edges = []
    for a in docs:
        for b in docs:
            if a < b:
                common = len(sets[a] & sets[b])
                near = common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) and lcs(docs[a], docs[b]) >= 0.8 * common
                if near or same[a] == same[b]:
                    edges.append((a, b))
    return components(docs, edges)


@pytest.mark.parametrize(("block", "star", "bound", "hot"), [(500, 2, 300_000, 20_000), (300_000, 2_000, 3, 2)])  # many blocks and parts; shuffles with hot keys
def test_against_brute_force(spark, monkeypatch, block, star, bound, hot):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(minhash, "STAR_ROWS", star)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = list(enumerate(texts(3)))
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "two words"), (904, "two  WORDS!"), (905, "x " * 20_000), (906, "x " * 19_999), (907, rows[3][1] + (" " + rows[3][1][:40]) * 9), (908, " ".join(reversed(rows[4][1].split())))]
    again = (900, rows[0][1], "z")
    random.Random(1).shuffle(rows)
    nulls = [(None, "two words", "z"), (None, rows[2][1] + " more", "z"), (None, "by itself it stands", "z"), (None, "by itself it stands", "z")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows] + [*nulls, again], "doc_id long, text string, keys string")
    found = near_duplicates(docs).collect()
    expected = brute(rows)
    assert Counter(r.doc_id for r in found)[None] == 4 and len(found) == len(rows) + 5
    assert Counter((r.class_id, r.kept) for r in found if r.doc_id is None) == {(expected[903], False): 1, (expected[rows[2][0]], False): 1, (None, True): 2}
    got = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert got == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in found if r.doc_id is not None)
    assert 20 < len(set(got.values())) < len(got)


def test_links_that_the_stars_miss(spark):
    """The first document of the bucket is like no other; the others are like their neighbours only."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(40)]
    rows = [(0, " ".join(shared + [f"a{rng.random()}" for _ in range(60)]))]
    for chain in range(4):
        text = [f"c{chain}x{k}" for k in range(200)] + shared
        for k in range(8):
            text = [w if j % 50 != 7 * k % 50 or j > 190 else f"n{chain}x{k}x{j}" for j, w in enumerate(text)]
            rows.append((1 + 10 * chain + k, " ".join(text)))
    found = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and 4 < len(set(found.values())) < len(rows)


def test_groups_are_linked_as_brute_force_links_them():
    rows = list(enumerate(texts(7)))
    docs = [distinct(t) for _, t in rows]
    expected = brute(rows)
    assert components(range(len(rows)), link_group([d for d, _ in rows], docs, 0.8)) == expected
    known = [expected[d] if d % 3 else 1000 + d for d, _ in rows]  # some connected already
    ties = [(a, b) for a, _ in rows for b, _ in rows if known[a] == known[b]]
    assert components(range(len(rows)), ties + link_group([d for d, _ in rows], docs, 0.8, known)) == expected


def test_rows_of_one_id_share_a_class_and_empty_tables_pass(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()} == {(1, 1), (5, 1), (7, 1)}
    assert near_duplicates(docs.limit(0)).collect() == []
