import hashlib
import random
import re

import numpy as np
import pytest

from folioscope.functions import joins
from folioscope.llm import substrings
from folioscope.llm.substrings import common_prefixes, deep_nodes, doubled_ranks, later_places, op6, remove_repeats


def brute(rows, window):
    """rows: (doc_id, text), no doc_id twice -> {doc_id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k} é" if k % 7 == 0 else f"W{k}" for k in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(4)]
    rows = []
    for doc in range(n):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 30))]]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a:], [rng.choice(words) for _ in range(rng.randint(0, 5))]]
        rows.append((doc, "\t\n "[rng.randint(0, 2)].join(x for p in parts for x in p)))
    rows += [(n + 1, rows[5][1]), (n + 2, rows[5][1] + " "), (n + 3, ""), (n + 4, None), (n + 5, " ".join(["same"] * 300)), (None, rows[7][1]), (n + 6, " ".join(passages[0] * 30))]
    # repeats within one run of windows, of every period and just long enough
    rows += [(n + 10 + 40 * p + k, f"a{p}{k} b{k} " + " ".join(f"q{p}{k}{j % p}" for j in range(20 + k)) + f" c{k}") for p in range(1, 7) for k in range(0, 16, 3)]
    return rows


@pytest.mark.parametrize(("seed", "places", "windows", "hot"), [(1, 2_000, 1_000, 20_000), (2, 3, 7, 1), (3, 1, 1_000, 20_000)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, places, windows, hot):
    monkeypatch.setattr(substrings, "GROUP_PLACES", places)  # 1 and 3: nearly all groups are split by longer prefixes
    monkeypatch.setattr(substrings, "SEGMENT_WINDOWS", windows)
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, starts string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6(spark, str(tmp_path)).collect()}
    assert found == brute(rows, 20)
    assert sum(r[1] for r in found.values()) > 500


def test_common_prefixes_are_those_of_the_suffixes():
    rng = random.Random(2)
    for n in (1, 2, 40, 200):
        row = np.array([rng.randint(0, 2) for _ in range(n)] + [9])
        ranks = doubled_ranks(row, n)
        assert sorted(range(n + 1), key=lambda k: row[k:].tolist()) == np.argsort(ranks[-1]).tolist()
        a, b = np.array([(rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(300)]).T
        a, b = a[a != b], b[a != b]
        length = lambda x, y: next((k for k, (p, q) in enumerate(zip(row[x:], row[y:], strict=False)) if p != q), n + 1 - max(x, y))
        assert common_prefixes(ranks, a, b).tolist() == [length(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_deep_nodes_are_maximal_repeats():
    """Each node's suffixes are all that begin with its words, and it is as deep as they agree."""
    rng, window = random.Random(8), 4
    rows = [(doc, 0, 10 * doc, [rng.choice("ab") for _ in range(rng.randint(4, 30))]) for doc in range(12)]
    rows += [(20, 0, 5, list("abababab")), (21, 0, 0, rows[0][3])]
    places, node, depth = deep_nodes(rows, window)
    suffixes = {(d, t, s + k): tuple(w[k:]) for d, t, s, w in rows for k in range(len(w) - window + 1)}
    assert len(places) == len(suffixes)
    groups = {}
    for p, n in zip(map(tuple, places.tolist()), node.tolist(), strict=True):
        groups.setdefault(n, []).append(suffixes[p])
    starts = {}
    for p, suffix in suffixes.items():
        starts.setdefault(suffix[:window], []).append(suffix)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, starts.values()))
    for n, own in groups.items():
        if len(own) > 1:
            agree = next((k for k, column in enumerate(zip(*own, strict=False)) if len(set(column)) > 1), min(map(len, own)))
            assert depth[n] == agree >= window
    gone = {(d, t, s + k) for d, t, s, n in later_places(places, node).tolist() for k in range(n)}
    firsts = {}
    for p in sorted(suffixes):
        firsts.setdefault(suffixes[p][:window], p)
    assert gone == {p for p, x in suffixes.items() if firsts[x[:window]] != p}


def test_a_line_many_times_within_and_across_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_PLACES", 50)
    line = " ".join(f"line{k}" for k in range(25))
    rows = [(k, "\n".join([f"own{k}"] + [f"{line} {'x' * (j % 3)}" for j in range(20)])) for k in range(30)] + [(99, "word " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6(spark, str(tmp_path)).collect()}
    assert found == brute(rows, 20)


def test_repeated_rows_are_one_document_and_empty_tables_pass(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    spark.createDataFrame([(1, text), (1, text), (2, "a b " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n_removed) for r in op6(spark, str(tmp_path)).collect()) == [(1, 0), (1, 0), (2, 40)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    scan, changed = remove_repeats(empty)
    assert scan.count() == 0 and changed.count() == 0
