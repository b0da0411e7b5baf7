import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import tokens
from folioscope.llm.tokens import VOCABULARY, attribute, encoder, line_starts, merged, section_tokens, token_spans


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([*"ab \n\t.é漢😀1"]), max_size=60))
def test_tokens_cover_the_text_and_come_back(text):
    starts, ends = token_spans(text)
    encoding = encoder(VOCABULARY)[0]
    ids = encoding.encode_ordinary(text)
    assert len(starts) == len(ids) and encoding.decode(ids) == text
    covered = sorted({c for s, e in zip(starts, ends, strict=True) for c in range(s, e)})
    assert covered == list(range(len(text)))
    assert (starts < ends).all() if len(starts) else True
    sections = line_starts(text)
    assert [text[a:b] for a, b in zip(sections, [*sections[1:], len(text)], strict=True)] == (text.splitlines(keepends=True) if text.isprintable() else [x for x in text.replace("\n", "\n\0").split("\0") if x]) or not text
    counts, _ = attribute(starts, ends, sections, len(text))
    assert counts.sum() == len(ids)


def test_crossing_tokens_go_where_most_of_them_is():
    starts, ends = np.array([0, 3, 9]), np.array([3, 9, 10])
    counts, crossing = attribute(starts, ends, np.array([0, 4, 6]), 10)  # 3..9 holds 1, 2 and 3 characters
    assert counts.tolist() == [1, 0, 2] and crossing.tolist() == [0, 0, 1]
    counts, crossing = attribute(np.array([0]), np.array([4]), np.array([0, 2]), 4)  # equal halves: the earlier
    assert counts.tolist() == [1, 0] and crossing.tolist() == [1, 0]


def test_table(spark):
    docs = spark.createDataFrame([(1, "one two\nthree", "a"), (None, None, "b"), (2, "", "c"), (2, "", "c"), (3, "word " * 40_000, "d")], "doc_id long, text string, start string")
    rows = [tuple(r) for r in section_tokens(docs).orderBy("doc_id", "section").collect()]
    assert rows[0] == (None, 0, 0, 0, 0, 0) and [r[:4] for r in rows[1:3]] == [(1, 0, 0, 8), (1, 1, 8, 13)]
    assert len(rows) == 6 and rows[-1][4] == 40_001
    assert section_tokens(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([*"aeinst '  \n\n\t.,-é漢😀12\x1c\x85\u2009"]), max_size=80))
def test_pieces_merged_here_are_the_encoders(text):
    encoding, ranks, _ = encoder(VOCABULARY)
    ids = encoding.encode_ordinary(text)
    own = [n for m in tokens._PIECES.finditer(text) for n in merged(m[0].encode(), ranks)]
    assert own == [len(encoding.decode_single_token_bytes(i)) for i in ids]


@pytest.mark.parametrize("run", [" ", "\n", "x", "é", "1", "=", " \t", "ab", "the"])
def test_both_sides_of_the_long_run_agree(monkeypatch, run):
    text = "He's " + run * 900 + " end\n\n'll" + run * 700
    whole = tokens.token_ends(text).tolist()
    monkeypatch.setattr(tokens, "LONG_RUN", 8)
    monkeypatch.setattr(tokens, "_LONG", tokens.regex.compile(r"\s{8}|\p{L}{8}|\p{N}{8}|[^\s\p{L}\p{N}]{8}"))
    assert tokens._LONG.search(text) and tokens.token_ends(text).tolist() == whole


@pytest.mark.parametrize("run", [" ", "\n", "x", "q", " \t"])
def test_two_million_of_a_kind(run):
    text, began = "a " + run * (2_000_000 // len(run)) + "z", time.time()
    starts, ends = token_spans(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] == ends[:-1]).all() and time.time() - began < 120


def test_attribution_against_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(["one two\nthree\n\n\nfour  \n five\n", "\n\n \n", "a\n" * 40, "漢字\n\n😀 x\n" * 5, "tail\n    indented\n\n\n\n    more"])]
    expected = Counter()
    encoding = encoder(VOCABULARY)[0]
    for k, text in docs:
        data, at, owner = text.encode(), 0, []
        line_of = [text[:c].count("\n") for c in range(len(text))]
        for token in encoding.encode_ordinary(text):
            end = at + len(encoding.decode_single_token_bytes(token))
            chars = [c for c in range(len(text)) if len(text[:c].encode()) < end and len(text[: c + 1].encode()) > at]
            held = Counter(line_of[c] for c in chars)
            owner.append(min(held, key=lambda s: (-held[s], s)))
            at = end
        assert at == len(data)
        expected.update((k, s) for s in owner)
    found = section_tokens(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.section): r.n_tokens for r in found if r.n_tokens} == dict(expected)
