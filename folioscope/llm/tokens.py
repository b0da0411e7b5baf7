"""Token counts by offset-mapped attribution: whole documents are encoded once, sections get their tokens by span."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import body, prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_PIECES = regex.compile(PATTERN)
#: Runs of one kind of character from this length on are too much for the encoder, which takes quadratic time or
#: a stack frame for each; texts that hold one are cut into pieces and merged here.
LONG_RUN = 4096
_LONG = regex.compile(rf"\s{{{LONG_RUN}}}|\p{{L}}{{{LONG_RUN}}}|\p{{N}}{{{LONG_RUN}}}|[^\s\p{{L}}\p{{N}}]{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """(encoding, rank of each token's bytes, byte length of each token id)"""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, lengths


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte lengths of the piece's tokens: pairs are merged by least rank, the leftmost of equals first.

    By a heap, so n log n in the length. An entry is out of date if its pair has changed since.
    """
    if piece in ranks:
        return [len(piece)]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapify(heap)
    while heap:
        _, k, end = heappop(heap)
        middle = after[k]
        if not alive[k] or middle >= n or after[middle] != end:
            continue
        alive[middle] = 0
        after[k] = end
        if end < n:
            before[end] = k
            if (r := ranks.get(piece[k : after[end]])) is not None:
                heappush(heap, (r, k, after[end]))
        if (left := before[k]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    return [after[k] - k for k in range(n) if alive[k]]


def token_ends(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Ends of the tokens in the text's UTF-8 bytes, in order."""
    encoding, ranks, lengths = encoder(path)
    if len(text) < LONG_RUN or not _LONG.search(text):
        return np.cumsum(lengths[np.asarray(encoding.encode_to_numpy(text), dtype=np.int64)])
    known: dict[str, list[int]] = {}
    sizes: list[int] = []
    for match in _PIECES.finditer(text):
        piece = match[0]
        if (found := known.get(piece)) is None:
            found = merged(piece.encode("utf-8"), ranks)
            if len(piece) < LONG_RUN:
                known[piece] = found
        sizes += found
    return np.cumsum(np.array(sizes, dtype=np.int64))


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token. A token that holds part of a character spans it."""
    ends = token_ends(text, path)
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    if len(data) == len(text):
        return starts, ends
    character = np.cumsum((data & 0xC0) != 0x80)
    return character[starts] - 1, character[ends - 1]


def line_starts(text: str) -> np.ndarray:
    """Sections by line, each with the line feed that ends it; an empty text is one empty section."""
    at, out = text.find("\n"), [0]
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, dtype=np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section, given the sections' starts (they fill the text).

    A token within a section is the section's. One that crosses boundaries goes to the section that holds
    most of its characters, the earliest of equals. So each token is counted once.
    """
    k = len(sections)
    if not len(starts):
        return np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    owner = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = np.flatnonzero(owner != last)
    limits = np.append(sections, length)
    for t in crossing:
        held = [min(ends[t], limits[s + 1]) - max(starts[t], limits[s]) for s in range(owner[t], last[t] + 1)]
        owner[t] += int(np.argmax(held))
    return np.bincount(owner, minlength=k), np.bincount(owner[crossing], minlength=k)


def section_tokens(docs: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each line of each document.

    Documents are encoded whole, once, so counts add up to the document's; the interval join of token spans
    with section spans runs beside the encoder, on sorted arrays, and nothing is shuffled. Null and empty
    texts have one empty section without tokens. Null and repeated doc_ids are kept as they come. Runs of
    any length, of blanks or letters, encode as the encoder would have it. The vocabulary file is the
    driver's and is sent to the executors; columns but the two are not looked at.
    """
    context = prepare(docs.sparkSession).sparkContext
    context.addFile(path)
    name = os.path.basename(path)

    def run(batches):
        sent = SparkFiles.get(name)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(5)]
            rows: list = []
            for doc, value in zip(ids, batch.column(1).to_pylist(), strict=True):
                sections = line_starts(value)
                counts, crossing = attribute(*token_spans(value, sent), sections, len(value))
                rows.extend([doc] * len(sections))
                for column, found in zip(out, (np.arange(len(sections)), sections, np.append(sections[1:], len(value)), counts, crossing), strict=True):
                    column.append(found)
            arrays = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array(a.astype(np.int64)) for a in arrays)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text")).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
