"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, body, member, mix, ngram_hashes, prepare, word_hashes

SHINGLE = 5
#: Fingerprints of 128 bits in 8 blocks. Within RADIUS some block differs by NEAR bits at most, so probing each
#: block's values that near finds all fingerprints within RADIUS. A pair of similarity 0.8 is expected to
#: differ in 19.4 bits with a deviation of 4.1, so about one in a million lies beyond.
BITS, BLOCKS, NEAR = 128, 8, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
_MASKS = np.array([sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(BITS // BLOCKS), k)], dtype=np.int64)
#: Benchmark text sent to the executors at once; more goes in further passes over the documents.
CHUNK_BYTES = 16_000_000
_FILTER_BITS = 22


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, as BLOCKS numbers; a shingle weighs as often as it occurs."""
    halves = np.stack((windows, mix(windows ^ np.uint64(0x5851F42D4C957F2D))), axis=-1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(*windows.shape, BITS // 8), axis=-1)
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > windows.shape[1], axis=1).view(">u2").astype(np.int64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard: shingles weigh as often as they occur."""
    values, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class ItemIndex:
    """Items by fingerprint block; and all their shingles, for the windows worth a fingerprint.

    An item of fewer than SHINGLE words is one shingle of all its words, so `shingle_of` is a group of items by the
    words of a shingle: SHINGLE for most.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        kept = [(i, w) for i, t in items if len(w := word_hashes(WORD.findall(t.lower())))]
        self.ids = [i for i, _ in kept]
        self.spans = np.array([min(SHINGLE, len(w)) for _, w in kept], dtype=np.int64)
        self.shingles = [ngram_hashes(w, SHINGLE) for _, w in kept]
        self.sizes = np.array([len(s) for s in self.shingles], dtype=np.int64)
        self.groups = {int(s): self._group(s) for s in np.unique(self.spans)}
        self.prints = np.concatenate([fingerprints(s[None]) for s in self.shingles]) if kept else np.zeros((0, BLOCKS), dtype=np.int64)
        self.order = np.argsort(self.prints, axis=0, kind="stable")
        self.offsets = np.stack([np.searchsorted(np.sort(self.prints[:, k]), np.arange((1 << BITS // BLOCKS) + 1)) for k in range(BLOCKS)])

    def _group(self, span: int):
        """Of the items with shingles of `span` words: all shingles, a filter of their first bits, the shingles by item size."""
        mine = [s for s, n in zip(self.shingles, self.spans, strict=True) if n == span]
        all_ = np.unique(np.concatenate(mine))
        filter_ = np.zeros(1 << _FILTER_BITS, dtype=bool)
        filter_[all_ >> np.uint64(64 - _FILTER_BITS)] = True
        return all_, filter_, {n: np.unique(np.concatenate([s for s in mine if len(s) == n])) for n in sorted({len(s) for s in mine})}

    def within(self, print_: np.ndarray) -> np.ndarray:
        """Items whose fingerprint differs in RADIUS bits at most."""
        found = []
        for k in range(BLOCKS):
            probes = print_[k] ^ _MASKS
            first, last = self.offsets[k][probes], self.offsets[k][probes + 1]
            for p in np.flatnonzero(last > first):
                found.append(self.order[first[p] : last[p], k])
        if not found:
            return np.zeros(0, dtype=np.int64)
        found = np.unique(np.concatenate(found))
        return found[np.bitwise_count(self.prints[found] ^ print_).sum(axis=1) <= RADIUS]

    def search(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of each item's best window, the first of equals."""
        words = word_hashes(WORD.findall(text.lower()))
        best: dict[int, tuple[float, int, int]] = {}
        for span, group in self.groups.items():
            if len(words) >= span:
                self._search(ngram_hashes(words, span), span, group, best)
        return [(self.ids[k], start, n, value) for k, (value, start, n) in sorted(best.items())]

    def _search(self, shingles: np.ndarray, span: int, group, best: dict[int, tuple[float, int, int]]) -> None:
        all_, filter_, of_size = group
        at = np.flatnonzero(filter_[shingles >> np.uint64(64 - _FILTER_BITS)])
        at = at[member(shingles[at], all_)]
        for size, own in of_size.items():
            width = min(size, len(shingles))
            least = self.threshold * (size + width) / (1 + self.threshold) - 1e-9  # shingles that a similar window shares
            if len(at) < least:
                continue
            known = np.zeros(len(shingles) + 1, dtype=np.int64)
            known[at[member(shingles[at], own)] + 1] = 1
            known = np.cumsum(known)
            starts = np.flatnonzero(known[width:] - known[:-width] >= least)
            for part in np.array_split(starts, len(starts) // 256 + 1):
                windows = shingles[part[:, None] + np.arange(width)]
                for start, window, print_ in zip(part.tolist(), windows, fingerprints(windows), strict=True):
                    for k in self.within(print_):
                        if self.sizes[k] == size and self.spans[k] == span:
                            value = weighted_similarity(window, self.shingles[k])
                            if value >= self.threshold - 1e-9 and (k not in best or value > best[k][0]):
                                best[k] = (value, start, width + span - 1)


def _searcher(index):
    def run(batches):
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.value.search(text)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "start", "n_words", "similarity"])

    return run


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the items found in each document, with their best windows.

    Words are runs of word characters, lower-cased; a window has as many words as the item, or is the whole
    of a shorter document. A window is found if it and the item have a weighted Jaccard similarity of
    `threshold` on five-word shingles; an item of fewer words is a single shingle of all of them. Windows that share too few shingles with all items of their size
    together to be similar to one get no fingerprint; for the others the multi-index search returns every item within
    RADIUS, and the similarity decides. Documents are read in place and never shuffled; the benchmark goes to
    the executors in chunks of CHUNK_BYTES, one pass for each; the driver builds the index of one chunk at a time.

    Items without words match nothing, nor do null or empty texts; a document with fewer words than an item's
    shingle doesn't match the item. Repeated items are found each under their id; repeated rows and null
    doc_ids are searched as they come.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text"))
    out = None
    for index in _indexes(benchmark, threshold, item_id, item):
        found = docs.mapInArrow(_searcher(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, start long, n_words long, similarity double")
        out = found if out is None else out.union(found)
    return out


def _indexes(benchmark: DataFrame, threshold: float, item_id: str, item: str):
    """Indexes of the items in chunks of about CHUNK_BYTES; one at least."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), body(item).alias("text"))
    bytes_ = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    chunks = bytes_ // CHUNK_BYTES + 1
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k)
        yield ItemIndex([(r.item_id, r.text) for r in part.toLocalIterator()], threshold)


def without_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text: str = "text", item_id: str = "item_id", item: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in which `benchmark_passages` finds nothing."""
    spark = prepare(docs.sparkSession)

    def clean(index):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not index.value.search(t or "") for t in batch.column(text).to_pylist()], pa.bool_()))

        return run

    for index in _indexes(benchmark, threshold, item_id, item):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(index)), docs.schema)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    return benchmark_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM benchmark),
spans AS (SELECT item_id, ws, least(5, len(ws)) AS z FROM b WHERE len(ws) >= 1),
ds AS (SELECT doc_id, z, len(ws) - z + 1 AS dn, p, array_to_string(ws[p : p + z - 1], ' ') AS sh FROM (SELECT doc_id, ws, z, unnest(range(1, len(ws) - z + 2)) AS p FROM d JOIN (SELECT DISTINCT z FROM spans) ON len(ws) >= z)),
bs AS (SELECT item_id, z, bn, sh, count(*) AS c FROM (SELECT item_id, z, len(ws) - z + 1 AS bn, array_to_string(ws[p : p + z - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(ws) - z + 2)) AS p FROM spans)) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, z, bn, least(bn, dn) AS width, dn, p, sh, c FROM ds JOIN bs USING (z, sh)),
starts AS (SELECT *, unnest(range(greatest(1, p - width + 1), least(p, dn - width + 1) + 1)) AS spot FROM hits),
counts AS (SELECT doc_id, item_id, z, bn, width, spot, least(count(*), any_value(c)) AS n_common FROM starts GROUP BY doc_id, item_id, z, bn, width, spot, sh),
scored AS (SELECT doc_id, item_id, z, width, spot, sum(n_common)::DOUBLE / (bn + width - sum(n_common)) AS similarity FROM counts GROUP BY doc_id, item_id, z, bn, width, spot)
SELECT doc_id, item_id, spot - 1 AS start, (width + z - 1)::BIGINT AS n_words, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, spot) = 1
"""
