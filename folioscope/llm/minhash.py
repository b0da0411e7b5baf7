"""Near-dedup by order MinHash: sketches that keep the text order of sampled shingles, verified by alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.joins import connected_components, spread_join
from folioscope.llm.common import WORD, body, bounded, cut, document_key, labelled_shingles, member, mix, prepare

#: Sketches of TUPLE shingles each, and as many over first occurrences alone: a pair of similarity 0.8 shares none
#: of the latter with a chance of about 1 in 100,000.
SKETCHES, TUPLE = 16, 3
#: Part of two texts' common shingles that must stand in the same order.
IN_ORDER = 0.8
#: Shingles in a block of a bucket; a task compares two blocks at most.
BLOCK_SHINGLES = 300_000
#: Documents that one task compares with the first of their bucket, about.
STAR_ROWS = 2_000
BROADCAST_ROWS = 300_000
_rng = np.random.default_rng(20190707)
_SEEDS = _rng.integers(0, 2**64, SKETCHES, dtype=np.uint64)[:, None]
_FACTORS = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def order_sketch(shingles: np.ndarray) -> np.ndarray:
    """A key for each sketch: the TUPLE occurrence-labelled shingles least under its hash, in text order."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ranks = (shingles ^ _SEEDS) * _FACTORS
    ranks ^= ranks >> np.uint64(32)
    if n > TUPLE:
        at = np.sort(np.argpartition(ranks, TUPLE - 1, axis=1)[:, :TUPLE], axis=1)
    else:
        at = np.broadcast_to(np.arange(n), (SKETCHES, n))
    key = mix(np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1))
    for j in range(at.shape[1]):
        key = mix(key ^ shingles[at[:, j]])
    return key.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the best alignment of two rows of distinct shingles within `band` of the diagonal.

    As no shingle repeats within a row, it is the longest increasing run of the positions in b of the
    shingles that both share, in the order of a.
    """
    _, pa_, pb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(pa_ - pb) <= band
    pa_, pb = pa_[near], pb[near]
    pb = pb[np.argsort(pa_)]
    if (pb[1:] > pb[:-1]).all():
        return len(pb)
    tails: list[int] = []
    for p in pb.tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, common: int, threshold: float) -> bool:
    """Whether two rows of distinct shingles with so many in common are near copies: `threshold` of all shingles are
    common, and IN_ORDER of these align. The band holds every alignment that long."""
    total = len(a) + len(b)
    need = IN_ORDER * common
    return common * (1 + threshold) >= threshold * total - 1e-9 and aligned(a, b, int(total - 2 * need) + 1) >= need - 1e-9


def link_group(ids: list[int], shingles: list[np.ndarray], threshold: float, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links of the group connect, beyond what `classes` has connected already.

    Searches breadth first: each document is compared with those that nothing has reached yet; with one of a
    class all of the class are reached. Common shingles are counted for all of these, and pairs that have
    enough of them are aligned.
    """
    sizes = np.array([len(s) for s in shingles])
    _, inverse, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(ids)), sizes)
    shared = times[inverse] > 1
    codes, doc = inverse[shared], doc[shared]
    own = np.split(codes, np.flatnonzero(doc[1:] != doc[:-1]) + 1) if len(codes) else []
    codes_of = dict(zip(np.unique(doc).tolist(), own, strict=True))
    class_of = np.arange(len(ids)) if classes is None else np.unique(np.array(classes), return_inverse=True)[1]
    left = np.array(sorted(codes_of, key=lambda k: ids[k]), dtype=np.int64)
    mark, edges = np.zeros(len(times), dtype=np.int32), []
    while len(left) > 1:
        reached = class_of[left] == class_of[left[0]]
        queue, left = left[reached].tolist(), left[~reached]
        flat, starts, packed = np.zeros(0, dtype=np.int64), left, None
        while queue and len(left):
            q = queue.pop()
            if packed is None or len(left) < 0.7 * len(packed):
                packed = left
                flat = np.concatenate([codes_of[k] for k in packed.tolist()])
                lengths = np.array([len(codes_of[k]) for k in packed.tolist()])
                starts = np.cumsum(lengths) - lengths
            mark[codes_of[q]] = 1
            common = np.add.reduceat(mark[flat], starts)
            mark[codes_of[q]] = 0
            may = (common * (1 + threshold) >= threshold * (sizes[q] + sizes[packed]) - 1e-9) & np.isin(packed, left)
            found = [u for u, n in zip(packed[may].tolist(), common[may].tolist(), strict=True) if similar(shingles[q], shingles[u], n, threshold)]
            edges += [(ids[q], ids[u]) for u in found]
            reached = np.isin(class_of[left], class_of[found])
            queue += left[reached].tolist()
            left = left[~reached]
    return edges


def _scan(size: int):
    def run(batches):
        for batch in batches:
            first, second, counts, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = WORD.findall(text.lower())
                whole = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                shingles, new = labelled_shingles(text, size)
                first.append((whole >> 64) - 2**63)
                second.append((whole & (2**64 - 1)) - 2**63)
                counts.append(len(shingles))
                keys.append(order_sketch(shingles) if new.all() else np.union1d(order_sketch(shingles), order_sketch(shingles[new])))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(counts, pa.int64()), lists], ["node", "doc_id", "s1", "s2", "n", "keys"])

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _stars(size: int, threshold: float):
    """Streams rows sorted by (v, part, ray): the texts of v first, then those to be compared with it."""

    def run(batches):
        group, centers = None, []
        for batch in batches:
            found = []
            for v, part, ray, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (v, part) != group:
                    group, centers = (v, part), []
                shingles, new = labelled_shingles(text, size)
                shingles = shingles[new]
                if not ray:
                    centers.append((shingles, np.sort(shingles)))
                elif any(similar(shingles, c, int(member(shingles, s).sum()), threshold) for c, s in centers):
                    found.append((node, v))
            yield _edges(found)

    return run


def _blocks(size: int, threshold: float):
    """Streams rows sorted by (g, i, j) and links each such group."""

    def flush(ids, held, classes):
        return _edges(link_group(ids, held, threshold, classes) if len(ids) > 1 else [])

    def run(batches):
        group, ids, held, classes = None, [], [], []
        for batch in batches:
            for g, i, j, node, class_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != group:
                    if len(ids) > 1:
                        yield flush(ids, held, classes)
                    group, ids, held, classes = (g, i, j), [], [], []
                shingles, new = labelled_shingles(text, size)
                if len(shingles):
                    ids.append(node)
                    held.append(shingles[new])
                    classes.append(class_)
        yield flush(ids, held, classes)

    return run


def star_links(rays: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Those of the pairs (u, v) that are near copies. texts: (node, text); a v of many pairs is sent to several tasks."""
    parts = rays.groupBy("v").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"), F.count("*").alias("m"))
    spread = spread_join(rays, parts, ["v"], "m").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("ray"), F.col("u").alias("node"))
    heads = parts.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("ray"), F.col("v").alias("node"))
    rows = texts.join(bounded(spread.union(heads), BROADCAST_ROWS), "node").select("v", "part", "ray", "node", "text")
    return rows.repartition("v", "part").sortWithinPartitions("v", "part", "ray").mapInArrow(_stars(size, threshold), "u long, v long")


def bucket_links(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links between documents of a bucket that are of different classes. members: (key, node, class, n).

    A bucket is cut into blocks of BLOCK_SHINGLES; each two of its blocks meet in one task.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count("*").alias("m"))
    rows = spread_join(members, blocks, ["key"], "m").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") < 2, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("b")))
    rows = rows.select("key", "b", F.explode(others).alias("o"), "node", "class")
    rows = texts.join(bounded(rows, BROADCAST_ROWS), "node").select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "class", "text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(size, threshold), "u long, v long")


def near_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, class), a row for each row given; node is common.document_key. See near_duplicates."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text")).select(document_key().alias("node"), "doc_id", "text")
    rows = cut(base.mapInArrow(_scan(size), "node long, doc_id long, s1 long, s2 long, n long, keys array<long>"))
    same = rows.groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.count("*").alias("m"))
    copied = spread_join(rows, same.where("m > 1").withColumn("w", F.col("m")), ["s1", "s2"], "w", "left").withColumn("rep", F.coalesce("rep", "node"))
    held = copied.where("node = rep").select("rep", "n", F.explode("keys").alias("key"))
    stars = held.groupBy("key").agg(F.min("rep").alias("v"), F.max("rep").alias("top"), F.count("*").alias("m")).where("v < top").drop("top")
    buckets = cut(spread_join(held, stars, ["key"], "m"))
    inside = buckets.select("rep").distinct()
    texts = cut(base.select("node", "text").join(bounded(inside.withColumnRenamed("rep", "node"), BROADCAST_ROWS), "node"))
    links = cut(star_links(cut(buckets.where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()), texts, threshold, size))
    classes = cut(connected_components(links))
    # what the stars leave: buckets of three documents or more in several classes, equal buckets once
    found = buckets.join(bounded(classes.withColumnRenamed("node", "rep"), BROADCAST_ROWS), "rep", "left").select("key", F.col("rep").alias("node"), "n", F.coalesce("component", "rep").alias("class"))
    found = cut(found.groupBy("key", "node").agg(F.max("n").alias("n"), F.first("class").alias("class")))
    mark = F.xxhash64("node")
    open_ = found.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("m"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s")).where("a < b and m > 2")
    open_ = open_.groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key", "m")
    more = bucket_links(spread_join(found, open_, ["key"], "m"), texts, threshold, size)
    several = copied.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("m")).where("a < b")  # one doc_id, several texts
    ends = spread_join(copied.select("node", "rep"), several, ["node"], "m").select(F.col("rep").alias("u"), F.col("a").alias("v"))
    more = cut(more.union(ends))
    if not more.isEmpty():
        classes = connected_components(classes.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    classes = classes.withColumnRenamed("node", "rep").join(copied.groupBy("rep").agg(F.count("*").alias("m")), "rep")
    return spread_join(copied.select("rep", "node", "doc_id"), classes, ["rep"], "m", "left").select("node", "doc_id", F.coalesce("component", "rep").alias("class"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept), a row for each row given: classes are what links of near copies connect.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of `threshold`, and their
    alignment shows that the common ones stand in the same order but for a fifth. Candidates share an order
    sketch, of all occurrence-labelled shingles or of the first occurrences alone: they are a bucket.
    Texts of the same words are one from the start. The documents of a bucket are first compared with its first
    one, a star, never in pairs. Where that leaves a bucket in several classes, documents of different classes
    in it are compared, in blocks that fit a task; so no two documents that share a sketch are left both
    unexamined and unconnected. The smallest doc_id of a class is its id and stays.

    Null and empty texts are copies of each other. Rows that share a doc_id are one document and in one
    class. A row with a null doc_id has a number from its text in place of one, larger than all ids, so that it
    goes if its class has an id; the class_id of a class without any id is null, and the equal texts that have
    the least number in it stay.
    """
    rows = near_classes(docs, threshold, size, doc_id, text)
    return rows.select("doc_id", F.when(F.col("class") < 2**62, F.col("class")).alias("class_id"), (F.col("node") == F.col("class")).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
