"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a run of `window` equal words at two places: two suffixes with such a common prefix.

1. Suffixes are dealt by a prefix of variable length: their words up to the end of the run of GRAM words that has the
   least hash among those of the first `window` words, their anchor. Equal windows have equal prefixes. Prefixes
   that end in one anchor are one group, so that consecutive suffixes travel as one segment of text; a group
   whose anchor occurs once in the corpus is a leaf and never moved.
2. A group of more segments than GROUP_PLACES, which the anchors tell before any text is moved, is reduced to its
   different segments and split: its suffixes are dealt by longer prefixes, of SPLIT_WORDS words, to as many
   parts as the group has too many segments.
3. Each group is a subtree: its suffixes are sorted by prefix doubling, neighbours' common prefix lengths are read off
   the ranks, and its internal nodes of depth `window` or more are the repeats; all places of a node but the
   first go. Parts of a split group are sorted by their first `window` words outside of memory and streamed: a run
   of equal ones is a node, of which only the first place is held, however many there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.joins import spread_join
from folioscope.llm.common import body, cut, member, ngram_hashes, prepare, word_hashes

GRAM = 6
#: Segments (under 40 words each, as a rule) of one group at most; with the ranks a group takes about 100 MB.
GROUP_PLACES = 20_000
#: Words of the prefixes that larger groups are split by, and parts of one at most.
SPLIT_WORDS, MOST_PARTS = 12, 1 << 16
#: Copies of the segments of a large group are told from the first in so many tasks at most.
MOST_SALTS = 64
#: Shared anchors that are broadcast at most, the hottest. They grow with the corpus, so the rest is always shuffled.
HOT_ANCHORS = 10_000
#: Suffixes in one segment at most; texts that repeat themselves have longer runs, which are cut.
SEGMENT_WINDOWS = 200
#: Groups are sorted together until they hold so many words.
TREE_WORDS = 100_000
#: In place of a null doc_id.
LAST_ID = 2**63 - 1


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes: the anchors' hashes in text order, the first and last window of each anchor's run of windows,
    and the hashes of grams that recur so near that a single run may hold equal windows. Runs of more than
    SEGMENT_WINDOWS are several."""
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    grams = least = ngram_hashes(words, min(GRAM, window))
    width, done = window - min(GRAM, window) + 1, 1
    while done < width:  # least of `done` grams from each place on
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    runs = np.diff(np.append(first, len(least)))
    if runs.max() > SEGMENT_WINDOWS:
        parts = -(-runs // SEGMENT_WINDOWS)
        first = np.repeat(first, parts) + SEGMENT_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    near = [grams[d:][grams[d:] == grams[:-d]] for d in range(1, min(width, len(grams) - 1) + 1)]
    near = np.unique(np.concatenate(near)) if near else grams[:0]
    return least[first].view(np.int64), first, np.append(first[1:], len(least)) - 1, near.view(np.int64)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but blanks, tabs and line ends (20 and 09 to 0D), which is what bytes are split at."""
    return text.encode("utf-8", "surrogatepass").split()


def _joined(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(k) for k in arrays]))).astype(np.int32), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _scan(window: int):
    def run(batches):
        for batch in batches:
            counts, digests, keys, places = [], [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                key, _, _, near = anchors(word_hashes(words), window)
                found, times = np.unique(key, return_counts=True)
                recurs = member(found, np.sort(near))
                times[recurs] = np.maximum(times[recurs], 2)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                keys.append(found)
                places.append(times)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(digests), _lists(keys, pa.int64()), _lists(places, pa.int32())], [*batch.schema.names[1:], "n_words", "digest", "keys", "places"])

    return run


def _segments(window: int):
    """Of each document, the words of the windows at its shared anchors, with the parts that their groups are split into."""

    def run(batches):
        for batch in batches:
            docs, texts, starts, hashes, runs, parts = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for doc, th, text, keys, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                found, first, last, _ = anchors(word_hashes(words), window)
                keys, split = np.array(keys, dtype=np.int64), np.array(split, dtype=np.int64)
                order = np.argsort(keys)
                keys, split = keys[order], split[order]
                at = np.flatnonzero(member(found, keys))
                docs += [doc] * len(at)
                texts += [th] * len(at)
                starts.append(first[at])
                hashes.append(found[at])
                parts.append(split[np.searchsorted(keys, found[at])])
                runs += [_joined(words[a:b]) for a, b in zip(first[at].tolist(), (last[at] + window).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(runs, pa.string()), pa.array(np.concatenate(parts).astype(np.int32))], ["key", "doc_id", "th", "start", "words", "parts"])

    return run


def doubled_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all places of `words` by their next 1, 2, 4, ... numbers, until `longest` are compared."""
    ranks, h = [np.unique(words, return_inverse=True)[1]], 1
    while h <= longest:
        now = ranks[-1]
        pair = now * (len(now) + 1)
        pair[:-h] += now[h:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1])
        h *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each two different places."""
    length = np.zeros(len(a), dtype=np.int64)
    top = len(ranks[0]) - 1
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        same = (np.maximum(x, y) <= top) & (ranks[level][np.minimum(x, top)] == ranks[level][np.minimum(y, top)])
        length[same] += 1 << level
    return length


def deep_nodes(rows: list[tuple[int, int, int, list[str]]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes' places (doc, th, start) in the order of the tree's leaves, for each the node of depth `window` or more
    that it is of, and each such node's depth: the words that all its suffixes begin with, as far as the rows go.

    rows: (doc, th, start, words): the suffixes are all that have `window` words. Of nested deep nodes the outermost counts; it has all their places.
    """
    number: dict[str, int] = {}
    sizes = np.array([len(r[3]) for r in rows])
    heads = np.cumsum(sizes + 1) - sizes - 1
    # every row ends in a number of its own, so no common prefix goes beyond it
    flat = np.full(int((sizes + 1).sum()), -1, dtype=np.int64)
    ends = heads + sizes
    flat[ends] = np.arange(len(rows))
    within = np.ones(len(flat), dtype=bool)
    within[ends] = False
    flat[within] = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in r[3]), dtype=np.int64, count=int(sizes.sum())) + len(rows)
    ranks = doubled_ranks(flat, int(sizes.max()))
    leaves = sizes - window + 1
    owner = np.repeat(np.arange(len(rows)), leaves)
    inner = np.arange(leaves.sum()) - np.repeat(np.cumsum(leaves) - leaves, leaves)
    at = heads[owner] + inner
    order = np.argsort(ranks[-1][at])
    at, owner, inner = at[order], owner[order], inner[order]
    shared = common_prefixes(ranks, at[:-1], at[1:])
    opens = np.concatenate(([True], shared < window))
    node = np.cumsum(opens) - 1
    depth = np.minimum.reduceat(np.append(np.where(opens[1:], 2**31, shared), 2**31), np.flatnonzero(opens)) if len(at) else shared
    places = np.array([r[:3] for r in rows], dtype=np.int64)[owner]
    places[:, 2] += inner
    return places, node, depth


def later_places(places: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Runs (doc, th, start, suffixes) of the places that aren't the first of their node. Equal places are one."""
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], node))
    places, node = places[order], node[order]
    same = node[1:] == node[:-1]
    # a place is later if it differs from the first of its node; rows that repeat a document are no second place
    head = np.concatenate(([True], ~same))
    first = places[np.flatnonzero(head)][np.cumsum(head) - 1]
    gone = places[(places != first).any(axis=1)]
    if not len(gone):
        return np.zeros((0, 4), dtype=np.int64)
    gone = gone[np.lexsort(gone.T[::-1])]
    gone = gone[np.concatenate(([True], (gone[1:] != gone[:-1]).any(axis=1)))]
    head = np.flatnonzero(np.concatenate(([True], (gone[1:] - gone[:-1] != [0, 0, 1]).any(axis=1))))
    return np.column_stack((gone[head], np.diff(np.append(head, len(gone)))))


def _trees(window: int):
    """Streams rows sorted by key and words, and gives the places that go.

    Whole key groups are held until they have TREE_WORDS words; of single suffixes only the node that is open.
    """

    def flush(held, later):
        rows = later_places(*deep_nodes(held, window)[:2]) if held else np.zeros((0, 4), dtype=np.int64)
        rows = np.concatenate((rows, np.array(later, dtype=np.int64).reshape(-1, 4)))
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], ["doc_id", "th", "start", "n"])

    def run(batches):
        held, last, size = [], None, 0
        node, first = None, None
        for batch in batches:
            later = []
            for key, doc, th, start, words, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if single:
                    place = (doc, th, start)
                    if node != (key, words):
                        node, first = (key, words), place
                    elif place != first:
                        first, place = min(first, place), max(first, place)
                        later.append((*place, 1))
                    continue
                if last != key and size >= TREE_WORDS:
                    yield flush(held, [])
                    held, size = [], 0
                last = key
                held.append((doc, th, start, words.split(" ")))
                size += len(held[-1][3])
            if later:
                yield flush([], later)
        yield flush(held, [])

    return run


def _split(large: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Of the segments of groups that are too large: their different suffixes, by part, and runs of windows that go."""
    place, words = F.struct("doc_id", "th", "start"), F.split("words", " ")
    # two hashes stand for the words
    alike = ["key", "h1", "h2"]
    large = large.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(window), "words")})
    least = large.groupBy(*alike).agg(F.min(place).alias("least"), F.count("*").alias("m"), F.first("words").alias("words"), F.first("parts").alias("parts"))
    salts = F.least("parts", F.lit(MOST_SALTS))
    copied = least.where("m > 1").select(*alike, "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    copies = large.select(*alike, place.alias("place"), F.pmod(F.xxhash64("doc_id", "th"), salts).cast("int").alias("salt"), (F.size(words) - (window - 1)).alias("n"))
    gone = copies.join(copied, [*alike, "salt"]).where("place > least").select("place.*", "n")
    rows = least.select("key", "least.*", "parts", words.alias("w"))
    rows = rows.select("key", "doc_id", "th", "start", "parts", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (window - 1))).alias("i"))
    part = F.pmod(F.xxhash64(F.slice("w", F.col("i"), min(SPLIT_WORDS, window))), F.col("parts"))
    return rows.select(F.xxhash64("key", part).alias("key"), "doc_id", "th", (F.col("start") + F.col("i") - 1).cast("int").alias("start"), F.array_join(F.slice("w", F.col("i"), window), " ").alias("words"), F.lit(True).alias("single")), gone


def repeated_windows(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scans the documents and finds the repeats; see `remove_repeats` for the rules.

    Returns the scan, one row for each row given (doc_id, th, check, len, n_words, digest, first_id), and the
    table (doc_id, th, text, runs) of those documents that hold repeats of earlier text, with the runs
    (start, n) of windows that go.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text"))
    base = base.withColumns({"th": F.xxhash64("text"), "check": F.hash(F.lit(window), "text"), "len": F.octet_length("text")})
    schema = "doc_id long, th long, check int, len int, n_words long, digest string, keys array<long>, places array<int>"
    scan = cut(base.select("text", "doc_id", "th", "check", "len").mapInArrow(_scan(window), schema))
    # equal texts: the first stands for all, and windows of the others all start in it as well
    copies = scan.groupBy("th", "check", "len").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1").withColumn("copied", F.lit(True))
    one = spread_join(scan, copies, ["th", "check", "len"], "m", "left").withColumn("first_id", F.when(F.col("copied"), F.col("first")).otherwise(F.col("doc_id"))).drop("copied", "first")
    heads = one.where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.size("keys") > 0))
    # an anchor at one place is a leaf
    seen = heads.select(F.explode(F.arrays_zip("keys", "places")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.places").alias("m"))
    parts = F.least(F.ceil(F.col("m") / GROUP_PLACES), F.lit(MOST_PARTS)).cast("int")
    shared = seen.where("m > 1").withColumn("parts", parts)
    met = spread_join(heads.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "th", F.explode("keys").alias("key")), shared, ["key"], "m", bound=HOT_ANCHORS)
    met = met.groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("parts") == 1, F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("parts") > 1, F.struct("key", "parts"))).alias("large"))
    whole = base.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "th", "text").repartition("doc_id", "th")
    live = whole.join(met, ["doc_id", "th"])
    schema = "key long, doc_id long, th long, start int, words string, parts int"
    trees = live.where("size(keys) > 0").select("doc_id", "th", "text", "keys", F.transform("keys", lambda k: F.lit(1)).alias("parts")).mapInArrow(_segments(window), schema)
    large = live.where("size(large) > 0").select("doc_id", "th", "text", "large.key", "large.parts").mapInArrow(_segments(window), schema)
    smaller, gone = _split(large, window)
    trees = trees.drop("parts").withColumn("single", F.lit(False)).union(smaller)
    found = trees.repartition("key").sortWithinPartitions("key", "words").mapInArrow(_trees(window), "doc_id long, th long, start int, n int")
    gone = found.union(gone)
    starts = gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return one.drop("keys", "places"), whole.join(starts, ["doc_id", "th"])


def covered(runs: list[dict], n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window of `runs`."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for r in runs:
        edges[r["start"]] += 1
        edges[r["start"] + r["n"] - 1 + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def _kept(window: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, th, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                stay = ~covered(runs, len(words), window)
                for column, value in zip(out, (doc, th, int((~stay).sum()), _joined([w for w, k in zip(words, stay, strict=True) if k])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "th", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scan, changed): the scan's rows and, for documents that lose words but aren't copies, (doc_id, th, n_removed, kept).

    Words are runs of anything but blanks, tabs and line ends. A word goes if a window of `window` words over
    it also starts earlier in the input, in a document with a smaller doc_id or further up in its own.
    Documents of fewer words, empty and null texts lose nothing. Of rows with equal texts all but the one
    with the smallest doc_id lose every word, if they have `window`; rows that repeat doc_id and text are the
    same document. A null doc_id comes after all others.
    """
    scan, hit = repeated_windows(docs, window, doc_id, text)
    return scan, hit.select("doc_id", "th", "text", "runs").mapInArrow(_kept(window), "doc_id long, th long, n_removed long, kept string")


def op6(spark, sf_dir: str) -> DataFrame:
    window = 20
    scan, changed = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window)
    changed = changed.select(F.col("doc_id").alias("head"), "th", "n_removed", F.sha2("kept", 256).alias("sha")).dropDuplicates(["head", "th"])
    rows = scan.withColumns({"copy": ~F.col("doc_id").eqNullSafe(F.col("first_id")), "head": F.coalesce("first_id", F.lit(LAST_ID))})
    rows = rows.join(changed, ["head", "th"], "left")
    all_gone = F.col("copy") & (F.col("n_words") >= window)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
gone AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM gone),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
