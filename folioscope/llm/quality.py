"""Quality classifier: a cumulative-link (proportional odds) regression of graded ratings on hashed text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import body, prepare

BUCKETS = 1 << 20
#: Rated rows that a model is fitted on at most, those with the least seeded hashes of their ids.
FIT_ROWS = 12_000
#: A bucket gets a weight if its presence goes with worse grades, at some cut, by DEFECT_Z standard errors, or with
#: better ones by MERIT_Z, in LEAST_ROWS rows.
DEFECT_Z, MERIT_Z, LEAST_ROWS = 3.5, 15.0, 3
#: A text whose known tokens are this part of all or more is judged by its evidence alone.
KNOWN = 0.4
#: Shares of tokens are counted in units of 1 / SHARE.
SHARE = 10_000
_EDGE = re.compile(r"^\W+|\W+$")
_MAX_CACHED = 200_000


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest((kind + value).encode("utf-8", "surrogatepass")) % BUCKETS


def token_buckets(token: str) -> tuple[int, ...]:
    """Of a blank-separated token: the buckets of its lower-cased word, of the word's two beginnings, and of its case and edges."""
    word = _EDGE.sub("", token)
    at = token.find(word) if word else 0
    case = "lower" if word.islower() else "upper" if word.isupper() and len(word) > 1 else "other"
    low = word.lower()
    return _bucket("word", low), _bucket("begin", low[:5]), _bucket("root", low[:4]), _bucket("case", f"{case} {token[:at][-4:]} {token[at + len(word):][:4]}")


class _Cache(dict):
    """Results of a function by token, so many at most."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: str):
        if len(self) >= _MAX_CACHED:
            self.clear()
        found = self[token] = self.of(token)
        return found


_buckets = _Cache(token_buckets)


def repeat_buckets(tokens: list[str]) -> list[int]:
    """For how often (in powers of two) a token follows its like."""
    return [_bucket("repeats", str(k)) for k in range(sum(map(eq, tokens, tokens[1:])).bit_length())]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's buckets in order, and of its tokens the share, in units of 1 / SHARE, that is in each."""
    tokens = text.split()
    counts = Counter(tokens)
    of = list(map(_buckets.__getitem__, counts))
    flat = np.array(of, dtype=np.int64).reshape(-1)
    times = np.repeat(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), 4)
    buckets, inverse = np.unique(np.concatenate((flat, np.array(repeat_buckets(tokens), dtype=np.int64))), return_inverse=True)
    shares = np.bincount(inverse[: len(flat)], weights=times, minlength=len(buckets)) * (SHARE / max(len(tokens), 1))
    return buckets.astype(np.int32), np.minimum(np.rint(shares), SHARE).astype(np.int16)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade > k) = known * sigmoid(score - thresholds[k]).

    The score is the sum of the negative weights of the buckets that a text has, and of the positive ones times
    the shares of its tokens that are in them: neither grows with mere length. `known` is the part of the
    tokens with beginnings, both of them, that the rated texts hold, over KNOWN, 1 at most: what is unknown has
    grade 0.
    """

    weights: np.ndarray
    thresholds: np.ndarray
    seen: np.ndarray  # bits of the buckets that rated texts hold

    def __post_init__(self):
        self._tokens = _Cache(self._token)
        self._repeats = [float(min(self.weights[_bucket("repeats", str(k))], 0)) for k in range(64)]

    def __reduce__(self):
        return OrdinalModel, (self.weights, self.thresholds, self.seen)

    def _token(self, token: str) -> tuple[tuple[int, ...], float, int]:
        """(buckets of negative weight, sum of the positive weights, whether known)"""
        buckets = token_buckets(token)
        weights = [float(self.weights[b]) for b in buckets]
        known = all(self.seen[b >> 3] >> (b & 7) & 1 for b in buckets[1:3])
        return tuple(b for b, w in zip(buckets, weights, strict=True) if w < 0), sum(w for w in weights if w > 0), int(known)

    def score(self, text: str) -> tuple[float, float]:
        """(score, known)"""
        tokens = text.split()
        if not tokens:
            return 0.0, 0.0
        defects: set[int] = set()
        good, known = 0.0, 0
        for (bad, merit, is_known), times in zip(map(self._tokens.__getitem__, counts := Counter(tokens)), counts.values(), strict=True):
            known += is_known * times
            if bad:
                defects.update(bad)
            if merit:
                good += merit * times
        repeats = sum(map(eq, tokens, tokens[1:])).bit_length()
        total = good / len(tokens) + float(self.weights[sorted(defects)].sum()) + sum(self._repeats[:repeats])
        return total, min(1.0, known / len(tokens) / KNOWN)

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) of each text, a column for each k."""
        scores = np.array([self.score(t) for t in texts], dtype=np.float64).reshape(-1, 2)
        return scores[:, 1:] * sigmoid(scores[:, :1] - self.thresholds)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 400, l2: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood with a small ridge, by Adam on all rows of `features`.

    A bucket whose presence goes with worse grades has a weight of 0 or less by its presence; one that goes with
    better grades has one of 0 or more by its share of the tokens. A bucket is known if LEAST_ROWS rows have
    it, or a hundredth of the rows if that is less. Without rows every weight is 0 and all is known.
    """
    weights = np.zeros(BUCKETS, dtype=np.float32)
    grades = np.asarray(grades, dtype=np.int64)
    n = len(rows)
    # at first the thresholds give each grade its share
    above = np.array([(grades > k).sum() for k in range(levels - 1)])
    share = (above + 0.5) / (n + 1.0)
    thresholds = np.log((1 - share) / share) + np.arange(levels - 1) * 1e-3
    if not n:
        return OrdinalModel(weights, thresholds, np.full(BUCKETS // 8, 255, dtype=np.uint8))
    # rows are gone through in parts, so that little more than they is held
    parts = [slice(k, min(k + 500, n)) for k in range(0, n, 500)]
    better = np.zeros((levels, BUCKETS), dtype=np.int64)  # rows with the bucket, by the grades that they are above; last all
    for part in parts:
        flat, of = np.concatenate([r[0] for r in rows[part]]), np.repeat(grades[part], [len(r[0]) for r in rows[part]])
        for k in range(levels - 1):
            better[k] += np.bincount(flat[of > k], minlength=BUCKETS)
        better[-1] += np.bincount(flat, minlength=BUCKETS)
    times = better[-1]
    seen = np.packbits(times >= min(LEAST_ROWS, max(n // 100, 1)), bitorder="little")
    often = np.flatnonzero(times >= LEAST_ROWS)
    up, down, held = np.zeros(len(often)), np.zeros(len(often)), times[often]
    for k in range(levels - 1):  # of each bucket's presence against each cut of the grades
        rate = (grades > k).mean()
        z = (better[k][often] - rate * held) / np.sqrt(np.maximum(held * (1 - held / n) * max(rate * (1 - rate), 1e-9), 1e-9))
        up, down = np.maximum(up, z), np.maximum(down, -z)
    strong = (up >= MERIT_Z) | (down >= DEFECT_Z)
    chosen, sign = often[strong], np.where(up[strong] > down[strong], 1.0, -1.0)
    del better, times, held, up, down, z
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    found = [[], [], []]
    for part in parts:
        column = place[np.concatenate([r[0] for r in rows[part]])]
        use = column >= 0
        found[0].append(column[use])
        found[1].append(np.repeat(np.arange(part.start, part.stop), [len(r[0]) for r in rows[part]])[use])
        found[2].append(np.concatenate([r[1] for r in rows[part]])[use])
    column, owner, value = map(np.concatenate, found)
    value = np.where(sign[column] > 0, value / SHARE, 1.0)
    del found, place
    # thresholds stay in order as a first one and logarithms of the steps to the next
    at = np.concatenate((np.zeros(len(chosen)), thresholds[:1], np.log(np.diff(thresholds))))
    first, second = np.zeros_like(at), np.zeros_like(at)
    d = len(chosen)
    for step in range(1, rounds + 1):
        cuts = at[d] + np.concatenate(([0.0], np.cumsum(np.exp(at[d + 1 :]))))
        score = np.bincount(owner, weights=at[column] * value, minlength=n)
        tail = np.column_stack((np.ones(n), sigmoid(score[:, None] - cuts), np.zeros(n)))
        upper, lower = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = low - up  # of the negative log likelihood, by the score
        by_cut = np.zeros((n, levels + 1))
        by_cut[np.arange(n), grades] += up
        by_cut[np.arange(n), grades + 1] -= low
        by_cut = by_cut[:, 1:-1].sum(axis=0)
        steps = np.exp(at[d + 1 :])
        gradient = np.concatenate((np.bincount(column, weights=slope[owner] * value, minlength=d) / n + l2 * at[:d], [by_cut.sum() / n], np.cumsum(by_cut[::-1])[::-1][1:] * steps / n))
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        at -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        at[:d] = np.where(at[:d] * sign > 0, at[:d], 0)
    weights[chosen] = at[:d]
    return OrdinalModel(weights, at[d] + np.concatenate(([0.0], np.cumsum(np.exp(at[d + 1 :])))), seen)


def grade() -> Column:
    """Of the labels: 0 low quality, 1 good but toxic, 2 good and clean; null if either value is null."""
    return F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


def fit_table(docs: DataFrame, ratings: DataFrame, levels: int, fit_rows: int = FIT_ROWS, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """A model of (doc_id, grade) ratings; ratings that lack either are left out.

    A document is fitted once: of its several ratings the lowest counts, of several texts of its id the one with
    the least hash. `fit_rows` rated texts at most are fitted on, those whose ids have the least seeded hashes,
    by one worker that holds their buckets; the driver gets the model alone.
    """
    prepare(docs.sparkSession)
    order = F.xxhash64(F.lit(seed), "doc_id")
    rated = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(order, "doc_id").limit(fit_rows)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text")).join(F.broadcast(rated), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int16()))], ["grade", "buckets", "shares"])

    def model(batches):
        found = [(int(g), batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()) for batch in batches for k, g in enumerate(batch.column(0).to_pylist())]
        found.sort(key=lambda r: (r[0], xxhash.xxh3_64_intdigest(r[1].tobytes())))  # sums don't depend on the rows' order
        fitted = fit([r[1:] for r in found], np.array([r[0] for r in found], dtype=np.int64), levels)
        at = np.flatnonzero(fitted.weights)
        columns = [pa.array([x.tolist()], t) for x, t in ((at, pa.list_(pa.int32())), (fitted.weights[at], pa.list_(pa.float32())), (fitted.thresholds, pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([fitted.seen.tobytes()], pa.binary())], ["at", "weights", "thresholds", "seen"])

    rows = rows.mapInArrow(run, "grade int, buckets array<int>, shares array<short>")
    found = rows.repartition(1).mapInArrow(model, "at array<int>, weights array<float>, thresholds array<double>, seen binary").collect()
    if not found:  # an empty table may have no partition
        return fit([], np.zeros(0), levels)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[found[0].at] = found[0].weights
    return OrdinalModel(weights, np.array(found[0].thresholds), np.frombuffer(found[0].seen, dtype=np.uint8))


#: A document is kept if its probability of the wanted grade or better is this or more.
LEAST_TAIL = 0.75


def rate(docs: DataFrame, model: OrdinalModel, keep_at: int, least_tail: float = LEAST_TAIL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail, kept) for every row, in one pass without a shuffle.

    tail is the probability of grade `keep_at` or better, and a document is kept if it is `least_tail` or
    more. Null and empty texts, and those of which nothing is known, have grade 0 and tail 0 and go. A model
    of no ratings gives every text with words the tail 0.5, so none is kept. Null and repeated doc_ids are
    rated as they come.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tails = sent.value.tails(batch.column(1).to_pylist())
            tail = tails[:, keep_at - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least_tail)], ["doc_id", "expected_grade", "tail", "kept"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")


def select_documents(docs: DataFrame, model: OrdinalModel, keep_at: int, least_tail: float = LEAST_TAIL, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that `rate` would keep; in one pass without a shuffle."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tails = sent.value.tails([t or "" for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array(tails[:, keep_at - 1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", grade().alias("grade"))
    return rate(docs, fit_table(docs, ratings, 3), keep_at=2)
