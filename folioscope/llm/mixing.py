"""Mixing sources to target weights by iterative proportional fitting of token counts."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import body, cut, prepare

DIMENSIONS = ("source", "lang", "topic")
#: Cells of the dimensions' values that are raked on the driver at most; more are raked as a table.
DRIVER_CELLS = 200_000
#: Raking stops after the first round that finds every marginal within TOLERANCE of its target, or after ROUNDS.
ROUNDS, TOLERANCE = 200, 1e-9
#: Topics, and dimensions of the hashed words that they are told apart by.
TOPICS, DIMS = 6, 8
#: Points are summed in units of 1 / UNIT, so that sums don't depend on the rows' order; 2**33 rows fit.
UNIT = 1 << 30
#: Tokens by characters, by bytes beyond one a character and by words. Fitted on a third of 10,000 documents in four
#: languages against a byte-pair vocabulary of 50,000. On another third it is off by 2.7 % of the tokens by document
#: and by 1.3 % by source and language; a whole language by 4.5 % at most.
BY_CHARACTER, BY_BYTE, BY_WORD = 0.484, 0.987, -0.626


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by dimension. `shares` fixes those of some values; the others divide what remains.

    They divide it by their own tokens to the power `temper`: 1 leaves them as they are, 0 makes them equal.
    Shares count only among values that occur and are scaled to sum to 1. Shares that leave nothing (sum 1 or
    more, with those of values that don't occur) hold among the values they name: those keep their part of the
    tokens, and the others, the null value "" too, keep theirs. So no value with tokens is left without a share.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: dict[str, float] = field(default_factory=dict)
    #: Expected part of all tokens to keep.
    budget: float = 0.75


PRODUCTION = Targets({"lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}}, {"source": 0.8, "topic": 0.5}, 0.75)


def word_classes(text: str = "text") -> Column:
    """How many of the text's different words, whatever their case, are of each of DIMS classes by hash.

    The whole text counts. A word is a run of letters and their marks.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(body(text)), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    codes = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(DIMS)))
    # Words of class k are what array_remove takes; the array of one code list binds it to a name.
    return F.transform(F.array(codes), lambda c: F.array(*(F.size(c) - F.size(F.array_remove(c, F.lit(k))) for k in range(DIMS))))[0]


def class_shares(counts: np.ndarray) -> np.ndarray:
    """Of each row of counts the shares of its classes; rows of none are left out."""
    counts = counts[counts.sum(axis=1) > 0].astype(float)
    return counts / counts.sum(axis=1, keepdims=True)


def directions(shares: np.ndarray, mean: np.ndarray) -> np.ndarray:
    points = shares - mean
    return points / np.maximum(np.sqrt((points**2).sum(axis=1, keepdims=True)), 1e-12)


def products(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """points @ centers.T, added up in one order however many points come at a time."""
    total = np.zeros((len(points), len(centers)))
    for d in range(points.shape[1]):
        total += points[:, d, None] * centers[:, d]
    return total


def _sums(blocks: DataFrame, of) -> np.ndarray:
    """Sum of the arrays of whole numbers that `of` makes of the blocks of counts; added by task, then on the driver."""
    def run(batches):
        total = None
        for batch in batches:
            for block in batch.column(0):
                part = of(np.frombuffer(block.as_buffer(), dtype=np.int32).reshape(-1, DIMS))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], ["sums"])

    found = [r.sums for r in blocks.mapInArrow(run, "sums array<long>").collect()]
    return np.array(found, dtype=np.int64).sum(axis=0) if found else np.zeros(0, np.int64)


def _packed(batches):
    for batch in batches:
        if batch.num_rows:
            counts = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["block"])


def centroid_weights(counts: DataFrame, topics: int = TOPICS, seed: int = 31, rounds: int = 30) -> np.ndarray:
    """Spherical k-means on class shares, around their mean, over all rows: a row of weights for each topic.

    counts has the counts of word_classes as its only column. The topic of a text is the row with the largest
    product with its counts: the centroid in the direction nearest to its own. Texts without words don't count;
    without any there are no rows. Each round is one pass over blocks of counts, of which a task sends its sums
    alone; it ends after `rounds`, or once the centroids stay. Sums are of whole numbers: the order of the rows
    or their partitions makes no difference.
    """
    spark = prepare(counts.sparkSession)
    blocks = cut(counts.mapInArrow(_packed, "block binary")).coalesce(max(spark.sparkContext.defaultParallelism, 1))
    found = _sums(blocks, lambda n: np.append(np.rint(class_shares(n) * UNIT).astype(np.int64).sum(axis=0), np.count_nonzero(n.sum(axis=1))))
    if not found.any():
        return np.zeros((0, DIMS))
    mean = found[:-1] / found[-1] / UNIT
    centers = np.random.default_rng(seed).normal(size=(topics, DIMS))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    for _ in range(rounds):
        def by_topic(n, centers=centers):
            points = directions(class_shares(n), mean)
            own, points = np.argmax(products(points, centers), axis=1), np.rint(points * UNIT).astype(np.int64)
            return np.stack([points[own == t].sum(axis=0) for t in range(topics)])

        sums = _sums(blocks, by_topic).reshape(topics, DIMS) / UNIT
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        before, centers = centers, np.where(sizes > 1e-9, sums / np.maximum(sizes, 1e-9), centers)
        if (centers == before).all():
            break
    return centers - (centers @ mean)[:, None]


def fit_topics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int | None = None, seed: int = 31) -> np.ndarray:
    """centroid_weights of every row; if `rows` is given, of so many documents at most, those whose ids have the
    least seeded hashes: one of each id, those without an id not."""
    if rows is None:
        return centroid_weights(docs.select(word_classes(text).alias("classes")), seed=seed)
    order = F.xxhash64(F.lit(seed), "key")
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("key")).orderBy(order, "key").limit(rows).distinct()
    counts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("t")).join(F.broadcast(ids), "key").select("key", word_classes("t").alias("n"))
    return centroid_weights(counts.groupBy("key").agg(F.min("n").alias("classes")).select("classes"), seed=seed)


def nearest(weights: np.ndarray, counts: Column, any_: Column) -> Column:
    """The topic with the largest product with the counts, "t0" and so on, the first of equals; "none" unless any_ or without topics."""
    if not len(weights):
        return F.lit("none")
    scores = lambda n: F.array(*(sum((F.lit(float(w)) * n[k] for k, w in enumerate(row)), F.lit(0.0)) for row in weights))
    best = F.transform(F.transform(F.array(counts), scores), lambda s: F.array_position(s, F.array_max(s)))[0] - 1
    return F.when(any_, F.concat(F.lit("t"), best.cast("string"))).otherwise("none")


def topic(weights: np.ndarray, text: str = "text") -> Column:
    """The nearest of the topics, "t0" and so on, the first of equals; "none" without a word or a topic."""
    return nearest(weights, word_classes(text), body(text).rlike(r"\p{L}|\p{M}"))


def tokens(text: str = "text") -> Column:
    """An estimate of the text's tokens by its length: see BY_CHARACTER. One at least, but none of white space alone."""
    words, characters = F.regexp_count(body(text), F.lit(r"\S+")), F.char_length(body(text))
    guess = F.round(BY_CHARACTER * characters + BY_BYTE * (F.octet_length(body(text)) - characters) + BY_WORD * words)
    return F.when(words > 0, F.greatest(F.lit(1), guess.cast("long"))).otherwise(0).cast("long")


def split(shares: dict[str, float], held: float, named: float, total: float) -> tuple[float, float]:
    """Factor of the fixed shares that occur, and the share of all other values.

    The fixed shares that occur sum to `held`, and their values have `named` of the `total` tokens.
    """
    if named >= total:
        return 1 / (held or 1.0), 0.0
    if not held:
        return 0.0, 1.0
    if sum(s for s in shares.values() if s > 0) > 1 - 1e-9:
        return named / total / held, (total - named) / total
    return 1.0, 1 - held


def target_shares(totals: dict[str, float], fixed: dict[str, float], temper: float) -> dict[str, float]:
    """Share of each value with tokens; all are positive."""
    totals = {k: t for k, t in totals.items() if t > 0}
    found = {k: s for k, s in fixed.items() if k in totals and s > 0}
    free = {k: t**temper for k, t in totals.items() if k not in found}
    factor, rest = split(fixed, sum(found.values()), sum(totals[k] for k in found), sum(totals.values()))
    return {k: s * factor for k, s in found.items()} | {k: rest * w / sum(free.values()) for k, w in free.items()}


def fit(weights: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Iterative proportional fitting of cell weights (sum 1) to the marginal targets, each as far as cells allow.

    And the largest difference of a marginal from its target that the last round met with.
    """
    weights, worst = weights / max(weights.sum(), 1e-300), 0.0
    for _ in range(rounds):
        worst = 0.0
        for d, target in enumerate(targets):
            have = np.bincount(codes[:, d], weights=weights, minlength=len(target))
            factor = np.divide(target, have, out=np.ones_like(target), where=have > 0)
            worst = max(worst, float(np.abs(have - target).max(initial=0.0)))
            weights = weights * factor[codes[:, d]]
        if worst < TOLERANCE:
            break
    return weights, worst


def rake(weights: np.ndarray, codes: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """The weights of fit."""
    return fit(weights, codes, targets)[0]


def probabilities(tokens_: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight / tokens), with c such that the expected tokens are `budget` of all; water filling."""
    ratio = np.divide(weights, tokens_, out=np.zeros_like(weights), where=tokens_ > 0)
    order = np.argsort(-ratio, kind="stable")
    goal = budget * tokens_.sum()
    full = np.concatenate(([0.0], np.cumsum(tokens_[order])))[:-1]  # tokens of the cells before, all kept whole
    rest = weights[order][::-1].cumsum()[::-1]
    c = np.divide(goal - full, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    finite = np.isfinite(c)
    fits = np.flatnonzero(finite & (np.where(finite, c, 0) * ratio[order] <= 1))
    scale = c[fits[0]] if len(fits) else np.inf
    return np.where(ratio > 0, np.minimum(1.0, np.where(np.isinf(scale), 1.0, scale * ratio)), np.where(tokens_ > 0, 0.0, 1.0))


def cell_chances(counts: np.ndarray, codes: np.ndarray, values: list[list[str]], targets: Targets) -> tuple[np.ndarray, float]:
    """Chance of each cell, and how far the raking ended off its targets. `codes` are places in the `values`."""
    goals = []
    for d, name in enumerate(DIMENSIONS):
        totals = np.bincount(codes[:, d], weights=counts, minlength=len(values[d]))
        shares = target_shares(dict(zip(values[d], totals.tolist(), strict=True)), targets.shares.get(name, {}), targets.temper.get(name, 1.0))
        goals.append(np.array([shares.get(v, 0.0) for v in values[d]]))
    weights, worst = fit(counts, codes, goals)
    return probabilities(counts, weights, targets.budget), worst


def _encode(batches) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Token counts, codes and values of Arrow batches of cells."""
    counts, codes, places = [np.zeros(0)], [np.zeros((0, len(DIMENSIONS)), dtype=np.int32)], [{} for _ in DIMENSIONS]
    for batch in batches:
        counts.append(batch.column("tokens").to_numpy(zero_copy_only=False).astype(float))
        codes.append(np.array([[p.setdefault(v, len(p)) for v in batch.column(d).to_pylist()] for d, p in zip(DIMENSIONS, places, strict=True)], dtype=np.int32).T)
    return np.concatenate(counts), np.concatenate(codes), [list(p) for p in places]


def _report(worst: float) -> None:
    if worst >= TOLERANCE:
        warnings.warn(f"raking ended after {ROUNDS} rounds with a marginal {worst:.3g} off its target share", RuntimeWarning, stacklevel=3)


def _driver_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))
    counts, places = np.array([float(r.tokens) for r in rows]), [{} for _ in DIMENSIONS]
    codes = np.array([[p.setdefault(r[d], len(p)) for d, p in zip(DIMENSIONS, places, strict=True)] for r in rows], dtype=np.int32).reshape(-1, len(DIMENSIONS))
    chance, worst = cell_chances(counts, codes, [list(p) for p in places], targets) if rows else (counts, 0.0)
    _report(worst)
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", chance double"
    return F.broadcast(cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), float(p)) for r, p in zip(rows, chance, strict=True)], schema))


def _table_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    """The same as _driver_cells, by the same code over the same order of cells, for more than a driver should hold.

    One worker holds all cells as three codes and a few numbers each, and every value once.
    """
    def chances(batches):
        counts, codes, values = _encode(batches)
        chance, worst = cell_chances(counts, codes, values, targets) if len(counts) else (counts, 0.0)
        for k in range(0, len(counts), 10_000):
            part = codes[k : k + 10_000]
            names = [pa.array([values[d][c] for c in part[:, d]], pa.string()) for d in range(len(DIMENSIONS))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(chance[k : k + 10_000]), pa.array(np.full(len(part), worst))], names=[*DIMENSIONS, "chance", "worst"])

    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", chance double, worst double"
    prepare(cells.sparkSession)
    found = cut(cells.repartition(1).sortWithinPartitions(*DIMENSIONS).mapInArrow(chances, schema))
    _report(found.agg(F.coalesce(F.max("worst"), F.lit(0.0))).first()[0])
    return found.drop("worst")


def mix(docs: DataFrame, targets: Targets = PRODUCTION, seed: int = 23, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic_of: Column | None = None, carry: tuple = ()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, chance, kept) for every row, and the `carry` columns as a struct `row`.

    Token counts by cell (source, language, topic) are raked until their marginals meet the targets; a cell's
    documents are kept with the chance that makes its expected tokens those, scaled to the budget and cut at 1.
    A document's draw is a hash of its id and text with the seed: the same in every run, and for its copies
    under other ids another one. Counts are aggregated partially before the shuffle.

    Targets that can't be met together, or only slowly, end the raking after ROUNDS with a warning that gives the
    largest gap; chances are then those of the last round.

    Topics are fitted here, on all rows, unless `topic_of` gives them. Tokens are estimated (see `tokens`).

    Null sources, languages and topics are the value "" each. Documents without tokens weigh nothing and are
    kept. Repeated rows share their fate. An empty table gives no rows.
    """
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), body(text)), 11) / float(1 << 53)
    columns = [F.col(doc_id).alias("doc_id"), value(F.col(source)).alias("source"), value(F.col(lang)).alias("lang"), tokens(text).alias("tokens"), draw.alias("draw")]
    named = word_classes(text).alias("classes") if topic_of is None else value(topic_of).alias("topic")
    narrow = cut(docs.select(*(columns[1:-1] if carry else columns), named))  # narrow rows are made once; rows that carry others again
    if topic_of is None:
        weights = centroid_weights(narrow.select("classes"))
        of_classes = nearest(weights, F.col("classes"), F.exists("classes", lambda n: n > 0))
        narrow, named = narrow.withColumn("topic", value(of_classes)), value(topic(weights, text)).alias("topic")  # never null, or the join would work it out twice
    rows = docs.select(*columns, named, F.struct(*carry).alias("row")) if carry else narrow
    cells = cut(narrow.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    chances = _driver_cells(cells, targets) if cells.count() <= DRIVER_CELLS else _table_cells(cells, targets)
    return rows.join(chances, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", "chance", (F.col("draw") < F.col("chance")).alias("kept"), *(["row"] if carry else []))


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
