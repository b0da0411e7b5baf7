"""What the training-data operators share: hashing of words and shingles, lineage cuts, null rules."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.lineage import checkpoint_folder

WORD = re.compile(r"\w+")
#: Rows and bytes of one Arrow batch at most (a row longer than that comes alone). The session's own bounds hold
#: where they are lower.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
_MAX_CACHED_WORDS = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches, sees to a checkpoint folder and ships the package."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if not 0 < now <= bound:
            spark.conf.set(name, str(bound))
    checkpoint_folder(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context, so workers need no installed copy."""
    context, top = spark.sparkContext, Path(__file__).parents[1]
    if getattr(context, "_folioscope_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="folioscope-package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent).as_posix())
    context.addPyFile(str(archive))
    context._folioscope_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder that all executors share."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def body(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


class _WordHashes(dict):
    """Hashes of words, given as text or as its UTF-8 bytes."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= _MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words as one run if there are fewer, of none if none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(size):
        out += words[j : n - size + 1 + j] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64
    out = mix(out + np.uint64(size))
    return out


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value the number of equal values before it."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(n, dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    out = np.zeros(n, dtype=np.int64)
    if not first.all():
        at = np.arange(n)
        out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def labelled_shingles(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's word shingles in order, each mixed with its occurrence number so that none repeats;
    and which of them are first occurrences.

    Words are runs of word characters, lower-cased. A text of fewer words than `size` is one shingle, a
    text without words has none.
    """
    shingles = ngram_hashes(word_hashes(WORD.findall((text or "").lower())), size)
    seen = occurrences(shingles) if len(shingles) else np.zeros(0, dtype=np.int64)
    return mix(shingles + seen.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), seen == 0


def document_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """The doc_id; for a null one a number from 2**62 on that its text decides."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(doc_id.cast("long"), F.xxhash64(body(text)).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The table, cut and counted: to be broadcast if it has `rows` rows at most, else joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")
