"""Rows that are met group by group, in order, by a Python function: one shuffle, and one group in memory at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch at most; the session's own bounds hold where they are lower.
BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20


def small_batches(df: DataFrame) -> None:
    spark = df.sparkSession
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(name))[0])
        if not 0 < now <= bound:
            spark.conf.set(name, str(bound))


def by_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """work(key, rows of that key in order) for every group; its results as a table of `schema`.

    The rows come as an iterator of the values beside the keys, so `work` decides what it holds. It must leave
    none of them. Functions are sent by value, so workers need no copy of the package: `work` has to be one
    made within a function, without names of its module.
    """
    small_batches(rows)
    rest = [c for c in rows.columns if c not in keys]
    n, bound = len(keys), BATCH_ROWS

    def run(batches):
        import itertools

        import pyarrow as pa

        arrow, out = None, []

        def flat():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*keys, *rest)), strict=True)

        def packed():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

        for key, group in itertools.groupby(flat(), lambda r: r[:n]):
            for found in work(key, (r[n:] for r in group)):
                out.append(found)
                if len(out) >= bound:
                    yield packed()
                    out = []
        if out:
            yield packed()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema: pa.Schema = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
