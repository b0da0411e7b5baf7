"""Joins on keys of which a few may have very many rows, and the component search that needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.lineage import settle

#: Rows of one join key that one task may take; keys of more are broadcast.
HOT_ROWS = 2_000
#: Rows of a table that is broadcast whole.
BROADCAST_ROWS = 300_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table with its lineage cut: to be broadcast if it has no more rows than that, else joined by a shuffle."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df.hint("merge")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", bound: int | None = None, total: int | None = None) -> DataFrame:
    """rows joined with table, which has each key once and tells in `weight` how many of the rows have it.

    A table of at most `bound` rows is broadcast. Of a larger one the hot keys are: those with more rows than
    HOT_ROWS or than `bound` keys can have of all, so there are never more than `bound`. The others are joined
    by a shuffle, in which no key is hot. `weight` is dropped. A null key finds nothing. how: inner or left.
    total: the sum of the weights, if it is known; with one up to HOT_ROWS no key can be hot.
    """
    if total is not None and total <= HOT_ROWS:
        return rows.join(table.drop(weight), keys, how)
    bound = BROADCAST_ROWS if bound is None else bound
    table = settle(table)
    if table.count() <= bound:
        return rows.join(F.broadcast(table.drop(weight)), keys, how)
    total = table.agg(F.sum(weight)).first()[0] if total is None else total
    hot = F.col(weight) > max(HOT_ROWS, total // bound + 1)
    few = F.broadcast(table.where(hot).drop(weight))
    at_hot = rows.join(few, keys)
    return at_hot.unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(weight).hint("merge"), keys, how))


def connected_components(edges: DataFrame, scope: list[str] = (), rounds: int = 60) -> DataFrame:
    """(scope, node, component) for every end of an edge (scope, u, v); component is the smallest node it reaches.

    Alternates large-star and small-star steps until the edges stay as they are. Each step links a node's
    neighbours to the smallest one, which keeps the edge count linear whatever a node's degree. Minima are
    aggregated partially and reach a hub's edges by broadcast, so that no task holds all of them. Null ends
    and loops are left out; no edges give no rows. Every round is cut by a checkpoint.
    """
    scope = list(scope)
    ordered = lambda df: settle(df.where("u is not null and v is not null and u <> v").select(*scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, mark = ordered(edges), None
    for _ in range(rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64(*scope, "u", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        few = found[0] <= HOT_ROWS
        both = now.union(now.select(*scope, "v", "u"))
        low = both.groupBy(*scope, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = spread_join(both, low, [*scope, "u"], "degree", total=found[0] if few else None).where("v > u").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else settle(large)
        low = large.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = spread_join(large, low, [*scope, "u"], "degree", total=found[0] if few else None).where("v <> m").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        now = ordered(small.union(low.select(*scope, "u", F.col("m").alias("v"))))
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    ends = now.groupBy(*scope, "u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return ends.union(now.select(*scope, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
