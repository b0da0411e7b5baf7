"""Every query with SQL against DuckDB, on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(list(value)) if hasattr(value, "__len__") and not isinstance(value, str) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(map(str, map(plain, r))) for r in frame.itertuples(index=False))) if not frame.empty else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}{'/*' if os.path.isdir(f'{SF}/{name}') else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = rows_of(QUERIES[name](spark, SF).toPandas()), rows_of(duck.sql(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert [tuple(map(str, r)) for r in ours[1]] == [tuple(map(str, r)) for r in theirs[1]]


#: The driver's tables have no first-person chapters with two names, and no decorated names, often enough.
EMPTY = {"name_variant_clusters", "narrator_aliases", "person_links"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    frames = [QUERIES[name](spark, SF) for _ in range(2)]
    first, second = (rows_of(f.toPandas()) for f in frames)
    assert first == second and bool(first[1]) == (name not in EMPTY)
