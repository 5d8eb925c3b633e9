"""Every registered query that has SQL, side by side with DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from lexispark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sketches_are_one_a_flag_and_task(spark):
    """No aggregate with a sketch is grouped by what is counted distinctly: its states would be as many as the orders."""
    plan = catalog.queries()["agg_approximate"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    sketched = [line for line in plan.splitlines() if "percentile" in line and "Aggregate" in line]
    assert sketched and not any("l_orderkey" in line.split("functions=")[0] for line in sketched)
