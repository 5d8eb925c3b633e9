"""Windows by slices say what plain windows say, and none of them takes a whole partition."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.operators import frame as O
from lexispark.operators import slices
from lexispark.plans import catalog

SF = "/root/testdata/sf0.001"
SLICED = ["win_rank", "win_lag_lead", "win_first_last_nth", "win_rows", "win_range", "win_groups"]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 60, 3)]), i, rng.choice([None, 1.0, 2.5])) for i in range(300)] + [("c", 7, 300, 1.0), ("d", None, 301, None)]
    return spark.createDataFrame(rows, "p string, k long, i long, v double").repartition(3).cache()


def said(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_rows_near_slices(spark, lines, monkeypatch, parts):
    """Also slices of fewer rows than a frame reaches."""
    monkeypatch.setattr(slices, "spread", lambda df: parts)
    rows = slices.cut(lines, ["p"], ["k", "i"])

    def ask(df, w):
        return df.select("p", "i", F.lag("v", 4, -1.0).over(w).alias("a"), F.lead("i", 3).over(w).alias("b"), F.sum("v").over(w.rowsBetween(-5, 2)).alias("c"))

    near = slices.near(rows, ["p"], ["k", "i"], 5, 3)
    w = slices.within(["p"]).orderBy("k", "i")
    before = slices.sums(rows, ["p"], total=F.sum("v"), values=F.count("v"))
    kept = slices.met(near, before, ["p"])
    found = kept.select("_own", "p", "i", F.lag("v", 4, -1.0).over(w).alias("a"), F.lead("i", 3).over(w).alias("b"), F.sum("v").over(w.rowsBetween(-5, 2)).alias("c"), slices.running(F.col("v"), w.rowsBetween(W.unboundedPreceding, 0), "total", "values").alias("d"))
    plain = W.partitionBy("p").orderBy("k", "i")
    wanted = ask(lines, plain).join(lines.select("i", F.sum("v").over(plain.rowsBetween(W.unboundedPreceding, 0)).alias("d")), "i").select("p", "i", "a", "b", "c", "d")
    assert said(found.where("_own").drop("_own")) == said(wanted)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_values_and_groups_near_slices(spark, lines, monkeypatch, parts):
    monkeypatch.setattr(slices, "spread", lambda df: parts)
    near = slices.near_values(slices.cut(lines, ["p"], ["k"]), ["p"], "k", 10, 5)
    found = near.select("_own", "p", "i", F.count("*").over(slices.within(["p"]).orderBy("k").rangeBetween(-10, 5)).alias("n")).where("_own").drop("_own")
    assert said(found) == said(lines.select("p", "i", F.count("*").over(W.partitionBy("p").orderBy("k").rangeBetween(-10, 5)).alias("n")))
    ranked = lines.withColumn("g", F.dense_rank().over(W.partitionBy("p").orderBy("k")))
    wanted = ranked.select("p", "i", F.sum("i").over(W.partitionBy("p").orderBy("g").rangeBetween(-3, 2)).alias("n"))
    assert said(O.over_groups(lines, ["p"], "k", -3, 2, n=F.sum("i")).select("p", "i", "n")) == said(wanted)


@pytest.mark.parametrize("name", SLICED)
def test_no_window_takes_a_whole_partition(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line for line in windows)


def test_whole_partitions_are_summed_without_a_window(spark):
    assert "Window" not in catalog.queries()["win_whole_partition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
