"""Windows over partitions larger than a task: each is cut into slices of its order, which meet what their frames reach beyond them.

A slice is a range of (partition, order), cut by sampling and written down
once, so that all that is asked of slices speaks of the same ones. What is
summed over the slices before (counts, totals) is a row a slice; the rows that
a frame reaches in neighbouring slices are copied there, and `_own` is false
for the copies. Partitions are expected to be few: the sums are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.shared import spread, stored


def cut(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """df with `_slice`: rows alike in partition and order are in one slice, and slices of a partition ascend."""
    return stored(df.repartitionByRange(spread(df), *partition, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def within(partition: list[str]):
    """A window over the rows of a slice."""
    return W.partitionBy(*partition, "_slice")


def sums(rows: DataFrame, partition: list[str], own: dict[str, Column] | None = None, **totals: Column) -> DataFrame:
    """A row a slice: (partition, _slice, own aggregates, and of each total `name` what the slices before have; `name_of` what the slice has and `name_all` what all have)."""
    found = rows.groupBy(*partition, "_slice").agg(*[c.alias(f"{n}_of") for n, c in totals.items()], *[c.alias(n) for n, c in (own or {}).items()])
    before, whole = W.partitionBy(*partition).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*partition)
    for n in totals:
        found = found.withColumn(n, F.sum(f"{n}_of").over(before)).withColumn(f"{n}_all", F.sum(f"{n}_of").over(whole))
    return stored(found.fillna(0, list(totals)), "slice-sums")


def _same(partition: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(partition)], F.lit(True))


def _other(found: DataFrame, partition: list[str], names: dict[str, str]) -> DataFrame:
    """Sums under names that no row has."""
    keys = [F.col(c).alias(f"_key{k}") for k, c in enumerate(partition)]
    return F.broadcast(found.select(*keys, F.col("_slice").alias("_at"), *[F.col(a).alias(b) for a, b in names.items()]))


def met(rows: DataFrame, found: DataFrame, partition: list[str]) -> DataFrame:
    """Rows with the sums of their slice."""
    names = {c: c for c in found.columns if c not in (*partition, "_slice")}
    joined = rows.join(_other(found, partition, names), _same(partition) & (F.col("_slice") == F.col("_at")))
    return joined.drop("_at", *[f"_key{k}" for k in range(len(partition))])


def _with_copies(rows: DataFrame, copies: list[DataFrame]) -> DataFrame:
    out = rows.withColumn("_own", F.lit(True))
    for one in copies:
        out = out.unionByName(one.withColumn("_slice", F.col("_at")).withColumn("_own", F.lit(False)).select(*out.columns))
    return out


def near(rows: DataFrame, partition: list[str], order: list[str], back: int, ahead: int, groups: bool = False) -> DataFrame:
    """Slices with the `back` rows before and the `ahead` rows behind each, or so many peer groups; a slice may be smaller than that."""
    place = F.dense_rank() if groups else F.row_number()
    places = sums(rows, partition, _n=F.count_distinct(F.struct(*order)) if groups else F.count("*"))
    up, down = within(partition).orderBy(*order), within(partition).orderBy(*[F.col(c).desc() for c in order])
    copies = []
    for reach, window, at in ((back, down, F.expr("_n + _n_of - _nth + 1")), (ahead, up, F.expr("_n + _nth"))):
        if reach:
            edge = met(rows.withColumn("_nth", place.over(window)).where(F.col("_nth") <= reach), places, partition).withColumn("_place", at)
            wanted = F.col("_place").between(F.expr(f"_b - {reach} + 1"), F.col("_b")) if window is down else F.col("_place").between(F.expr("_b + _m + 1"), F.expr(f"_b + _m + {reach}"))
            copies.append(edge.join(_other(places, partition, {"_n": "_b", "_n_of": "_m"}), _same(partition) & wanted))
    return _with_copies(rows, copies)


def near_values(rows: DataFrame, partition: list[str], by: str, back: int, ahead: int) -> DataFrame:
    """Slices with the rows whose value is up to `back` below or `ahead` above those of a slice; null values meet none."""
    ends = sums(rows, partition, own={"_low": F.min(by), "_high": F.max(by)})
    edge = met(rows, ends, partition).where(f"`{by}` > _high - {back} or `{by}` < _low + {ahead} or `{by}` in (_low, _high)").drop("_low", "_high")
    reached = F.expr(f"_at <> _slice and ((`{by}` >= _l - {back} and `{by}` < _l) or (`{by}` > _h and `{by}` <= _h + {ahead}))")
    return _with_copies(rows, [edge.join(_other(ends, partition, {"_low": "_l", "_high": "_h"}), _same(partition) & reached)])


def running(value: Column, window, total: str, count: str) -> Column:
    """The sum of `value` over what the window says of a slice's own rows and over the slices before, which have `total` of `count` values that aren't null; null without any."""
    here = F.sum(F.when(F.col("_own"), value)).over(window)
    return F.when(here.isNotNull() | (F.col(count) > 0), F.coalesce(here, F.lit(0)) + F.col(total))
