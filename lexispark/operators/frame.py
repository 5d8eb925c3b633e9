"""Relational operators whose meaning differs from Spark's defaults."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.operators import slices


def order(column: Column | str, descending: bool = False) -> Column:
    """Nulls last when ascending, first when descending: the opposite of Spark's default."""
    column = F.col(column) if isinstance(column, str) else column
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in zip(a.columns, b.columns, strict=True)])


def intersect(a: DataFrame, b: DataFrame, keep_all: bool = True) -> DataFrame:
    """Rows of a that b has, by position, nulls alike; keep_all keeps every one of them."""
    left = a if keep_all else a.distinct()
    return left.alias("l").join(b, _same(left, b), "left_semi")


def subtract(a: DataFrame, b: DataFrame, keep_all: bool = True) -> DataFrame:
    """Rows of a that b has not, by position, nulls alike; keep_all keeps repeats."""
    left = a if keep_all else a.distinct()
    return left.join(b, _same(left, b), "left_anti")


def right_semi(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of b with a partner in a."""
    return b.join(a, on, "left_semi")


def right_anti(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of b without a partner in a."""
    return b.join(a, on, "left_anti")


def null_safe_join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Null keys equal each other."""
    return a.join(b, reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in on]), how)


def over_groups(df: DataFrame, partition: list[str], by: str, begin: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a GROUPS frame: from `begin` to `end` peer groups around the row's own.

    Peer groups are numbered by dense_rank, and the frame is a range of those numbers. A bounded frame is
    taken slice by slice, so a partition may be larger than a task; one without bounds takes a partition a task.
    """
    bounded = max(abs(begin), abs(end)) < 1 << 31
    rows, keys = (slices.near(slices.cut(df, partition, [by]), partition, [by], max(0, -begin), max(0, end), groups=True), [*partition, "_slice"]) if bounded else (df.withColumn("_own", F.lit(True)), partition)
    ranked = rows.withColumn("_group", F.dense_rank().over(W.partitionBy(*keys).orderBy(by)))
    frame = W.partitionBy(*keys).orderBy("_group").rangeBetween(begin, end)
    return ranked.select(*df.columns, "_own", *[a.over(frame).alias(n) for n, a in aggregates.items()]).where("_own").drop("_own")


def unnest(df: DataFrame, column: str) -> DataFrame:
    """A row for each element; an empty or null list gives one row with null."""
    return df.select(*[F.explode_outer(c).alias(c) if c == column else F.col(c) for c in df.columns])


def limit(df: DataFrame, skip: int = 0, fetch: int | None = None) -> DataFrame:
    out = df.offset(skip) if skip else df
    return out if fetch is None else out.limit(fetch)


def similar_to(column: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL SIMILAR TO: % and _ as in LIKE, | * + ? ( ) [ ] as in regular expressions, over the whole string.

    The character behind `escape` (one character, or none) stands for itself. A bracket that isn't closed is an error.
    """
    if len(escape) > 1:
        raise ValueError("an escape is one character")
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == escape:
            if at + 1 == len(pattern):
                raise ValueError("nothing behind the escape")
            out.append(re.escape(pattern[at + 1]))
            at += 1
        elif c == "[":
            end = pattern.find("]", at + 2)
            if end < 0:
                raise ValueError("a bracket isn't closed")
            out.append(pattern[at : end + 1].replace("\\", "\\\\"))
            at = end
        else:
            out.append({"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$", "\\": "\\\\"}.get(c, c))
        at += 1
    return column.rlike(f"(?s)^(?:{''.join(out)})\\z")


def regex_match(column: Column, pattern: str, ignore_case: bool = False, negate: bool = False) -> Column:
    """The operators ~ ~* !~ !~*."""
    found = column.rlike(("(?i)" if ignore_case else "") + pattern)
    return ~found if negate else found
