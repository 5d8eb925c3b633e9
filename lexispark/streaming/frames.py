"""Bounded windows over streams: aggregates over the rows before each row of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def preceding(stream: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """The stream's rows (key, order, value) with n, total, lo and hi of `value` over the row and the `rows` before it of its key.

    The stream has to bring the rows of a key in order from batch to batch;
    within a batch they are put in order. All that is kept of a key are its
    last `rows` values, so memory depends on the keys and not on the stream's
    length. Null values count as rows, and not in the aggregates; rows with a
    null key are a key like any other. Gives each row once, as it comes.
    """
    names = [key, *order, value]
    fields = [stream.schema[n] for n in names]
    out = StructType([*fields]).add("n", "long").add("total", "double").add("lo", "double").add("hi", "double")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(batches)).sort_values(order, kind="stable", ignore_index=True)
        before = list(state.get[0]) if state.exists else []
        line = pd.Series([None if pd.isna(x) else float(x) for x in [*before, *found[value]]], dtype="float64")
        frame = line.rolling(rows + 1, min_periods=1)
        put = found[names].copy()
        put["n"] = frame.count().astype("int64").iloc[len(before) :].to_numpy()
        for name, got in (("total", frame.sum()), ("lo", frame.min()), ("hi", frame.max())):
            put[name] = got.iloc[len(before) :].to_numpy()
        last = line.iloc[max(0, len(line) - rows) :] if rows else line.iloc[:0]
        state.update(([None if pd.isna(x) else x for x in last],))
        yield put

    return stream.select(*names).groupBy(F.col(key)).applyInPandasWithState(step, out, "tail array<double>", "append", GroupStateTimeout.NoTimeout)
