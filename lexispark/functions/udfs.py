"""Functions of one's own: scalar ones by volatility, aggregates with states that merge."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

IMMUTABLE, STABLE, VOLATILE = "immutable", "stable", "volatile"


def scalar(fn: Callable[..., pd.Series], returns: str, volatility: str = IMMUTABLE) -> Callable[..., Column]:
    """A column function from one over pandas Series.

    immutable: equal arguments give equal results for ever, so a call on values
    alone is made once, here. stable: for the length of a query, so a call
    without columns is made when the query is written down. volatile: every
    call anew, and the optimiser may neither merge, move nor repeat calls.
    """
    if volatility not in (IMMUTABLE, STABLE, VOLATILE):
        raise ValueError(f"no volatility {volatility!r}")

    def call(*args: Any) -> Column:
        if volatility != VOLATILE and not any(isinstance(a, Column) for a in args):
            value = fn(*[pd.Series([a]) for a in args]).iloc[0] if args else fn()
            value = value.iloc[0] if isinstance(value, pd.Series) else value
            return F.lit(value.item() if hasattr(value, "item") else value).cast(returns)
        made = F.pandas_udf(fn, returns)
        return (made.asNondeterministic() if volatility == VOLATILE else made)(*[a if isinstance(a, Column) else F.lit(a) for a in args])

    return call


class Accumulator:
    """An aggregate: rows go in by batches, states of tasks are merged, one value comes out."""

    def update(self, *columns: pd.Series) -> None:
        raise NotImplementedError

    def state(self) -> Any:
        """Anything that can be pickled; small, since every task sends one for each key."""
        raise NotImplementedError

    def merge(self, state: Any) -> None:
        raise NotImplementedError

    def evaluate(self) -> Any:
        raise NotImplementedError


#: Keys that a task holds before it sends its states on.
HELD = 50_000


def aggregate(df: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Accumulator], name: str, returns: str) -> DataFrame:
    """(keys, name): an aggregate of one's own by keys.

    Each task keeps a state a key and sends that, so only states are shuffled
    and a key's rows never meet in one task. Null keys are one group.
    """
    used = df.select(*keys, *inputs)
    state = StructType([*[df.schema[k] for k in keys], StructField("state", _parse_datatype_string("binary"))])
    out = StructType([*[df.schema[k] for k in keys], StructField(name, _parse_datatype_string(returns))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[tuple, Accumulator]] = {}

        def flush() -> pd.DataFrame:
            rows = [(*key, pickle.dumps(acc.state())) for key, acc in held.values()]
            return pd.DataFrame(rows, columns=[*keys, "state"])

        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                plain = tuple(None if pd.isna(k) else k for k in key)
                held.setdefault(plain, (plain, make()))[1].update(*[rows[c] for c in inputs])
            if len(held) >= HELD:
                yield flush()
                held = {}
        yield flush()

    def merged(states: pa.Table) -> pa.Table:
        acc = make()
        for one in states["state"]:
            acc.merge(pickle.loads(one.as_py()))
        columns = {k: states[k].slice(0, 1) for k in keys}
        return pa.table({**columns, name: pa.array([acc.evaluate()])})

    return used.mapInPandas(partial, state).groupBy(*keys).applyInArrow(merged, out)


class Quantile(Accumulator):
    """An approximate quantile of values with weights of any positive size, from clusters of neighbours: small ones at both ends, `size` or so in all.

    Null values and weights, and weights that aren't positive, take no part; without any other the quantile is null.
    """

    def __init__(self, q: float, size: int = 200):
        self.q, self.size = q, size
        self.mean, self.weight = np.zeros(0), np.zeros(0)

    def _add(self, mean: np.ndarray, weight: np.ndarray) -> None:
        mean, weight = np.concatenate([self.mean, mean]), np.concatenate([self.weight, weight])
        order = np.argsort(mean, kind="stable")
        mean, weight = mean[order], weight[order]
        if len(mean) > 4 * self.size:
            # clusters are alike in the angle whose sine runs from -1 to 1 with the rank
            rank = (np.cumsum(weight) - weight / 2) / weight.sum()
            cluster = np.floor(self.size * np.arcsin(2 * rank - 1) / np.pi)
            first = np.flatnonzero(np.diff(cluster, prepend=-np.inf))
            total = np.add.reduceat(weight, first)
            mean, weight = np.add.reduceat(mean * weight, first) / total, total
        self.mean, self.weight = mean, weight

    def update(self, values: pd.Series, weights: pd.Series) -> None:
        x, w = values.to_numpy(np.float64, na_value=np.nan), weights.to_numpy(np.float64, na_value=np.nan)
        there = ~np.isnan(x) & (w > 0)
        self._add(x[there], w[there])

    def state(self):
        return self.mean.tolist(), self.weight.tolist()

    def merge(self, state) -> None:
        self._add(np.array(state[0]), np.array(state[1]))

    def evaluate(self):
        if not len(self.mean):
            return None
        rank = (np.cumsum(self.weight) - self.weight / 2) / self.weight.sum()
        return float(np.interp(self.q, rank, self.mean))
