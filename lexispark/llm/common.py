"""What the operators share: shared storage, input columns, parallelism."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.shared import scratch, shared_dir, stored

__all__ = ["columns", "each", "forgets", "fresh", "held_out", "lean", "partitions", "scratch", "shared_dir", "spread", "stored", "table"]

#: The ASCII blanks that end a word.
BLANK = r"[\x20\x09-\x0D]"
#: What has to change for runs of blanks to become one space each; a lone space stays as it is.
BLANK_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of about as many bytes as df has: at least those it is read in."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, df.rdd.getNumPartitions())


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key that a task may well take alone.
ALONE = 10_000


def spread(big: DataFrame, small: DataFrame, key: str | list[str], rows: str, total: int) -> DataFrame:
    """big joined with small, which has one row for each key (never null) and, in `rows`, how many of big's `total` rows have that key.

    Keys that a thousandth of all rows have (and ALONE at least) are looked up where the rows are: there are a
    thousand of them at most, so they are broadcast, and no key's rows need to meet in one task. small is read twice.
    """
    names = [key] if isinstance(key, str) else key
    least = max(ALONE, total // 1000)
    often = small.where(F.col(rows) >= least).collect() if total >= least else []
    if not often:
        return big.join(small, names)
    hot = F.broadcast(big.sparkSession.createDataFrame(often, small.schema))
    return big.join(hot, names).unionByName(big.join(hot.select(*names), names, "left_anti").join(small, names))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that nothing learns from: crc32(text of the id) mod 5 is 0. True for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# memory of Python workers: they live on after a task and serve other stages

_CACHES: list = []
_LAST = [""]


def forgets(cached):
    """Mark a cached function: a worker that goes over to another operator drops what it holds."""
    _CACHES.append(cached)
    return cached


def _begin(operator: str) -> None:
    if _LAST[0] != operator:
        for cached in _CACHES:
            cached.cache_clear()
        _LAST[0] = operator
        _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], operator: str) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, in a worker that keeps no memory of other operators' tasks nor of finished ones."""

    def task(batches: Iterator) -> Iterator:
        _begin(operator)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def each(column: pa.Array) -> Iterator:
    """A column's values one by one, so that no batch of long texts is held twice."""
    for k in range(len(column)):
        yield column[k].as_py()
