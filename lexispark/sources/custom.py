"""Tables from code of one's own: a schema, partitions, and a scan that is told the columns, filters and limit asked for.

`register` makes a `Source` a format of the session, so that spark.read, SQL and
the optimiser see a table like any other: comparisons in a WHERE reach the
source where it says that it can use them, and Spark applies again what the
source doesn't apply exactly. Columns and a limit are handed down by `scan`.
Each partition is read by a task of its own.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

EXACT, INEXACT, UNSUPPORTED = "exact", "inexact", "unsupported"
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}

#: (column, sign, value) with the signs = > >= < <= in.
Condition = tuple[str, str, Any]


class Source(ABC):
    """What a table of one's own has to say; instances are sent to tasks."""

    @abstractmethod
    def schema(self) -> StructType:
        """Of all columns."""

    def supports(self, condition: Condition) -> str:
        """EXACT if a scan gives only rows that meet the condition, INEXACT if it can leave out some that don't, else UNSUPPORTED."""
        return UNSUPPORTED

    def partitions(self, conditions: list[Condition]) -> list[Any]:
        """What is to be read, a part for each task; conditions can rule out parts."""
        return [None]

    @abstractmethod
    def read(self, part: Any, columns: list[str], conditions: list[Condition], limit: int | None) -> Iterable[pa.RecordBatch]:
        """The part's rows with just these columns; at most `limit` of them are asked for."""


class _Part(InputPartition):
    def __init__(self, value: Any):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, source: Source, columns: list[str], limit: int | None):
        self.source, self.columns, self.limit, self.conditions = source, columns, limit, []

    def pushFilters(self, filters):
        for f in filters:
            sign = _SIGNS.get(type(f))
            condition = (f.attribute[0], sign, list(f.value) if sign == "in" else f.value) if sign and len(f.attribute) == 1 else None
            kind = self.source.supports(condition) if condition else UNSUPPORTED
            if kind != UNSUPPORTED:
                self.conditions.append(condition)
            if kind != EXACT:
                yield f  # for Spark to apply

    def partitions(self):
        return [_Part(p) for p in self.source.partitions(self.conditions)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        left = self.limit
        for batch in self.source.read(partition.value, self.columns, self.conditions, left):
            batch = batch.select(self.columns)
            if left is not None:
                batch = batch.slice(0, left)
                left -= batch.num_rows
            yield batch
            if left == 0:
                return


def register(spark: SparkSession, name: str, source: Source) -> None:
    """Make a source the session's format `name`: spark.read.format(name).load()."""
    label = name

    class Own(DataSource):
        @classmethod
        def name(cls):
            return label

        def _columns(self) -> list[str]:
            asked = self.options.get("columns")
            return json.loads(asked) if asked else source.schema().names

        def schema(self):
            return StructType([source.schema()[c] for c in self._columns()])

        def reader(self, schema):
            limit = self.options.get("limit")
            return _Reader(source, self._columns(), None if limit is None else int(limit))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Own)


def scan(spark: SparkSession, name: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """A registered source's rows: columns are read alone; a condition goes as far down as the source takes it, and a limit without a condition to each part."""
    reader = spark.read.format(name)
    if columns is not None and where is None:
        reader = reader.option("columns", json.dumps(columns))
    if limit is not None and where is None:
        reader = reader.option("limit", limit)
    found = reader.load()
    if where is not None:
        found = found.where(where)
    if columns is not None:
        found = found.select(*columns)
    return found if limit is None else found.limit(limit)
