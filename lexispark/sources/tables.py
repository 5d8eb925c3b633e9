"""Sources and sinks: files of any store by format, tables by name, DDL."""

from __future__ import annotations

import io
import lzma
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexispark.operators.frame import order
from lexispark.shared import stored

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "avro": "avro", "orc": "orc", "text": "text"}
COMPRESSION = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "bzip2": "bzip2", "zstd": "zstd", "zst": "zstd", "": "none", None: "none"}


class UnsupportedSource(ValueError):
    """A format or codec that this installation can't read."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str | list[str], fmt: str, schema: StructType | str | None = None, *, header: bool = True, delimiter: str = ",", recursive: bool = False, merge_schema: bool = False) -> DataFrame:
    """A file, a directory (hive partitions are found) or several paths.

    Without a schema it is inferred. merge_schema: files whose columns differ
    are read together, missing columns as null. Compressed CSV and JSON are
    told by their endings; files of xz are read whole, each by one task, since
    they can't be split.
    """
    kind = FORMATS.get(fmt.lower())
    if kind is None:
        raise UnsupportedSource(f"no format {fmt!r}")
    paths = [path] if isinstance(path, str) else path
    packed = [p.endswith(".xz") for p in paths]
    if any(packed) and not (all(packed) and kind in ("csv", "json", "text")):
        raise UnsupportedSource("xz is read for CSV, JSON and text, not together with other files")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if kind == "csv":
        reader = reader.option("header", str(header).lower()).option("sep", delimiter).option("inferSchema", str(schema is None).lower())
    if kind == "parquet":
        reader = reader.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if any(packed):
        lines = _xz_lines(spark, paths)
        return lines if kind == "text" else (reader.csv if kind == "csv" else reader.json)(lines.rdd.map(lambda r: r.value))
    if kind == "avro":
        from lexispark.sources import avro

        return avro.read(spark, paths, schema)
    return reader.format(kind).load(paths)


def _xz_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value): the lines of files compressed with xz."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                text = io.TextIOWrapper(lzma.open(io.BytesIO(content.as_py())), "utf-8", newline="\n")
                while lines := text.readlines(1 << 22):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in lines], pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, "value string")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON lines {id, text} under a path, at any depth; texts in lower case."""
    rows = spark.read.option("recursiveFileLookup", "true").schema("id string, text string").json(path)
    return rows.select("id", F.lower("text").alias("text"))


def write(df: DataFrame, path: str, fmt: str, *, partition_by: list[str] = (), mode: str = "errorifexists", header: bool = True, sort: list[str] = ()) -> None:
    """A directory of files, one or more a task."""
    kind = FORMATS.get(fmt.lower())
    if kind in (None, "avro"):
        raise UnsupportedSource(f"no sink for {fmt!r}")
    if sort:
        df = df.sortWithinPartitions(*[order(c) for c in sort])
    out = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (out.option("header", str(header).lower()) if kind == "csv" else out).format(kind).save(path)


def empty(spark: SparkSession, schema: StructType | str, one_row: bool = False) -> DataFrame:
    """No row, or one row of nulls."""
    none = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(None for _ in none.columns)], none.schema) if one_row else none


_EXTERNAL = re.compile(
    r"\s*CREATE\s+EXTERNAL\s+TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?(?P<name>[\w.`\"]+)\s*(?:\((?P<columns>.*?)\))?\s*STORED\s+AS\s+(?P<format>\w+)"
    r"(?P<header>\s+WITH\s+HEADER\s+ROW)?(?:\s+DELIMITER\s+'(?P<delimiter>.)')?(?:\s+COMPRESSION\s+TYPE\s+(?P<codec>\w+))?"
    r"(?:\s+PARTITIONED\s+BY\s*\((?P<partitions>[^)]*)\))?(?:\s+OPTIONS\s*\([^)]*\))?\s+LOCATION\s+'(?P<path>[^']*)'\s*;?\s*$",
    re.IGNORECASE | re.DOTALL,
)
_TYPES = [(r"\bINT\s+UNSIGNED\b", "BIGINT"), (r"\bBIGINT\s+UNSIGNED\b", "DECIMAL(20,0)"), (r"\bSMALLINT\s+UNSIGNED\b", "INT"), (r"\bTINYINT\s+UNSIGNED\b", "SMALLINT")]
_TYPES += [(r"\b(?:TEXT|VARCHAR(?:\(\d+\))?|CHAR(?:\(\d+\))?)(?=\s*(?:,|$|NOT|NULL))", "STRING"), (r"\bREAL\b", "FLOAT"), (r"\bBYTEA\b", "BINARY"), (r"\bNOT\s+NULL\b", "")]


def create_external_table(spark: SparkSession, statement: str) -> DataFrame:
    """CREATE EXTERNAL TABLE … STORED AS … LOCATION …: binds the files to a temporary view."""
    m = _EXTERNAL.match(statement)
    if not m:
        raise ValueError("not a CREATE EXTERNAL TABLE statement")
    name = m["name"].strip('`"')
    if m["missing"] and spark.catalog.tableExists(name):
        return spark.table(name)
    columns = m["columns"]
    for pattern, kind in _TYPES if columns else ():
        columns = re.sub(pattern, kind, columns, flags=re.IGNORECASE)
    df = read(spark, m["path"], m["format"], columns, header=bool(m["header"]), delimiter=m["delimiter"] or ",")
    df.createOrReplaceTempView(name)
    return df


_TABLE_AS = re.compile(r"\s*CREATE\s+(?P<replace>OR\s+REPLACE\s+)?TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?(?P<name>\w+)\s+AS\s+(?P<query>.*?);?\s*$", re.IGNORECASE | re.DOTALL)
_DROP = re.compile(r"\s*DROP\s+(?:TABLE|VIEW)\s+(?P<if>IF\s+EXISTS\s+)?(?P<name>\w+)\s*;?\s*$", re.IGNORECASE)
_EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?P<analyze>ANALYZE\s+)?(?P<verbose>VERBOSE\s+)?(?P<query>(?:SELECT|WITH|VALUES)\b.*)$", re.IGNORECASE | re.DOTALL)


def create_table_as(spark: SparkSession, name: str, df: DataFrame, replace: bool = False, missing: bool = False) -> DataFrame:
    """A table of the session: df's rows written down once in the shared folder, under a name."""
    if spark.catalog.tableExists(name) and not replace:
        if missing:
            return spark.table(name)
        raise ValueError(f"table {name!r} exists")
    made = stored(df, f"table-{name}")
    made.createOrReplaceTempView(name)
    return made


def explain(df: DataFrame, analyze: bool = False, verbose: bool = False) -> list[tuple[str, str]]:
    """(kind, text) of a plan; analyze runs the query and adds how many rows it gave."""
    plan = df._jdf.queryExecution()
    out = [("logical_plan", plan.optimizedPlan().toString()), ("physical_plan", plan.executedPlan().toString())]
    if verbose:
        out.insert(0, ("initial_logical_plan", plan.logical().toString()))
    if analyze:
        out.append(("rows", str(df.count())))
    return out


def prepare(spark: SparkSession, statement: str):
    """PREPARE: a function of the values for $1, $2, … that gives the statement's DataFrame."""
    named = re.sub(r"\$(\d+)", r":p\1", statement)

    def execute(*values, **tables: DataFrame) -> DataFrame:
        return spark.sql(named, args={f"p{k}": v for k, v in enumerate(values, 1)}, **tables)

    return execute


def sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """spark.sql, and the statements that Spark spells otherwise: external tables, CREATE TABLE … AS, DROP of either, EXPLAIN.

    Tables may be given by name.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    done = spark.createDataFrame([], "result string")
    if re.match(r"\s*CREATE\s+EXTERNAL\s+TABLE", statement, re.IGNORECASE):
        create_external_table(spark, statement)
        return done
    if m := _TABLE_AS.match(statement):
        create_table_as(spark, m["name"], spark.sql(m["query"]), bool(m["replace"]), bool(m["missing"]))
        return done
    if (m := _DROP.match(statement)) and (spark.catalog.dropTempView(m["name"]) or m["if"]):
        return done
    if m := _EXPLAIN.match(statement):
        return spark.createDataFrame(explain(spark.sql(m["query"]), bool(m["analyze"]), bool(m["verbose"])), "plan_type string, plan string")
    return spark.sql(statement)


def information_schema(spark: SparkSession) -> dict[str, DataFrame]:
    """tables, columns and df_settings of the session's catalog."""
    found = spark.catalog.listTables()
    tables = [(t.catalog or "", ".".join(t.namespace or []), t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in found]
    fields = [(t.name, k + 1, c.name, c.dataType, c.nullable) for t in found for k, c in enumerate(spark.catalog.listColumns(t.name))]
    settings = [(r["key"], r["value"]) for r in spark.sql("SET").collect()]
    return {
        "tables": spark.createDataFrame(tables, "table_catalog string, table_schema string, table_name string, table_type string"),
        "columns": spark.createDataFrame(fields, "table_name string, ordinal_position int, column_name string, data_type string, is_nullable boolean"),
        "df_settings": spark.createDataFrame(settings, "name string, setting string"),
    }
