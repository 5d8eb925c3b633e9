"""Sources and sinks, changing indexes and streams: what is written is read back, with SQL over the tables it came from.

Files go to the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.plans.indexes import store
from lexispark.shared import scratch
from lexispark.sources import tables as S
from lexispark.sources.tables import table as t
from lexispark.streaming import ingest
from lexispark.text import search as searching
from lexispark.text.query import must, parse
from lexispark.text.segments import SegmentedIndex

Q: dict = {}


def query(sql: str | None):
    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


# files


def _through(df: DataFrame, fmt: str, **options) -> DataFrame:
    """df written in a format and read again with the schema it had."""
    path = scratch(df.sparkSession, f"src-{fmt}")
    S.write(df, path, fmt, **options)
    return S.read(df.sparkSession, path, fmt, df.schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_csv(spark, sf):
    return _through(t(spark, sf, "orders").drop("o_orderdate"), "csv")


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def src_json(spark, sf):
    return _through(t(spark, sf, "events").drop("ts"), "json")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30")
def src_parquet_sorted(spark, sf):
    """A sink sorted within files, and a filter that skips row groups of them."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _through(df, "parquet", sort=["l_quantity"]).where("l_quantity > 30")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size = 7")
def src_hive_partitions(spark, sf):
    """A filter on a partition column reads one folder."""
    path = scratch(spark, "src-hive")
    S.write(t(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), path, "parquet", partition_by=["p_size"])
    return S.read(spark, path, "parquet").where("p_size = 7").select("p_partkey", "p_brand")


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1")
def src_schema_merge(spark, sf):
    """Files whose columns differ, read together."""
    path, s = scratch(spark, "src-merge"), t(spark, sf, "supplier")
    S.write(s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name"), f"{path}/a", "parquet")
    S.write(s.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name", "s_acctbal"), f"{path}/b", "parquet")
    return S.read(spark, [f"{path}/a", f"{path}/b"], "parquet", merge_schema=True).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
def src_external_table(spark, sf):
    """CREATE EXTERNAL TABLE over CSV files, then SQL over its name."""
    path = scratch(spark, "src-external")
    S.write(t(spark, sf, "nation"), path, "csv")
    S.sql(spark, f"CREATE EXTERNAL TABLE ext_nation (n_nationkey INT, n_name VARCHAR, n_regionkey INT) STORED AS CSV WITH HEADER ROW LOCATION '{path}'")
    return S.sql(spark, "SELECT n_regionkey, count(*) AS n FROM ext_nation GROUP BY n_regionkey")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(lower(text)) AS digest FROM documents")
def src_corpus(spark, sf):
    """Documents as JSON lines, read by the corpus reader."""
    path = scratch(spark, "src-corpus")
    S.write(t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), path, "json")
    return S.corpus(spark, path).select("id", F.md5("text").alias("digest"))


@query("SELECT CAST(NULL AS INTEGER) AS a, CAST(NULL AS VARCHAR) AS b")
def src_empty_row(spark, sf):
    return S.empty(spark, "a int, b string", one_row=True)


@query("SELECT 1 AS k, 'x' AS v UNION ALL SELECT 2, NULL")
def src_memory(spark, sf):
    return spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")


@query("SELECT 'n_nationkey' AS column_name, 1 AS ordinal_position UNION ALL SELECT 'n_name', 2 UNION ALL SELECT 'n_regionkey', 3")
def meta_columns(spark, sf):
    """information_schema.columns of a registered table."""
    t(spark, sf, "nation").createOrReplaceTempView("meta_nation")
    return S.information_schema(spark)["columns"].where("table_name = 'meta_nation'").select("column_name", "ordinal_position")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def sql_session_variable(spark, sf):
    spark.sql("DECLARE OR REPLACE VARIABLE wanted_region INT DEFAULT 0")
    spark.sql("SET VAR wanted_region = 3")
    # the variable is read when the statement is analysed
    return spark.sql("SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey = wanted_region", nation=t(spark, sf, "nation"))


# changing indexes

_TOKENS = r"SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM"
_NEW = "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'zulu renewed the text' ELSE text END AS text FROM documents"


def _index(spark, name: str) -> SegmentedIndex:
    return SegmentedIndex(spark, scratch(spark, name))


@query(f"WITH d AS ({_NEW}), tok AS ({_TOKENS} d) SELECT doc_id FROM tok GROUP BY doc_id HAVING bool_or(term = 'the') AND (bool_or(term = 'of') OR bool_or(term = 'zulu'))")
def text_update(spark, sf):
    """Documents are updated: a tombstone hides the old version, a later segment holds the new one."""
    index, docs = _index(spark, "text-update"), t(spark, sf, "documents")
    index.add_documents(docs)
    index.flush()
    index.update_documents(docs.where("lang = 'fr'").select("doc_id", F.lit("zulu renewed the text").alias("text")))
    index.flush()
    return index.search("the AND (of OR zulu)")


_PLAIN = f"WITH tok AS ({_TOKENS} documents) SELECT doc_id FROM tok GROUP BY doc_id HAVING bool_or(term = 'der') OR bool_or(term = 'la')"


@query(_PLAIN)
def text_merge_equiv(spark, sf):
    """Two segments merged to one answer as one corpus does."""
    index, docs = _index(spark, "text-merge"), t(spark, sf, "documents").select("doc_id", "text")
    for rest in (0, 1):
        index.add_documents(docs.where(F.pmod("doc_id", F.lit(2)) == rest))
        index.flush()
    index.compact()
    return index.search("der OR la")


@query(_PLAIN.replace("documents)", "documents WHERE lang IS DISTINCT FROM 'fr')"))
def text_segment_delete(spark, sf):
    """Tombstones hide the French documents of an index."""
    index, docs = _index(spark, "text-delete"), t(spark, sf, "documents")
    index.add_documents(docs)
    index.flush()
    index.delete_documents(docs.where("lang = 'fr'"))
    return index.search("der OR la")


@query(_PLAIN)
def text_stream_ingest(spark, sf):
    """Documents come as a stream of files; each micro-batch becomes a segment."""
    path = scratch(spark, "stream-docs")
    t(spark, sf, "documents").select("doc_id", "text").write.parquet(path)
    index = _index(spark, "stream-index")
    stream = ingest.file_stream(spark, path, "parquet", "doc_id bigint, text string")
    ingest.ingest(stream, index, scratch(spark, "stream-state")).awaitTermination()
    return index.search("der OR la")


# workloads of many queries

_WORDS = "the of and la de der die und le les with by".split()
AND_LOG = {f"and{k}": f"+{a} +{b} +{c}" for k, (a, b, c) in enumerate(zip(_WORDS, _WORDS[1:], _WORDS[2:]))}
OR_LOG = {f"or{k}": f"{a} {b} zzzunknown" for k, (a, b) in enumerate(zip(_WORDS, _WORDS[3:]))}
MIXED_LOG = {f"mix{k}": f"{a} AND ({b} OR {c})" for k, (a, b, c) in enumerate(zip(_WORDS, _WORDS[2:], _WORDS[5:]))}


def _counted(name: str, log: dict[str, str]) -> None:
    def run(spark, sf):
        return searching.count_many(store(spark, sf).postings, {tag: parse(q) for tag, q in log.items()})

    def says(p) -> str:
        parts = getattr(p, "parts", None)
        return f"has_{p.term}" if parts is None else "(" + (" AND " if type(p).__name__ == "And" else " OR ").join(map(says, parts)) + ")"

    terms = sorted(set().union(*(parse(q).terms() for q in log.values())))
    has = ", ".join(f"bool_or(term = '{x}') AS has_{x}" for x in terms)
    counts = " UNION ALL ".join(f"SELECT '{tag}' AS tag, count(*) FILTER (WHERE {says(parse(q))}) AS n_docs FROM h" for tag, q in log.items())
    Q[name] = (run, f"WITH tok AS ({_TOKENS} documents), h AS (SELECT doc_id, {has} FROM tok GROUP BY doc_id) {counts}")


_counted("text_workload_and", AND_LOG)
_counted("text_workload_or", OR_LOG)
_counted("text_workload_mixed", AND_LOG | OR_LOG | MIXED_LOG)


@query("SELECT count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id FROM documents) WHERE doc_id >= 0")
def text_empty_and(spark, sf):
    """Everything but what has two terms that no document has."""
    found = store(spark, sf).postings
    docs = t(spark, sf, "documents").select("doc_id")
    nothing = searching.search(found, must(["zzzone", "zzztwo"]))
    return docs.join(nothing, "doc_id", "left_anti").agg(F.count_distinct("doc_id").alias("n_docs"))


# streams of events


def _events(spark, sf) -> DataFrame:
    path = scratch(spark, "stream-events")
    events = t(spark, sf, "events")
    events.write.parquet(path)
    return ingest.file_stream(spark, path, "parquet", events.schema)


def _drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The last state of a streaming aggregate, or all rows of a stream that appends, once the stream has read what there is."""
    spark = df.sparkSession
    path = scratch(spark, "stream-out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    """Windows over a stream of files."""
    found = _drained(ingest.tumbling(_events(spark, sf), "1 day"))
    return found.withColumn("begin", F.date_format("begin", "yyyy-MM-dd"))


@query("SELECT event_id, event_type, upper(event_type) AS kind FROM events WHERE value > 50")
def stream_static_join(spark, sf):
    """A stream joined with a static table, rows appended as they come."""
    kinds = t(spark, sf, "events").select("event_type").distinct().withColumn("kind", F.upper("event_type"))
    joined = ingest.stream_static(kinds, _events(spark, sf).where("value > 50"), ["event_type"])
    return _drained(joined.select("event_id", "event_type", "kind"), "append")
