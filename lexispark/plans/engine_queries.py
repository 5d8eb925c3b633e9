"""The search engine's own calls, sources and functions of one's own, statements about tables, and what Spark does to whole frames, with SQL that says the same."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import parity as P
from lexispark.functions import udfs
from lexispark.operators import extension
from lexispark.operators import frame as O
from lexispark.plans.indexes import store
from lexispark.shared import scratch
from lexispark.sources import avro, custom
from lexispark.sources import tables as S
from lexispark.sources.tables import table as t
from lexispark.streaming import ingest
from lexispark.streaming.frames import preceding
from lexispark.text.engine import TextEngine, commands, concurrent, offline, shell
from lexispark.text.segments import MergePolicy, SegmentedIndex

Q: dict = {}


def query(sql: str | None):
    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


_TOKENS = r"tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)"


def _matching(condition: str) -> str:
    return f"SELECT doc_id FROM tok GROUP BY doc_id HAVING {condition}"


def _has(term: str) -> str:
    return f"bool_or(term = '{term}')"


# the engine


def _engine(spark, sf) -> TextEngine:
    engine = TextEngine(spark)
    engine.register_index("docs", store(spark, sf).postings)
    return engine


@query(f"WITH {_TOKENS} {_matching(f'{_has("der")} AND ({_has("die")} OR {_has("das")})')}")
def text_engine_boolean(spark, sf):
    """An index registered by name, and a search of it."""
    return _engine(spark, sf).boolean("docs", "der AND (die OR das)").select("doc_id")


@query(f"WITH {_TOKENS}, m AS ({_matching(f'{_has("la")} AND {_has("le")}')}) SELECT doc_id, CAST(sum(n) AS BIGINT) AS score FROM (SELECT doc_id, term, least(count(*), 255) AS n FROM tok JOIN m USING (doc_id) WHERE term IN ('la', 'le') GROUP BY ALL) GROUP BY doc_id")
def text_engine_provider(spark, sf):
    """A registered index's provider, asked with scores; the name stood for another index before."""
    engine = _engine(spark, sf)
    first = engine.index_provider("docs")
    assert engine.register_documents("docs", t(spark, sf, "documents").where("text is null")) is first
    engine.register_index("docs", first)
    return engine.boolean_with_provider(engine.index_provider("docs"), "la AND le", is_score=True, strict=True).select("doc_id", "score")


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS n_docs FROM tok WHERE term BETWEEN 'the' AND 'them' GROUP BY term")
def text_engine_index(spark, sf):
    """All postings of a registered index."""
    return _engine(spark, sf).index("docs").where(F.col("term").between("the", "them")).groupBy("term").agg(F.count("*").alias("n_docs"))


_LOG = {"a": ("der AND die", f"{_has('der')} AND {_has('die')}"), "b": ("+la +le", f"{_has('la')} AND {_has('le')}"), "c": ("the OR zzznone", _has("the")), "d": ("zzznone", _has("zzznone"))}
_COUNTS = " UNION ALL ".join(f"SELECT '{tag}' AS tag, count(*) AS n FROM ({_matching(sql)})" for tag, (_, sql) in _LOG.items())


def _answers(spark, lines: Iterator[str], named: dict[str, str] | None = None) -> DataFrame:
    rows = [line.split("\t") for line in lines]
    return spark.createDataFrame([((named or {}).get(tag, tag), int(n)) for tag, n in rows], "tag string, n bigint")


@query(f"WITH {_TOKENS} {_COUNTS}")
def text_shell(spark, sf):
    """Lines `tag<TAB>query`, answered one after the other."""
    return _answers(spark, shell(_engine(spark, sf), "docs", [f"{tag}\t{q}" for tag, (q, _) in _LOG.items()]))


@query(f"WITH {_TOKENS} {_COUNTS}")
def text_concurrent(spark, sf):
    """The same searches at once, as many as each line says."""
    lines = [f"{k + 1}\t{q}" for k, (q, _) in enumerate(_LOG.values())]
    return _answers(spark, concurrent(_engine(spark, sf), "docs", lines), {q: tag for tag, (q, _) in _LOG.items()})


@query(f"WITH {_TOKENS} SELECT 2 * count(*) AS queries, 2 * count(*) FILTER (WHERE n > 0) AS found, 0 AS errors FROM ({_COUNTS})")
def text_offline(spark, sf):
    """A file of queries, asked twice over."""
    path = scratch(spark, "query-log")
    spark.createDataFrame([(q,) for q, _ in _LOG.values()], "value string").write.text(path)
    done = offline(_engine(spark, sf), "docs", path, rounds=2)
    return spark.createDataFrame([(done["queries"], done["found"], done["errors"])], "queries bigint, found bigint, errors int")


@query("SELECT * FROM (VALUES (0, 'ok'), (1, 'ok'), (2, 'ok'), (3, '2'), (4, 'ok'), (5, '1'), (6, 'ok'), (7, 'ok'), (8, '1'), (9, '1'), (10, 'error: ?')) AS v(step, answer)")
def text_commands(spark, sf):
    """Commands of a search shell, from inserts to merges."""
    said = [("INSERT", "red green", 1), ("INSERT", "red blue", 2), ("MERGE", "", None), ("SEARCH", "red", None), ("DELETE", "", 1), ("SEARCH", "red", None), ("UPDATE", "blue only", 2), ("MERGE", "", None)]
    said += [("SEARCH", "blue AND only", None), ("SEGLEN", "", None), ("?", "", None)]
    index = SegmentedIndex(spark, scratch(spark, "commands"), MergePolicy(at_least=2))
    lines = (f'{{"cmd": "{cmd}", "text": "{text}", "meta": {"null" if meta is None else meta}}}' for cmd, text, meta in said)
    return spark.createDataFrame(list(enumerate(commands(index, lines))), "step int, answer string")


@query(f"WITH {_TOKENS} SELECT 'before' AS at, count(*) AS n FROM ({_matching(_has('la'))}) UNION ALL SELECT 'during', count(*) FROM ({_matching(_has('la'))}) UNION ALL SELECT 'after', count(*) FROM ({_matching(_has('la'))}) UNION ALL SELECT 'segments', 1 UNION ALL SELECT 'merges', 1")
def text_background_merge(spark, sf):
    """Segments of like size are merged in the background while searches go on: one begun before the merge reads on after it."""
    index = SegmentedIndex(spark, scratch(spark, "background"), MergePolicy(at_least=99))
    docs = t(spark, sf, "documents").select("doc_id", "text")
    for lang in (F.col("lang") == "en", ~F.col("lang").eqNullSafe("en")):
        index.add_documents(t(spark, sf, "documents").where(lang).select(*docs.columns))
        index.flush()
    index.policy = MergePolicy(at_least=2, band=64.0)
    before = index.search("la")
    jobs = index.schedule_merge()
    during = index.count("la")
    for job in jobs:
        job.result()
    rows = [("before", before.count()), ("during", during), ("after", index.count("la")), ("segments", index.segment_num()), ("merges", len(jobs))]
    return spark.createDataFrame(rows, "at string, n bigint")


@query("SELECT 1 AS k, '[[1, 2, 3, 4], [6, 7, 8, 9]]' AS found")
def text_merge_policy(spark, sf):
    """Levels of like size, of four segments or more."""
    sizes = {1: 100, 2: 9_000, 3: 10_000, 4: 12_000, 5: 60_000, 6: 900_000, 7: 1_000_000, 8: 1_100_000, 9: 1_200_000, 10: 50_000_000}
    return spark.createDataFrame([(1, str(sorted(MergePolicy().find(sizes))))], "k int, found string")


# sources of one's own


class Powers(custom.Source):
    """k, its square and its parity, for k from 0; parts are ranges of k."""

    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def schema(self):
        from pyspark.sql.types import LongType, StringType, StructType

        return StructType().add("k", LongType()).add("square", LongType()).add("parity", StringType())

    def supports(self, condition):
        column, sign, _ = condition
        return custom.UNSUPPORTED if column != "k" or sign == "in" else custom.EXACT if sign in ("<", ">=") else custom.INEXACT

    def partitions(self, conditions):
        edges = np.linspace(0, self.n, self.parts + 1).astype(int).tolist()
        low = max([v if sign in (">=", ">", "=") else 0 for _, sign, v in conditions] or [0])
        high = min([v + (sign != "<") if sign in ("<", "<=", "=") else self.n for _, sign, v in conditions] or [self.n])
        return [(max(a, low), min(b, high)) for a, b in zip(edges, edges[1:]) if max(a, low) < min(b, high)] or [(0, 0)]

    def read(self, part, columns, conditions, limit):
        low, high = part
        high = high if limit is None else min(high, low + limit)
        k = np.arange(low, high)
        made = {"k": lambda: pa.array(k), "square": lambda: pa.array(k * k), "parity": lambda: pa.array(np.where(k % 2, "odd", "even").tolist(), pa.string())}
        yield pa.RecordBatch.from_arrays([made[c]() for c in columns], names=columns)


_POWERS = "(SELECT range AS k, range * range AS square, CASE WHEN range % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM range(100000))"


def _powers(spark) -> None:
    custom.register(spark, "lexispark_powers", Powers(100_000, 4))


@query(f"SELECT parity, count(*) AS n, CAST(sum(square) AS BIGINT) AS total FROM {_POWERS} WHERE k >= 500 AND k < 90000 AND square > 1000000 GROUP BY parity")
def src_custom_filter(spark, sf):
    """A source that takes some comparisons itself; Spark applies the others."""
    _powers(spark)
    return custom.scan(spark, "lexispark_powers", where="k >= 500 AND k < 90000 AND square > 1000000").groupBy("parity").agg(F.count("*").alias("n"), F.sum("square").alias("total"))


@query(f"SELECT square FROM {_POWERS} WHERE k < 3 UNION ALL SELECT count(*) FROM {_POWERS}")
def src_custom_scan(spark, sf):
    """A source asked for a column and for some first rows, and as a table in SQL."""
    _powers(spark)
    spark.read.format("lexispark_powers").load().createOrReplaceTempView("own_powers")
    first = custom.scan(spark, "lexispark_powers", ["k", "square"], limit=3).select("square")
    return first.union(spark.sql("SELECT count(*) AS square FROM own_powers"))


def _put(spark, path: str, data: bytes) -> None:
    """A file in any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()


@query("SELECT n_nationkey, n_name FROM nation")
def src_xz(spark, sf):
    """CSV compressed with xz."""
    import lzma

    path = f"{scratch(spark, 'xz')}/nation.csv.xz"
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name")
    _put(spark, path, lzma.compress(("n_nationkey,n_name\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows.collect())).encode()))
    return S.read(spark, path, "csv", rows.schema)


@query("SELECT n_nationkey, nullif(n_name, 'FRANCE') AS n_name, CAST(n_regionkey AS DOUBLE) / 4 AS x, true AS flag, TIMESTAMP '2024-02-03 04:05:06.000007' AS at, DATE '1969-12-30' AS day FROM nation")
def src_avro(spark, sf):
    """An Avro file of the 25 nations, with a null and logical types."""
    path = f"{scratch(spark, 'avro')}/nation.avro"
    at, day = dt.datetime(2024, 2, 3, 4, 5, 6, 7, tzinfo=dt.UTC), dt.date(1969, 12, 30)
    rows = [(r.n_nationkey, None if r.n_name == "FRANCE" else r.n_name, r.n_regionkey / 4, True, at, day) for r in t(spark, sf, "nation").collect()]
    kinds = ["int", "string", "double", "boolean", {"type": "long", "logicalType": "timestamp-micros"}, {"type": "int", "logicalType": "date"}]
    _put(spark, path, avro.container(list(zip(["n_nationkey", "n_name", "x", "flag", "at", "day"], kinds)), rows, block_rows=10))
    return S.read(spark, path, "avro").withColumn("at", F.col("at").cast("timestamp_ntz"))


# functions of one's own


class Rms(udfs.Accumulator):
    """The root of the mean square."""

    def __init__(self):
        self.n, self.total = 0, 0.0

    def update(self, x: pd.Series) -> None:
        x = x.dropna()
        self.n += len(x)
        self.total += float((x * x).sum())

    def state(self):
        return self.n, self.total

    def merge(self, state) -> None:
        self.n, self.total = self.n + state[0], self.total + state[1]

    def evaluate(self):
        return (self.total / self.n) ** 0.5 if self.n else None


@query("SELECT l_returnflag, l_shipmode, round(sqrt(avg(x * x)), 6) AS rms FROM (SELECT l_returnflag, nullif(l_linestatus, 'O') AS l_shipmode, CASE WHEN l_quantity > 5 THEN l_extendedprice END AS x FROM lineitem) GROUP BY ALL")
def udaf_mergeable(spark, sf):
    """An aggregate of one's own: tasks send a state a key, which are merged. A key and values may be null."""
    lines = t(spark, sf, "lineitem").select("l_returnflag", F.nullif(F.col("l_linestatus"), F.lit("O")).alias("l_shipmode"), F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("x"))
    found = udfs.aggregate(lines, ["l_returnflag", "l_shipmode"], ["x"], Rms, "rms", "double")
    return found.withColumn("rms", F.round("rms", 6))


@query("SELECT n_nationkey, n_nationkey + 10 AS moved, 7.0::DOUBLE AS folded, true AS same, true AS own FROM nation")
def udf_volatility(spark, sf):
    """An immutable call on values is folded, a stable one is alike in all rows, a volatile one is another in each."""
    plus = udfs.scalar(lambda a, b: a + b, "double")
    mark = udfs.scalar(lambda: pd.Series([np.random.random()]), "double", udfs.STABLE)
    draw = udfs.scalar(lambda k: pd.Series(np.random.random(len(k))), "double", udfs.VOLATILE)
    rows = t(spark, sf, "nation").withColumns({"moved": plus(F.col("n_nationkey"), F.lit(10)).cast("int"), "folded": plus(3, 4), "mark": mark(), "draw": draw(F.col("n_nationkey"))})
    seen = rows.agg(F.count_distinct("mark").alias("marks"), F.count_distinct("draw").alias("draws"), F.count("*").alias("n"))
    return rows.drop("mark", "draw").crossJoin(F.broadcast(seen)).select("n_nationkey", "moved", "folded", (F.col("marks") == 1).alias("same"), (F.col("draws") == F.col("n")).alias("own"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def ext_best(spark, sf):
    """A plan of nodes of one's own: a rule makes one node of a sort and two limits."""
    rows = t(spark, sf, "customer").select("c_custkey", "c_acctbal", F.struct("c_acctbal", -F.col("c_custkey")).alias("by"))
    plan = extension.Limit((extension.Limit((extension.Sort((extension.Scan((), rows),), "by", True),), 9),), 5)
    best = extension.optimise(plan, [extension.limit_of_limit, extension.limit_of_sort])
    assert extension.explained(best) == ["Best 5 by by desc", "  Scan"]
    return extension.lower(best).select("c_custkey", "c_acctbal")


# approximate and volatile functions, digests


def _keyed(df: DataFrame, name: str) -> DataFrame:
    """df with its flag under another name."""
    return df.withColumnRenamed("l_returnflag", name)


@query("SELECT l_returnflag, true AS orders_near, true AS median_near, true AS p90_near, true AS weighted_near FROM lineitem GROUP BY ALL")
def agg_approximate(spark, sf):
    """Sketches beside exact values: distinct counts within 15 %, quantiles within 1 % of the ranks.

    Sketches are one for each flag and task. Beside a distinct count in one aggregate they would be one for
    each flag and order, so exact values are aggregates of their own: of different orders, and of quantities by
    how often they occur.
    """
    lines, q = t(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), F.col("l_quantity")
    sketched = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("about"), F.percentile_approx(q, 0.5, 1000).alias("median"), F.percentile_approx(q, 0.9, 1000).alias("p90"))
    counted = lines.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"))
    often = lines.groupBy("l_returnflag", q).agg(F.count("*").alias("n"))
    ranked = often.groupBy("l_returnflag").agg(
        *[F.percentile(q, p, F.col("n")).alias(f"e{round(100 * p)}") for p in (0.49, 0.5, 0.51, 0.89, 0.91)], F.percentile(q, 0.5, 3 * F.col("n")).alias("weighted")
    )
    found = O.null_safe_join(O.null_safe_join(sketched, _keyed(counted, "flag2"), [("l_returnflag", "flag2")]), _keyed(ranked, "flag3"), [("l_returnflag", "flag3")])
    return found.select(
        "l_returnflag", (F.abs(F.col("about") - F.col("orders")) <= 0.15 * F.col("orders")).alias("orders_near"), F.col("median").between(F.floor("e49"), F.ceil("e51")).alias("median_near"),
        F.col("p90").between(F.floor("e89"), F.ceil("e91")).alias("p90_near"), (F.abs(F.col("weighted") - F.col("e50")) <= 1).alias("weighted_near"),
    )


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY ALL")
def agg_weighted_quantile(spark, sf):
    """The approximate 0.7 quantile of prices, each weighing as its discount and tax say; its rank among the weights is within 1 % of that."""
    lines = t(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), (F.col("l_discount") + F.col("l_tax") + 0.001).alias("w"))
    found = udfs.aggregate(lines, ["l_returnflag"], ["x", "w"], lambda: udfs.Quantile(0.7), "about", "double")
    below = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag").agg((F.sum(F.when(F.col("x") <= F.col("about"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("rank"))
    return below.select("l_returnflag", F.col("rank").between(0.69, 0.71).alias("near"))


@query("SELECT count(*) AS n, true AS qualified FROM orders")
def src_store_uri(spark, sf):
    """A table by the full URI of its store, whatever file system that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/orders.parquet")
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return S.read(spark, uri, "parquet").agg(F.count("*").alias("n"), F.lit(":/" in uri).alias("qualified"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_DIGESTS = ["md5", "sha224", "sha384", "sha512", "blake2s", "blake2b"]


def _digests() -> str:
    """Values from another library, by region."""
    cases = [f"CASE r_name {' '.join(f"WHEN '{r}' THEN '{hashlib.new(d, r.encode()).hexdigest()}'" for r in _REGIONS)} END AS {d}" for d in _DIGESTS]
    return f"SELECT r_regionkey, {', '.join(cases)} FROM region"


@query(_digests())
def fn_crypto_more(spark, sf):
    name = F.col("r_name")
    known = F.when(name.isin(_REGIONS), name)
    return t(spark, sf, "region").select("r_regionkey", *[F.lower(F.hex(P.digest(known, d))).alias(d) for d in _DIGESTS])


@query("SELECT count(*) AS n, true AS random_spread, true AS uuid_own, true AS now_alike, true AS today, true AS clock FROM orders")
def fn_volatile(spark, sf):
    """random and uuid are another in each row, now and the like the same in all."""
    rows = t(spark, sf, "orders").select(F.rand().alias("r"), F.uuid().alias("u"), F.now().alias("n"), F.current_date().alias("d"), P.current_time().alias("t"))
    return rows.agg(
        F.count("*").alias("n"), ((F.count_distinct("r") == F.count("*")) & (F.min("r") >= 0) & (F.max("r") < 1) & F.avg("r").between(0.4, 0.6)).alias("random_spread"),
        ((F.count_distinct("u") == F.count("*")) & F.bool_and(F.col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))).alias("uuid_own"), (F.count_distinct("n") == 1).alias("now_alike"),
        ((F.count_distinct("d") == 1) & F.bool_and(F.col("d") == F.to_date("n"))).alias("today"), ((F.count_distinct("t") == 1) & F.bool_and(F.col("t").rlike(r"^\d\d:\d\d:\d\d\.\d{6}$"))).alias("clock"),
    )


@query("SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|PROMO).*(BRASS|TIN)$') AS kinds, false AS escaped, starts_with(p_name, 'a') AS begins FROM part")
def rel_similar_escape(spark, sf):
    name = F.col("p_name")
    return t(spark, sf, "part").select("p_partkey", O.similar_to(F.col("p_type"), "(STANDARD|PROMO)%(BRASS|TIN)").alias("kinds"), O.similar_to(name, "!%!_", escape="!").alias("escaped"), O.similar_to(name, "[a]%").alias("begins"))


@query("SELECT event_id, epoch_us(ts) * 1000 % 60000000000 AS nanos FROM events")
def fn_date_nanos(spark, sf):
    return t(spark, sf, "events").select("event_id", P.date_part("nanosecond", F.col("ts")).cast("long").alias("nanos"))


# statements and whole frames


@query("SELECT true AS made, 3 AS n, false AS there, false AS view_there")
def ddl_schema(spark, sf):
    """A schema with a table, made and dropped; a view likewise."""
    S.sql(spark, "CREATE SCHEMA IF NOT EXISTS lexispark_ddl")
    made = spark.catalog.databaseExists("lexispark_ddl")
    S.sql(spark, "CREATE OR REPLACE TEMPORARY VIEW ddl_view AS SELECT id FROM range(3)")
    n = spark.table("ddl_view").count()
    S.sql(spark, "DROP VIEW ddl_view")
    S.sql(spark, "DROP SCHEMA lexispark_ddl CASCADE")
    return spark.createDataFrame([(made, n, spark.catalog.databaseExists("lexispark_ddl"), spark.catalog.tableExists("ddl_view"))], "made boolean, n int, there boolean, view_there boolean")


@query("SELECT 'logical_plan' AS plan_type, true AS says UNION ALL SELECT 'physical_plan', true UNION ALL SELECT 'rows', true")
def explain_analyze(spark, sf):
    S.sql(spark, "DROP VIEW IF EXISTS explained_nation")
    t(spark, sf, "nation").createOrReplaceTempView("explained_nation")
    found = S.sql(spark, "EXPLAIN ANALYZE SELECT n_name FROM explained_nation WHERE n_regionkey = 1")
    return found.select("plan_type", F.when(F.col("plan_type") == "rows", F.col("plan") == "5").otherwise(F.col("plan").contains("n_regionkey")).alias("says"))


@query("SELECT 'n_name' AS col_name, 'string' AS data_type UNION ALL SELECT 'n_nationkey', 'int' UNION ALL SELECT 'n_regionkey', 'int' UNION ALL SELECT 'columns', '3' UNION ALL SELECT 'option', '123' UNION ALL SELECT 'listed', 'true'")
def show_describe_set(spark, sf):
    """DESCRIBE, SHOW COLUMNS, SHOW TABLES and SET."""
    t(spark, sf, "nation").createOrReplaceTempView("shown_nation")
    described = S.sql(spark, "DESCRIBE shown_nation").select("col_name", "data_type")
    n = S.sql(spark, "SHOW COLUMNS IN shown_nation").count()
    S.sql(spark, "SET lexispark.example.option = 123")
    option = spark.conf.get("lexispark.example.option")
    listed = S.sql(spark, "SHOW TABLES").where("tableName = 'shown_nation'").count() == 1
    return described.union(spark.createDataFrame([("columns", str(n)), ("option", option), ("listed", str(listed).lower())], "col_name string, data_type string"))


@query("SELECT (SELECT count(*) FROM customer) AS n, true AS few")
def part_coalesce(spark, sf):
    """Partitions put together without a shuffle."""
    few = t(spark, sf, "customer").repartition(8).coalesce(2).select(F.spark_partition_id().alias("p"))
    return few.agg(F.count("*").alias("n"), (F.count_distinct("p") <= 2).alias("few"))


@query("SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 2) AS most, true AS cached FROM customer GROUP BY ALL")
def cache_reuse(spark, sf):
    """A cached frame answers a count and an aggregate."""
    kept = t(spark, sf, "customer").select("c_mktsegment", "c_acctbal").cache()
    kept.count()
    found = kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("most"))
    cached = "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    return found.withColumn("cached", F.lit(cached))


@query("SELECT count(*) AS counted, count(*) AS collected, true AS shown FROM nation")
def act_count_collect_show(spark, sf):
    df = t(spark, sf, "nation")
    return spark.createDataFrame([(df.count(), len(df.collect()), "n_name" in df._show_string(3))], "counted bigint, collected bigint, shown boolean")


# streams


@query("SELECT 'bounded' AS kind, true AS allowed UNION ALL SELECT 'unbounded', false")
def stream_checked(spark, sf):
    """What needs all of its input refuses a stream."""
    path = scratch(spark, "stream-checked")
    t(spark, sf, "nation").write.parquet(path)
    rows = []
    for kind, df in (("bounded", t(spark, sf, "nation")), ("unbounded", ingest.file_stream(spark, path, "parquet", t(spark, sf, "nation").schema))):
        try:
            ingest.check_bounded(df)
            rows.append((kind, True))
        except ValueError:
            rows.append((kind, False))
    return spark.createDataFrame(rows, "kind string, allowed boolean")


@query("""
SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def stream_rows_window(spark, sf):
    """A bounded window over a stream: each event with the three before it of its user."""
    path, out = scratch(spark, "stream-rows"), scratch(spark, "stream-rows-out")
    events = t(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    events.write.parquet(path)
    found = preceding(ingest.file_stream(spark, path, "parquet", events.schema), "user_id", ["at", "event_id"], "value", 3)
    found.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "stream-rows-state")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("event_id", "n", F.round("total", 6).alias("total"), "lo", "hi")
