"""Statements in the shape of the other TPC-H queries, on the columns that exist here, and what SQL sugar adds.

Where a TPC-H query needs partsupp or a column that the tables lack, a column
of like use stands in for it; joins, subqueries and aggregates are as there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import parity as P
from lexispark.plans.sql_queries import statement
from lexispark.sources.tables import table as t

Q: dict = {}


def _sql(name: str, text: str, duck: str | None = None) -> None:
    Q[name] = statement(text, duck)


_sql(
    "tpch_q2",
    """SELECT s_acctbal, s_name, n_name FROM {supplier} s, {nation}, {region} WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND s_acctbal = (SELECT max(s2.s_acctbal) FROM {supplier} s2, {nation} n2 WHERE s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r_regionkey) ORDER BY s_acctbal DESC, n_name, s_name LIMIT 100""",
)
_sql(
    "tpch_q9",
    """SELECT nation, o_year, round(sum(amount), 3) AS sum_profit FROM (SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10 AS amount
  FROM {part}, {supplier}, {lineitem}, {orders}, {nation} WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_size < 15) profit GROUP BY nation, o_year""",
)
_sql("tpch_q11", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM {lineitem} GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM {lineitem})")
_sql(
    "tpch_q12",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate GROUP BY l_linestatus""",
)
_sql("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count")
_sql(
    "tpch_q16",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem}, {part} WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
)
_sql(
    "tpch_q19",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {lineitem}, {part} WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11)
OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_partkey = l_partkey AND p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30)""",
)
_sql(
    "tpch_q20",
    """SELECT s_name FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey AND s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size < 10)
GROUP BY l_suppkey HAVING sum(l_quantity) > 100)""",
)
_sql(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""",
)
_sql("sub_exists_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_sql("sql_is_distinct", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS d, nullif(n_regionkey, 1) IS NOT DISTINCT FROM NULL AS s FROM {nation}")
_sql("sql_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice <= 100000) AS small_customers FROM {orders} GROUP BY o_orderstatus")
_sql(
    "sql_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
)
_sql("sql_window", "SELECT o_orderkey, rank_in FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank_in FROM {orders}) r WHERE rank_in <= 2")
_sql("sql_set_operations", "SELECT n_regionkey AS k FROM {nation} INTERSECT SELECT r_regionkey FROM {region} EXCEPT SELECT 2 UNION SELECT 99")
_sql("sql_limit_offset", "SELECT p_partkey, p_size FROM {part} ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 30")


def query(sql: str | None):
    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS f_initcap FROM part")
def fn_initcap(spark, sf):
    return t(spark, sf, "part").select("p_partkey", P.initcap(F.col("p_name")).alias("f_initcap"))


@query("SELECT p_partkey, substr(p_name, 1, 1) AS s_neg, '' AS s_none, left(p_name, 0) AS l_zero, right(p_name, 0) AS r_zero, p_name AS s_all FROM part")
def fn_places(spark, sf):
    """Places before the first, and lengths of zero."""
    name = F.col("p_name")
    return t(spark, sf, "part").select("p_partkey", P.substr(name, -1, 3).alias("s_neg"), P.substr(name, -5, 3).alias("s_none"), P.left(name, 0).alias("l_zero"), P.right(name, 0).alias("r_zero"), P.substr(name, -3).alias("s_all"))


_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


@query("SELECT event_id, " + ", ".join(f"strftime(date_trunc('{u}', ts), '%Y-%m-%d %H:%M:%S') AS t_{u}" for u in _UNITS) + " FROM events")
def fn_date_trunc(spark, sf):
    return t(spark, sf, "events").select("event_id", *[F.date_format(F.date_trunc(u, "ts"), "yyyy-MM-dd HH:mm:ss").alias(f"t_{u}") for u in _UNITS])


@query("SELECT o_custkey, list_sort(list(x), 'ASC', 'NULLS FIRST') AS kept, count(*) AS n FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS x FROM orders) GROUP BY ALL")
def agg_array_agg(spark, sf):
    """array_agg keeps nulls: a list for each customer, null for each order that isn't finished."""
    df = t(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("x"))
    return df.groupBy("o_custkey").agg(F.sort_array(P.array_agg(F.col("x"))).alias("kept"), F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(avg(l_quantity) AS DOUBLE) AS mean, min(l_shipdate) AS first_day, max(l_returnflag) AS word FROM lineitem GROUP BY ALL")
def agg_min_max_types(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.min("l_shipdate").alias("first_day"), F.max("l_returnflag").alias("word"))


@query("SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS mean FROM customer")
def win_udaf(spark, sf):
    """An aggregate of one's own over a window."""

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return t(spark, sf, "customer").select("c_custkey", F.round(mean("c_acctbal").over(W.partitionBy("c_nationkey")), 6).alias("mean"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a FULL JOIN supplier b ON a.s_suppkey = b.s_suppkey + 3 AND a.s_acctbal > b.s_acctbal")
def join_full_residual(spark, sf):
    """A full join whose condition is more than equal keys."""
    s = t(spark, sf, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    return a.join(b, (F.col("a") == F.col("b") + 3) & (F.col("x") > F.col("y")), "full").select("a", "b")
