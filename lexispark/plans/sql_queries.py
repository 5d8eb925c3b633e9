"""SQL statements run as they are, TPC-H-shaped ones among them: subqueries, CTEs, VALUES, parameters.

A statement is given once where both engines read it alike; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexispark.sources.tables import table
from lexispark.streaming import ingest

Q: dict = {}


def statement(text: str, duck: str | None = None, **args):
    """(function, SQL) of a statement."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark, sf):
        return spark.sql(text, args=args or None, **{n: table(spark, sf, n) for n in used})

    return run, duck or re.sub(r"\{(\w+)\}", r"\1", text)


def _sql(name: str, text: str, duck: str | None = None, **args) -> None:
    Q[name] = statement(text, duck, **args)


_sql(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
_sql(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderpriority FROM {customer}, {orders}, {lineitem}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
_sql(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o.o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
)
_sql(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
)
_sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_sql(
    "tpch_q7",
    """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = 0 AND n2.n_regionkey = 1) x
GROUP BY supp_nation, cust_nation, l_year""",
)
_sql(
    "tpch_q8",
    """SELECT o_year, round(sum(CASE WHEN nation = 'CHINA' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation FROM {part}, {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2, {region}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND p_size < 30) x
GROUP BY o_year""",
)
_sql(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM {customer}, {orders}, {lineitem}, {nation}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
_sql("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM {lineitem}, {part} WHERE l_partkey = p_partkey")
_sql(
    "tpch_q15",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM {lineitem} GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM {supplier}, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)""",
)
_sql(
    "tpch_q17",
    "SELECT round(sum(l_extendedprice) / 7.0, 3) AS avg_yearly FROM {lineitem} li, {part} WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)",
)
_sql(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty FROM {customer}, {orders}, {lineitem}
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
_sql("tpch_q22", "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM {customer} c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey) GROUP BY c_nationkey")
_sql("sub_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})")
_sql("sub_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')")
_sql("sub_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
_sql("sub_correlated", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
_sql("sql_cte", "WITH a AS (SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey), b AS (SELECT max(n) AS m FROM a) SELECT n_regionkey, n FROM a, b WHERE n = m")
_sql("sql_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v (a, b)")
_sql("sql_natural_join", "SELECT n_name, m FROM {nation} NATURAL JOIN (SELECT n_regionkey, max(n_nationkey) AS m FROM {nation} GROUP BY n_regionkey) x")
_sql("sql_order_by_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM {nation} ORDER BY k NULLS LAST, n_nationkey LIMIT 10")
_sql("sql_parameters", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :status", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", low=100000, status="O")
_sql("sql_extract", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, substring(o_orderstatus FROM 1 FOR 1) AS s, trim(BOTH FROM o_orderpriority) AS p FROM {orders}")


def scan_pruned(spark, sf):
    """Two columns and a pushed filter of a wide table."""
    return table(spark, sf, "lineitem").where("l_shipdate < timestamp '1995-01-01'").select("l_orderkey", "l_partkey")


Q["scan_pruned"] = (scan_pruned, "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'")


def view_inlined(spark, sf):
    table(spark, sf, "nation").where("n_regionkey = 3").createOrReplaceTempView("asia_view")
    return spark.sql("SELECT n_name FROM asia_view WHERE n_nationkey > 5")


Q["view_inlined"] = (view_inlined, "SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5")


def events_tumbling(spark, sf):
    found = ingest.tumbling(table(spark, sf, "events"), "1 hour")
    return found.withColumn("begin", F.date_format("begin", "yyyy-MM-dd HH:mm:ss"))


Q["events_tumbling"] = (events_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")


def events_sessions(spark, sf):
    found = ingest.sessions(table(spark, sf, "events"), "30 minutes")
    return found.withColumn("begin", F.date_format("begin", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


Q["events_sessions"] = (
    events_sessions,
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begin, count(*) AS n FROM s GROUP BY user_id, k""",
)
