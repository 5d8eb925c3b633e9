"""Scans, projections, joins, aggregates, windows, sorts and set operations, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexispark.functions import parity as P
from lexispark.operators import frame as O
from lexispark.operators import slices
from lexispark.sources.tables import table as t

Q: dict = {}


def query(sql: str | None):
    """Register a function under its name with the SQL that gives the same rows."""

    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


# projection, filter, predicates


@query("SELECT l_orderkey, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def rel_project_filter(spark, sf):
    return t(spark, sf, "lineitem").where("l_quantity > 45 and l_discount < 0.03").select("l_orderkey", (F.col("l_quantity") * 2).alias("doubled"))


@query("SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey >> 2 AS sr, o_orderkey << 2 AS sl FROM orders")
def rel_arithmetic(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        k, P.int_div(k, F.lit(7)).alias("q"), (k % 7).alias("r"), (-k).alias("neg"), k.bitwiseAND(12).alias("a"), k.bitwiseOR(3).alias("o"), k.bitwiseXOR(5).alias("x"), F.shiftright(k, 2).alias("sr"), F.shiftleft(k, 2).alias("sl")
    )




@query("""
SELECT c_custkey, c_acctbal IS DISTINCT FROM 0 AS dist, nullif(c_mktsegment, 'BUILDING') IS NULL AS isnull,
  nullif(c_mktsegment, 'BUILDING') IS NOT NULL AS notnull, (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY') IS TRUE AS istrue,
  (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY') IS NOT FALSE AS notfalse, (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY') IS NULL AS isunknown,
  c_acctbal BETWEEN 0 AND 1000 AS betw, c_nationkey IN (1, 2, 3) AS inlist, c_nationkey NOT IN (1, 2, 3) AS notin FROM customer""")
def rel_predicates(spark, sf):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    same = segment == "MACHINERY"
    return t(spark, sf, "customer").select(
        "c_custkey",
        (~F.col("c_acctbal").eqNullSafe(0)).alias("dist"),
        segment.isNull().alias("isnull"),
        segment.isNotNull().alias("notnull"),
        same.eqNullSafe(True).alias("istrue"),
        (~same.eqNullSafe(False)).alias("notfalse"),
        same.isNull().alias("isunknown"),
        F.col("c_acctbal").between(0, 1000).alias("betw"),
        F.col("c_nationkey").isin(1, 2, 3).alias("inlist"),
        (~F.col("c_nationkey").isin(1, 2, 3)).alias("notin"),
    )


@query(r"""
SELECT p_partkey, p_type LIKE '%a%' AS lk, p_type ILIKE '%A%' AS ilk, regexp_matches(p_type, '^[A-Z]') AS m, NOT regexp_matches(p_type, '(?i)^e') AS nm,
  regexp_full_match(p_brand, '(?s)Brand.*(1|2)') AS sim, p_name || '/' || p_brand AS cat FROM part""")
def rel_like_regex(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey",
        F.col("p_type").like("%a%").alias("lk"),
        F.col("p_type").ilike("%A%").alias("ilk"),
        O.regex_match(F.col("p_type"), "^[A-Z]").alias("m"),
        O.regex_match(F.col("p_type"), "^e", ignore_case=True, negate=True).alias("nm"),
        O.similar_to(F.col("p_brand"), "Brand%(1|2)").alias("sim"),
        F.concat("p_name", F.lit("/"), "p_brand").alias("cat"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code, CAST(o_totalprice AS BIGINT) >= 0 AS pos, TRY_CAST(o_orderpriority AS INTEGER) AS tried FROM orders""")
def rel_case_cast(spark, sf):
    price = F.col("o_totalprice")
    return t(spark, sf, "orders").select(
        "o_orderkey",
        F.when(price > 100000, "big").when(price > 50000, "mid").otherwise("small").alias("size"),
        F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).alias("code"),
        (price.cast("bigint") >= 0).alias("pos"),
        F.col("o_orderpriority").try_cast("int").alias("tried"),
    )


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS VARCHAR) AS month_on, CAST(o_orderdate - INTERVAL 10 DAY AS VARCHAR) AS ten_before FROM orders")
def rel_interval(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t(spark, sf, "orders").select("o_orderkey", day(F.expr("o_orderdate + interval 1 month")).alias("month_on"), day(F.expr("o_orderdate - interval 10 days")).alias("ten_before"))


@query("SELECT vec_id, embedding[1] AS first, embedding[3] AS third, embedding[99] AS outside FROM embeddings")
def rel_index_field(spark, sf):
    e = F.col("embedding")
    return t(spark, sf, "embeddings").select("vec_id", P.index(e, 1).alias("first"), P.index(e, 3).alias("third"), P.index(e, 99).alias("outside"))


@query("SELECT n_nationkey AS id, upper(n_name) AS label FROM nation WHERE n_regionkey = 2")
def rel_rename_with_column(spark, sf):
    df = t(spark, sf, "nation").where("n_regionkey = 2").withColumn("label", F.upper("n_name")).withColumnRenamed("n_nationkey", "id")
    return df.select("id", "label")


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > o_totalprice / 100")
def join_inner_residual(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    return o.join(c, (o.o_custkey == c.c_custkey) & (c.c_acctbal > o.o_totalprice / 100)).select("o_orderkey", "c_name")


def _outer(how):
    def run(spark, sf):
        """Whole tables; a customer's order is a partner where the balance is over a hundredth of its price."""
        c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
        return c.join(o, (c.c_custkey == o.o_custkey) & (c.c_acctbal > o.o_totalprice / 100), how).select("c_custkey", "o_orderkey")

    return run


for _how, _word in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    Q[f"join_{_how}"] = (_outer(_how), f"SELECT c_custkey, o_orderkey FROM customer {_word} JOIN orders ON c_custkey = o_custkey AND c_acctbal > o_totalprice / 100")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_left_semi(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1)")
def join_right_semi(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return O.right_semi(n, t(spark, sf, "supplier"), ["s_nationkey"]).select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1)")
def join_right_anti(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return O.right_anti(n, t(spark, sf, "supplier"), ["s_nationkey"]).select("s_suppkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return t(spark, sf, "nation").crossJoin(t(spark, sf, "region")).select("n_name", "r_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(spark, sf):
    a, b = t(spark, sf, "nation").alias("a"), t(spark, sf, "nation").alias("b")
    on = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON a.n_nationkey < b.r_regionkey")
def join_nested_loop_left(spark, sf):
    a, b = t(spark, sf, "nation"), t(spark, sf, "region")
    return a.join(b, a.n_nationkey < b.r_regionkey, "left").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@query("WITH x AS (SELECT nullif(n_regionkey, 1) AS k, n_nationkey FROM nation) SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM x a JOIN x b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, sf):
    x = t(spark, sf, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k"), "n_nationkey")
    a, b = x.select(F.col("k").alias("ka"), F.col("n_nationkey").alias("a")), x.select(F.col("k").alias("kb"), F.col("n_nationkey").alias("b"))
    return O.null_safe_join(a, b, [("ka", "kb")]).select("a", "b")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def join_sort_merge(spark, sf):
    o, li = t(spark, sf, "orders").where("o_totalprice > 200000"), t(spark, sf, "lineitem")
    return o.hint("merge").join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber")


@query("SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)")
def join_using(spark, sf):
    return t(spark, sf, "nation").join(t(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name")


# aggregation


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_quantity), 2) AS total, round(sum(DISTINCT l_quantity), 2) AS distinct_total,
  min(l_discount) AS lo, max(l_tax) AS hi, round(avg(l_extendedprice), 4) AS mean, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY ALL""")
def agg_basic(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.round(F.sum("l_quantity"), 2).alias("total"),
        F.round(F.sum_distinct("l_quantity"), 2).alias("distinct_total"),
        F.min("l_discount").alias("lo"),
        F.max("l_tax").alias("hi"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"),
        F.count_if(F.col("l_quantity") > 25).alias("large"),
    )


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderpriority) AS lo FROM orders WHERE o_orderkey < 0")
def agg_ungrouped_empty(spark, sf):
    return t(spark, sf, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderpriority").alias("lo"))


@query("""
SELECT l_returnflag, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp,
  round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS co FROM lineitem GROUP BY ALL""")
def agg_statistics(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.var_samp(q), 4).alias("vs"),
        F.round(F.var_pop(q), 4).alias("vp"),
        F.round(F.stddev_samp(q), 6).alias("ss"),
        F.round(F.stddev_pop(q), 6).alias("sp"),
        F.round(F.covar_samp(q, d), 6).alias("cs"),
        F.round(F.covar_pop(q, d), 6).alias("cp"),
        F.round(F.corr(q, F.col("l_extendedprice")), 6).alias("co"),
    )


@query("SELECT p_brand, CAST(trunc(median(p_size)) AS INTEGER) AS mid, round(median(p_retailprice), 4) AS price FROM part GROUP BY ALL")
def agg_median(spark, sf):
    return t(spark, sf, "part").groupBy("p_brand").agg(P.median(F.col("p_size"), "int").alias("mid"), F.round(F.median("p_retailprice"), 4).alias("price"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL")
def agg_percentile(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", 0.9), 6).alias("p90"))


@query("SELECT r_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 3 GROUP BY ALL")
def agg_array_keeps_nulls(spark, sf):
    r, n = t(spark, sf, "region"), t(spark, sf, "nation").where("n_nationkey > 3")
    joined = r.join(n, r.r_regionkey == n.n_regionkey, "left")
    held = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return joined.groupBy("r_regionkey").agg(F.transform(held, lambda e: e["n_name"]).alias("names"))


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS kinds FROM orders GROUP BY ALL")
def agg_array_distinct(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("kinds"))


_SUMS = "count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2 FROM lineitem"


def _grouped(kind):
    def run(spark, sf):
        df = t(spark, sf, "lineitem")
        g = df.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus") if kind == "sets" else getattr(df, kind)("l_returnflag", "l_linestatus")
        return g.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))

    return run


for _kind, _by in (("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    Q[f"agg_{_kind}"] = (_grouped(_kind), f"SELECT l_returnflag, l_linestatus, {_SUMS} GROUP BY {_by}")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


# windows

_TOTAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_BY = f"PARTITION BY l_returnflag ORDER BY {', '.join(_TOTAL)}"


def _line(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", *_TOTAL)


_FLAG = ["l_returnflag"]


def _unique():
    return slices.within(_FLAG).orderBy(*_TOTAL)


def _key():
    return slices.within(_FLAG).orderBy("l_orderkey")


def _sliced(spark, sf, back: int, ahead: int):
    """Lines in slices of their order, with the rows before and behind each."""
    return slices.near(slices.cut(_line(spark, sf), _FLAG, _TOTAL), _FLAG, _TOTAL, back, ahead)


def _own(rows, *columns):
    return rows.select("_own", *columns).where("_own").drop("_own")


@query(f"""
SELECT l_orderkey, l_linenumber, row_number() OVER u AS rn, rank() OVER k AS rk, dense_rank() OVER k AS dr, round(percent_rank() OVER k, 9) AS pr, round(cume_dist() OVER k, 9) AS cd,
  ntile(7) OVER u AS nt FROM lineitem WINDOW u AS ({_BY}), k AS (PARTITION BY l_returnflag ORDER BY l_orderkey)""")
def win_rank(spark, sf):
    rows = slices.cut(_line(spark, sf), _FLAG, ["l_orderkey"])
    found = slices.met(rows, slices.sums(rows, _FLAG, n=F.count("*"), keys=F.count_distinct(F.struct("l_orderkey"))), _FLAG)
    ranked = found.select(
        "l_orderkey",
        "l_linenumber",
        "n_all",
        (F.row_number().over(_unique()) + F.col("n")).alias("rn"),
        (F.rank().over(_key()) + F.col("n")).alias("rk"),
        (F.dense_rank().over(_key()) + F.col("keys")).alias("dr"),
        (F.count("*").over(_key()) + F.col("n")).alias("upto"),
    )
    # of 7 buckets the first n % 7 have a row more
    ranked = ranked.withColumns({"least": F.expr("n_all div 7"), "more": F.expr("n_all % 7")}).withColumn("wide", F.expr("more * (least + 1)"))
    return ranked.select(
        "l_orderkey",
        "l_linenumber",
        "rn",
        "rk",
        "dr",
        F.round(F.when(F.col("n_all") > 1, (F.col("rk") - 1) / (F.col("n_all") - 1)).otherwise(0.0), 9).alias("pr"),
        F.round(F.col("upto") / F.col("n_all"), 9).alias("cd"),
        F.expr("CASE WHEN rn <= wide THEN (rn - 1) div (least + 1) ELSE more + (rn - 1 - wide) div least END + 1").alias("nt"),
    )


@query(f"SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS lag1, lag(l_quantity, 2, -1) OVER w AS lag2, lead(l_quantity, 3) OVER w AS lead3 FROM lineitem WINDOW w AS ({_BY})")
def win_lag_lead(spark, sf):
    return _own(_sliced(spark, sf, 2, 3), "l_orderkey", "l_linenumber", F.lag("l_quantity").over(_unique()).alias("lag1"), F.lag("l_quantity", 2, -1.0).over(_unique()).alias("lag2"), F.lead("l_quantity", 3).over(_unique()).alias("lead3"))


@query(f"SELECT l_orderkey, l_linenumber, first_value(l_quantity) OVER w AS f, last_value(l_quantity) OVER w AS l, nth_value(l_quantity, 2) OVER w AS n2 FROM lineitem WINDOW w AS ({_BY} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def win_first_last_nth(spark, sf):
    w = _unique().rowsBetween(-2, 1)
    return _own(_sliced(spark, sf, 2, 1), "l_orderkey", "l_linenumber", F.first("l_quantity").over(w).alias("f"), F.last("l_quantity").over(w).alias("l"), F.nth_value("l_quantity", 2).over(w).alias("n2"))


@query(f"SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, min(l_quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lo, round(avg(l_quantity) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 6) AS ahead FROM lineitem WINDOW w AS ({_BY})")
def win_rows(spark, sf):
    q = F.col("l_quantity")
    rows = slices.cut(_line(spark, sf), _FLAG, _TOTAL)
    before = slices.sums(rows, _FLAG, total=F.sum(q), values=F.count(q))
    return _own(
        slices.met(slices.near(rows, _FLAG, _TOTAL, 3, 4), before, _FLAG),
        "l_orderkey",
        "l_linenumber",
        F.round(slices.running(q, _unique().rowsBetween(W.unboundedPreceding, 0), "total", "values"), 2).alias("running"),
        F.min(q).over(_unique().rowsBetween(-3, 3)).alias("lo"),
        F.round(F.avg(q).over(_unique().rowsBetween(1, 4)), 6).alias("ahead"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey RANGE BETWEEN 10 PRECEDING AND 5 FOLLOWING) AS near, round(sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey), 2) AS peers FROM lineitem")
def win_range(spark, sf):
    q = F.col("l_quantity")
    rows = slices.cut(_line(spark, sf), _FLAG, ["l_orderkey"])
    before = slices.sums(rows, _FLAG, total=F.sum(q), values=F.count(q))
    return _own(
        slices.met(slices.near_values(rows, _FLAG, "l_orderkey", 10, 5), before, _FLAG),
        "l_orderkey",
        "l_linenumber",
        F.count("*").over(_key().rangeBetween(-10, 5)).alias("near"),
        F.round(slices.running(q, _key(), "total", "values"), 2).alias("peers"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
def win_groups(spark, sf):
    return O.over_groups(_line(spark, sf), ["l_returnflag"], "l_orderkey", -1, 1, near=F.count("*")).select("l_orderkey", "l_linenumber", "near")


@query("SELECT DISTINCT l_returnflag, round(sum(l_quantity) OVER (PARTITION BY l_returnflag), 2) AS whole FROM lineitem")
def win_whole_partition(spark, sf):
    """A window over whole partitions says the same in all of a partition's rows, so what differs is an aggregate."""
    return _line(spark, sf).groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("whole"))


# sort, limit, set operations, unnest


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(O.order("o_totalprice", True), O.order("o_orderkey"))
    return O.limit(df, 5, 20)


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k ASC NULLS LAST, n_nationkey LIMIT 22")
def sort_nulls_last(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k")).orderBy(O.order("k"), "n_nationkey").limit(22)


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_nationkey LIMIT 7")
def sort_nulls_first(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.nullif(F.col("n_regionkey"), F.lit(2)).alias("k")).orderBy(O.order("k", True), "n_nationkey").limit(7)


def _debtors(spark, sf):
    """All lines' suppliers, and the suppliers in debt or without a key."""
    x = t(spark, sf, "lineitem").select(F.nullif(F.col("l_suppkey"), F.lit(3)).alias("k"))
    return x, t(spark, sf, "supplier").select(F.nullif(F.col("s_suppkey"), F.lit(3)).alias("k"), "s_acctbal").where("k is null or s_acctbal < 0").select("k")


_X, _Z = "(SELECT nullif(l_suppkey, 3) AS k FROM lineitem)", "(SELECT k FROM (SELECT nullif(s_suppkey, 3) AS k, s_acctbal FROM supplier) WHERE k IS NULL OR s_acctbal < 0)"


@query(f"SELECT k FROM {_X} UNION ALL SELECT k FROM {_Z}")
def set_union_all(spark, sf):
    x, z = _debtors(spark, sf)
    return x.union(z)


@query(f"SELECT k FROM {_X} UNION SELECT k FROM {_Z}")
def set_union(spark, sf):
    x, z = _debtors(spark, sf)
    return x.union(z).distinct()


@query(f"SELECT k FROM {_X} INTERSECT SELECT k FROM {_Z}")
def set_intersect(spark, sf):
    return O.intersect(*_debtors(spark, sf), keep_all=False)


@query(f"SELECT x.k FROM {_X} x WHERE EXISTS (SELECT 1 FROM {_Z} z WHERE x.k IS NOT DISTINCT FROM z.k)")
def set_intersect_all(spark, sf):
    return O.intersect(*_debtors(spark, sf))


@query(f"SELECT k FROM {_X} EXCEPT SELECT k FROM {_Z}")
def set_except(spark, sf):
    return O.subtract(*_debtors(spark, sf), keep_all=False)


@query(f"SELECT x.k FROM {_X} x WHERE NOT EXISTS (SELECT 1 FROM {_Z} z WHERE x.k IS NOT DISTINCT FROM z.k)")
def set_except_all(spark, sf):
    return O.subtract(*_debtors(spark, sf))


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def unnest_list(spark, sf):
    return O.unnest(t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x")), "x")


@query("SELECT vec_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS x FROM (SELECT vec_id, list_filter(embedding, lambda v: v > 0.3) AS x FROM embeddings)")
def unnest_list_empty(spark, sf):
    """Large components only: vectors without one keep a row."""
    large = F.filter("embedding", lambda v: v > F.lit(0.3))
    return O.unnest(t(spark, sf, "embeddings").select("vec_id", large.alias("x")), "x")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL")
def repartition_distribute(spark, sf):
    return t(spark, sf, "lineitem").repartition("l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))
