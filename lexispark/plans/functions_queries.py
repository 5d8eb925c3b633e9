"""Every scalar function, with SQL that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexispark.functions import parity as P
from lexispark.sources.tables import table as t

Q: dict = {}


def query(sql: str | None):
    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


@query("""
SELECT l_orderkey, l_linenumber, abs(x) AS f_abs, round(acos(y), 9) AS f_acos, round(asin(y), 9) AS f_asin, round(atan(x), 9) AS f_atan, round(atan2(x, y + 2), 9) AS f_atan2, ceil(x) AS f_ceil,
  round(cos(x), 9) AS f_cos, round(exp(y), 9) AS f_exp, floor(x) AS f_floor, round(ln(z), 9) AS f_ln, round(log10(z), 9) AS f_log, round(log2(z) / 3, 9) AS f_log8, round(log10(z), 9) AS f_log10, round(log2(z), 9) AS f_log2,
  round(pow(y, 3), 9) AS f_pow, CAST(l_linenumber * l_linenumber AS BIGINT) AS f_ipow, round(x) AS f_round, CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS f_signum, round(sin(x), 9) AS f_sin, round(sqrt(z), 9) AS f_sqrt, round(tan(y), 9) AS f_tan, trunc(x) AS f_trunc
FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25.5 AS x, l_discount - 0.05 AS y, l_quantity AS z FROM lineitem)""")
def fn_math(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r = lambda c: F.round(c, 9)
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25.5).alias("x"), (F.col("l_discount") - 0.05).alias("y"), F.col("l_quantity").alias("z"))
    return df.select(
        "l_orderkey", "l_linenumber", F.abs(x).alias("f_abs"), r(F.acos(y)).alias("f_acos"), r(F.asin(y)).alias("f_asin"), r(F.atan(x)).alias("f_atan"), r(F.atan2(x, y + 2)).alias("f_atan2"), P.ceil(x).alias("f_ceil"),
        r(F.cos(x)).alias("f_cos"), r(F.exp(y)).alias("f_exp"), P.floor(x).alias("f_floor"), r(P.ln(z)).alias("f_ln"), r(P.log(z)).alias("f_log"), r(P.log(F.lit(8.0), z)).alias("f_log8"), r(F.log10(z)).alias("f_log10"), r(F.log2(z)).alias("f_log2"),
        r(P.power(y, F.lit(3))).alias("f_pow"), P.power(F.col("l_linenumber"), F.lit(2), integers=True).alias("f_ipow"), P.round_(x).alias("f_round"), P.signum(x).alias("f_signum"), r(F.sin(x)).alias("f_sin"), r(F.sqrt(z)).alias("f_sqrt"), r(F.tan(y)).alias("f_tan"), P.trunc(x).alias("f_trunc"),
    )


@query("""
SELECT p_partkey, ascii(p_name) AS f_ascii, CAST(bit_length(p_name) AS INTEGER) AS f_bits, trim(s, 'xy ') AS f_btrim, CAST(length(p_name) AS INTEGER) AS f_len, chr(233 + p_size) AS f_chr, concat(p_name, n, 'z') AS f_concat,
  concat_ws('-', p_name, n, 'z') AS f_ws, left(p_name, 3) AS f_left, left(p_name, -3) AS f_left_neg, lower(p_type) AS f_lower, lpad(p_brand, 12, '*') AS f_lpad, ltrim(s) AS f_ltrim, CAST(strlen(p_name) AS INTEGER) AS f_octets,
  repeat(p_brand, 2) AS f_repeat, replace(p_name, 'a', 'AA') AS f_replace, reverse(p_name) AS f_reverse, right(p_name, 4) AS f_right, right(p_name, -4) AS f_right_neg, rpad(p_brand, 12, '*') AS f_rpad, rtrim(s) AS f_rtrim,
  split_part(p_type, ' ', 2) AS f_split, split_part(p_type, ' ', 9) AS f_split_out, starts_with(p_name, 'p') AS f_starts, CAST(instr(p_name, 'a') AS INTEGER) AS f_strpos, substr(p_name, 2) AS f_substr, substr(p_name, 2, 3) AS f_substr3,
  substr(p_name, 1, 2) AS f_substr_zero, lower(to_hex(p_partkey)) AS f_hex, translate(p_name, 'abc', 'xy') AS f_translate, trim(s) AS f_trim, upper(p_name) AS f_upper
FROM (SELECT *, '  yx' || p_name || 'x ' AS s, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS n FROM part)""")
def fn_string(spark, sf):
    name, s, n = F.col("p_name"), F.col("s"), F.col("n")
    df = t(spark, sf, "part").withColumns({"s": F.concat(F.lit("  yx"), "p_name", F.lit("x ")), "n": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))})
    return df.select(
        "p_partkey", F.ascii(name).alias("f_ascii"), F.bit_length(name).alias("f_bits"), F.btrim(s, F.lit("xy ")).alias("f_btrim"), F.char_length(name).alias("f_len"), P.chr_(F.col("p_size") + 233).alias("f_chr"), P.concat(name, n, F.lit("z")).alias("f_concat"),
        F.concat_ws("-", name, n, F.lit("z")).alias("f_ws"), P.left(name, 3).alias("f_left"), P.left(name, -3).alias("f_left_neg"), F.lower("p_type").alias("f_lower"), F.lpad("p_brand", 12, "*").alias("f_lpad"), P.ltrim(s).alias("f_ltrim"), F.octet_length(name).alias("f_octets"),
        F.repeat("p_brand", 2).alias("f_repeat"), F.replace(name, F.lit("a"), F.lit("AA")).alias("f_replace"), F.reverse(name).alias("f_reverse"), P.right(name, 4).alias("f_right"), P.right(name, -4).alias("f_right_neg"), F.rpad("p_brand", 12, "*").alias("f_rpad"), P.rtrim(s).alias("f_rtrim"),
        P.split_part(F.col("p_type"), " ", 2).alias("f_split"), P.split_part(F.col("p_type"), " ", 9).alias("f_split_out"), F.startswith(name, F.lit("p")).alias("f_starts"), P.strpos(name, F.lit("a")).alias("f_strpos"), P.substr(name, 2).alias("f_substr"), P.substr(name, 2, 3).alias("f_substr3"),
        P.substr(name, 0, 3).alias("f_substr_zero"), P.to_hex(F.col("p_partkey")).alias("f_hex"), F.translate(name, "abc", "xy").alias("f_translate"), F.trim(s).alias("f_trim"), F.upper(name).alias("f_upper"),
    )


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(\w+) (\w+)') THEN [regexp_extract(p_type, '(\w+) (\w+)', 1), regexp_extract(p_type, '(\w+) (\w+)', 2)] END AS f_match,
  CASE WHEN regexp_matches(p_type, '(?i)^E\w*') THEN [regexp_extract(p_type, '(?i)^E\w*')] END AS f_match_flag, regexp_replace(p_name, '[aeiou]', '_') AS f_first, regexp_replace(p_name, '[aeiou]', '_', 'g') AS f_all,
  regexp_replace(p_name, '(\w)(\w)', '\2\1') AS f_swap FROM part""")
def fn_regex(spark, sf):
    name, kind = F.col("p_name"), F.col("p_type")
    return t(spark, sf, "part").select(
        "p_partkey",
        P.regexp_match(kind, r"(\w+) (\w+)").alias("f_match"),
        P.regexp_match(kind, r"^E\w*", "i").alias("f_match_flag"),
        P.regexp_replace(name, "[aeiou]", "_").alias("f_first"),
        P.regexp_replace(name, "[aeiou]", "_", "g").alias("f_all"),
        P.regexp_replace(name, r"(\w)(\w)", r"\2\1").alias("f_swap"),
    )


@query("SELECT p_partkey, md5(p_name) AS f_md5, sha256(p_name) AS f_sha256 FROM part")
def fn_crypto(spark, sf):
    name = F.col("p_name")
    return t(spark, sf, "part").select("p_partkey", F.md5(name).alias("f_md5"), F.lower(F.hex(P.digest(name, "sha256"))).alias("f_sha256"))


@query("""
SELECT event_id, CAST(year(ts) AS DOUBLE) AS d_year, CAST(quarter(ts) AS DOUBLE) AS d_quarter, CAST(month(ts) AS DOUBLE) AS d_month, CAST(week(ts) AS DOUBLE) AS d_week, CAST(day(ts) AS DOUBLE) AS d_day, CAST(dayofyear(ts) AS DOUBLE) AS d_doy, CAST(dayofweek(ts) AS DOUBLE) AS d_dow,
  CAST(hour(ts) AS DOUBLE) AS d_hour, CAST(minute(ts) AS DOUBLE) AS d_minute, microsecond(ts) / 1e6 AS d_second, microsecond(ts) / 1e3 AS d_millisecond, CAST(microsecond(ts) AS DOUBLE) AS d_microsecond,
  strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS t_week, strftime(date_trunc('quarter', ts), '%Y-%m-%d %H:%M:%S') AS t_quarter, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS t_hour,
  strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01 00:02:30'), '%Y-%m-%d %H:%M:%S') AS binned FROM events""")
def fn_date(spark, sf):
    ts = F.col("ts")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    parts = ("year", "quarter", "month", "week", "day", "doy", "dow", "hour", "minute", "second", "millisecond", "microsecond")
    origin = F.lit("2001-01-01 00:02:30").cast("timestamp")
    return t(spark, sf, "events").select(
        "event_id", *[P.date_part(p, ts).alias(f"d_{p}") for p in parts], *[text(F.date_trunc(p, ts)).alias(f"t_{p}") for p in ("week", "quarter", "hour")], text(P.date_bin(15 * 60 * 1_000_000, ts, origin)).alias("binned")
    )


@query("""
SELECT o_orderkey, epoch_us(to_timestamp(o_orderkey)::TIMESTAMP) AS secs, o_orderkey * 1000 AS millis, o_orderkey AS micros, o_orderkey * 1000000 AS unixtime, 1704164645000000 AS parsed FROM orders""")
def fn_timestamps(spark, sf):
    k, us = F.col("o_orderkey"), F.unix_micros
    return t(spark, sf, "orders").select(
        k, us(F.timestamp_seconds(k)).alias("secs"), us(F.timestamp_millis(k)).alias("millis"), us(F.timestamp_micros(k)).alias("micros"), us(P.from_unixtime(k)).alias("unixtime"), us(F.to_timestamp(F.lit("2024-01-02T03:04:05"))).alias("parsed")
    )


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS c, nullif(o_orderkey, 5) AS n FROM orders")
def fn_conditional(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit("open")).alias("c"), F.nullif(F.col("o_orderkey"), F.lit(5)).alias("n"))


@query("SELECT n_nationkey, [n_name, 'x'] AS arr, n_name AS c0, n_regionkey AS c1, 'Utf8' AS kind FROM nation")
def fn_array_struct(spark, sf):
    df = t(spark, sf, "nation").select("n_nationkey", F.array("n_name", F.lit("x")).alias("arr"), P.struct(F.col("n_name"), F.col("n_regionkey")).alias("s"), P.arrow_typeof(F.col("n_name")).alias("kind"))
    return df.select("n_nationkey", "arr", "s.c0", "s.c1", "kind")


@query("SELECT c_custkey, c_acctbal * 1.1 AS up FROM customer")
def udf_scalar(spark, sf):
    @F.pandas_udf("double")
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.1

    return t(spark, sf, "customer").select("c_custkey", raised("c_acctbal").alias("up"))


@query("SELECT c_mktsegment, round(sqrt(avg(c_acctbal * c_acctbal)), 4) AS rms FROM customer GROUP BY ALL")
def udf_aggregate(spark, sf):
    @F.pandas_udf("double")
    def rms(x: pd.Series) -> float:
        return float((x * x).mean() ** 0.5)

    return t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(rms("c_acctbal"), 4).alias("rms"))


