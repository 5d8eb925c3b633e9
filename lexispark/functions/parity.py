"""Scalar functions whose meaning differs from Spark's of the same name.

Each takes and gives columns and is made of built-in functions, so plans stay
in generated code; the two that can't be are marked.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions import blake3


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# numbers


def ceil(x: Column) -> Column:
    """As a double."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    """As a double."""
    return F.floor(x).cast("double")


def trunc(x: Column) -> Column:
    """Towards zero, as a double."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def ln(x: Column) -> Column:
    """NaN below zero and -inf at zero."""
    x = x.cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def log(*args: Column) -> Column:
    """log(x) is to base 10; log(b, x) to base b."""
    return F.log10(args[0]) if len(args) == 1 else F.log(args[1]) / F.log(args[0])


def power(x: Column, y: Column, integers: bool = False) -> Column:
    """Of integers an integer, of anything else a double."""
    return F.pow(x, y).cast("long") if integers else F.pow(x, y)


def round_(x: Column) -> Column:
    """Half away from zero, no places."""
    return F.round(x.cast("double"), 0)


def signum(x: Column) -> Column:
    """1 for zero, as for all that is not negative."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x))


def int_div(a: Column, b: Column) -> Column:
    """Integer / integer stays an integer, cut towards zero."""
    return F.call_function("div", a, b)


# strings


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def chr_(n: Column) -> Column:
    """Any code point; 0 and what is no code point raise an error."""
    bad = (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    tail = lambda shift: F.shiftright(n, shift).bitwiseAND(0x3F).bitwiseOR(0x80)
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    utf8 = (
        F.when(n < 0x80, two(n))
        .when(n < 0x800, F.concat(two(F.shiftright(n, 6).bitwiseOR(0xC0)), two(tail(0))))
        .when(n < 0x10000, F.concat(two(F.shiftright(n, 12).bitwiseOR(0xE0)), two(tail(6)), two(tail(0))))
        .otherwise(F.concat(two(F.shiftright(n, 18).bitwiseOR(0xF0)), two(tail(12)), two(tail(6)), two(tail(0))))
    )
    return F.when(bad, F.raise_error(F.lit("not a code point")).cast("string")).otherwise(F.decode(F.unhex(utf8), "UTF-8"))


def initcap(s: Column) -> Column:
    """A word is a run of letters and digits."""
    runs = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2147483647)))), "")


def left(s: Column, n: Column) -> Column:
    """n < 0: all but the last -n characters."""
    n = _col(n)
    return F.when(n >= 0, F.substring(s, F.lit(1), n)).otherwise(F.substring(s, F.lit(1), F.greatest(F.char_length(s) + n, F.lit(0))))


def right(s: Column, n: Column) -> Column:
    """n < 0: all but the first -n characters."""
    n = _col(n)
    keep = F.when(n >= 0, F.least(n, F.char_length(s))).otherwise(F.greatest(F.char_length(s) + n, F.lit(0)))
    return F.substring(s, F.char_length(s) - keep + 1, keep)


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """Places before the first count, but give nothing; a negative length raises an error."""
    start = _col(start)
    if length is None:
        return F.substring(s, F.greatest(start, F.lit(1)), F.lit(2147483647))
    length = _col(length)
    stop = start + length
    begin = F.greatest(start, F.lit(1))
    return F.when(length < 0, F.raise_error(F.lit("negative length")).cast("string")).otherwise(F.substring(s, begin, F.greatest(stop - begin, F.lit(0))))


def split_part(s: Column, delimiter: Column, n: Column) -> Column:
    """Parts from 1; beyond the last an empty string; n < 1 raises an error."""
    n = _col(n)
    return F.when(n < 1, F.raise_error(F.lit("n must be at least 1")).cast("string")).otherwise(F.split_part(s, _col(delimiter), n))


def strpos(s: Column, part: Column) -> Column:
    return F.locate(part, s) if isinstance(part, str) else F.call_function("instr", s, part)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def ltrim(s: Column, chars: str | None = None) -> Column:
    return F.ltrim(s) if chars is None else F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str | None = None) -> Column:
    return F.rtrim(s) if chars is None else F.rtrim(s, F.lit(chars))


# regular expressions


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\\[pP]\{\w+\}", "a", pattern)).groups


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """The capture groups of the first match (the match itself if there are none); null without a match."""
    if "g" in flags:
        raise ValueError("regexp_match takes no flag g")
    full = f"(?{flags}){pattern}" if flags else pattern
    n = _groups(pattern)
    found = [F.regexp_extract(s, full, k) for k in range(1, n + 1)] or [F.regexp_extract(s, full, 0)]
    return F.when(s.rlike(full), F.array(*found))


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    r"""The first match only, unless flags has g; \1 in the replacement is the first group."""
    inner = "".join(f for f in flags if f != "g")
    head = f"(?{inner})" if inner else ""
    if "g" in flags:
        return F.regexp_replace(s, head + pattern, re.sub(r"\\(\d)", r"$\1", replacement))
    shifted = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", replacement)
    return F.regexp_replace(s, f"(?s)^(.*?){'(?-s)'}{head}(?:{pattern})", "$1" + shifted)


# digests


def sha(s: Column, bits: int) -> Column:
    """SHA-2 as binary: 224, 256, 384 or 512 bits."""
    return F.unhex(F.sha2(s, bits))


def digest(s: Column, algorithm: str) -> Column:
    """Binary digest by md5, sha224, sha256, sha384, sha512, blake2s, blake2b or blake3 (the last three in Python)."""
    if algorithm == "md5":
        return F.unhex(F.md5(s))
    if algorithm.startswith("sha"):
        return sha(s, int(algorithm[3:]))
    if algorithm not in ("blake2s", "blake2b", "blake3"):
        raise ValueError(f"no algorithm {algorithm!r}")
    one = blake3.digest if algorithm == "blake3" else lambda data: hashlib.new(algorithm, data).digest()

    @F.pandas_udf("binary")
    def blake(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v.encode() if isinstance(v, str) else bytes(v)))

    return blake(s)


# dates


def date_part(part: str, ts: Column) -> Column:
    """As a double; dow counts from 0 on Sunday; smaller units include the whole seconds."""
    micros = F.unix_micros(ts.cast("timestamp"))
    second = F.pmod(micros, F.lit(60_000_000))
    special = {
        "dow": lambda: F.dayofweek(ts) - 1,
        "doy": lambda: F.dayofyear(ts),
        "second": lambda: F.expr("0") + second / 1e6,
        "millisecond": lambda: second / 1e3,
        "microsecond": lambda: second,
        "nanosecond": lambda: second * 1000,
        "epoch": lambda: micros / 1e6,
    }
    value = special[part]() if part in special else F.date_part(F.lit(part), ts)
    return value.cast("double")


def date_bin(step_micros: int, ts: Column, origin: Column) -> Column:
    """The begin of the bin of `step_micros` that ts lies in, counted from origin."""
    at, zero = F.unix_micros(ts.cast("timestamp")), F.unix_micros(origin.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - zero, F.lit(step_micros)))


def from_unixtime(seconds: Column) -> Column:
    """A timestamp."""
    return F.timestamp_seconds(seconds)


def current_time() -> Column:
    return F.date_format(F.now(), "HH:mm:ss.SSSSSS")


# arrays, structs, types


def struct(*fields: Column) -> Column:
    """Fields are named c0, c1, …"""
    return F.struct(*[f.alias(f"c{k}") for k, f in enumerate(fields)])


def array_agg(x: Column) -> Column:
    """Nulls are kept."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda e: e["x"])


def median(x: Column, kind: str) -> Column:
    """In the input's type: of an even number of integers the middle is cut to an integer."""
    return F.median(x).cast(kind)


def index(array: Column, n: int) -> Column:
    """a[n], from 1; null outside."""
    return F.try_element_at(array, F.lit(n))


_ARROW = {"bigint": "Int64", "int": "Int32", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32", "string": "Utf8", "boolean": "Boolean", "binary": "Binary", "date": "Date32", "void": "Null"}


def arrow_typeof(x: Column) -> Column:
    """The columnar library's name of a type."""
    names = F.create_map(*[F.lit(v) for pair in _ARROW.items() for v in pair])
    return F.coalesce(F.try_element_at(names, F.typeof(x)), F.typeof(x))
