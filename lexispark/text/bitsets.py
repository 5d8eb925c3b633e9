"""Sets of ids as tables of 64-bit words.

A set is (word, bits): word = id div 64, and bits has one bit for each id in
it; words without an id have no row. Set algebra is a join on word and one
bitwise operation, so two sets meet word by word and no id is unfolded. Rank
and select go by prefix sums of population counts, summed by blocks of words
first, so that no task ranks the whole set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = 64
#: Words of one block of prefix sums.
BLOCK_WORDS = 1 << 14


def _bit(k: Column) -> Column:
    """The word with bit k alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def of(ids: DataFrame, column: str = "id") -> DataFrame:
    """The set of a column's ids (0 or more); repeats count once, nulls are left out."""
    i = F.col(column).cast("long")
    kept = ids.where(i.isNotNull()).select(F.shiftright(i, 6).alias("word"), _bit(i.bitwiseAND(63)).alias("bit"))
    return kept.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def ids(bitset: DataFrame) -> DataFrame:
    """(id) of every member."""
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)).alias("k")
    return bitset.select("word", place).select((F.shiftleft("word", 6) + F.col("k")).alias("id"))


def _met(a: DataFrame, b: DataFrame, how: str, bits) -> DataFrame:
    joined = a.select("word", F.col("bits").alias("x")).join(b.select("word", F.col("bits").alias("y")), "word", how)
    zero = F.lit(0).cast("long")
    out: Column = bits(F.coalesce("x", zero), F.coalesce("y", zero))
    return joined.select("word", out.alias("bits")).where("bits <> 0")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b."""
    return _met(a, b, "inner", lambda x, y: x.bitwiseAND(y))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """a or b."""
    return _met(a, b, "full", lambda x, y: x.bitwiseOR(y))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """a but not b."""
    return _met(a, b, "left", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def one_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """a or b, but not both."""
    return _met(a, b, "full", lambda x, y: x.bitwiseXOR(y))


def any_of(sets: list[DataFrame]) -> DataFrame:
    """The union of many sets, in one shuffle."""
    return reduce(DataFrame.unionByName, sets).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def all_of(sets: list[DataFrame]) -> DataFrame:
    """What all of many sets have, in one shuffle."""
    met = reduce(DataFrame.unionByName, sets).groupBy("word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    return met.where((F.col("n") == len(sets)) & (F.col("bits") != 0)).select("word", "bits")


def size(bitset: DataFrame) -> DataFrame:
    """One row: n, the number of members."""
    return bitset.agg(F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("n"))


def between(bitset: DataFrame, low: int, high: int) -> DataFrame:
    """Members from low to high, both included; only the words that hold them are read."""
    first, last = low >> 6, high >> 6
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    head, tail = signed(((1 << 64) - 1) ^ ((1 << (low & 63)) - 1)), signed((1 << ((high & 63) + 1)) - 1)
    bits = F.col("bits")
    bits = F.when(F.col("word") == first, bits.bitwiseAND(F.lit(head))).otherwise(bits)
    bits = F.when(F.col("word") == last, bits.bitwiseAND(F.lit(tail))).otherwise(bits)
    return bitset.where(F.col("word").between(first, last)).select("word", bits.alias("bits")).where("bits <> 0")


def contains(bitset: DataFrame, asked: DataFrame, column: str = "id") -> DataFrame:
    """asked with `has`, whether its id is a member."""
    i = F.col(column).cast("long")
    met = asked.withColumn("word", F.shiftright(i, 6)).join(bitset, "word", "left")
    return met.select(*asked.columns, F.coalesce(F.getbit("bits", i.bitwiseAND(63).cast("int")) == 1, F.lit(False)).alias("has"))


def ranked(bitset: DataFrame) -> DataFrame:
    """(word, bits, before): how many members stand in smaller words."""
    placed = bitset.select("word", "bits", F.bit_count("bits").cast("long").alias("n"), F.expr(f"word div {BLOCK_WORDS}").alias("block"))
    sums = placed.groupBy("block").agg(F.sum("n").alias("n"))
    head = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("block", F.coalesce(F.sum("n").over(head), F.lit(0)).alias("base"))
    inside = W.partitionBy("block").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    counted = placed.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(base, "block").select("word", "bits", (F.col("base") + F.col("here")).alias("before"))


def rank(bitset: DataFrame) -> DataFrame:
    """(id, rank) of every member: how many members are not larger."""
    below = lambda k: F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), k)))
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)).alias("k")
    unfolded = ranked(bitset).select("word", "bits", "before", place)
    return unfolded.select((F.shiftleft("word", 6) + F.col("k")).alias("id"), (F.col("before") + F.bit_count(below(F.col("k"))) + 1).alias("rank"))


def select(bitset: DataFrame, nth: list[int]) -> DataFrame:
    """(nth, id) of the members at some ranks, from 0; ranks beyond the last give no row. Only words that hold one are unfolded."""
    asked = F.filter(F.array(*[F.lit(n).cast("long") for n in nth]), lambda n: (n >= F.col("before")) & (n < F.col("before") + F.bit_count("bits")))
    found = ranked(bitset).select("word", "bits", "before", F.explode(asked).alias("nth"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    return found.select("nth", (F.shiftleft("word", 6) + F.element_at(places, (F.col("nth") - F.col("before") + 1).cast("int"))).alias("id"))


def with_range(bitset: DataFrame, low: int, high: int) -> DataFrame:
    """The set with all ids from low to high, both included."""
    return any_of([bitset, _span(bitset.sparkSession, low, high)])


def without_range(bitset: DataFrame, low: int, high: int) -> DataFrame:
    """The set without any id from low to high, both included; words outside stay as they are."""
    first, last = low >> 6, high >> 6
    bits = F.col("bits").bitwiseAND(F.bitwise_not(_within(F.col("word"), low, high)))
    return bitset.select("word", F.when(F.col("word").between(first, last), bits).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")


def _within(word: Column, low: int, high: int) -> Column:
    """The bits of a word between low's and high's, which are low to high."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    head, tail = signed(((1 << 64) - 1) ^ ((1 << (low & 63)) - 1)), signed((1 << ((high & 63) + 1)) - 1)
    full = F.lit(-1).cast("long")
    return F.when(word == low >> 6, F.lit(head)).otherwise(full).bitwiseAND(F.when(word == high >> 6, F.lit(tail)).otherwise(full))


def _span(spark: SparkSession, low: int, high: int) -> DataFrame:
    if high < low:
        return spark.createDataFrame([], "word bigint, bits bigint")
    return spark.range(low >> 6, (high >> 6) + 1).select(F.col("id").alias("word"), _within(F.col("id"), low, high).alias("bits"))


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether a is a subset of b, a superset, disjoint from it, the same set; and the sizes of and, or, a without b, one of both."""
    x, y = F.coalesce("x", F.lit(0).cast("long")), F.coalesce("y", F.lit(0).cast("long"))
    met = a.select("word", F.col("bits").alias("x")).join(b.select("word", F.col("bits").alias("y")), "word", "full")

    def total(bits: Column) -> Column:
        return F.coalesce(F.sum(F.bit_count(bits).cast("long")), F.lit(0).cast("long"))

    counted = met.agg(total(x.bitwiseAND(y)).alias("n_and"), total(x.bitwiseOR(y)).alias("n_or"), total(x.bitwiseAND(F.bitwise_not(y))).alias("n_sub"), total(y.bitwiseAND(F.bitwise_not(x))).alias("n_over"))
    return counted.select(
        (F.col("n_sub") == 0).alias("is_subset"), (F.col("n_over") == 0).alias("is_superset"), (F.col("n_and") == 0).alias("is_disjoint"), (F.col("n_sub") + F.col("n_over") == 0).alias("is_equal"),
        "n_and", "n_or", "n_sub", (F.col("n_sub") + F.col("n_over")).alias("n_xor"),
    )


#: Words of one serialised chunk: 65,536 ids, 8 KB.
CHUNK_WORDS = 1024


def serialised(bitset: DataFrame) -> DataFrame:
    """(chunk, n, data): a row for each 65,536 ids that have a member; data is the chunk's 1,024 words, big-endian, lowest ids first, bit 0 of a word for its lowest id."""
    placed = bitset.select(F.expr(f"word div {CHUNK_WORDS}").alias("chunk"), F.pmod("word", F.lit(CHUNK_WORDS)).cast("int").alias("k"), "bits")
    held = placed.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("k", "bits"))).alias("words"), F.sum(F.bit_count("bits").cast("long")).alias("n"))
    hexes = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)), lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("words", k), F.lit(0).cast("long"))), 16, "0"))
    return held.select("chunk", "n", F.unhex(F.array_join(hexes, "")).alias("data"))


def deserialised(chunks: DataFrame) -> DataFrame:
    """The set that was serialised."""
    k = F.explode(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)))
    words = chunks.select("chunk", k.alias("k"), F.hex("data").alias("h")).select((F.col("chunk") * CHUNK_WORDS + F.col("k")).alias("word"), F.substring("h", F.col("k") * 16 + 1, F.lit(16)).alias("h"))
    # a word's halves, since a hexadecimal number of 16 digits is beyond a signed long
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    bits = F.call_function("shiftleft", half(1), F.lit(32)).bitwiseOR(half(9))
    return words.select("word", bits.alias("bits")).where("bits <> 0")


def save(bitset: DataFrame, path: str) -> None:
    serialised(bitset).write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return deserialised(spark.read.schema("chunk bigint, n bigint, data binary").parquet(path))
