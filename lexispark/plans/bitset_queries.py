"""Set algebra on bitsets of order and part keys, with SQL over the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexispark.shared import scratch
from lexispark.sources.tables import table as t
from lexispark.text import bitsets as B

Q: dict = {}

_A, _B, _C = "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'"


def query(sql: str | None):
    def keep(run):
        Q[run.__name__] = (run, sql)
        return run

    return keep


def _sets(spark, sf):
    lines, orders = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    return (
        B.of(lines.where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))),
        B.of(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))),
        B.of(lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))),
    )


@query(f"SELECT id FROM ({_A}) INTERSECT SELECT id FROM ({_B})")
def bitset_and(spark, sf):
    a, b, _ = _sets(spark, sf)
    return B.ids(B.both(a, b))


@query(f"SELECT id FROM ({_A}) UNION SELECT id FROM ({_B})")
def bitset_or(spark, sf):
    a, b, _ = _sets(spark, sf)
    return B.ids(B.either(a, b))


@query(f"SELECT id FROM ({_A}) EXCEPT SELECT id FROM ({_B})")
def bitset_sub(spark, sf):
    a, b, _ = _sets(spark, sf)
    return B.ids(B.without(a, b))


@query(f"SELECT coalesce(a.id, b.id) AS id FROM ({_A}) a FULL JOIN ({_B}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def bitset_xor(spark, sf):
    a, b, _ = _sets(spark, sf)
    return B.ids(B.one_of(a, b))


@query(f"SELECT 'all' AS kind, count(*) AS n FROM (SELECT id FROM ({_A}) INTERSECT SELECT id FROM ({_B}) INTERSECT SELECT id FROM ({_C})) UNION ALL SELECT 'any', count(*) FROM (SELECT id FROM ({_A}) UNION SELECT id FROM ({_B}) UNION SELECT id FROM ({_C}))")
def bitset_many(spark, sf):
    sets = list(_sets(spark, sf))
    return B.size(B.all_of(sets)).select(F.lit("all").alias("kind"), "n").union(B.size(B.any_of(sets)).select(F.lit("any").alias("kind"), "n"))


@query(f"SELECT id FROM ({_A}) WHERE id BETWEEN 100 AND 1000")
def bitset_range(spark, sf):
    return B.ids(B.between(_sets(spark, sf)[0], 100, 1000))


@query(f"SELECT p_partkey AS id, p_partkey IN ({_A}) AS has FROM part")
def bitset_contains(spark, sf):
    return B.contains(_sets(spark, sf)[0], t(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query(f"SELECT id, row_number() OVER (ORDER BY id) AS rank FROM ({_A})")
def bitset_rank(spark, sf):
    return B.rank(_sets(spark, sf)[0])


@query(f"SELECT nth, id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nth FROM ({_A})) WHERE nth IN (0, 7, 70, 300)")
def bitset_select(spark, sf):
    return B.select(_sets(spark, sf)[0], [0, 7, 70, 300, 10**15])


@query(_A)
def bitset_saved(spark, sf):
    """Serialised to a file and back."""
    path = scratch(spark, "bitset")
    B.save(_sets(spark, sf)[0], path)
    return B.ids(B.load(spark, path))


@query(f"SELECT id FROM ({_A}) UNION SELECT unnest(range(70, 1001)) AS id")
def bitset_with_range(spark, sf):
    return B.ids(B.with_range(_sets(spark, sf)[0], 70, 1000))


@query(f"SELECT id FROM ({_A}) WHERE id NOT BETWEEN 70 AND 1000")
def bitset_without_range(spark, sf):
    return B.ids(B.without_range(_sets(spark, sf)[0], 70, 1000))


def _related(a: str, b: str) -> str:
    return (
        f"SELECT count(*) FILTER (WHERE x.id IS NOT NULL AND y.id IS NULL) = 0 AS is_subset, count(*) FILTER (WHERE x.id IS NULL) = 0 AS is_superset, count(*) FILTER (WHERE x.id = y.id) = 0 AS is_disjoint, count(*) FILTER (WHERE x.id IS NULL OR y.id IS NULL) = 0 AS is_equal,"
        f" count(*) FILTER (WHERE x.id = y.id) AS n_and, count(*) AS n_or, count(*) FILTER (WHERE y.id IS NULL) AS n_sub, count(*) FILTER (WHERE x.id IS NULL OR y.id IS NULL) AS n_xor FROM ({a}) x FULL JOIN ({b}) y ON x.id = y.id"
    )


_ALL = "SELECT DISTINCT l_orderkey AS id FROM lineitem"


@query(" UNION ALL ".join(f"SELECT '{name}' AS pair, * FROM ({_related(a, b)})" for name, a, b in (("lines", _A, _C), ("subset", _A, _ALL), ("same", _B, _B), ("apart", _B, "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'"))))
def bitset_relation(spark, sf):
    """Subset, superset, disjoint, equal, and sizes, of four pairs of sets."""
    a, b, c = _sets(spark, sf)
    every = B.of(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))
    rest = B.of(t(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")))
    pairs = {"lines": (a, c), "subset": (a, every), "same": (b, b), "apart": (b, rest)}
    return reduce(lambda x, y: x.unionByName(y), [B.relation(x, y).select(F.lit(name).alias("pair"), "*") for name, (x, y) in pairs.items()])
