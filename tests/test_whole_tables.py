"""Queries over whole tables: every row of the input reaches the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.plans import catalog
from lexispark.sources.tables import table

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF)


def test_array_agg_keeps_every_order(spark):
    orders = table(spark, SF, "orders")
    found = run(spark, "agg_array_agg").select(F.sum("n"), F.sum(F.size("kept")), F.sum(F.expr("size(filter(kept, x -> x is null))"))).first()
    assert tuple(found) == (orders.count(), orders.count(), orders.where("o_orderstatus <> 'F'").count())


def test_min_max_reads_every_line(spark):
    lines = table(spark, SF, "lineitem")
    found = {r.l_returnflag: (r["mean"], r.first_day) for r in run(spark, "agg_min_max_types").collect()}
    assert found == {r.l_returnflag: (r.q / r.n, r.d) for r in lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.min("l_shipdate").alias("d")).collect()}


def test_outer_joins_lose_no_row(spark):
    customers, orders = table(spark, SF, "customer").count(), table(spark, SF, "orders").count()
    for how, c, o in (("left", customers, None), ("right", None, orders), ("full", customers, orders)):
        found = run(spark, f"join_{how}")
        sides = found.select(F.count_distinct("c_custkey"), F.count_distinct("o_orderkey"), F.count_if(F.col("c_custkey").isNull()), F.count_if(F.col("o_orderkey").isNull())).first()
        assert c is None or (sides[0] == c and sides[3] > 0)
        assert o is None or (sides[1] == o and sides[2] > 0)
        assert found.where("c_custkey is not null and o_orderkey is not null").count() > 0


def test_set_operations_meet_suppliers_of_any_key(spark):
    sf = "/root/testdata/sf0.01"  # no supplier of the smallest tables is in debt
    lines, suppliers, ask = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), catalog.queries()
    debtors = suppliers.where("s_suppkey = 3 or s_acctbal < 0")
    met, rest = ask["set_intersect_all"](spark, sf), ask["set_except_all"](spark, sf)
    assert met.count() == lines.join(debtors, F.expr("l_suppkey = s_suppkey")).count()
    assert met.where("k >= 9").count() > 0
    assert rest.count() == lines.count() - met.count()
    assert ask["set_union_all"](spark, sf).count() == lines.count() + debtors.count()


def test_unnest_gives_every_component(spark):
    vectors = table(spark, SF, "embeddings")
    all_of = vectors.select(F.sum(F.size("embedding"))).first()[0]
    assert run(spark, "unnest_list").count() == all_of
