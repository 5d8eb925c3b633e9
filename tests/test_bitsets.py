from __future__ import annotations

import random

import pytest

from lexispark.text import bitsets as B


def make(spark, values):
    return B.of(spark.createDataFrame([(v,) for v in values], "id bigint"))


def members(bitset):
    return sorted(r.id for r in B.ids(bitset).collect())


@pytest.fixture(scope="module")
def pair(spark):
    rng = random.Random(21)
    a = {rng.randrange(4000) for _ in range(900)} | {0, 63, 64, 127, 2**40, 2**40 + 63}
    b = {rng.randrange(4000) for _ in range(900)} | {63, 127, 2**40 + 63}
    return a, b, make(spark, [*a, *a, None]), make(spark, b)


def test_algebra(pair):
    a, b, x, y = pair
    assert members(x) == sorted(a) and B.size(x).first().n == len(a)
    for f, want in ((B.both, a & b), (B.either, a | b), (B.without, a - b), (B.one_of, a ^ b)):
        assert members(f(x, y)) == sorted(want), f.__name__
    assert members(B.any_of([x, y, x])) == sorted(a | b) and members(B.all_of([x, y, y])) == sorted(a & b)


def test_ranges_ranks_and_members(spark, pair):
    a, _, x, _ = pair
    for low, high in ((0, 0), (5, 70), (63, 64), (64, 127), (100, 3000), (2**40, 2**40 + 63)):
        assert members(B.between(x, low, high)) == [v for v in sorted(a) if low <= v <= high]
    assert sorted((r.id, r["rank"]) for r in B.rank(x).collect()) == [(v, k + 1) for k, v in enumerate(sorted(a))]
    nth = [0, 1, 100, len(a) - 1, len(a)]
    assert sorted((r.nth, r.id) for r in B.select(x, nth).collect()) == [(n, sorted(a)[n]) for n in nth[:-1]]
    asked = spark.createDataFrame([(v, "k") for v in (0, 1, 63, 10**9, None)], "id bigint, tag string")
    got = {r.id: r.has for r in B.contains(x, asked).collect()}
    assert got == {v: v in a for v in (0, 1, 63, 10**9, None)}


def test_empty(spark):
    none = make(spark, [])
    assert members(none) == [] and B.size(none).first().n == 0 and members(B.both(none, none)) == [] and B.rank(none).count() == 0
