from __future__ import annotations

import numpy as np
import pytest

from lexispark.llm import topk

DDL = "vec_id bigint, embedding array<float>, rank string"


def brute(rows, every=50, k=5):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **how):
    return sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, DDL), **how).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist(), "x") for i in range(400)]
    rows += [(500, None, "x"), (550, [0.1, None] + [0.0] * 14, "x"), (600, [float("nan")] * 16, "x"), (650, [float("inf")] * 16, "x"), (None, [0.5] * 16, "x")]
    rows += [(700 + i, [0.25] * 16, "x") for i in range(60)]  # ties
    rows += [(1, rows[1][1], "x"), (50, rows[50][1], "x"), (800, [0.5, -0.5], None), (850, [], None)]  # repeated rows, short vectors
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard=64, block=3, k=3) == brute(rows, k=3)


def test_tiles(spark, monkeypatch):
    """Many shards and blocks in few tiles, so that thresholds go from shard to shard; and tiles cover the table."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 0.2, 8) + (i % 7) / 10).astype(np.float32).tolist(), "x") for i in range(900)]
    monkeypatch.setattr(topk, "TILE_SHARDS", 5)
    monkeypatch.setattr(topk, "TILE_BLOCKS", 2)
    assert run(spark, rows, every=10, shard=16, block=4) == brute(rows, every=10)
    assert topk._tiles(57, 23, 4) == (12, 12) and topk._tiles(7, 3, 12) == (6, 2) and topk._tiles(1, 1, 12) == (1, 1)


def test_scores_beyond_a_long_fail(spark):
    rows = [(0, [3e30, 1.0], "x"), (1, [3e30, 1.0], "x")]
    with pytest.raises(Exception, match="(?i)overflow|too large|out of"):
        run(spark, rows)


def test_large_values_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 8) * 2.0**20).astype(np.float32).tolist(), "x") for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0], "x"), (1, [2.0], "x")]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(1, [1.0], "x")]) == []
    assert run(spark, []) == []
