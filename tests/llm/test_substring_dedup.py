from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from lexispark.llm import substring_dedup as sd

DDL = "doc_id bigint, text string, begin string"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DDL)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.cut(df, texts=False, **how).collect()), key=str)


def corpus(rng):
    def text(n, vocabulary=9):
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    passage = text(60, 500)
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, passage), (6, f"a b {passage}\n c  d"), (7, text(34, 3)), (8, "x " * 200), (9, "é ü " * 40)]
    rows += [(10 + k, text(rng.randrange(5, 90), 400) + " " + passage[: rng.randrange(200)]) for k in range(20)]
    rows += [(100, passage), (100, passage), (None, passage), (None, text(80, 2)), (101, text(80, 2))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    assert run(spark, rows) == brute(rows, 35)


def test_other_windows_and_overflow(spark):
    rows = corpus(random.Random(3))
    assert run(spark, rows, window=6, seed=3, limits=sd.Limits(50, 20, often=3, contexts=5, context_bytes=300)) == brute(rows, 6)


@pytest.mark.parametrize("bits", [1, 6])
def test_collisions_of_hashes(spark, bits):
    """Nothing rests on hashes: with next to none of their bits the result is the same."""
    rows = corpus(random.Random(5))
    assert run(spark, rows, limits=sd.Limits(hash_bits=bits)) == brute(rows, 35)
    assert run(spark, rows, window=6, seed=3, limits=sd.Limits(200, often=8, hash_bits=bits)) == brute(rows, 6)


def test_words_that_share_a_polynomial_hash(spark):
    """Two words whose hashes are equal for every odd base modulo 2**64."""
    a, b = "ab", "ba"
    for _ in range(10):
        a, b = a + b, b + a
    head = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{b} {head}"), (4, f"{a} {head}")]
    assert [r[2] for r in run(spark, rows)] == [0, 0, 0, 0] and run(spark, rows) == brute(rows, 35)


def test_hot_anchor(spark):
    """One line in every text, behind and before other words; some neighbourhoods repeat."""
    rng = random.Random(6)
    line = " ".join(f"h{k}" for k in range(30))
    rows = [(k, f"{' '.join(f'a{rng.randrange(3)}' for _ in range(rng.randrange(9)))} {line} {' '.join(f'b{rng.randrange(3)}' for _ in range(rng.randrange(9)))}") for k in range(400)]
    assert run(spark, rows, limits=sd.Limits(often=4)) == brute(rows, 35)
    assert run(spark, rows, limits=sd.Limits(task_windows=60, often=4, contexts=7, context_bytes=2000)) == brute(rows, 35)


def test_long_text_in_steps(spark):
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400))
    part = " ".join(long.split()[30:120])
    rows = [(1, long), (2, "start " + part + " end")]
    assert run(spark, rows, limits=sd.Limits(step=50)) == brute(rows, 35)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(sd.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, sd.op10_substring_dedup(spark, sf).select(*names).collect())) == sorted(want.fetchall())


def test_long_words_and_words_beyond_ascii(spark):
    rows = [(1, "é" * 3000 + " ü" * 40), (2, "x " + "é" * 3000 + " ü" * 40), (3, None)]
    assert run(spark, rows) == brute(rows, 35)
