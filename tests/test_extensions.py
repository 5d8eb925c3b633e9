"""Changing indexes under concurrent use, kept indexes, sources, functions and plans of one's own."""

from __future__ import annotations

import decimal
import importlib
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark import shared
from lexispark.functions import blake3, udfs
from lexispark.functions import parity as P
from lexispark.operators import extension as E
from lexispark.operators import frame as O
from lexispark.plans.engine_queries import Powers, Rms
from lexispark.sources import avro, custom
from lexispark.text import bitsets as B
from lexispark.text import segments
from lexispark.text.segments import MergePolicy, SegmentedIndex
from lexispark.text.store import IndexStore


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def found(index, query):
    return sorted(r.doc_id for r in index.search(query).collect())


def test_what_is_queued_during_a_flush_waits(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.add_documents(docs(spark, (1, "one")))
    write = SegmentedIndex._write

    def late(self, *args):
        if not self.segments():
            self.add_documents(docs(spark, (2, "one")))
        return write(self, *args)

    monkeypatch.setattr(SegmentedIndex, "_write", late)
    assert index.flush() and found(index, "one") == [1] and index.pending() == 1
    assert index.flush() and found(index, "one") == [1, 2] and index.pending() == 0
    assert not index.flush()


def test_the_last_version_of_a_call_counts(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.add_documents(docs(spark, (1, "old"), (2, "other"), (1, "new")).coalesce(1))
    index.flush()
    assert found(index, "new") == [1] and found(index, "old") == []


def test_readers_of_merged_segments_read_on(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", MergePolicy(at_least=99))
    for k in range(3):
        index.add_documents(docs(spark, (k, f"word w{k}")))
        index.flush()
    reading = index.search("word")
    index.compact()
    assert index.segment_num() == 1 and reading.count() == 3 and found(index, "word") == [0, 1, 2]
    assert index.vacuum() == 0
    assert index.vacuum(retention=-10) == 3 and found(index, "w1") == [1]


def test_deletes_and_flushes_during_a_merge(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", MergePolicy(at_least=99))
    for k in range(3):
        index.add_documents(docs(spark, (k, "word"), (10 + k, "word")))
        index.flush()
    write, merged = SegmentedIndex._write, []

    def meanwhile(self, seg, *args):
        write(self, seg, *args)
        if not merged:  # the merged files are there, the manifest isn't
            merged.append(seg)
            assert self.merging() == {1, 2, 3} and self.find_merges() == []
            self.delete_document(1)
            self.add_documents(docs(spark, (7, "word")))
            self.flush()

    monkeypatch.setattr(SegmentedIndex, "_write", meanwhile)
    index.compact()
    assert found(index, "word") == [0, 2, 7, 10, 11, 12] and index.merging() == set()
    index.add_documents(docs(spark, (1, "word again")))
    index.flush()
    index.compact()
    assert found(index, "word") == [0, 1, 2, 7, 10, 11, 12] and index.segment_num() == 1


def test_kept_index(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        IndexStore.load(spark, path)
    IndexStore.save(docs(spark, (5, "a b a"), (9, "b"), (9, "c"), (None, "a"), (7, None)), path)
    store = IndexStore.load(spark, path)
    assert sorted(map(tuple, store.docs.where("doc_id is not null").collect())) in ([(5, 1), (7, 2), (9, 3)], [(5, 0), (7, 1), (9, 2)])
    assert sorted((r.term, r.nums) for r in store.stats.collect()) == [("a", 1), ("b", 2), ("c", 1)]
    assert {(r.doc_id, r.term, r.tf) for r in store.terms("a", "b").where("doc_id is not null").collect()} == {(5, "a", 2), (5, "b", 1), (9, "b", 1)}
    scan = store.postings.where("term = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,b)" in scan


def test_bitsets_of_odd_ids(spark):
    ids = [0, 63, 64, 65535, 65536, 1 << 40, (1 << 40) + 63]
    a = B.of(spark.createDataFrame([(i,) for i in ids], "id bigint"))
    back = B.deserialised(B.serialised(a))
    assert sorted(r.id for r in B.ids(back).collect()) == ids
    assert sorted(r.id for r in B.ids(B.with_range(a, 62, 66)).collect()) == sorted({*ids, 62, 63, 64, 65, 66})
    assert sorted(r.id for r in B.ids(B.without_range(a, 63, 65535)).collect()) == [0, 65536, 1 << 40, (1 << 40) + 63]
    assert B.ids(B.with_range(a, 5, 4)).count() == len(ids)
    empty = a.where("word < 0")
    assert tuple(B.relation(empty, a).first()) == (True, False, True, False, 0, 7, 0, 7) and tuple(B.relation(empty, empty).first()) == (True, True, True, True, 0, 0, 0, 0)


def test_source_is_told_what_is_asked(spark, monkeypatch):
    custom.register(spark, "powers_told", Powers(1000, 5))
    plan = spark.read.format("powers_told").load().where("k < 10 and parity = 'odd'")
    assert sorted(r.k for r in plan.collect()) == [1, 3, 5, 7, 9]
    reader = custom._Reader(Powers(1000, 5), ["k"], 4)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    left = list(reader.pushFilters([LessThan(("k",), 300), GreaterThan(("k",), 100), EqualTo(("parity",), "odd")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo] and reader.conditions == [("k", "<", 300), ("k", ">", 100)]
    assert [p.value for p in reader.partitions()] == [(100, 200), (200, 300)]
    assert [b.to_pydict() for b in reader.read(reader.partitions()[0])] == [{"k": [100, 101, 102, 103]}]
    assert custom.scan(spark, "powers_told", ["square"], limit=2).count() == 2


def test_states_of_many_tasks_merge(spark, monkeypatch):
    monkeypatch.setattr(udfs, "HELD", 2)
    df = spark.range(1000).selectExpr("id % 7 as k", "cast(id as double) as x").repartition(6)
    got = {r.k: r.out for r in udfs.aggregate(df, ["k"], ["x"], Rms, "out", "double").collect()}
    want = df.toPandas().groupby("k").x.apply(lambda x: float((x * x).mean() ** 0.5)).to_dict()
    assert got == pytest.approx(want)
    assert udfs.aggregate(df.limit(0), ["k"], ["x"], Rms, "out", "double").count() == 0


def test_quantiles_of_weighted_values():
    rng = np.random.default_rng(1)
    x, w = rng.lognormal(0, 2, 50_000), rng.random(50_000) ** 4
    parts = [udfs.Quantile(0.9) for _ in range(5)]
    for k, part in enumerate(parts):
        for at in range(k * 10_000, (k + 1) * 10_000, 2500):
            part.update(pd.Series(x[at : at + 2500]), pd.Series(w[at : at + 2500]))
    whole = udfs.Quantile(0.9)
    for part in parts:
        whole.merge(part.state())
        assert len(part.state()[0]) <= 800
    assert w[x <= whole.evaluate()].sum() / w.sum() == pytest.approx(0.9, abs=0.005)
    few = udfs.Quantile(0.5)
    few.update(pd.Series([1.0, None, 3.0, 9.0]), pd.Series([1.0, 5.0, 1.0, -2.0]))
    assert few.evaluate() == 2.0 and udfs.Quantile(0.5).evaluate() is None


def test_volatility_is_named(spark):
    with pytest.raises(ValueError):
        udfs.scalar(lambda x: x, "int", "sometimes")
    calls = []
    once = udfs.scalar(lambda x: calls.append(1) or pd.Series([4]), "int", udfs.STABLE)
    assert spark.range(5).select(once(1).alias("x")).distinct().count() == 1 and calls == [1]


def test_blake3_of_known_inputs(spark):
    """The specification's test input is 0, 1, …, 250, 0, 1, …; digests of it and of short texts as published."""
    line = bytes(k % 251 for k in range(5000))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"}
    assert {n: blake3.digest(line[:n]).hex() for n in want} == want
    assert blake3.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({blake3.digest(line[:n]) for n in (1023, 1024, 1025, 2048, 2049, 3073, 4096, 5000)}) == 8
    df = spark.createDataFrame([("abc",), (None,)], "s string")
    assert [None if r[0] is None else bytes(r[0]).hex()[:8] for r in df.select(P.digest(F.col("s"), "blake3")).collect()] == ["6437b3ac", None]


@pytest.mark.parametrize("codec", ["null", "deflate", "bzip2", "xz", "zstandard"])
def test_avro_round_trip(spark, tmp_path, codec):
    rows = [(k, f"é{k}" if k % 3 else None, -k / 7, bytes([k % 256])) for k in range(300)] + [(None, None, None, None), (-(1 << 63), "", 0.0, b"")]
    (tmp_path / "a.avro").write_bytes(avro.container([("k", "long"), ("s", "string"), ("x", "double"), ("b", "bytes")], rows, codec, 64))
    df = avro.read(spark, [f"{tmp_path}/a.avro"])
    assert df.dtypes == [("k", "bigint"), ("s", "string"), ("x", "double"), ("b", "binary")]
    assert sorted(((r.k, r.s, r.x, None if r.b is None else bytes(r.b)) for r in df.collect()), key=str) == sorted(rows, key=str)
    assert avro.read(spark, [f"{tmp_path}/a.avro"], "s string, missing int").where("missing is not null").count() == 0


def test_avro_of_nested_types():
    """Arrays, maps, enums, fixed, decimals and records, decoded from bytes written out by hand."""
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}, {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["x", "y"]}},
        {"name": "f", "type": {"type": "fixed", "name": "f", "size": 2}}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 5, "scale": 2}}, {"name": "n", "type": ["string", "null"]}, {"name": "g", "type": "float"},
    ]}
    data = bytes([4, 2, 3, 0, 1, 4, 2, 107, 1, 0, 2, 104, 105, 4, 255, 133, 2, 0, 0, 0, 63])
    assert avro.reader(schema)(avro._Bytes(data)) == {"a": [1, -2], "m": {"k": True}, "e": "y", "f": b"hi", "d": decimal.Decimal("-1.23"), "n": None, "g": 0.5}
    assert avro.spark_type(schema).simpleString() == "struct<a:array<int>,m:map<string,boolean>,e:string,f:binary,d:decimal(5,2),n:string,g:float>"
    for bad in (b"none", b"Obj\x01\x00"):
        with pytest.raises(ValueError):
            avro._head(bad)


def test_rules_that_do_not_end(spark):
    with pytest.raises(RuntimeError):
        E.optimise(E.Limit((E.Scan((), spark.range(3)),), 1), [lambda n: E.Limit(n.children, n.n + 1) if isinstance(n, E.Limit) else None])


def test_similar_to_errors():
    for bad, escape in (("a[b", "\\"), ("a\\", "\\"), ("a", "xy")):
        with pytest.raises(ValueError):
            O.similar_to(None, bad, escape)


def test_shared_folder_has_to_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Context()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_entry_without_a_library(monkeypatch):
    """Where a library that the training-data package needs is missing, the other queries are there."""
    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("lexispark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    importlib.invalidate_caches()
    known = __spark_entry__.queries()
    assert "text_and2" in known and not any(n.startswith("op") and n[2].isdigit() for n in known)
    assert set(__spark_entry__.oracle_sql()) <= set(known)
