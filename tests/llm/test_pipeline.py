from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lexispark.llm import language_id

SF = "/root/testdata/sf0.001"


def simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(spark, rows):
    """The stages without Spark; the language model is the trained one, applied text by text."""
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= language_id.MIN_SCORE]
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        text = (r["text"] or "").encode()
        for b in b"\t\n\x0b\x0c\r":
            text = text.replace(bytes([b]), b" ")
        first.setdefault(b" ".join(text.split()) + bytes([text[:1] == b" ", text[-1:] == b" "]), r)
    rows = list(first.values())
    prints = [simhash(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    words = [(r["text"] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if gone:
            r["text"] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            out[r["doc_id"], k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    return out


def test_run_against_plain_version(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = plain(spark, rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
