"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word has a selector in its top four bits and, below, as many ids as
fit at the selector's width: from 240 zeros to one id of 60 bits. Ids of more
than 60 bits are escapes: their word only says that the next entry of the
block's escape list stands here.

A file is a Parquet file of blocks; a row is one block of whole documents, in
ascending order of doc_id, with

    shard, block        place of the file among all, and of the block in it
    start_in_shard      ids of the shard before this block
    n_ids, n_words      so that blocks decode alone, in any order
    doc_ids, sizes      the block's documents and how many ids each has
    escapes             ids too large for a word
    words               the Simple-8b words, little-endian

Spark's writers and readers move the files, so they work in any store, and a
task that is lost and run again leaves no half-written file behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, lean, partitions, scratch, table
from lexispark.llm.word_bpe import encoder

#: (ids in a word, bits of each) by selector; selector 1 is the escape.
SELECTORS = [(240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 1
#: A block is closed once it has this many ids.
BLOCK_IDS = 1 << 15

_COUNT = np.array([c for c, _ in SELECTORS], np.int64)
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_BY_COUNT = sorted((c, b, s) for s, (c, b) in enumerate(SELECTORS) if s != ESCAPE)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of an array of ids (uint64)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    most = np.zeros(n + 240, np.uint8)  # the most bits among the next `have` ids
    if int(ids.max()) < len(_BITS):
        most[:n] = _BITS[ids]
    else:
        most[:n] = np.frexp(ids.astype(np.float64))[1]
        most[:n][ids >= np.uint64(1 << 60)] = 64
    choice, have = np.full(n, ESCAPE, np.uint8), 1
    for count, width, selector in _BY_COUNT:
        while have < count:
            step = min(have, count - have)  # windows double where they can, so 240 takes a few steps
            most[:n] = np.maximum(most[:n], most[step : n + step])
            have += step
        fits = most[:n] <= width
        if not fits.any():
            break  # more ids in fewer bits won't fit either
        np.copyto(choice, selector, where=fits)
    counts = _COUNT[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += counts[at]
    first = np.array(starts)
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for selector in np.unique(chosen):
        count, width = SELECTORS[selector]
        if selector == ESCAPE or width == 0:
            continue
        own = np.flatnonzero(chosen == selector)
        for k in range(count):
            words[own] |= padded[first[own] + k] << np.uint64(k * width)
    return words, ids[first[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block (uint64), one gather for each selector that occurs."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(chosen):
        own = np.flatnonzero(chosen == selector)
        first = ends[own] - counts[own]
        if selector == ESCAPE:
            out[first] = escapes
            continue
        count, width = SELECTORS[selector]
        for k in range(count if width else 0):
            out[first + k] = (words[own] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out[:n]


BLOCK_DDL = "shard int, block int, start_in_shard bigint, n_ids bigint, n_words bigint, doc_ids array<bigint>, sizes array<bigint>, escapes binary, words binary"
_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("n_words", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("escapes", pa.binary()), ("words", pa.binary())]
)


def write(docs: DataFrame, path: str, ids_of: Callable[[], Callable[[str | None], bytes]], kind: str = "<u4") -> None:
    """Write the ids of every row of docs (doc_id, text) to `path` in ascending order of doc_id.

    ids_of() is called once a task and gives the function from text to ids, as the bytes of an array of `kind`;
    if that has `all`, it is asked for the ids of a column of texts at once.
    Null ids come first; rows of equal id stay next to each other, in the order they are read in. Null texts are
    for ids_of to judge (word_ids takes them as empty). A text of any length is one document of one block, which
    a task holds as a whole; an empty table gives files without blocks. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = ids_of(), TaskContext.get().partitionId()
        encode_all = getattr(encode, "all", lambda texts: map(encode, each(texts)))
        block, start, size = 0, 0, 0
        width = np.dtype(kind).itemsize
        held: list[bytes] = []
        names: list[int] = []

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind).astype(np.uint64)
            words, escapes = pack(ids)
            row = [[shard], [block], [start], [len(ids)], [len(words)], [names], [[len(h) // width for h in held]], [escapes.astype("<u8").tobytes()], [words.astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                held.append(ids)
                names.append(doc_id)
                size += len(ids) // width
                if size >= BLOCK_IDS:
                    yield closed()
                    block, start, size, held, names = block + 1, start + size, 0, [], []
        if held:
            yield closed()

    ordered = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("tie"))
    ordered = ordered.repartitionByRange(partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # no dictionary and no column statistics for words: they don't repeat
    ordered.select("doc_id", "text").mapInArrow(lean(run, "word_bpe"), BLOCK_DDL).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the files at `path`.

    ids are little-endian uint64 bytes, left out without with_ids; they are
    decoded all the same. start is the number of ids of all documents before.
    Offsets of shards come from one small row a shard; nothing else is gathered.
    """
    blocks = spark.read.schema(BLOCK_DDL).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.selectExpr("shard", "coalesce(sum(total) over (order by shard rows between unbounded preceding and 1 preceding), 0) as shard_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                small = ids.astype("<u4")
                parts = [(int(e - s), int(e)) for s, e in zip(sizes, ends, strict=True)]
                out = {
                    "shard": pa.array([row["shard"]] * len(sizes), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start_in_shard": pa.array(row["start_in_shard"] + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(small[a:b]) for a, b in parts], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].tobytes() for a, b in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    ddl = "shard int, doc_id bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(lean(run, "token_file"), ddl)
    return docs.join(before, "shard").select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def word_ids(vocabulary: str, end_id: int) -> Callable[[], Callable[[str | None], bytes]]:
    """For write(): the ids of a tokenizers vocabulary, with end_id after each document."""

    def make():
        words, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()

        def encode(text: str | None) -> bytes:
            return words.encode(text) + end

        encode.all = lambda texts: (bytes(ids) + end for ids in words.encode_all(texts))
        return encode

    return make


def op1_token_file(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, word_ids(vocabulary, 2))
    return read(spark, path, with_ids=False)
