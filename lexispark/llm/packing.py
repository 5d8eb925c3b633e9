"""Packing documents into fixed-length sequences by length patterns.

Lengths are a small histogram whatever the corpus, so the plan is made from
the histogram alone. Lengths are grouped into bins; all patterns of up to
`PATTERN_DOCS` bins that fit a sequence are enumerated, and non-negative least
squares says how often each is to be used to consume the histogram (Krell et
al., 2021). Counts are rounded down and patterns are filled with exact
lengths, the last of them chosen to leave least room; what is left is packed
best-fit, longest first, into the room that patterns leave, and into new
sequences.

The plan is a table of (length, first rank, count, first sequence, offset): the
r-th document of a length has its place by a binary search. Ranks come from
counts by task and length; no document is gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, lean, stored, table
from lexispark.llm.word_bpe import encoder

LENGTH = 4096
BINS = 64
PATTERN_DOCS = 3
END_ID = 1


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    slope = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= tiny:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            old = x[at]
            step = (old[low] / (old[low] - best[low] + 1e-300)).min()
            x[at] = old + step * (best - old)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def patterns(bins: int, docs: int) -> list[tuple[int, ...]]:
    """Multisets of up to `docs` bin sizes (1..bins, largest first) whose sum is exactly `bins`."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < docs:
            for size in range(min(left, head[-1] if head else bins), 0, -1):
                if size * (docs - len(head)) >= left:
                    grow((*head, size), left - size)

    grow((), bins)
    return out


class Rooms:
    """Groups of alike sequences by the room they have left."""

    def __init__(self, length: int):
        self.length = length
        self.by_room: dict[int, list[list]] = {}
        self.has = np.zeros(length + 1, bool)

    def add(self, count: int, lengths: tuple[int, ...], room: int) -> None:
        self.by_room.setdefault(room, []).append([count, lengths])
        self.has[room] = True

    def put(self, size: int, count: int) -> None:
        """Place `count` documents of `size`, each where it leaves least room; new sequences where none has room."""
        while count:
            room = size + int(np.argmax(self.has[size:]))
            if not self.has[room]:
                per = self.length // size
                full, rest = divmod(count, per)
                if full:
                    self.add(full, (size,) * per, self.length - per * size)
                if rest:
                    self.add(1, (size,) * rest, self.length - rest * size)
                return
            group = self.by_room[room]
            have, lengths = group[-1]
            fit = min(have, count)
            group[-1][0] -= fit
            if not group[-1][0]:
                group.pop()
                if not group:
                    self.has[room] = False
            self.add(fit, (*lengths, size), room - size)
            count -= fit

    def groups(self) -> Iterator[tuple[int, tuple[int, ...]]]:
        for group in self.by_room.values():
            for count, lengths in group:
                yield count, lengths


def plan(histogram: dict[int, int], length: int = LENGTH, bins: int = BINS, docs: int = PATTERN_DOCS) -> list[tuple[int, tuple[int, ...]]]:
    """[(sequences, lengths in each)] that use up the histogram {length: count} of lengths from 1 to `length`."""
    left = {size: n for size, n in histogram.items() if n}
    rooms = Rooms(length)
    width = -(-length // bins)
    by_bin: dict[int, list[int]] = {}
    for size in sorted(left, reverse=True):
        by_bin.setdefault(-(-size // width), []).append(size)
    target = np.zeros(bins)
    for k, sizes in by_bin.items():
        target[k - 1] = sum(left[s] for s in sizes)
    shapes = patterns(bins, docs)
    # a bin counts by the tokens it holds: long documents are to be placed well, short ones fill what is left
    weight = np.sqrt(np.arange(1, bins + 1) / bins)
    matrix = np.zeros((bins, len(shapes)))
    for k, shape in enumerate(shapes):
        for size in shape:
            matrix[size - 1, k] += 1
    scale = max(1.0, float(target.max(initial=0)))
    counts = nnls(matrix * weight[:, None], target / scale * weight) * scale
    there = np.zeros(length + 1, bool)
    there[list(left)] = True
    for k in np.argsort([-max(s) for s in shapes], kind="stable"):
        head, tail = (shapes[k][:-1], shapes[k][-1]) if len(shapes[k]) > 1 else (shapes[k], 0)
        times = int(counts[k] + 1e-9)
        while times > 0:
            # the longest of each bin, and last the length that fills the rest best, if the pattern's bin or the next has one
            used: list[int] = []
            for size in head:
                used += [s for s in by_bin.get(size, ()) if left[s] > used.count(s)][:1]
            room = length - sum(used)
            if tail and len(used) == len(head):
                fit = [s for s in np.flatnonzero(there[: room + 1])[-3:][::-1].tolist() if left[s] > used.count(s) and s > (tail - 1) * width][:1]
                used, room = used + fit, room - sum(fit)
            if len(used) < len(shapes[k]):
                break
            run = min(times, *(left[s] // n for s, n in Counter(used).items()))
            rooms.add(run, tuple(used), room)
            times -= run
            for s in used:
                left[s] -= run
            for s in set(used):
                if not left[s]:
                    there[s] = False
                    by_bin[-(-s // width)].remove(s)
    for size in sorted(left, reverse=True):
        if left[size]:
            rooms.put(size, left[size])
    return list(rooms.groups())


def places(groups: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """{length: rows (first rank, first sequence, offset)} in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for count, lengths in groups:
        offset = 0
        for size in lengths:
            out.setdefault(size, []).append((ranks[size], sequence, offset))
            ranks[size] += count
            offset += size
        sequence += count
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
_PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs (doc_id, text), with their rank among the task's pieces of that length, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, part = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        met: Counter[int] = Counter()
        schema = pa.schema(_PIECE + ([("ids", pa.binary())] if with_ids else []))
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                ids = bytes(ids) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    size = len(own) // 4
                    rows.append((doc_id, k, at // 4, size, zlib.crc32(own), part, met[size], *[own] * with_ids))
                    met[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    found = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "word_bpe"), _PIECE_DDL + ", ids binary" * with_ids)
    return stored(found, "pieces")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of every row of docs (doc_id, text; others are ignored) with its sequence_id and offset there.

    Null text counts as empty: it is one piece, the end id alone. Rows that
    repeat an id are documents like any other; null ids stay null. An empty
    table gives an empty result. Columns: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and ids (little-endian uint32) with_ids.

    The plan that is broadcast depends on the lengths that occur, of which
    there are at most `length`, and not on the number of documents.
    """
    cut = pieces(docs, vocabulary, length, end_id, with_ids)
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = by_task.selectExpr("part", "length", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as base")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, length)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = where.value
        for batch in batches:
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                rows = by_length[int(size)]
                at = np.searchsorted(rows[:, 0], ranks[own], side="right") - 1
                sequence[own] = rows[at, 1] + ranks[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("nth")).alias("rank"))
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lean(place, "packing"), ddl)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), with_ids=False)
