"""Removal of repeated passages by seed and extend.

A seed is a run of `SEED` words. Of the seeds in a window of `WINDOW` words the
one with the least hash is the window's anchor (winnowing). The anchor and its
place depend on nothing but the window's words, so equal windows have equal
anchors at equal places, wherever they stand. Documents meet on anchors twice:

1. To choose. An occurrence of an anchor brings the hashes of the windows that
   it leads, and windows that no other occurrence can have are dropped. Equal
   windows have equal hashes, so nothing that repeats is lost; windows that
   differ and share a hash come through.
2. To extend. Each occurrence in a chosen passage brings its words. From equal
   seeds, matches grow word by word to the left and to the right
   (`repeated_windows`), by the words themselves: what is removed never rests
   on a hash. Overlapping repeats join to the maximal passages that go.

A task first compares what it has itself, so of a passage that it meets a
thousand times one occurrence leaves it. An anchor that a task meets in
`Limits.often` places is hot: its windows are dealt by their own hash instead
of the anchor's (a seed as long as the window), which spreads them, and the
task tells the anchor's bucket, which deals its other windows likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, lean, partitions, stored, table

WINDOW = 35
SEED = 16


@dataclass(frozen=True)
class Limits:
    """How much is held at once; results don't depend on it."""

    task_windows: int = 800_000  #: windows that a task gathers before it compares them and sends them on
    bucket_windows: int = 1_200_000  #: windows of one bucket that are compared in one place
    step: int = 200_000  #: words of one text that are hashed at once
    often: int = 64  #: different places of an anchor in one task that make it hot
    contexts: int = 40_000  #: occurrences whose words are compared at once
    context_bytes: int = 48 << 20  #: words that a task gathers before it sends them on
    hash_bits: int = 64  #: bits of hashes that count; with fewer more is compared by words


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made as far as they are needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, have, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BACK, have, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(line: bytes, window: int, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(seed hashes, window hashes of 48 bits, begin and end of each word) of a line of words with one blank between two; None if it has no window."""
    data = np.frombuffer(line, np.uint8)
    blanks = np.flatnonzero(data == 32)
    n = len(blanks) + 1
    if n < window:
        return None
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    head, foot = total[starts], total[ends]
    shift = down[starts]
    seeds = _mixed((foot[seed - 1 :] - head[: n - seed + 1]) * shift[: n - seed + 1])
    whole = _mixed(((foot[window - 1 :] - head[: n - window + 1]) * shift[: n - window + 1]) ^ _MIX) >> np.uint64(16)
    if bits < 64:
        seeds, whole = seeds >> np.uint64(64 - bits) << np.uint64(64 - bits), whole & np.uint64((1 << bits) - 1)
    return seeds, whole, starts, ends


def _least(values: np.ndarray, want: int) -> np.ndarray:
    """The least of each `want` neighbours, by stretches that double."""
    have = 1
    while have < want:
        step = min(have, want - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def windows(line: bytes, window: int = WINDOW, seed: int = SEED, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, window hash of 48 bits) of each window of a line of words with one blank between two."""
    found = _hashes(line, window, seed, bits)
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _least(found[0], window - seed + 1), found[1]


#: Low bits of a seed's hash that give way to its place when places of anchors are looked for.
_PLACE = np.uint64((1 << 20) - 1)


def _same(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first): which windows occur more than once, and which are the first of their kind."""
    n = len(anchor)
    repeated, first = np.zeros(n, bool), np.ones(n, bool)
    if n > 1:
        key = anchor * _MIX + whole
        order = np.argsort(key, kind="stable")
        a, k = anchor[order], key[order]
        equal = (k[1:] == k[:-1]) & (a[1:] == a[:-1])
        repeated[order[1:][equal]] = True
        repeated[order[:-1][equal]] = True
        first[order[1:][equal]] = False
    return repeated, first


def _spans(doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (document, place), ordered by both, joined where they overlap or touch: (document, begin, end)."""
    if not len(doc):
        return doc, at, at
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(doc)]]) - 1
    return doc[begin], at[begin], at[last] + window


#: Kinds of rows: a hot anchor (in doc_id, its windows in text_hash), windows by anchor, windows by their own hash, spans that may repeat.
HOT, BY_ANCHOR, BY_WINDOW, SPAN = range(4)
_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("windows", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])
OUT_DDL = "kind int, bucket int, windows binary, doc_id bigint, text_hash bigint, begin int, end int"


def _rows(n: int, **columns_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns_[f.name], f.type) if f.name in columns_ else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _spans_batch(ids: list | pa.Array, hashes: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    doc, begin, end = spans
    return _rows(len(doc), kind=np.full(len(doc), SPAN, np.int32), doc_id=pa.array(ids, pa.int64()).take(pa.array(doc)), text_hash=hashes[doc], begin=begin, end=end)


def _blob(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: pa.Array, hashes: np.ndarray) -> bytes:
    """Windows of one bucket: documents, then runs of windows with one anchor and places in a row, then six bytes a window."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(anchor)]]))
    docs, own = np.unique(doc[begin], return_inverse=True)
    names = ids.take(pa.array(docs))
    head = np.array([len(docs), len(begin), len(anchor)], "<i8")
    parts = [head, np.asarray(names.fill_null(0)), np.asarray(names.is_null().cast(pa.int64())), hashes[docs], anchor[begin], own.astype("<i4"), at[begin].astype("<i4"), size.astype("<i4")]
    return b"".join([p.tobytes() for p in parts] + [whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()])


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    """(ids, nulls, hashes) of documents and (anchor, whole, document, place) of windows."""
    n_docs, n_runs, n = np.frombuffer(data, "<i8", 3).tolist()
    at, out = 24, []
    for kind, count in (("<i8", n_docs), ("<i8", n_docs), ("<i8", n_docs), ("<u8", n_runs), ("<i4", n_runs), ("<i4", n_runs), ("<i4", n_runs)):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * int(kind[2])
    ids, nulls, hashes, anchor, own, place, size = out
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    first = np.cumsum(size) - size
    return ids, nulls, hashes, np.repeat(anchor, size), whole.view("<u8")[:, 0], np.repeat(own, size), np.repeat(place - first, size) + np.arange(n)


def _dealt(kind: int, anchor, whole, doc, at, ids: pa.Array, hashes, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of anchors or of windows; windows keep the order of documents and places within it."""
    by = anchor if kind == BY_ANCHOR else _mixed(whole ^ anchor)
    bucket = (_mixed(by) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        own = order[edges[k] : edges[k + 1]]
        yield _rows(1, kind=[kind], bucket=[k], windows=[_blob(anchor[own], whole[own], doc[own], at[own], ids, hashes)])


def _hot(anchor: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of `often` windows or more, and how many they have."""
    found, counts = np.unique(anchor, return_counts=True)
    return found[counts >= often], counts[counts >= often]


def candidates(docs: DataFrame, buckets: int, window: int, seed: int, limits: Limits) -> DataFrame:
    """Windows by bucket of their anchors, hot anchors, and the spans whose windows one task has met twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[int] = []
        parts: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            anchor, whole = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            at = np.concatenate([p[2] + np.arange(len(p[0])) for p in parts])
            known, names = np.array(hashes, np.int64), pa.array(ids, pa.int64())
            repeated, first = _same(anchor, whole)
            yield _spans_batch(names, known, _spans(doc[repeated], at[repeated], window))
            anchor, whole, doc, at = anchor[first], whole[first], doc[first], at[first]
            hot, counts = _hot(anchor, limits.often)
            if len(hot):
                yield _rows(len(hot), kind=np.full(len(hot), HOT, np.int32), bucket=(_mixed(hot) % np.uint64(buckets)).astype(np.int32), doc_id=hot.view(np.int64), text_hash=counts)
            spread = np.isin(anchor, hot)
            for kind, own in ((BY_WINDOW, spread), (BY_ANCHOR, ~spread)):
                yield from _dealt(kind, anchor[own], whole[own], doc[own], at[own], names, known, buckets)

        for batch in batches:
            for doc_id, text, text_hash in zip(*map(each, batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for begin in range(0, max(1, len(words) - window + 1), limits.step):
                    anchor, whole = windows(b" ".join(words[begin : begin + limits.step + window - 1]), window, seed, limits.hash_bits)
                    if len(anchor):
                        ids.append(doc_id)
                        hashes.append(text_hash)
                        parts.append((anchor, whole, begin))
                        held += len(anchor)
                    if held >= limits.task_windows:
                        yield from flush()
                        ids, hashes, parts, held = [], [], [], 0
        yield from flush()

    return docs.where("text is not null").select("doc_id", "text", "text_hash").mapInArrow(lean(run, "substring_dedup"), OUT_DDL)


def _compare(batches: Iterator[pa.RecordBatch], window: int, again: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket, hot anchors before windows. again: buckets for windows of hot anchors and of a bucket that grows too large (0: keep all)."""
    at_bucket, parts, held, spilled = None, [], 0, False
    hot: list[int] = []
    spread: list[tuple] = []  # windows of hot anchors

    def columns_of(blobs: list[tuple]) -> tuple:
        sizes = np.cumsum([0, *(len(p[0]) for p in blobs)])
        ids = pa.array(np.concatenate([p[0] for p in blobs]), mask=np.concatenate([p[1] for p in blobs]).astype(bool))
        return ids, np.concatenate([p[2] for p in blobs]), *(np.concatenate([p[k] + (sizes[i] if k == 5 else 0) for i, p in enumerate(blobs)]) for k in (3, 4, 5, 6))

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        ids, hashes, anchor, whole, doc, place = columns_of(parts)
        repeated, first = _same(anchor, whole)
        own = np.flatnonzero(repeated)
        own = own[np.lexsort((place[own], doc[own]))]
        yield _spans_batch(ids, hashes, _spans(doc[own], place[own], window))
        if spilled or not last:
            yield from _dealt(BY_WINDOW, anchor[first], whole[first], doc[first], place[first], ids, hashes, again)

    def dealt_anew() -> Iterator[pa.RecordBatch]:
        if spread:
            ids, hashes, anchor, whole, doc, place = columns_of(spread)
            yield from _dealt(BY_WINDOW, anchor, whole, doc, place, ids, hashes, again)
            spread.clear()

    for batch in batches:
        for kind, bucket, blob, name in zip(*map(each, batch.columns[:4]), strict=True):
            if bucket != at_bucket:
                yield from flush(True)
                yield from dealt_anew()
                at_bucket, parts, held, spilled, hot = bucket, [], 0, False, []
            if kind == HOT:
                hot.append(name)
                continue
            part = _unblob(blob)
            if hot:
                own = np.isin(part[3], np.array(hot, np.int64).view(np.uint64))
                if own.any():
                    spread.append((*part[:3], *(x[own] for x in part[3:])))
                    part = (*part[:3], *(x[~own] for x in part[3:]))
                    if len(spread) >= 256:
                        yield from dealt_anew()
            parts.append(part)
            held += len(part[3])
            if again and held >= most:
                yield from flush(False)
                parts, held, spilled = [], 0, True
    yield from flush(True)
    yield from dealt_anew()


def _gathered(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): different spans of a text only, so what is gathered is bounded by the text."""
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def chosen(docs: DataFrame, window: int, seed: int, limits: Limits) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, spans) of texts with windows that may repeat, by hashes alone, and the hot anchors.

    Of the hot anchors those come to the driver that have a 500,000th of the windows of all of them, so 500,000 at most.
    """
    n = partitions(docs)
    buckets = 8 * n

    def compare(again: int):
        return lambda batches: _compare(batches, window, again, limits.bucket_windows)

    met = candidates(docs, buckets, window, seed, limits)
    dealt = met.repartition(n, F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "begin"), F.lit(buckets)).cast("int")))
    ordered = dealt.sortWithinPartitions("bucket", "kind")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def compared() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = np.asarray(batch.column(0))
                others = batch.filter(pa.array(kind != BY_ANCHOR))
                if others.num_rows:
                    passed.append(others)
                own = batch.filter(pa.array(kind <= BY_ANCHOR))
                if own.num_rows:
                    yield own

        for out in compare(buckets)(compared()):
            yield from passed
            passed.clear()
            yield out
        yield from passed

    once = stored(ordered.mapInArrow(lean(first, "substring_dedup"), OUT_DDL), "repeats")
    later = once.where(F.col("kind") == BY_WINDOW).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(compare(0), "substring_dedup"), OUT_DDL)
    found = once.where(F.col("kind") == SPAN).unionByName(later)
    hot = once.where(F.col("kind") == HOT).groupBy(F.col("doc_id").alias("anchor")).agg(F.sum("text_hash").alias("n"))
    total = hot.agg(F.sum("n")).first()[0] or 0
    few = hot.where(F.col("n") >= max(limits.often, total // 500_000)).select("anchor").toArrow().column(0).to_numpy()
    return _gathered(found), few.astype(np.int64).view(np.uint64)


# words


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def occurrences(words: list[bytes], spans: list[dict], window: int, seed: int, limits: Limits, hot: np.ndarray) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(key, place of the anchor in the context, context, begin, end) of the anchors of the windows in some spans of a text.

    A context is the words of all neighbouring windows that an anchor leads; its key is the anchor's hash. Of hot
    anchors each window is a context of its own, with a hash of its words as key. begin and end are places in the text.
    """
    for first, last in _joined(spans):
        for base in range(first, last - window + 1, limits.step):
            line = b" ".join(words[base : min(last, base + limits.step + window - 1)])
            found = _hashes(line, window, seed, limits.hash_bits)
            if found is None:
                continue
            seeds, _, starts, ends = found
            marked = seeds & ~_PLACE | np.arange(len(seeds), dtype=np.uint64)  # of equal seeds the first
            lead = _least(marked, window - seed + 1)
            anchor, place = lead >> np.uint64(20), (lead & _PLACE).astype(np.int64)
            spread = np.isin(anchor, hot)
            new = np.ones(len(lead), bool)
            new[1:] = (lead[1:] != lead[:-1]) | spread[1:]
            begin = np.flatnonzero(new)
            end = np.concatenate([begin[1:], [len(lead)]]) + window - 1
            offset = place[begin] - begin
            keys = (anchor[begin] << np.uint64(1)).view(np.int64).tolist()
            for key, alone, at, off, b, e in zip(keys, spread[begin].tolist(), offset.tolist(), zip(starts[begin].tolist(), ends[end - 1].tolist(), strict=True), begin.tolist(), end.tolist(), strict=True):
                context = line[off[0] : off[1]]
                yield (xxhash.xxh64_intdigest(context) >> 2 << 1 | 1 if alone else key), at, context, base + b, base + e


def repeated_windows(keys: np.ndarray, places: np.ndarray, contexts: list[list[bytes]], window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, first word of the window in it) of every window that another context has at the same place from an equal seed.

    From classes of equal seeds, matches are extended word by word: a class of
    equal left sides splits by the next word to the left, likewise to the
    right, and windows are equal where left class and right class are.
    """
    n, reach = len(keys), window - seed
    known: dict[bytes, int] = {}
    number = known.setdefault
    flat = np.array([number(w, len(known) + 1) for c in contexts for w in c], np.int64)
    sizes = np.array(list(map(len, contexts)), np.int64)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + reach - places[row]
    words = np.zeros((n, 2 * reach + seed), np.int64)  # 0: outside of the context
    words[row, column] = flat

    def split(classes: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.unique(classes * (len(known) + n + 1) + by, return_inverse=True)[1]

    here = np.unique(keys, return_inverse=True)[1]
    for k in range(seed):
        here = split(here, words[:, reach + k])
    left, right = [here], [here]
    for k in range(reach):
        left.append(split(left[-1], words[:, reach - 1 - k]))
        right.append(split(right[-1], words[:, reach + seed + k]))
    found = []
    for k in range(reach + 1):
        at = places - k
        there = np.flatnonzero((at >= 0) & (at + window <= sizes))
        equal, count = np.unique(left[k][there] * n + right[reach - k][there], return_inverse=True, return_counts=True)[1:]
        own = there[count[equal] > 1]
        found.append((own, at[own]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_CONTEXT = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("context", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])
CONTEXT_DDL = "key bigint, place int, context binary, doc_id bigint, text_hash bigint, begin int, end int"


class _Held:
    """Different contexts, by their words; a context that is met again repeats as a whole, where it is and where it was first."""

    def __init__(self):
        self.rows: dict[tuple[int, bytes], list] = {}
        self.spans: list[tuple] = []
        self.size = 0

    def add(self, key: int, place: int, context: bytes, doc_id: int | None, text_hash: int, begin: int, end: int) -> None:
        row = self.rows.get((place, context))
        if row is None:
            self.rows[place, context] = [key, False, doc_id, text_hash, begin, end]
            self.size += len(context)
            return
        if not row[1]:
            row[1] = True
            self.spans.append(tuple(row[2:]))
        self.spans.append((doc_id, text_hash, begin, end))

    def repeats(self) -> pa.RecordBatch:
        out, self.spans = self.spans, []
        found = [pa.array([s[k] for s in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary()), *found], schema=_CONTEXT)


def _own_contexts(batches: Iterator[pa.RecordBatch], window: int, seed: int, limits: Limits, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, text_hash, spans): contexts that differ, and the spans (without a key) that one task has met twice."""
    held = _Held()

    def flush() -> Iterator[pa.RecordBatch]:
        yield held.repeats()
        rows = [(row[0], place, context, *row[2:]) for (place, context), row in held.rows.items()]
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 4096]], f.type) for k, f in enumerate(_CONTEXT)], schema=_CONTEXT)

    for batch in batches:
        for doc_id, text, text_hash, spans in zip(*map(each, batch.columns[:4]), strict=True):
            for key, place, context, begin, end in occurrences(text.encode("utf-8", "surrogatepass").split(), spans, window, seed, limits, hot):
                held.add(key, place, context, doc_id, text_hash, begin, end)
                if held.size >= limits.context_bytes or len(held.spans) >= 1 << 18:
                    yield from flush()
                    held = _Held()
    yield from flush()


def _extended(batches: Iterator[pa.RecordBatch], window: int, seed: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Contexts come ordered by key; spans that repeat, and spans that are known already."""
    held, at = _Held(), None

    def flush() -> Iterator[pa.RecordBatch]:
        yield held.repeats()
        rows = list(held.rows.items())
        keys = np.array([row[0] for _, row in rows], np.int64)
        _, own, count = np.unique(keys, return_inverse=True, return_counts=True)
        rows = [rows[k] for k in np.flatnonzero(count[own] > 1)]  # a context alone under its key has no partner
        if rows:
            keys, places = np.array([row[0] for _, row in rows], np.int64), np.array([place for (place, _), _ in rows], np.int64)
            found, begin = repeated_windows(keys, places, [context.split(b" ") for (_, context), _ in rows], window, seed)
            order = np.lexsort((begin, found))
            for k, b, e in zip(*(x.tolist() for x in _spans(found[order], begin[order], window)), strict=True):
                row = rows[k][1]
                held.spans.append((row[2], row[3], row[4] + b, row[4] + e))
            yield held.repeats()

    for batch in batches:
        known = batch.column(0).is_null()
        if (spans := batch.filter(known)).num_rows:
            yield spans
            batch = batch.filter(batch.column(0).is_valid())
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at:
                if len(held.rows) >= limits.contexts:
                    yield from flush()
                    held = _Held()
                at = row[0]
            held.add(*row)
            if len(held.spans) >= 1 << 18:
                yield held.repeats()
    yield from flush()


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, text_hash, spans) for documents with repeated windows; spans are [begin, end) in words, not yet joined.

    docs has doc_id, text, text_hash; all its columns travel with the texts, so that the join of the result with docs finds texts dealt already.
    """
    found, hot = chosen(docs, window, seed, limits)
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(hot >> np.uint64(20)))
    met = dealt_with(docs, found, "inner")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _own_contexts(batches, window, seed, limits, shared.value)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _extended(batches, window, seed, limits)

    contexts = met.select("doc_id", "text", "text_hash", "spans", *[c for c in docs.columns if c not in ("doc_id", "text", "text_hash")]).mapInArrow(lean(own, "substring_dedup"), CONTEXT_DDL)
    dealt = contexts.repartition(partitions(docs), F.coalesce("key", F.xxhash64("doc_id", "begin"))).sortWithinPartitions("key")
    return _gathered(dealt.mapInArrow(lean(extended, "substring_dedup"), CONTEXT_DDL))


def dealt_with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with what was found for their texts."""
    other = found.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), how)


def _removed(n: int, spans: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["begin"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge)[:n] > 0


def cut(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = True, keep: tuple[str, ...] = (), limits: Limits = Limits()) -> DataFrame:
    """Every row of docs (doc_id, text) without the words that a repeated window covers.

    Columns: doc_id, n_words, n_removed, kept_sha256, with texts also kept (the
    words that stay, joined by one blank; null for null texts), and with keep a
    struct `row` of the columns named there, as they are. Null text has no words. Texts of fewer words than a
    window, and empty ones, lose none. Rows that repeat an id are documents like any
    other. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed has from 1 to `window` words")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"), *[F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] * bool(keep))
    joined = dealt_with(named, repeats(named, window, seed, limits), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, spans in zip(each(batch.column(1)), each(batch.column(2)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                left, gone = words, 0
                if spans:
                    out = _removed(len(words), spans)
                    gone = int(out.sum())
                    left = [words[k] for k in np.flatnonzero(~out)]
                kept = b" ".join(left)
                rows.append((len(words), gone, hashlib.sha256(kept).hexdigest(), None if text is None else kept.decode("utf-8", "surrogatepass")))
            get = [[r[k] for r in rows] for k in range(4)]
            arrays = [batch.column(0), pa.array(get[0], pa.int64()), pa.array(get[1], pa.int64()), pa.array(get[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                arrays.append(pa.array(get[3], pa.string()))
                names.append("kept")
            if keep:
                arrays.append(batch.column(3))
                names.append("row")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts
    if keep:
        ddl += ", row " + named.schema["row"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans", *["row"] * bool(keep)).mapInArrow(lean(run, "substring_dedup"), ddl)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(columns(table(spark, sf_dir, "documents"), "doc_id", "text"), texts=False)


#: Windows are compared as md5 of their words; fine for tables of some thousand documents.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), rep AS (
  SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, i + o AS p FROM rep, range(35) AS places(o)
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r
), lost AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
