"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles'
64-bit hashes have it set. Two fingerprints are linked when they differ in at
most `RADIUS` bits, and documents are grouped by the connected components of
those links.

Candidates come from covering LSH (Pagh, 2016): every bit position gets a
vector of RADIUS + 1 bits; each non-zero vector v of that space gives a mask
of the positions whose vector has an odd product with v. Whatever `RADIUS`
positions two fingerprints differ in, their vectors span less than the whole
space, so some v is orthogonal to all of them and the two agree under v's
mask: every pair within the radius meets in one of 2^(RADIUS+1) - 1 tables.

Within a bucket no pairs are listed. A bucket's fingerprints are linked by a
spanning forest: fingerprints near a pivot join it, and only clusters that are
still apart and close enough are compared, so a bucket of m gives fewer than m
rows. A bucket of more than `CELL` fingerprints is cut into chunks (`links`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, fresh, lean, partitions, spread, stored, table
from lexispark.llm.components import components

RADIUS = 4
SHINGLE = 4
BITS = 64
#: Fingerprints of one bucket that are compared in one place.
CELL = 4096
#: Shingles hashed at once.
STEP = 1 << 16

_SIGNED = 1 << 63


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint; 0 for null texts and texts without a word."""
    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not parts:
        return 0
    line = b" ".join(parts)
    width = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = len(ends)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, STEP):
        hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; position i has the vector i mod (2^(radius+1) - 1) + 1."""
    size = (1 << (radius + 1)) - 1
    place = [i % size + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (place[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - 2 * _SIGNED if x >= _SIGNED else x


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect exactly the components of the graph of distances up to radius."""
    n = len(prints)
    cluster = np.full(n, -1)
    pivots: list[int] = []
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left):
        pivot = left[0]
        near = np.bitwise_count(prints[left] ^ prints[pivot]) <= radius
        own = left[near]
        cluster[own] = len(pivots)
        edges += [(int(pivot), int(x)) for x in own if x != pivot]
        pivots.append(int(pivot))
        left = left[~near]
    if len(pivots) == 1:
        return edges
    root = list(range(len(pivots)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    heads = prints[pivots]
    order = np.argsort(cluster, kind="stable")
    bounds = np.searchsorted(cluster[order], np.arange(len(pivots) + 1))
    members = [order[bounds[k] : bounds[k + 1]] for k in range(len(pivots))]
    for a in range(len(pivots)):
        for b in np.flatnonzero(np.bitwise_count(heads[a + 1 :] ^ heads[a]) <= 3 * radius) + a + 1:
            if find(a) == find(int(b)):
                continue
            for x in members[a]:
                near = np.flatnonzero(np.bitwise_count(prints[members[b]] ^ prints[x]) <= radius)
                if len(near):
                    edges.append((int(x), int(members[b][near[0]])))
                    root[find(a)] = find(int(b))
                    break
    return edges


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, print) come ordered by cell; a cell is complete when the next begins."""
    at, held = None, []

    def linked() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        prints = np.unique(np.array(held, np.int64)).view(np.uint64)
        found = forest(prints)
        if not found:
            return None
        pairs = prints.view(np.int64)[np.array(found)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    for batch in batches:
        for cell, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if cell != at:
                if (out := linked()) is not None:
                    yield out
                at, held = cell, []
            held.append(value)
    if (out := linked()) is not None:
        yield out


def _linked(cells: DataFrame, n: int) -> DataFrame:
    """(a, b) of the forests of cells (cell, print)."""
    return cells.select("cell", "print").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lean(_edges, "links"), "a bigint, b bigint").distinct()


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): edges between different fingerprints (column print, long) that span the components of links.

    Buckets of more than `cell` fingerprints are cut into chunks, which are
    linked each by itself first. In a bucket of near copies that makes one
    component of most of them, and what is in one component needs no more
    comparing: only the others are held against it, and against each other.
    """
    n, total = partitions(prints), prints.count() * len(masks(radius))
    keyed = prints.select(
        "print",
        F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])).alias("mask", "key"),
    )
    keyed = keyed.select("print", F.xxhash64("mask", "key").alias("bucket"))
    sized = stored(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")

    def chunk(size: Column) -> Column:
        return F.pmod(F.xxhash64("print"), F.ceil(size / cell)).cast("int")

    met = spread(keyed, sized, "bucket", "n", total).select("print", F.xxhash64("bucket", chunk(F.col("n"))).alias("cell"))
    edges = stored(_linked(met, n), "simhash-links")
    large = sized.where(F.col("n") > cell)
    if large.isEmpty():
        return edges
    root = components(edges, "a", "b").withColumnRenamed("node", "print")
    crowded = spread(keyed, large, "bucket", "n", total).drop("n").join(root, "print", "left")
    crowded = stored(crowded.withColumn("root", F.coalesce("root", "print")), "simhash-crowded")
    sizes = crowded.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    # the largest component of each bucket, and how many fingerprints aren't in it
    heads = sizes.groupBy("bucket").agg(F.max_by("root", "k").alias("head"), F.max("k").alias("most"), F.sum("k").alias("n")).where("n > most")
    placed = spread(crowded, stored(heads, "simhash-heads"), "bucket", "n", crowded.count())
    rest = F.col("n") - F.col("most")
    placed = placed.select("print", "bucket", (F.col("root") == F.col("head")).alias("inside"), "most", rest.alias("rest"))

    def pairs(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / cell).cast("int") - 1)).alias("other")

    inner = placed.where("inside").select("print", "bucket", chunk(F.col("most")).alias("own"), pairs("rest"))
    outer = placed.where("not inside").select("print", "bucket", chunk(F.col("rest")).alias("own"), "most", "rest")
    across = inner.unionByName(outer.select("print", "bucket", F.col("own").alias("other"), pairs("most").alias("own")))
    among = outer.select("print", "bucket", "own", pairs("rest"))
    cells = across.select(F.xxhash64("bucket", F.lit(0), "own", "other").alias("cell"), "print").unionByName(
        among.select(F.xxhash64("bucket", F.lit(1), F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "print")
    )
    return edges.unionByName(_linked(cells, n)).distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, print) of every row, print as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t) for t in each(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "print"])

    named = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return named.mapInArrow(lean(run, "simhash"), "doc_id bigint, text_hash bigint, print bigint")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, print, root, component_id) for every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id in the component, root its smallest
    fingerprint. Null ids are passed over, unless all of the component's are
    null. Null and blank texts have fingerprint 0 and are linked like any
    other. Rows that repeat an id are rows like any other; an empty table gives
    an empty result.
    """
    prints = stored(fingerprints(docs), "simhash")
    least = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "simhash-distinct")
    edges = stored(links(least), "simhash-links")
    joined = components(edges, "a", "b")  # (node, root): only nodes that have an edge
    found = stored(least.join(joined.withColumnRenamed("node", "print"), "print", "left").select("print", "least", "n_docs", F.coalesce("root", "print").alias("root")), "simhash-roots")
    roots = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    named = stored(spread(found, roots, "root", "n_prints", found.count()).select("print", "root", "component_id", "n_docs"), "simhash-components")
    return spread(prints, named, "print", "n_docs", prints.count()).select("doc_id", "text_hash", "print", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id; all columns stay as they are."""
    names = docs.columns
    own, first_id, first_hash = fresh(docs, "own_hash", "first_id", "first_hash")
    first = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count("*").alias("rows"))
    first = stored(first.select("row.*", "rows"), "simhash-first")
    kept = first.select(F.col("doc_id").alias(first_id), F.col("text_hash").alias(first_hash))
    marked = docs.withColumn(own, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(own) == F.col(first_hash)), "left_semi")
    if not first.where("rows > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", own])  # rows that repeat both id and text: one stays
    return marked.select(*[F.col(f"`{n}`") for n in names])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
