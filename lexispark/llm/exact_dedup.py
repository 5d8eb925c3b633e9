"""Exact deduplication on a cuckoo-filter index.

Texts are equal when they are identical after every run of ASCII blanks has
become one space. A digest index holds live digests: a cuckoo filter answers
"certainly new" without touching the stored keys; a hit is verified against
the keys stored in that bucket (SHA-256 and byte length of the normalised
text), so a false positive never merges two texts. Digests can be deleted
again, and a filter that overflows is rebuilt, twice as large, from the
stored keys.

In Spark every task first runs its rows through an index of its own, so one
group of copies leaves a task as one row however many copies it has; what is
left is dealt out by digest, and one index per bucket of digests merges it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import BLANK_RUN, columns, fresh, lean, partitions, spread, stored, table

SLOTS = 4
KICKS = 200
#: Digests one index holds at once in a merging task; a bucket of digests is cut to about this many.
BUCKET_KEYS = 50_000


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit hashes: 16-bit fingerprints, four slots a bucket."""

    def __init__(self, buckets: int = 64):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.slots: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.size = 0

    def _places(self, h: int) -> tuple[int, int, int]:
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & self.mask)

    def __contains__(self, h: int) -> bool:
        mark, a, b = self._places(h)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, h: int) -> bool:
        """False when no place was found; the caller then rebuilds the filter."""
        mark, a, b = self._places(h)
        for place in (a, b):
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                self.size += 1
                return True
        place = a
        for kick in range(KICKS):
            victim = kick % SLOTS
            mark, self.slots[place][victim] = self.slots[place][victim], mark
            place = self._other(place, mark)
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                self.size += 1
                return True
        return False

    def delete(self, h: int) -> bool:
        mark, a, b = self._places(h)
        for place in (a, b):
            if mark in self.slots[place]:
                self.slots[place].remove(mark)
                self.size -= 1
                return True
        return False


class CuckooIndex:
    """Live digests with what they stand for: the least (id, tie) seen and the number of rows.

    Keys are (digest, length); `content` holds them bucketed by the low bits of the digest.
    """

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}
        self.live = 0
        self.resizes = 0

    @staticmethod
    def _hash(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def find(self, digest: bytes, length: int) -> list | None:
        h = self._hash(digest)
        if h not in self.filter:
            return None
        for entry in self.content.get(h & 0xFFFF_FFFF, ()):
            if entry[0] == digest and entry[1] == length:
                return entry
        return None

    def insert(self, digest: bytes, length: int, first: tuple, rows: int = 1) -> bool:
        """True if the digest was new; otherwise its entry takes the smaller id and the added rows."""
        entry = self.find(digest, length)
        if entry is not None:
            entry[2] = min(entry[2], first)
            entry[3] += rows
            return False
        h = self._hash(digest)
        self.content.setdefault(h & 0xFFFF_FFFF, []).append([digest, length, first, rows])
        self.live += 1
        if not self.filter.insert(h):
            self._resize()
        return True

    def delete(self, digest: bytes, length: int) -> bool:
        """Forget a live digest; False if it was not there."""
        entry = self.find(digest, length)
        if entry is None:
            return False
        h = self._hash(digest)
        bucket = self.content[h & 0xFFFF_FFFF]
        bucket.remove(entry)
        if not bucket:
            del self.content[h & 0xFFFF_FFFF]
        self.live -= 1
        return self.filter.delete(h)

    def _resize(self) -> None:
        """Rebuild the filter from the stored keys, doubled until all of them find a place."""
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            if buckets > 64 * max(1024, self.live):  # equal fingerprint and place throughout: only equal 64-bit prefixes do that
                raise OverflowError("too many digests share their first 64 bits")
            self.filter = CuckooFilter(buckets)
            self.resizes += 1
            if all(self.filter.insert(self._hash(e[0])) for bucket in self.content.values() for e in bucket):
                return

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


_LAST = (1 << 63) - 1
_PARTIAL = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("first_id", pa.int64()), ("tie", pa.int64()), ("n_rows", pa.int64())])
_PARTIAL_DDL = "digest binary, n_bytes bigint, first_id bigint, tie bigint, n_rows bigint"


def _batch(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.binary()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2][1] for r in rows], pa.int64()),
            pa.array([r[2][2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
        ],
        schema=_PARTIAL,
    )


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest met since the index was last emptied; it is emptied at BUCKET_KEYS digests."""
    index = CuckooIndex()
    for batch in batches:
        get = [c.to_pylist() for c in batch.columns]
        for digest, length, first, tie, rows in zip(*get, strict=True):
            index.insert(digest, length, (first is None, first, tie) if first is not None else (True, None, tie), rows)
        if index.live >= BUCKET_KEYS:
            yield _batch(index)
            index = CuckooIndex()
    yield _batch(index)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by digest bucket; a bucket is complete when the next one begins."""
    index, at = CuckooIndex(), None
    for batch in batches:
        get = [c.to_pylist() for c in batch.columns]
        for bucket, digest, length, first, tie, rows in zip(*get, strict=True):
            if bucket != at:
                if index.live >= 2048:
                    yield _batch(index)
                    index = CuckooIndex()
                at = bucket
            index.insert(digest, length, (first is None, first, tie), rows)
    yield _batch(index)


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, digest, n_bytes, print) of every row; tie is another for each row and orders rows of equal doc_id, print is a hash of the text as it is."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANK_RUN, " ")
    return (
        columns(docs, "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.xxhash64("text").alias("print"))
        .select("doc_id", F.monotonically_increasing_id().alias("tie"), F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), "print")
    )


def groups_of(keys: DataFrame) -> DataFrame:
    """(digest, n_bytes, first_id, tie, n_rows): one row for each different text."""
    partial = keys.select("digest", "n_bytes", F.col("doc_id").alias("first_id"), "tie", F.lit(1).cast("long").alias("n_rows")).mapInArrow(lean(_gather, "exact_dedup"), _PARTIAL_DDL)
    bucket = F.xxhash64("digest").bitwiseAND(0xFFFFF)
    return (
        partial.select(bucket.alias("bucket"), *partial.columns)
        .repartition(partitions(keys), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(_merge, "exact_dedup"), _PARTIAL_DDL)
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs with the row that stands for its text.

    Input columns: doc_id, text; others are ignored. Null text counts as empty.
    The row with the smallest doc_id stays; null ids come after all others, and
    of rows that share both id and text one stays. An empty table gives an
    empty result; texts of any length are digested in the JVM, whole, and don't
    move. Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    keys = stored(keys_of(docs), "dedup-keys")
    groups = stored(groups_of(keys), "dedup-groups")
    joined = spread(keys, groups.withColumnRenamed("tie", "keep_tie"), ["digest", "n_bytes"], "n_rows", keys.count())
    return joined.select(
        "doc_id",
        F.col("first_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        (F.col("tie") == F.col("keep_tie")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a smaller doc_id has; all columns stay as they are.

    Nulls, blanks and repeated rows as in dedup(). A row that stays is found
    again by its id and a hash of its text; texts move once.
    """
    names = docs.columns
    own, first_id, first_print = fresh(docs, "own_print", "first_id", "first_print")
    keys = stored(keys_of(docs), "dedup-keys")
    one = groups_of(keys).select("tie").join(keys, "tie").select(F.col("doc_id").alias(first_id), F.col("print").alias(first_print))
    matched = docs.withColumn(own, F.xxhash64("text")).join(one, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(own) == F.col(first_print)), "left_semi")
    if not keys.groupBy("doc_id", "print").count().where("count > 1").isEmpty():
        matched = matched.dropDuplicates(["doc_id", own])  # rows that repeat both id and text all match; one stays
    return matched.select(*[F.col(f"`{n}`") for n in names])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
