"""A text index that changes: segments, tombstones, commits and merges.

An index is a folder of immutable segments (postings and document ids by
seg_id), tombstones and a manifest. A segment counts once a manifest version
lists it, so a job that dies half-way leaves nothing visible. A tombstone
(doc_id, upto) hides the document in segments born up to `upto`; a later
version of the document, in a later segment, is seen. A merged segment is as
old as the newest that it holds, so what is deleted during a merge stays so.

Queued documents are folders, one for each call; a flush takes the folders that
are there when it begins, and what is queued meanwhile waits for the next.
Merges may run beside searches, flushes and other merges of one
`SegmentedIndex`; the files of merged segments stay for readers of older
manifests until `vacuum` finds them past their time.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.shared import spread
from lexispark.text import search as searching
from lexispark.text.query import Predicate
from lexispark.text.tokenize import postings

#: Pending documents that make commit() write a segment.
FLUSH_DOCS = 512
POSTINGS = "seg_id int, doc_id bigint, term string, tf smallint"
DOCS = "seg_id int, doc_id bigint"
TOMBSTONES = "doc_id bigint, upto int"
PENDING = "doc_id bigint, text string, added bigint, nth bigint"
MANIFEST = "seg_id int, n_docs bigint, born int"
#: Seconds for which files of merged segments and old manifests stay.
RETENTION = 3600.0


@dataclass(frozen=True)
class MergePolicy:
    """Segments of about one size are merged: levels are bands of `band` in log2 of the size."""

    band: float = 0.75
    at_least: int = 4
    min_layer: int = 10_000
    max_docs: int = 10_000_000

    def find(self, sizes: dict[int, int]) -> list[list[int]]:
        """Groups of segment ids to merge, from {seg_id: documents}."""
        small = sorted(((n, s) for s, n in sizes.items() if n <= self.max_docs), reverse=True)
        groups: list[list[int]] = []
        level, top = [], math.inf
        for n, seg in small:
            height = math.log2(max(n, self.min_layer))
            if level and height < top - self.band:
                groups.append(level)
                level = []
            if not level:
                top = height
            level.append(seg)
        groups.append(level)
        return [sorted(g) for g in groups if len(g) >= self.at_least]


class SegmentedIndex:
    """An index at a path of any store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, policy: MergePolicy | None = None, retention: float = RETENTION):
        self.spark, self.path, self.policy, self.retention = spark, path.rstrip("/"), policy or MergePolicy(), retention
        self._lock = threading.RLock()  # held while a manifest is read, changed and published
        self._merging: set[int] = set()
        self._given = 0  # the largest segment id handed out
        self._pool: ThreadPoolExecutor | None = None

    # storage

    def _fs(self, part: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, part: str) -> bool:
        fs, at = self._fs(part)
        return fs.exists(at)

    def _drop(self, part: str) -> None:
        fs, at = self._fs(part)
        fs.delete(at, True)

    def _read(self, part: str, ddl: str) -> DataFrame:
        if not self._exists(part):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{part}")

    def _versions(self) -> list[int]:
        fs, at = self._fs("manifest")
        found = fs.listStatus(at) if fs.exists(at) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._exists(f"manifest/{n}/_SUCCESS"))

    def _manifest(self) -> dict[int, tuple[int, int]]:
        """{seg_id: (documents, born)} of the visible segments."""
        versions = self._versions()
        if not versions:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={versions[-1]}").collect()
        return {r.seg_id: (r.n_docs, r.born) for r in rows}

    def segments(self) -> dict[int, int]:
        """{seg_id: documents, deleted ones included} of the visible segments."""
        return {seg: n for seg, (n, _) in self._manifest().items()}

    def _publish(self, segments: dict[int, tuple[int, int]]) -> None:
        version = max(self._versions(), default=0) + 1
        rows = self.spark.createDataFrame([(seg, n, born) for seg, (n, born) in sorted(segments.items())], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def segment_num(self) -> int:
        return len(self.segments())

    # changes

    def add_documents(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Queue documents; they are seen after a commit. Of versions of one document the one queued last is taken, within a call the later row."""
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(time.time_ns()).alias("added"), F.monotonically_increasing_id().alias("nth"))
        rows.write.parquet(f"{self.path}/pending/{uuid.uuid4().hex}")

    def add_document(self, doc_id: int, text: str) -> None:
        self.add_documents(self.spark.createDataFrame([(doc_id, text)], "doc_id bigint, text string"))

    def _queue(self) -> list[str]:
        """The complete folders of queued documents."""
        fs, at = self._fs("pending")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(f"pending/{n}" for n in names if self._exists(f"pending/{n}/_SUCCESS"))

    def _queued(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], PENDING)
        return self.spark.read.schema(PENDING).parquet(*[f"{self.path}/{f}" for f in folders])

    def pending(self) -> int:
        return self._queued(self._queue()).count()

    def commit(self) -> bool:
        """Write a segment if enough documents are pending, then merge where the policy says so."""
        return self.flush() if self.pending() >= FLUSH_DOCS else False

    def flush(self) -> bool:
        """Write the documents that are pending now as a segment, however few; False if there are none."""
        folders = self._queue()
        queued = self._queued(folders)
        if queued.isEmpty():
            return False
        # texts are dealt by document, and the terms of the last version are counted there; small queues make few files
        dealt = queued.repartition(spread(queued, 8, least=1), "doc_id")
        last = dealt.groupBy("doc_id").agg(F.max_by(F.struct("text"), F.struct("added", "nth"))["text"].alias("text"))
        seg = self._next()
        self._write(seg, postings(last), queued.select("doc_id").distinct())
        n = self._count(seg)
        with self._lock:
            self._publish(self._manifest() | {seg: (n, seg)})
        for folder in folders:
            self._drop(folder)
        self.merge()
        return True

    def _next(self) -> int:
        """A segment id that no other has or gets."""
        with self._lock:
            marks = self._read("tombstones", TOMBSTONES).agg(F.max("upto")).first()[0]
            self._given = max([self._given, *self._manifest(), marks or 0]) + 1
            return self._given

    def _write(self, seg: int, found: DataFrame, docs: DataFrame) -> None:
        # sorted by term, so that row groups without a query's terms are skipped
        found.select("doc_id", "term", "tf").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{self.path}/postings/seg_id={seg}")
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/seg_id={seg}")

    def _count(self, seg: int) -> int:
        return self.spark.read.schema("doc_id bigint").parquet(f"{self.path}/docs/seg_id={seg}").count()

    def delete_documents(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Hide documents in all segments there are."""
        upto = max(self.segments(), default=0)
        ids.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(upto).cast("int").alias("upto")).write.mode("append").parquet(f"{self.path}/tombstones")

    def delete_document(self, doc_id: int) -> None:
        self.delete_documents(self.spark.createDataFrame([(doc_id,)], "doc_id bigint"))

    def update_documents(self, docs: DataFrame) -> None:
        """Hide the old versions and queue the new ones."""
        self.delete_documents(docs)
        self.add_documents(docs)

    # merging

    def find_merges(self) -> list[list[int]]:
        """What the policy would merge, of segments that aren't being merged."""
        with self._lock:
            return self.policy.find({seg: n for seg, n in self.segments().items() if seg not in self._merging})

    def merging(self) -> set[int]:
        """Segments that a merge is at work on."""
        return set(self._merging)

    def merge(self) -> int:
        """Merge what the policy finds; the number of merges made."""
        groups = self._claimed()
        for group in groups:
            self._compact(group)
        return len(groups)

    def schedule_merge(self) -> list[Future]:
        """Merge what the policy finds in the background, one job after the other; searches go on meanwhile."""
        self._pool = self._pool or ThreadPoolExecutor(1, "merge")
        return [self._pool.submit(self._compact, group) for group in self._claimed()]

    def _claimed(self) -> list[list[int]]:
        with self._lock:
            groups = self.find_merges()
            self._merging.update(seg for g in groups for seg in g)
            return groups

    def compact(self, group: list[int] | None = None) -> None:
        """Rewrite segments (by default all that aren't being merged) as one, without what tombstones hide."""
        with self._lock:
            there = set(self.segments()) - self._merging
            group = sorted(there if group is None else there & set(group))
            self._merging.update(group)
        if group:
            self._compact(group)

    def _compact(self, group: list[int]) -> None:
        try:
            born = max(self._manifest()[s][1] for s in group)
            seg = self._next()
            docs = self.live_docs().where(F.col("seg_id").isin(group)).select("doc_id")
            self._write(seg, self.live_postings().where(F.col("seg_id").isin(group)), docs)
            n = self._count(seg)
            with self._lock:
                self._publish({s: k for s, k in self._manifest().items() if s not in group} | {seg: (n, born)})
        finally:
            self._merging.difference_update(group)
        self.vacuum()

    def vacuum(self, retention: float | None = None) -> int:
        """Delete manifests that were replaced more than `retention` seconds ago, and segments that only they list; the number of segments deleted."""
        before = (time.time() - (self.retention if retention is None else retention)) * 1000
        with self._lock:
            versions = self._versions()
            fs, at = self._fs("manifest")
            since = {v: fs.getFileStatus(self._fs(f"manifest/v={v}")[1]).getModificationTime() for v in versions}
            old = [v for v, after in zip(versions, versions[1:]) if since[after] <= before]
            lists = lambda v: {r.seg_id for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={v}").collect()}
            kept = set().union(*(lists(v) for v in versions if v not in old))
            gone = set().union(*(lists(v) for v in old)) - kept
            for seg in gone:
                self._drop(f"postings/seg_id={seg}")
                self._drop(f"docs/seg_id={seg}")
            for v in old:
                self._drop(f"manifest/v={v}")
        return len(gone)

    # reading

    def _live(self, part: str, ddl: str) -> DataFrame:
        seen = self._manifest()
        if not seen:
            return self.spark.createDataFrame([], ddl)
        # the folders of the manifest's segments, whatever comes or goes beside them
        paths = [f"{self.path}/{part}/seg_id={seg}" for seg in sorted(seen)]
        rows = self.spark.read.schema(ddl).option("basePath", f"{self.path}/{part}").parquet(*paths)
        marks = self._read("tombstones", TOMBSTONES).groupBy("doc_id").agg(F.max("upto").alias("upto"))
        ages = [(seg, born) for seg, (_, born) in sorted(seen.items()) if born != seg]
        if ages:
            merged = F.broadcast(self.spark.createDataFrame(ages, "seg_id int, born int"))
            rows = rows.join(merged, "seg_id", "left").withColumn("born", F.coalesce("born", "seg_id"))
        else:
            rows = rows.withColumn("born", F.col("seg_id"))
        dead = (rows["doc_id"] == marks["doc_id"]) & (rows["born"] <= marks["upto"])
        return rows.join(marks, dead, "left_anti").drop("born")

    def live_postings(self) -> DataFrame:
        return self._live("postings", POSTINGS)

    def live_docs(self) -> DataFrame:
        return self._live("docs", DOCS)

    def search(self, query: str | Predicate) -> DataFrame:
        return searching.search(self.live_postings(), query, self.live_docs())

    def count(self, query: str | Predicate) -> int:
        return self.search(query).count()

    def scored(self, query: str | Predicate) -> DataFrame:
        return searching.scored(self.live_postings(), query)
