"""A text index that is kept: tables sorted by term, so that a search reads the row groups of its terms alone.

    blocks      term, block, offs, tfs, doc_ids: postings by blocks of documents
    docs        doc_id, doc_ord
    stats       term, nums, n_blocks, selectivity

Postings (doc_id, term, tf) and bitmaps (term, bucket, bits) are views of the
blocks: a filter by term reaches the scan, so only the blocks of the terms
asked for are unfolded. A bitmap takes 4 KB however few documents have its
term, so those of all terms are not kept.

Each table is written once, when it is first asked for, and is there once its
folder is complete; `load` finds what an earlier session has saved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.shared import partitions, remove, stored
from lexispark.text import index as indexing

TABLES = {
    "blocks": "term string, block int, offs array<smallint>, tfs array<smallint>, doc_ids array<bigint>",
    "docs": "doc_id bigint, doc_ord bigint",
    "stats": "term string, nums bigint, n_blocks bigint, selectivity double",
}
#: Postings that a task sorts and folds to blocks.
ROWS = 1_000_000
#: Rows of a row group's column chunk, in bytes: small enough that a term's postings are a few of many.
ROW_GROUP = 4 << 20


class IndexStore:
    """The index of a corpus at a path of any store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, docs: DataFrame | None = None):
        self.spark, self.path, self.corpus = spark, path.rstrip("/"), docs

    @classmethod
    def save(cls, docs: DataFrame, path: str) -> IndexStore:
        """Build all tables of a corpus (doc_id, text) at path."""
        store = cls(docs.sparkSession, path, docs)
        for name in TABLES:
            store.table(name)
        return store

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IndexStore:
        """The index that was saved at path."""
        store = cls(spark, path)
        if missing := [name for name in TABLES if not store._there(name)]:
            raise FileNotFoundError(f"no index at {path}: {missing} missing")
        return store

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _write(self, name: str, df: DataFrame, n: int, *by: str, then=lambda ranged: ranged) -> None:
        ordered = then(df.repartitionByRange(n, *by)).sortWithinPartitions(*by)
        ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{name}")

    def _make(self, name: str) -> None:
        if self.corpus is None and name in ("blocks", "docs"):
            raise FileNotFoundError(f"no {name} at {self.path}")
        if name == "docs":
            indexing.ordinals(self.corpus).write.mode("overwrite").parquet(f"{self.path}/docs")
        elif name == "blocks":
            # ranges are cut by sampling: texts are cut to terms once, before that
            found = stored(indexing.placed(self.corpus, ords=self.docs), "postings")
            n = max(partitions(self.corpus), found.count() // ROWS + 1)
            self._write(name, indexing.entries(found), n, "term", "block", then=indexing.folded)
        else:
            blocks = self.blocks
            self._write(name, indexing.term_stats(blocks), partitions(blocks), "term")

    def table(self, name: str) -> DataFrame:
        if name == "postings":
            return self.postings
        if name == "bitmaps":
            return self.bitmaps
        found = self._kept(name)
        # of documents with a null id there are postings only
        return found.where("block is not null").drop("doc_ids") if name == "blocks" else found

    def _kept(self, name: str) -> DataFrame:
        if not self._there(name):
            self._make(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        entry = F.explode(F.arrays_zip("doc_ids", "tfs")).alias("e")
        return self._kept("blocks").select("term", entry).select(F.col("e.doc_ids").alias("doc_id"), "term", F.col("e.tfs").alias("tf"))

    @property
    def blocks(self) -> DataFrame:
        return self.table("blocks")

    @property
    def docs(self) -> DataFrame:
        return self.table("docs")

    @property
    def stats(self) -> DataFrame:
        return self.table("stats")

    @property
    def bitmaps(self) -> DataFrame:
        return indexing.bitmaps(self.blocks)

    def terms(self, low: str, high: str) -> DataFrame:
        """The postings of terms from low to high, both included."""
        return self.postings.where(F.col("term").between(low, high))

    def drop(self) -> None:
        remove(self.spark, self.path)
