"""The kept indexes of the registered text queries: one a table of documents, built once a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexispark.shared import scratch
from lexispark.sources.tables import table
from lexispark.text.store import IndexStore

_STORES: dict[tuple, IndexStore] = {}


def store(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The index of a directory's documents; built anew where their files have changed."""
    path = f"{sf_dir}/documents.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, path, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength())
    if key not in _STORES:
        _STORES[key] = IndexStore(spark, scratch(spark, "index"), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _STORES[key]
