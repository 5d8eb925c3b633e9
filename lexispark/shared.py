"""Storage that driver and executors share, and tables written there to end lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local folder if there are no executors on other machines (tests), and an error else.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexispark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    held = weakref.ref(spark)

    def run() -> None:
        session = held()
        if session is not None and session.sparkContext._jsc is not None and not session.sparkContext._jsc.sc().isStopped():
            remove(session, path)

    atexit.register(run)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexispark/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of about as many bytes as df has: at least those it is read in."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, df.rdd.getNumPartitions())


def spread(df: DataFrame, mb: int = 4, least: int | None = None) -> int:
    """Partitions of about `mb` MB each of df's files, for what unfolds to far more than it is stored in; never fewer than `least`, or else `partitions`.

    What a task holds then depends on `mb` and not on the size of df.
    """
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = found if found < 1 << 50 else 0  # frames of unknown size say more
    return max(partitions(df) if least is None else least, min(100_000, known // (mb << 20)))


def stored(df: DataFrame, name: str, sort_within: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.sortWithinPartitions(*sort_within) if sort_within else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
