"""Shared helpers: where intermediate tables live and how they are written.

Intermediate tables are Parquet files in the folder named by
``spark.checkpoint.dir`` (shared by the driver and every executor), so a lost
executor costs a re-read, never a recomputation of what came before.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and
    everything runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexiweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark deletes the shuffle files of a query as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written by one operator call; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the frame that reads it back; the shuffle
        files of the plan that made it go, as nothing else reads them."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def arrow_rows(spark: SparkSession, most: int = 1000, size: int = 4 << 20) -> None:
    """Hold Arrow batches to ``most`` rows and ``size`` bytes, so long texts fit a
    Python worker.  The settings stay, as frames are planned when they are used."""
    for key, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", most), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(str(spark.conf.get(key)).rstrip("b")) <= limit:
            spark.conf.set(key, str(limit))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents that returns their columns: whatever these are called,
    they do not clash with the operator's own names."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        plain = [n if n in ("doc_id", "text", "lang") else f"c{k}" for k, n in enumerate(names)]
        return operator(docs.toDF(*plain), *args, **kwargs).toDF(*names)

    return run
