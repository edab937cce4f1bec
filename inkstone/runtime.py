"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``. Where none is set, a local master gets a fresh
    one; on a cluster that is an error, since executors share no local folder."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and return a frame that reads it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Shuffle files of the queries inside go as each ends. Else they stay until the driver collects its garbage, so a job of
    many rounds keeps those of all of them."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session has ``value`` inside, and what it had before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one job below the shared checkpoint folder; ``remove`` deletes them when their last reader is done.

    A table that is read back starts a fresh plan with its true size, where a checkpoint carries along what the
    optimizer has inferred about it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables = 0

    def write(self, rows: DataFrame) -> DataFrame:
        """``rows``, written once and read back."""
        path = f"{self.folder}/{self._tables}"
        self._tables += 1
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def remove(self, *kept: DataFrame) -> None:
        """Delete all tables but those that ``kept`` reads."""
        names = {f.rpartition("/")[0].rpartition("/")[2] for rows in kept for f in rows.inputFiles() if f"/{self.folder.rpartition('/')[2]}/" in f}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in range(self._tables):
            if str(k) not in names:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
                path.getFileSystem(conf).delete(path, True)
