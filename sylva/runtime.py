"""Session helpers: the shared scratch folder and lineage cuts through written tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a machine-local folder only in local mode without one (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sylva-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no lineage.

    ``save`` writes and reads back; ``drop`` frees a table that no later step reads. What is left goes at exit,
    as a returned DataFrame still reads it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by`` parts the table by a column's values, so that ``drop(f"{name}/{by}=value")`` frees one of them."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Frees all tables but those that the result still reads."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone by now
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now rather than when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
