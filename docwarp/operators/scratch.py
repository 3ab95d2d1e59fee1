"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode, where it may be unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-docwarp-"))
    return "file://" + _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this Python process ends."""
    path = f"{shared_dir(spark)}/docwarp-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def forget() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(forget)
    return path


def unsent(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its joins shuffle it (a hint to broadcast the other side goes first).

    Pairs of requests and documents repeat so much that their Parquet files are a thousandth of what they hold: 13 million rows in 4 MB.
    Spark takes the files' size for that of the rows, and would collect them all on the driver for a broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
