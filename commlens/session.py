"""Session defaults and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "commlens", **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and adaptive execution."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The table written in buckets of ``key`` below spark.checkpoint.dir: joins of such tables on the key need no exchange.

    The files go when the application ends, and the name with the session.
    """
    spark = df.sparkSession
    name = f"commlens_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    atexit.register(_remove, spark, path)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder, where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="commlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir; the folder goes when the application ends."""
    path = f"{shared_folder(spark)}/commlens-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if SparkContext._active_spark_context is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the table, written once as Parquet below spark.checkpoint.dir and read back.

    It survives the loss of any executor, is columnar, and is computed once (a checkpoint of rows
    is computed twice).  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
