"""Written tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import getpass
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local folder is used only for a local master without a setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return "file://" + os.path.join(tempfile.gettempdir(), f"polyweft-{getpass.getuser()}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/polyweft/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before: its folder's owner cleans up
            return
