"""Tables and files that all executors share and that survive a lost one."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir.

    Where that is unset: below the warehouse, or for a local master in the temporary folder.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        local = spark.sparkContext.master.startswith("local")
        home = "file://" + os.path.join(tempfile.gettempdir(), "starlattice-checkpoints") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_starlattice"
    return f"{home.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def posix_folder(spark: SparkSession, tag: str) -> str:
    """The same as a folder that file functions can open; the shared folder must be mounted for that."""
    path = shared_path(spark, tag).removeprefix("file://")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path} is not a mounted folder")
    os.makedirs(path, exist_ok=True)
    return path


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
