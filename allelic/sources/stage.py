"""Intermediate tables in the folder that the driver and all executors share: they cut the plan, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder, in local mode only: executors of a cluster would each write to their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='allelic-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read from there; the table goes when the driver's process ends."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
