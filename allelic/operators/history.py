"""Results by version: a stored table of results that new ones are merged into, latest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge_history(old: DataFrame | None, new: DataFrame, key: str = "commit", order: str = "date") -> DataFrame:
    """A row for each key: the new one where there is one, else the old one; of several new rows that of the latest date. Rows without a key count for nothing."""
    rows = new.withColumn("_new", F.lit(True))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc_nulls_last(order), *[F.asc_nulls_last(c) for c in sorted(new.columns) if c not in (key, order)])
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_new")


def latest_first(history: DataFrame, order: str = "date", *then: str) -> DataFrame:
    return history.orderBy(F.desc_nulls_last(order), *then)


def first_of_each(history: DataFrame, version: str, order: str = "date") -> DataFrame:
    """Of each version the latest row (the first one, latest first), in order of time; rows without a version don't count."""
    first = Window.partitionBy(version).orderBy(F.desc_nulls_last(order))
    return history.where(F.col(version).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").orderBy(F.asc_nulls_first(order))


def _states(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return ()
    names = [str(f.getPath().getName()) for f in system.listStatus(place) if f.isDirectory() and system.exists(hadoop.Path(f.getPath(), "_SUCCESS"))]
    return tuple(sorted(n for n in names if n.startswith("state-")))


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The last state that was written whole, or None."""
    states = _states(spark, path)
    return spark.read.parquet(f"{path}/{states[-1]}") if states else None


def add_to_history(spark: SparkSession, path: str, new: DataFrame, key: str = "commit", order: str = "date") -> bool:
    """Merges rows into the history at ``path``; whether anything changed. A state is a folder of its own, so a job that fails leaves the last one, and rows that are there already leave it as it is."""
    old = read_history(spark, path)
    merged = merge_history(old, new, key, order)
    if old is not None and set(old.columns) == set(merged.columns):
        was = old.select(*merged.columns)
        if merged.exceptAll(was).isEmpty() and was.exceptAll(merged).isEmpty():
            return False
    merged.write.parquet(f"{path}/state-{len(_states(spark, path)):08d}")
    return True
