"""Row operators on streams: all are stateless, so a stream of variant texts runs through the same functions, or batch by batch through the batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant


def variant_stream(spark: SparkSession, path: str, schema: str = "hgvs string") -> DataFrame:
    """Variants of tab-separated files as they arrive, parsed, with their canonical texts and errors."""
    rows = spark.readStream.csv(path, sep="\t", schema=schema)
    return with_variant(rows, "hgvs").withColumn("text", format_variant(F.col("variant")))


def batches_to(stream: DataFrame, job: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs a batch job (as ``validate``) on each batch of a stream and writes its rows under ``folder``, one folder a batch.

    A batch that is run again after a failure, with the rows that the checkpoint holds for its number, overwrites its own folder, so no row is there twice.
    Triggers as those of a stream writer, by default all that is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
