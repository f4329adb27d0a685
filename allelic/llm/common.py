"""What the operators of this subpackage share: document keys, shared storage, batch bounds."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id; sorts before every other id.
NULL_ID = -(2**63)
#: Rows and bytes of whole texts handed to Python at once.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or an own one where that is unset, in local mode only (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='allelic-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    # deletion at the end is asked for a path that is there
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again; cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of whole texts small, in rows and in bytes; bounds set lower stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if _bytes_of(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _bytes_of(size: str) -> float:
    """Of a size as Spark's settings give it; without bound where it isn't read."""
    digits = size.lower().rstrip("bkmg")
    power = {"k": 10, "m": 20, "g": 30}.get(size.lower()[len(digits) :][:1], 0)
    return int(digits) << power if digits.isdigit() else float("inf")


def key_of(id_col: str | Column) -> Column:
    """The document id as a long that is never null."""
    return F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long"), F.lit(NULL_ID))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``_id`` (never null), ``_th`` (hash of the text) and ``_text`` (never null); with ``carry`` the whole row as ``_row``.

    (_id, _th) identifies a document: rows that repeat in id and text are one document, rows that share only the id
    are told apart by the hash, which also orders them.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    columns = [key_of(F.col(f"`{id_col}`")).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return docs.select(*columns)


def id_back(column: str | Column = "_id") -> Column:
    """The id as it was, null where it was null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NULL_ID, c)


def row_with(docs: DataFrame, changed: dict[str, Column], row: str = "_row") -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them replaced; types and order stay."""
    kinds = dict(docs.dtypes)
    return [(changed[c].cast(kinds[c]) if c in changed else F.col(row).getField(c)).alias(c) for c in docs.columns]


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow; at a task's end the worker, which stays, gives memory that it no longer uses back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped
