"""Token ids as Arrow IPC files of fixed-size lists.

The ids of all documents, in ascending order of id and each followed by an end id, form one stream. It is dealt into
files by ranges of the document id. A file holds record batches of ROWS rows; a row has ``ids``, a fixed-size list of
``seq_len`` ids, and ``mask``, one of as many flags that are false where the file's last row is padded. All rows are of
one size, so position p of a file's stream is at row p // seq_len, in batch p // (seq_len * ROWS): readers map the file
and slice it without copying. Next to each file, an index file holds document, start in the file and length.

Files are written by executors into a folder that all share, under a temporary name first and moved when whole, so a
task that runs again replaces its file by an equal one.

Defined results: a null text counts as empty and still gets its end id; a null id sorts first; rows of one id are
ordered by a hash of their text, and repeated rows are written each; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelic.llm.chunks import larger, library_chunks
from allelic.llm.common import bounded_batches, id_back, keyed, trimmed

SEQ_LEN = 2048
#: Rows of a record batch.
ROWS = 256
MANIFEST = "part int, name string, documents long, ids long"


class TokenWriter:
    """Writes one stream of ids as fixed-size rows, with its index."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, seq_len: int, kind: pa.DataType, rows: int = ROWS):
        self.fs, self.seq_len, self.rows, self.kind = fs, seq_len, rows, kind
        self.finals = [f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"]
        self.temps = [f"{f}.{uuid.uuid4().hex}.tmp" for f in self.finals]
        self.schemas = [
            pa.schema([pa.field("ids", pa.list_(kind, seq_len)), pa.field("mask", pa.list_(pa.bool_(), seq_len))], metadata={"seq_len": str(seq_len), "rows": str(rows)}),
            pa.schema([pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64())]),
        ]
        self.outs = [fs.open_output_stream(t) for t in self.temps]
        self.writers = [pa.ipc.new_file(o, s) for o, s in zip(self.outs, self.schemas, strict=True)]
        self.waiting: list[np.ndarray] = []
        self.held = self.documents = self.total = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        starts = self.total + np.cumsum(lens) - lens
        self.writers[1].write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(lens.astype(np.int64))], schema=self.schemas[1]))
        self.waiting.append(ids)
        self.held, self.total, self.documents = self.held + len(ids), self.total + len(ids), self.documents + len(lens)
        if self.held >= self.seq_len * self.rows:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        step = self.seq_len * self.rows
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            rows = -(-len(part) // self.seq_len)
            full = np.zeros(rows * self.seq_len, self.kind.to_pandas_dtype())
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (full, mask)]
            self.writers[0].write_batch(pa.record_batch(lists, schema=self.schemas[0]))
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        for w, o, t, f in zip(self.writers, self.outs, self.temps, self.finals, strict=True):
            w.close()
            o.close()
            self.fs.move(t, f)


class TokenFile:
    """Random access to a written stream; rows and ids are views of the mapped file where the store allows it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        meta = self.reader.schema.metadata
        self.seq_len, self.rows = int(meta[b"seq_len"]), int(meta[b"rows"])
        self.at, self.ids_of, self.mask_of = -1, np.zeros(0), pa.array([], pa.bool_())

    def _batch(self, number: int) -> np.ndarray:
        if self.at != number:
            batch = self.reader.get_batch(number)
            self.at, self.ids_of, self.mask_of = number, batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
        return self.ids_of

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        at = number % self.rows * self.seq_len
        ids = self._batch(number // self.rows)[at : at + self.seq_len]
        return ids, self.mask_of.slice(at, self.seq_len).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """The ids start .. start + n of the stream, in pieces by batch."""
        step, out = self.seq_len * self.rows, []
        while n:
            at = start % step
            part = self._batch(start // step)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out

    def close(self) -> None:
        self.source.close()


def vocabulary_size(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer's file."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, seq_len: int = SEQ_LEN, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into ``folder`` (a URI that driver and executors share); returns the manifest: part, name, documents, ids. ``vocabulary``: one more than the largest id; by default that of the tokenizer."""
    spark = docs.sparkSession
    if vocabulary is None:
        vocabulary = vocabulary_size(tokenizer)
    bounded_batches(spark)
    kind = pa.uint16() if max(vocabulary - 1, end_id) < 1 << 16 else pa.uint32()
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, chunks = TaskContext.get().partitionId(), None, library_chunks(tokenizer, "byte_level")
        name = f"tokens-{part:06d}"
        for batch in larger(batches, 1):
            if out is None:
                fs, path = pafs.FileSystem.from_uri(folder)
                out = TokenWriter(fs, path, name, seq_len, kind)
            ids, begin = chunks.gather(*chunks.texts(batch.column(1)))
            ids = np.insert(ids, begin[1:], end_id)
            out.add(batch.column(0), ids, np.diff(begin) + 1)
        chunks.clear()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([out.documents]), pa.array([out.total])], names=["part", "name", "documents", "ids"])

    ordered = keyed(docs, id_col, text_col).repartitionByRange("_id", "_th").sortWithinPartitions("_id", "_th").select(id_back().alias("_id"), "_text")
    # one row a file: what the driver holds grows with the files, not with the documents
    return spark.createDataFrame(ordered.mapInArrow(trimmed(write), MANIFEST).toArrow())


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, out of the files."""
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = np.cumsum([0] + [r["ids"] for r in files])
    parts = spark.createDataFrame([(k, r["name"], int(before[k])) for k, r in enumerate(files)], "k int, name string, before long").repartitionByRange(len(files), "k")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = TokenFile(fs, f"{path}/{name}.arrow")
                with fs.open_input_file(f"{path}/{name}.index.arrow") as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        b = index.get_batch(i)
                        crcs = []
                        for start, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                            crc = 0
                            for piece in tokens.ids(start, n):
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy() + first), b.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                tokens.close()

    return parts.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
