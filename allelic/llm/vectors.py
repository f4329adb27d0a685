"""What both searches share: valid vectors, tiles of queries and shards, top lists and their merging.

Queries are dealt into blocks by hash, vectors into shards by turns. Each pair of a block and a shard is a tile, one
partition of its own: the block's queries come first in it, the shard's vectors stream past them. Nothing goes through
the driver; a task holds one block of queries, their lists and one batch of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelic.llm.common import id_back, key_of, trimmed

#: Queries of a block (of 64 doubles each, 32 MB) and vectors of a shard.
QUERY_BLOCK, SHARD = 65_536, 262_144
#: Queries and vectors of one matrix product.
QUERY_TILE, VECTOR_TILE = 512, 4096
#: Lists merged in the first round of the merge: one per query and residue of the shard's number.
FAN_IN = 256


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v (doubles); without vectors that are null, empty or hold null or non-finite components."""
    v = F.col("_v")
    return vectors.select(key_of(F.col(f"`{id_col}`")).alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )


def matrices(batch: pa.RecordBatch | pa.Table, id_at: str = "_id", v_at: str = "_v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each dimension, ids ascending, at most VECTOR_TILE rows."""
    ids = batch.column(id_at).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(id_at).to_numpy()
    v = batch.column(v_at)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], v.type)
    offsets = v.offsets.to_numpy()
    flat = v.values.to_numpy(zero_copy_only=False)
    dims = np.diff(offsets)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        for k in range(0, len(rows), VECTOR_TILE):
            part = rows[k : k + VECTOR_TILE]
            yield ids[part], flat[offsets[part][:, None] + np.arange(d)]


def block_of(batches: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The queries of a tile: dimension -> ids, matrix; ids ascending."""
    by: dict[int, list] = {}
    for batch in batches:
        for ids, m in matrices(batch):
            by.setdefault(m.shape[1], []).append((ids, m))
    found = {}
    for d, parts in sorted(by.items()):
        ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        found[d] = ids[order], m[order]
    return found


class TopLists:
    """The k best candidates of each query so far: score descending, then id ascending."""

    def __init__(self, queries: int, k: int, dtype=np.float64):
        self.k = k
        self.ids = np.zeros((queries, k), np.int64)
        self.scores = np.zeros((queries, k), dtype)
        self.n = np.zeros(queries, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """scores: of queries first.. against candidates; ids: of the candidates, by column or by cell; allowed: cells that count."""
        q, n = scores.shape
        if not n:
            return
        k, rows = self.k, slice(first, first + q)
        least = self.scores[rows, -1]
        full = self.n[rows] == k
        ok = np.ones(scores.shape, bool) if allowed is None else allowed
        mask = ok & (~full[:, None] | (scores >= least[:, None]))
        crowded = np.flatnonzero(mask.sum(1) > 4 * k)
        if len(crowded):  # partial selection: only what reaches the k-th best of the tile
            part = np.where(mask[crowded], scores[crowded], np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf)
            kth = np.partition(part, n - k, axis=1)[:, n - k]
            mask[crowded] &= scores[crowded] >= kth[:, None]
        r, c = np.nonzero(mask)
        if not len(r):
            return
        have = np.nonzero(np.arange(k)[None, :] < self.n[rows][:, None])
        own = have[0] + first, have[1]
        row = np.concatenate([r, have[0]])
        score = np.concatenate([scores[r, c], self.scores[own]])
        cand = np.concatenate([ids[c] if ids.ndim == 1 else ids[r, c], self.ids[own]])
        order = np.lexsort((cand, -score, row))
        row, score, cand = row[order], score[order], cand[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        row, rank = row[keep] + first, rank[keep]
        self.scores[row, rank], self.ids[row, rank] = score[keep], cand[keep]
        self.n[rows] = np.bincount(row - first, minlength=q)

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.arange(self.k)[None, :] < self.n[:, None])
        return query_ids[r], self.ids[r, c], self.scores[r, c]


def tiles(vectors: DataFrame, queries: DataFrame, rows: int, asked: int, block: int | None = None) -> tuple[DataFrame, int]:
    """Rows of ``queries`` and ``vectors`` (_id, _v, ...) with _vector (false: a query), a partition for each pair of block and shard, queries first; and the number of blocks.

    A query id that repeats counts once, with its least vector. Vectors take their shards by turns, so rows that repeat are
    spread; ``vectors`` must be read from a table, where each attempt of a task meets its rows in the same order.
    """
    blocks = max(1, -(-asked // (block or QUERY_BLOCK)))
    shards = max(1, -(-rows // SHARD), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    one = queries.groupBy("_id").agg(F.min(F.struct(F.size("_v").alias("_n"), "_v")).alias("_least")).select("_id", "_least._v")
    own_block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    asked_rows = one.withColumn("_block", own_block).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    dealt = vectors.withColumn("_shard", shard).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = dealt.withColumn("_vector", F.lit(True)).unionByName(asked_rows.withColumn("_vector", F.lit(False)), allowMissingColumns=True)
    tile = F.col("_shard") * blocks + F.col("_block")
    return both.repartitionById(blocks * shards, tile).sortWithinPartitions("_vector").drop("_block", "_shard"), blocks


def partial_lists(vectors: DataFrame, queries: DataFrame, kernel: Callable, kind: str, rows: int, asked: int, block: int | None = None) -> DataFrame:
    """_q, _c, _s, _shard: top lists of each tile. kernel(block) makes a function from batches of vectors to (query ids, candidate ids, scores); rows and asked: how many vectors and queries there are at most; block: queries of a block."""
    dealt, blocks = tiles(vectors, queries, rows, asked, block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId() // blocks, []

        def candidates(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for batch in batches:
            of_vectors = batch.column(batch.schema.get_field_index("_vector"))
            n = batch.num_rows - (of_vectors.true_count if batch.num_rows else 0)
            if n:
                own.append(batch.slice(0, n))
            if n < batch.num_rows:
                if own:
                    for q, c, s in kernel(block_of(own))(candidates(batch.slice(n))):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s), pa.array(np.full(len(q), shard, np.int32))], names=["_q", "_c", "_s", "_shard"])
                return

    return dealt.mapInArrow(trimmed(scan), f"_q long, _c long, _s {kind}, _shard int")


def narrowed(lists: DataFrame, k: int) -> DataFrame:
    """_q, _c, _s, _r (from 1): the k best of each query of the lists of all shards, in two rounds."""
    best = [F.col("_s").desc(), F.col("_c").asc()]
    near = lists.withColumn("_g", F.col("_shard") % FAN_IN)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_q", "_g").orderBy(*best))).where(F.col("_r") <= k)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(*best))).where(F.col("_r") <= k)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the lists of all shards merged."""
    return narrowed(lists, k).select(id_back("_q").alias("query_id"), F.col("_r").cast("int").alias("rank"), id_back("_c").alias("vec_id"), F.col("_s").alias("score"))
