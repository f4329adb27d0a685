"""Exact top-k search by integer inner product.

Components are scaled and floored to integers. A tile of queries times a tile of a shard is one matrix product (in
doubles, which is exact while the sums stay under 2**53; beyond that, Python integers); each tile gives a partial
selection that joins the shard's top list of a query, and the lists of all shards are merged in two rounds. Every pair
of a query and a row is scored; memory holds a block of queries with a list each and one batch of a shard.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
dimension than the query's are no candidates of it; rows with the query's id are its own row; a query id that repeats
counts once; repeated rows are candidates each; components that leave the doubles when scaled count with their exact floor; ties go to the smaller id; sums beyond a long are held at its ends;
fewer candidates than k give fewer rows, empty tables none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.vectors import QUERY_TILE, TopLists, matrices, merged, partial_lists, valid_vectors

EXACT = 2.0**53


def floored(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component: whole doubles, or Python integers where scaling a component leaves the doubles."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * m)
    if np.isfinite(whole).all():
        return whole
    return np.array([[math.floor(Fraction(x) * Fraction(scale)) for x in r] for r in m.tolist()], object).reshape(m.shape)


def integer_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers (doubles, or integers of any size), as longs."""
    if q.dtype != object and v.dtype != object and np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _kernel(k: int, scale: float):
    def on(block: dict):
        def run(batches: Iterator[pa.RecordBatch]):
            lists = {d: TopLists(len(ids), k, np.int64) for d, (ids, _) in block.items()}
            whole = {d: floored(m, scale) for d, (_, m) in block.items()}
            for batch in batches:
                for ids, m in matrices(batch):
                    if (d := m.shape[1]) in block:
                        m = floored(m, scale)
                        for at in range(0, len(block[d][0]), QUERY_TILE):
                            own = block[d][0][at : at + QUERY_TILE]
                            lists[d].add(at, integer_scores(whole[d][at : at + QUERY_TILE], m), ids, own[:, None] != ids[None, :])
            for d, found in lists.items():
                yield found.rows(block[d][0])

        return run

    return on


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the k rows of ``vectors`` of the highest integer inner product."""
    lists = partial_lists(valid_vectors(vectors, id_col, vector_col), valid_vectors(queries, id_col, vector_col), _kernel(k, scale), "long", vectors.count(), queries.count())
    return merged(lists, k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
