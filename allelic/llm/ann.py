"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are scaled to length one, so that the largest cosine is the largest inner product. Two components together are
quantised to one of 16 centroids (four bits). The codebooks minimise a loss that weighs the part of the residual
parallel to the vector ETA times the orthogonal part, since only the former changes the large inner products: codes are
chosen by coordinate descent over the subspaces, centroids by the weighted normal equations. A query turns into a table
of 16 products per subspace; a scan of the codes sums table entries by code.

The sums alone can't part rows that lie closer than the codes' error (tight groups, rows about one mean, many rows), so an exact check
follows: with a row's residual split into its part p along the row and the length t of the rest, a row of cosine s to the query has a sum of at
least (1 - p) s - t sqrt(1 - s^2), which grows with s. A row whose sum is below that for the query's k-th best cosine so far can't be among
the k nearest; all others are scored by the exact cosine in doubles. No row that belongs to a result is lost, however the rows lie.

The codebooks are fitted on at most ``sample`` rows (smallest hashes of the id); every row is encoded and searched.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part; vectors of
another dimension than the query's are no candidates of it; rows with the query's id are its own row; a query id that
repeats counts once; repeated rows are candidates each; ties go to the smaller id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from allelic.llm.common import stored, trimmed
from allelic.llm.vectors import QUERY_TILE, VECTOR_TILE, TopLists, matrices, merged, partial_lists, valid_vectors

CENTROIDS, SUB = 16, 2
SAMPLE = 20_000
SHORTLIST = 256
#: What sums in single precision may be off; the share of pairs let through from which a tile is multiplied in doubles first; values gathered together.
SLACK, DENSE, GATHERED = 2e-5, 1 / 64, 1 << 21
#: Queries of a block: their lists are short, so that more of them meet a shard.
ASKED_BLOCK = 131_072
#: Inner products above this share of the vectors' lengths are those that matter; it sets the weight of the parallel part.
THRESHOLD = 0.2


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so that no square overflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in doubles."""
    a, b = (x / np.abs(x).max(-1, keepdims=True) for x in (a, b))
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _parts(x: np.ndarray) -> np.ndarray:
    """rows x subspaces x SUB; an odd dimension gets a zero."""
    if x.shape[1] % SUB:
        x = np.pad(x, ((0, 0), (0, SUB - x.shape[1] % SUB)))
    return x.reshape(len(x), -1, SUB)


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) of unit rows, by coordinate descent on |r|^2 + (weight - 1) <r, x>^2."""
    p = _parts(x)
    dist = np.stack([((p[:, m, None, :] - books[m][None]) ** 2).sum(-1) for m in range(p.shape[1])], 1)
    along = np.stack([((p[:, m, None, :] - books[m][None]) * p[:, m, None, :]).sum(-1) for m in range(p.shape[1])], 1)
    codes = dist.argmin(2)
    at = np.arange(len(p))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for m in range(p.shape[1]):
            rest = total - along[at, m, codes[:, m]]
            codes[:, m] = (dist[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[at, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, weight: float, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces x CENTROIDS x SUB) for unit rows."""
    p, rng = _parts(x), np.random.default_rng(seed)
    books = np.stack([p[rng.choice(len(p), CENTROIDS, replace=len(p) < CENTROIDS), m] for m in range(p.shape[1])])
    for _ in range(rounds):
        codes = encode(x, books, weight, 1)
        r = ((p - books[np.arange(p.shape[1])[None], codes]) * p).sum(2)
        total = r.sum(1)
        for m in range(p.shape[1]):
            target = (total - r[:, m]) + (p[:, m] ** 2).sum(1)
            for j in range(CENTROIDS):
                own = codes[:, m] == j
                if own.any():
                    y, t = p[own, m], target[own]
                    books[m, j] = np.linalg.solve(len(y) * np.eye(SUB) + (weight - 1) * y.T @ y, y.sum(0) + (weight - 1) * (t[:, None] * y).sum(0))
            new = ((p[:, m] - books[m, codes[:, m]]) * p[:, m]).sum(1)
            total, r[:, m] = total - r[:, m] + new, new
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :parts]


def nonzero(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.exists("_v", lambda x: x != 0))


def residuals(u: np.ndarray, packed: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows and their codes: the residual's part along the row, and the length of the rest; for a code that points away from its row what excludes nothing."""
    x = _parts(u).reshape(len(u), -1)
    r = x - decoded(packed, books)
    p = (r * x).sum(1)
    t = np.sqrt(((r - p[:, None] * x) ** 2).sum(1))
    return np.where(p < 1, p, 1e3), np.where(p < 1, t, 1e3)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """_id, _v, _code, _p, _t (see ``residuals``) of every valid row, written to the shared folder, and the codebooks of each dimension."""
    rows = nonzero(valid_vectors(vectors, id_col, vector_col))
    single = vectors.schema[vector_col].dataType.elementType == FloatType()
    by: dict[int, list] = {}
    for _, m in matrices(rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).toArrow()):
        by.setdefault(m.shape[1], []).append(unit(m))
    books = {d: fit(np.concatenate(x), eta(d)) for d, x in by.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in matrices(batch):
                d, u = m.shape[1], unit(m)
                # a dimension that the sample missed has no codebook; its rows are searched exactly
                packed, p, t = np.zeros((len(m), 0), np.uint8), np.zeros(len(m)), np.zeros(len(m))
                if d in sent.value:
                    packed = pack(encode(u, sent.value[d], eta(d)))
                    p, t = residuals(u, packed, sent.value[d])
                flat = pa.array(m.ravel().astype(np.float32 if single else np.float64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * d, pa.int32()), flat), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(p.astype(np.float32)), pa.array(t.astype(np.float32))],
                    names=["_id", "_v", "_code", "_p", "_t"],
                )

    coded = rows.mapInArrow(trimmed(code), f"_id long, _v array<{'float' if single else 'double'}>, _code binary, _p float, _t float")
    return stored(coded, "ann"), books


def decoded(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The centroids that codes stand for, row by row."""
    codes = unpack(packed, len(books))
    return books[np.arange(len(books))[None], codes].reshape(len(codes), -1).astype(np.float32)


def _distinct(m: np.ndarray, ids: np.ndarray, codes: list, copies: int) -> np.ndarray:
    """Places of the rows to look at: of equal vectors those of the ``copies`` smallest ids, since no query can have more of them."""
    if len(set(codes)) == len(codes):
        return np.arange(len(ids))
    _, group = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * m.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[rank < copies])


def _scored(found: TopLists, at: int, pairs: np.ndarray, asked: np.ndarray, m: np.ndarray, ids: np.ndarray) -> None:
    """Exact cosines of the marked pairs of a tile go to the lists."""
    r, c = np.nonzero(pairs)
    if not len(r):
        return
    exact, step = np.full(pairs.shape, -np.inf), max(1, GATHERED // m.shape[1])
    for low in range(0, len(r), step):
        i, j = r[low : low + step], c[low : low + step]
        exact[i, j] = cosines(asked[i], m[j])
    found.add(at, exact, ids, pairs)


def _kernel(books: dict[int, np.ndarray], k: int, shortlist: int):
    """The k nearest rows of a shard for each query of a block, by their exact cosine: one running list for the whole shard.

    A query's table has 16 products a subspace, and a row's sum takes the entries that its codes name. For a tile of queries all
    these sums together are the product of the queries and the rows' centroids. Queries with fewer than k rows so far score the ``shortlist`` rows of the
    highest sums first; then every row that its sum doesn't exclude is scored. Where that would be a large share of the tile, one product in doubles picks those worth it.
    """

    def tile(found: TopLists, at: int, asked: np.ndarray, tables: np.ndarray, units: np.ndarray, own: np.ndarray, rows: tuple) -> None:
        m, u, near, p, t, ids = rows
        guess = tables @ near.T
        open_ = own[:, None] != ids[None, :]
        if (short := np.flatnonzero(found.n[at : at + len(own)] < k)).size:
            first, n = np.zeros_like(open_), min(shortlist, len(ids))
            best = np.argpartition(np.where(open_[short], guess[short], -np.inf), len(ids) - n, axis=1)[:, len(ids) - n :]
            first[short[:, None], best] = True
            first &= open_
            _scored(found, at, first, asked, m, ids)
            open_ &= ~first
        least = np.where(found.n[at : at + len(own)] == k, found.scores[at : at + len(own), -1], -1.0)
        held = np.clip(least, 0, 1).astype(np.float32)[:, None]
        may = guess + held * p[None, :] + np.sqrt(1 - held * held) * t[None, :] >= held - SLACK
        may |= (least < 0)[:, None]  # the bound grows with the cosine from 0 on
        may &= open_
        if may.sum() > DENSE * may.size:
            exact = np.where(may, units @ u.T, -np.inf)
            kth = np.partition(exact, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
            may &= exact >= np.maximum(kth, least)[:, None] - 1e-9
        _scored(found, at, may, asked, m, ids)

    def on(block: dict):
        def run(batches: Iterator[pa.RecordBatch]):
            lists = {d: TopLists(len(ids), k) for d, (ids, _) in block.items()}
            asked = {d: m.astype(np.float64) for d, (_, m) in block.items()}
            units = {d: unit(m) for d, m in asked.items()}
            tables = {d: _parts(u).reshape(len(u), -1).astype(np.float32) for d, u in units.items()}
            for batch in batches:
                ids, dims, p, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_d", "_p", "_t"))
                for d in np.unique(dims).tolist():
                    if d not in block:
                        continue
                    of_dim = np.flatnonzero(dims == d)
                    for low in range(0, len(of_dim), VECTOR_TILE):
                        part = of_dim[low : low + VECTOR_TILE]
                        codes = batch.column("_code").take(pa.array(part)).to_pylist()
                        m = batch.column("_v").take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d)
                        kept = _distinct(m, ids[part], codes, k + 1)
                        part, m, codes = part[kept], m[kept], [codes[i] for i in kept.tolist()]
                        u = unit(m)
                        # no codebook: the rows stand for themselves
                        near = decoded(np.frombuffer(b"".join(codes), np.uint8).reshape(len(part), -1), books[d]) if d in books else _parts(u).reshape(len(u), -1).astype(np.float32)
                        rows = m, u, near, p[part], t[part], ids[part]
                        for at in range(0, len(block[d][0]), QUERY_TILE):
                            q = slice(at, at + QUERY_TILE)
                            tile(lists[d], at, asked[d][q], tables[d][q], units[d][q], block[d][0][q], rows)
            for d, found in lists.items():
                yield found.rows(block[d][0])

        return run

    return on


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): for each row of ``queries`` the k nearest rows of ``vectors``.

    Codes and vectors are dealt to the tiles; each shard keeps k rows a query, and those of all shards are merged.
    """
    index, books = build_index(vectors, id_col, vector_col, sample)
    asked = nonzero(valid_vectors(queries, id_col, vector_col))
    codes = index.withColumn("_d", F.size("_v").cast("int"))
    asked = asked.withColumn("_v", F.col("_v").cast(index.schema["_v"].dataType)) if queries.schema[vector_col] == vectors.schema[vector_col] else asked
    return merged(partial_lists(codes, asked, _kernel(books, k, max(k, shortlist)), "double", index.count(), queries.count(), ASKED_BLOCK), k)
