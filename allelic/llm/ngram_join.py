"""Similarity join on word n-grams by MinHash banding, verified on the full n-gram sets.

1. A text's n-grams of five lower-cased words are hashed to a set. Texts of one set are copies: one class, whose
   representative is its first document. From the set come a sketch (the low byte of each minimum) and band hashes.
2. Bands: as many rows a band as a bounded number of hashes allows at the target recall (``banding``).
3. Representatives are shuffled on their band hashes. Within a bucket, pairs whose sketches agree too little are put
   aside (the bound is more than six standard deviations under the threshold's mean), the rest are linked to a forest.
4. The sketches of each component of these forests are compared in blocks. A text is sent only to those pairs of blocks
   where its sketch agrees with another; there each such pair is verified on the full sets. A task gives each document
   its number of links and a forest of them, never the pairs.

Buckets and components of more than BLOCK members are dealt into blocks, and each pair of blocks is a group of its own:
none is cut short and no group is larger than two blocks.

Defined results: a null text counts as empty; texts without words are alone in their class; texts of fewer than n words
have one n-gram, all their words; a null id sorts first; rows equal in id and text are copies of each other; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import bounded_batches, id_back, keyed, row_with, stored, trimmed
from allelic.llm.components import components

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: Members of a block.
BLOCK = 256
#: Word hashes that a worker process remembers.
WORDS = 150_000
SCHEMA = "_id long, _th long, _n int, _ca long, _cb long, _sketch binary, _bands array<long>"


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) that find a pair at the threshold with the target recall in at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_words = _Words()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str, n: int = N) -> np.ndarray:
    """Distinct hashes of the n-grams, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, len(_FACTORS) + k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * _FACTORS[i % len(_FACTORS)]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each hash function."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, ((a[:, None] * s[None, at : at + 2048] + b[:, None]) >> np.uint64(32)).min(1))
    return out


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _th, _n (n-grams), _ca and _cb (hash of the set), _sketch, _bands of each row."""
    bounded_batches(docs.sparkSession)
    a, b = functions(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                s = shingles(text, n)
                if not len(s):
                    out.append((0, 0, 0, b"", []))
                    continue
                m = minima(s, a, b)
                of_set = xxhash.xxh3_128_intdigest(s.tobytes())
                keys = [_signed(xxhash.xxh3_64_intdigest(m[k * rows : (k + 1) * rows].tobytes(), k)) for k in range(bands)]
                out.append((len(s), _signed(of_set >> 64), _signed(of_set & (1 << 64) - 1), (m & np.uint64(255)).astype(np.uint8).tobytes(), keys))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["_id", "_th", "_n", "_ca", "_cb", "_sketch", "_bands"])

    return keyed(docs, id_col, text_col).mapInArrow(trimmed(run), SCHEMA)


def in_blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that it is part of: _i, _j (the blocks), _b (its own); sorted by group within partitions."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_node", F.lit(3)), blocks).cast("int")
    rows = rows.withColumn("_b", own).withColumn("_k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_k")).withColumn("_j", F.greatest("_b", "_k")).drop("_k")
    return rows.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of consecutive equal first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def agreeing(sketches: np.ndarray, mine: np.ndarray, least: float) -> np.ndarray:
    """Pairs (x < y) of rows whose sketches agree in a share of at least ``least``; of two blocks, only pairs across them."""
    n, found = len(sketches), []
    for at in range(0, n, 64):
        same = (sketches[at : at + 64, None, :] == sketches[None, :, :]).mean(2)
        x, y = np.nonzero(same >= least)
        x += at
        found.append(np.stack([x, y])[:, x < y])
    pairs = np.concatenate(found, 1)
    return pairs if mine.all() or not mine.any() else pairs[:, mine[pairs[0]] != mine[pairs[1]]]


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member (by number) that each is linked to."""
    label = np.arange(n)
    while pairs.shape[1]:
        new = label.copy()
        least = np.minimum(label[pairs[0]], label[pairs[1]])
        np.minimum.at(new, pairs[0], least)
        np.minimum.at(new, pairs[1], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def similar_pairs(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the pairs whose sets have a Jaccard similarity of at least the threshold."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    small, large = np.minimum(sizes[pairs[0]], sizes[pairs[1]]), np.maximum(sizes[pairs[0]], sizes[pairs[1]])
    pairs = pairs[:, small >= threshold * large - 1e-9]
    if pairs.shape[1] <= 2 * len(sets):
        common = np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs.T.tolist()), np.int64, pairs.shape[1])
    else:  # incidence matrices of the n-grams that more than one text has, a stretch of n-grams at a time
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
        often = np.bincount(column)[column] > 1
        column, owner = column[often], owner[often]
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        table = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            part = np.zeros((len(sets), 2048), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            table += part @ part.T
        common = table[pairs[0], pairs[1]].astype(np.int64)
    union = sizes[pairs[0]] + sizes[pairs[1]] - common
    return pairs[:, common >= threshold * union - 1e-9]


def _candidates(buckets: DataFrame, least: float) -> DataFrame:
    """u, v: forests of the pairs of each bucket that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches, 3):
            nodes = [r[4:6] for r in group]
            sketches = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(group), -1)
            pairs = agreeing(sketches, np.array([r[3] == r[1] for r in group]), least)
            for k, r in enumerate(roots(len(group), pairs).tolist()):
                if k != r:
                    out.append((*nodes[k], *nodes[r]))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    rows = in_blocks(buckets, "_band", "_members").select("_band", "_i", "_j", "_b", "_node._id", "_node._th", "_sketch")
    found = rows.mapInArrow(trimmed(run), "_a long, _at long, _z long, _zt long")
    return found.distinct().select(F.struct(F.col("_a").alias("_id"), F.col("_at").alias("_th")).alias("u"), F.struct(F.col("_z").alias("_id"), F.col("_zt").alias("_th")).alias("v"))


def _edges(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["_a", "_at", "_z", "_zt"])


def _agreeing_members(near: DataFrame, least: float) -> DataFrame:
    """The members of each pair of blocks whose sketches agree with another's in it; without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches, 4):
            sketches = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(len(group), -1)
            pairs = agreeing(sketches, np.array([r[4] == r[2] for r in group]), least)
            out += [group[k] for k in np.unique(pairs).tolist()]
            if len(out) > 10_000:
                yield _members_batch(out)
                out = []
        if out:
            yield _members_batch(out)

    rows = in_blocks(near, "_root", "_members").select("_root._id", "_root._th", "_i", "_j", "_b", F.col("_node._id").alias("_nid"), F.col("_node._th").alias("_nth"), "_sketch", "_size")
    return rows.mapInArrow(trimmed(run), ", ".join(f"{k} {t}" for k, t in _MEMBER.items()))


#: A member of a component in a pair of blocks (_i, _j; its own: _b).
_MEMBER = {"_rid": "long", "_rth": "long", "_i": "int", "_j": "int", "_b": "int", "_id": "long", "_th": "long", "_sketch": "binary", "_size": "long"}


def _members_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), _MEMBER.values(), strict=True)], names=list(_MEMBER))


def _verified(members: DataFrame, threshold: float, least: float, n: int) -> DataFrame:
    """_id, _th, _links (similar texts), _rows (their rows), _rid and _rth (a smaller text linked with, or itself): of each text and pair of blocks with links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            group = list({r[5:7]: r for r in group}.values())  # rows that repeat
            group.sort(key=lambda r: r[5:7])
            sketches = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(len(group), -1)
            pairs = agreeing(sketches, np.array([r[4] == r[2] for r in group]), least)
            if not pairs.shape[1]:
                continue
            used, pairs = np.unique(pairs, return_inverse=True)
            group = [group[i] for i in used.tolist()]
            pairs = similar_pairs([shingles(r[9], n) for r in group], pairs.reshape(2, -1), threshold)
            sizes = np.array([r[8] for r in group], np.int64)
            links = np.bincount(pairs.ravel(), minlength=len(group))
            rows = np.bincount(pairs[0], sizes[pairs[1]], len(group)) + np.bincount(pairs[1], sizes[pairs[0]], len(group))
            root = roots(len(group), pairs)
            keep = np.flatnonzero(links)
            ids, ths = np.array([r[5] for r in group], np.int64), np.array([r[6] for r in group], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[keep], ths[keep], links[keep], rows[keep].astype(np.int64), ids[root[keep]], ths[root[keep]])], names=["_id", "_th", "_links", "_rows", "_rid", "_rth"])

    group = ["_rid", "_rth", "_i", "_j"]
    rows = members.repartition(*group).sortWithinPartitions(*group).select(*_MEMBER, "_text")
    return rows.mapInArrow(trimmed(run), "_id long, _th long, _links long, _rows long, _rid long, _rth long")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """_id, _th, _class and _rep (nodes), _size (rows of the representative's class), _links (similar texts), _rows (their rows); a row for each row of ``docs``."""
    bands, rows = banding(threshold, recall)
    # agreement of sketches at the threshold, less 6.2 standard deviations
    mean = threshold + (1 - threshold) / 256
    least = max(0.0, mean - 6.2 * math.sqrt(mean * (1 - mean) / (bands * rows)))
    signed = stored(signatures(docs, bands, rows, n, id_col, text_col), "signatures")
    node = F.struct("_id", "_th")
    worded = signed.where("_n > 0")
    classes = worded.groupBy("_ca", "_cb").agg(F.min(node).alias("_node"), F.count(F.lit(1)).alias("_size"))
    first = worded.join(classes.hint("merge"), ["_ca", "_cb"]).where(node == F.col("_node")).dropDuplicates(["_node"])
    reps = stored(first.select("_node", "_size", "_sketch", "_bands"), "representatives")
    banded = reps.select("_node", F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_members")).where("_members > 1")
    buckets = banded.join(shared.hint("merge"), "_band").join(reps.select("_node", "_sketch").hint("merge"), "_node")
    near = components(_candidates(buckets, least))
    near = near.select(F.col("node").alias("_node"), F.col("root").alias("_root")).unionAll(near.select(F.col("root").alias("_node"), F.col("root").alias("_root")).distinct())
    sizes = near.groupBy("_root").agg(F.count(F.lit(1)).alias("_members"))
    near = near.join(sizes.hint("merge"), "_root").join(reps.select("_node", "_size", "_sketch").hint("merge"), "_node")
    near = near.select("_root", "_members", "_node", "_size", "_sketch")
    members = keyed(docs, id_col, text_col).join(_agreeing_members(near, least).hint("merge"), ["_id", "_th"])
    found = stored(_verified(members, threshold, least, n), "links")
    links = found.groupBy("_id", "_th").agg(F.sum("_links").alias("_links"), F.sum("_rows").alias("_rows"))
    merged = components(found.select(node.alias("u"), F.struct(F.col("_rid").alias("_id"), F.col("_rth").alias("_th")).alias("v")))
    merged = merged.select(F.col("node._id").alias("_id"), F.col("node._th").alias("_th"), F.col("root").alias("_class"))
    of_rep = classes.select("_ca", "_cb", "_size", F.col("_node._id").alias("_id"), F.col("_node._th").alias("_th")).join(links.hint("merge"), ["_id", "_th"], "left").join(merged.hint("merge"), ["_id", "_th"], "left")
    of_rep = of_rep.select("_ca", "_cb", "_size", node.alias("_rep"), F.coalesce("_class", node).alias("_class"), F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_rows", F.lit(0)).alias("_rows"))
    all_worded = worded.select("_id", "_th", "_ca", "_cb").join(of_rep.hint("merge"), ["_ca", "_cb"]).select("_id", "_th", "_class", "_rep", "_size", "_links", "_rows")
    alone = signed.where("_n = 0").select("_id", "_th", node.alias("_class"), node.alias("_rep"), F.lit(1).cast("long").alias("_size"), F.lit(0).cast("long").alias("_links"), F.lit(0).cast("long").alias("_rows"))
    return all_worded.unionAll(alone)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (first document of all that it is linked with, over any steps), rep_id (first document with its n-gram set), n_copies (other rows with that set), n_links (other rows of at least the threshold's similarity, copies among them)."""
    return similar_classes(docs, id_col, text_col, n, threshold).select(
        id_back().alias("doc_id"), id_back(F.col("_class._id")).alias("class_id"), id_back(F.col("_rep._id")).alias("rep_id"),
        (F.col("_size") - 1).alias("n_copies"), (F.col("_size") - 1 + F.col("_rows")).alias("n_links"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, its first document's; the columns stay."""
    kept = similar_classes(docs, id_col, text_col).where(F.struct("_id", "_th") == F.col("_class")).select("_id", "_th").distinct()
    rows = keyed(docs, id_col, text_col, carry=True).select("_id", "_th", "_row").join(kept.hint("merge"), ["_id", "_th"], "left_semi")
    # of rows equal in id and text the one with the least hash stays, whatever their order
    return rows.groupBy("_id", "_th").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select(*row_with(docs, {}))


#: On the words of a whole table, every pair that shares an n-gram; for small tables.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w WHERE len(w) > 0
), c AS (
  SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS h, g FROM s
), r AS (
  SELECT h, min(doc_id) AS rep_id, count(*) AS size, any_value(n) AS n, any_value(g) AS g FROM c GROUP BY h
), u AS (SELECT rep_id, n, unnest(g) AS x FROM r),
p AS (
  SELECT a.rep_id AS a, b.rep_id AS b FROM u a JOIN u b ON a.x = b.x AND a.rep_id < b.rep_id
  GROUP BY a.rep_id, b.rep_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (
  SELECT rep_id AS v, rep_id AS root FROM r UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.v
), m AS (SELECT v, min(root) AS class_id FROM t GROUP BY v),
l AS (SELECT e.a, CAST(sum(r.size) AS BIGINT) AS k FROM e JOIN r ON r.rep_id = e.b GROUP BY e.a)
SELECT c.doc_id, m.class_id, r.rep_id, r.size - 1 AS n_copies, r.size - 1 + coalesce(l.k, 0) AS n_links
FROM c JOIN r USING (h) JOIN m ON m.v = r.rep_id LEFT JOIN l ON l.a = r.rep_id
UNION ALL
SELECT doc_id, doc_id, doc_id, 0, 0 FROM w WHERE len(w) = 0
"""
