"""Importance resampling towards a target distribution: hashed unigram features, array-scored weights, and a draw without replacement.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters of whole texts; every word is a
feature, its bucket is its crc32 modulo BUCKETS. A bucket's gain compares its smoothed share in the target texts with that in
all documents; a document's weight is the floored mean gain of its words. Adding Gumbel noise from a hash of the id to the
weights and keeping the highest sums draws documents without replacement, in proportion to the exponentials of the weights.

The draw: every task scores its texts by one look-up in the array of gains for each word. Counts of eligible scores (a
score takes few values: gains are thousandths of a logarithm, noise lies within -3,200 and 22,900) give the
threshold and cut the drawn scores into ranges with known first ranks. Each partition's eligible rows from the
threshold up are sorted into a run, which is cut into blocks by range. A range's blocks meet in the order of their first
rows, and a tournament tree merges the runs: a block is opened when the merge reaches it, so that the rows in memory are
those of one open block a run. The merge of the last range stops when the draw is complete. No row below the threshold is moved.

Defined results: a null text has no words (weight 0); a null id counts as the empty text in the hash, sorts first and stays
null; repeated ids tie and are ordered by features and weight, so each row is drawn or not on its own; fewer than
``least`` words: never drawn; no eligible rows, or an empty table: nothing drawn; without target texts the gains still
follow the formula. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import NULL_ID, bounded_batches, key_of, stored, trimmed

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Drawn rows in a range of scores, and at most so many ranges (then they grow).
RANGE_ROWS, RANGES = 4096, 4096
#: Rows sorted in memory to a run.
RUN_ROWS = 1 << 18
#: Bytes of a text looked at together, and words remembered with their bucket by a task.
SLICE, CACHE = 1 << 22, 1 << 18
#: 0-9, a-z after lower-casing, and every byte of a non-ASCII character.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCORED = "doc_id long, n_features long, weight long, score long"
BLOCK = "range int, s long, i long, n long, w long, run int, part int, scores binary, ids binary, features binary, weights binary"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each slice; a word that crosses a border of slices stays whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and WORD.match(data, end):
            end = WORD.match(data, end).end()
        yield WORD.findall(data[at:end].translate(LOWER))
        at = end


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``texts`` in each bucket; a task sends at most a row for each bucket."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        seen: Counter = Counter()

        def empty() -> None:
            np.add.at(total, np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for batch in batches:
            for text in _texts(batch.column(0)):
                for found in words(text):
                    seen.update(found)
                if len(seen) > CACHE:
                    empty()
        empty()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    bounded_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the quotient of smoothed shares) of each bucket."""
    n, m, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((t + 1) * (n + k)) / ((s + 1) * (m + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """floor of 1000 times a Gumbel deviate from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every row."""

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.tolist()

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                value = table[zlib.crc32(word) % len(table)]
                if len(self) < CACHE:
                    self[word] = value
                return value

        known = Known()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k, text in enumerate(_texts(batch.column(1))):
                for found in words(text):
                    n[k] += len(found)
                    total[k] += sum(map(known.__getitem__, found))
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(weight), pa.array(weight + np.array([noise(i, seed) for i in ids], np.int64))], names=["doc_id", "n_features", "weight", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(score, SCORED)


class Tournament:
    """A tree of winners over the heads of runs; ``None`` stands for a run that has no row at hand and loses to all."""

    def __init__(self, runs: int, heads: list | None = None):
        self.size = 1 << max(runs - 1, 0).bit_length()
        self.heads: list[tuple | None] = (heads or []) + [None] * (self.size - len(heads or []))
        self.tree = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._match(node)

    def _match(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self.tree[node] = a if x is not None and (y is None or x <= y) else b

    def winner(self) -> int:
        return self.tree[1]

    def change(self, run: int, head: tuple | None) -> None:
        """A new head of a run; its matches up to the root are played again."""
        self.heads[run] = head
        node = (run + self.size) >> 1
        while node:
            self._match(node)
            node >>= 1


def merged(blocks: Iterator[tuple[tuple, list[tuple]]], stop: int | None = None) -> Iterator[tuple]:
    """Rows in order, of sorted blocks (run, rows) that arrive in the order of their first rows; after ``stop`` rows the merge ends and the others follow as they are.

    A row is out when no block still to come can hold one before it, so a run's next block is opened only then.
    """
    slots: dict[tuple, int] = {}
    waiting: list[deque] = []
    tree, done = Tournament(1), 0

    def out(limit: tuple | None) -> Iterator[tuple]:
        nonlocal done
        while done != stop and (head := tree.heads[tree.winner()]) is not None and (limit is None or head <= limit):
            slot, done = tree.winner(), done + 1
            yield waiting[slot].popleft()
            tree.change(slot, waiting[slot][0] if waiting[slot] else None)

    for run, rows in blocks:
        yield from out(rows[0])
        slot = slots.setdefault(run, len(slots))
        if slot == len(waiting):
            waiting.append(deque())
        if len(slots) > tree.size:
            tree = Tournament(2 * tree.size, tree.heads)
        waiting[slot].extend(rows)
        tree.change(slot, waiting[slot][0])
        if done == stop:
            break
    yield from out(None)
    for rows in (*waiting, *(rows for _, rows in blocks)):
        yield from rows


def _plan(counts: list[tuple[int, int]], draw: int, range_rows: int, ranges: int) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The threshold, and of the ranges of scores from the top the lowest score and the rows before."""
    if draw <= 0:
        return None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = max(range_rows, -(-draw // ranges))
    lows, firsts, total, start = [], [], 0, 0
    for score, n in sorted(counts, reverse=True):
        total += n
        if total - start >= size or total >= draw:
            lows.append(score)
            firsts.append(start)
            start = total
        if total >= draw:
            break
    return lows[-1], np.array(lows, np.int64), np.array(firsts, np.int64)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 in order of the draw, null where not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = stored(scored(docs, gain, id_col, text_col, seed), "scores")
    eligible = F.col("n_features") >= least
    # a score takes a bounded number of values, however many rows there are
    counts = [(r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    draw = percent * sum(n for _, n in counts) // 100
    threshold, lows, firsts = _plan(counts, draw, range_rows, RANGES)
    if threshold is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # sorted runs of this partition; each is cut into blocks by range
        held, part = [], 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= run_rows:
                yield run_of(held, TaskContext.get().partitionId(), part)
                held, part = [], part + 1
        if sum(b.num_rows for b in held):
            yield run_of(held, TaskContext.get().partitionId(), part)

    def run_of(held: list[pa.RecordBatch], run: int, part: int) -> pa.RecordBatch:
        ids, features, weights, scores = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(4))
        order = np.lexsort((weights, features, ids, -scores))
        ids, features, weights, scores = ids[order], features[order], weights[order], scores[order]
        at = np.searchsorted(-lows, -scores)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        cut = lambda a: [x.tobytes() for x in np.split(a, starts[1:])]
        same = lambda n: pa.array(np.full(len(starts), n, np.int32))
        heads = [pa.array(at[starts].astype(np.int32)), *[pa.array(a[starts]) for a in (scores, ids, features, weights)], same(run), same(part)]
        return pa.RecordBatch.from_arrays([*heads, *[pa.array(cut(a), pa.binary()) for a in (scores, ids, features, weights)]], names=BLOCK_COLUMNS)

    def opened(row: dict) -> tuple[tuple[int, int], list[tuple]]:
        a = [np.frombuffer(row[c], np.int64).tolist() for c in ("scores", "ids", "features", "weights")]
        return (row["run"], row["part"]), [(-s, i, n, w) for s, i, n, w in zip(*a, strict=True)]

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_range(now: int, blocks: list | Iterator) -> Iterator[pa.RecordBatch]:
            rank, held = int(firsts[now]), []
            for negative, i, n, w in merged(blocks, draw - rank):
                rank += 1
                held.append((None if i == NULL_ID else i, n, w, -negative, rank if rank <= draw else None))
                if len(held) >= 8192:
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

        def batch_of(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["doc_id", "n_features", "weight", "score", "rank"])

        stream = (r for b in batches for r in b.to_pylist())
        row = next(stream, None)
        while row is not None:
            now, rest = row["range"], [row]

            def same(now: int = now, rest: list = rest) -> Iterator[tuple]:
                while rest and rest[0] is not None and rest[0]["range"] == now:
                    yield opened(rest[0])
                    rest[0] = next(stream, None)

            yield from of_range(now, same())
            row = rest[0]

    high = rows.where(eligible & (F.col("score") >= threshold)).withColumn("doc_id", key_of("doc_id"))
    runs = high.select("doc_id", "n_features", "weight", "score").mapInArrow(blocks, BLOCK)
    places = min(len(lows), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism))
    sent = runs.repartition(places, "range").sortWithinPartitions("range", F.desc("s"), "i", "n", "w", "run", "part")
    drawn = sent.mapInArrow(ranks, f"{SCORED}, rank long")
    return drawn.unionByName(rows.where(~(eligible & (F.col("score") >= threshold))).withColumn("rank", F.lit(None).cast("long")))


#: A crc32 of the words' bytes is folded over a table that is made from its polynomial.
ORACLE_SQL = rf"""
WITH bits AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) t(n))
), texts AS (
  SELECT doc_id, text, true AS own, row_number() OVER () AS k FROM documents UNION ALL SELECT NULL, text, false, NULL FROM benchmark
), found AS (
  SELECT doc_id, own, k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT unnest(ws) AS w FROM found)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substring(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda a, b: xor(a // 256, crc[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, bits
), occurrences AS (
  SELECT k, own, bucket, count(*) AS n FROM (SELECT k, own, unnest(ws) AS w FROM found) JOIN hashed USING (w) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (own), 0) AS ss, coalesce(sum(n) FILTER (NOT own), 0) AS tt FROM occurrences
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(sum(n) FILTER (NOT own), 0) + 1) * (ss + {BUCKETS}) AS DOUBLE) / CAST((coalesce(sum(n) FILTER (own), 0) + 1) * (tt + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
  FROM occurrences, totals GROUP BY bucket, ss, tt
), weights AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM occurrences JOIN gain USING (bucket) WHERE own GROUP BY k
), scored AS (
  SELECT f.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('{SEED}:' || coalesce(CAST(f.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM found f LEFT JOIN weights USING (k) WHERE f.own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS r, (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {PERCENT} * eligible // 100 THEN r END AS rank FROM ranked
"""
