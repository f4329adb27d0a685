"""Packing documents into sequences of fixed length by cutting-stock column generation.

A document of n tokens gives n // length full sequences and a remainder. Remainders are rounded up to classes of
GRAIN tokens, and their histogram is a cutting-stock problem: a pattern says how many remainders of each class share a
sequence. A linear program over patterns minimises the sequences; new patterns come from an unbounded knapsack, solved
by dynamic programming at the program's dual prices, until none improves it. Counts of patterns are rounded down, and
patterns that fill less than FILL of a sequence are not used (at sf0.1 279 of 9,999 remainders are left over for that or by rounding, at sf0.01 some 240 of 1,000, nearly all by rounding). Remainders, ranked within their class, go to the copies of
the patterns in order. Those left over (by rounding, or of unused patterns) form one stream that is cut every ``length``
tokens; its end is cut into powers of two, which need no padding. Only these documents are cut at a place that is no
multiple of ``length``.

Defined results: a null text counts as empty and packs its end id; a null id sorts first; repeated rows are packed each;
an empty table gives no rows; a remainder of any size fits.

At scale: texts are read once and only small rows (counts, checksums) are moved; ranks come from a range partitioning and
one row per partition; the program sees at most length / GRAIN classes whatever the corpus. Documents that were cut
inside a remainder are read again for the checksums of their pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.chunks import larger, library_chunks
from allelic.llm.common import bounded_batches, id_back, keyed, stored, trimmed

LENGTH, GRAIN, FILL = 2048, 8, 0.9


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best value of each room up to ``room``, and the item taken last (-1: none). Sizes ascend."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        n = upto[w]
        best[w] = best[w - 1]
        if n:
            got = best[w - sizes[:n]] + values[:n]
            k = got.argmax()
            if got[k] > best[w] + 1e-12:
                best[w], pick[w] = got[k], k
    return best, pick


def _taken(pick: np.ndarray, sizes: np.ndarray, room: int, first: int) -> np.ndarray:
    """Counts of the best pattern that holds item ``first``."""
    counts = np.zeros(len(sizes))
    counts[first] = 1
    w = room - int(sizes[first])
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 4e-3, rounds: int = 400, smooth: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts by size) and how often each is used, possibly in part, to meet the demand exactly with few rooms.

    Column generation on a basis of one pattern for each size. Each round prices with one knapsack: the best pattern
    through every item is a candidate column, entered while its reduced cost stays negative. Prices are smoothed towards
    size / room, the prices of a program without waste. Ends when no pattern improves the program, or within ``gap`` of
    its lower bound.
    """
    m = len(sizes)
    ideal = sizes / room
    patterns = np.diag(room // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    least = float(demand @ ideal)
    for _ in range(rounds):
        entered = 0
        for share in (smooth, 0.0):
            price = inverse.sum(0)
            best, pick = knapsack(share * ideal + (1 - share) * price, sizes, room)
            if not share:
                least = max(least, x.sum() / max(1.0, best[room]))
            through = ideal * share + (1 - share) * price + best[room - sizes]
            for i in np.argsort(-through):
                new = _taken(pick, sizes, room, int(i))
                if price @ new <= 1 + 1e-7:
                    continue
                step = inverse @ new
                grows = step > 1e-9
                if not grows.any():
                    continue
                ratio = np.where(grows, x / np.where(grows, step, 1), np.inf)
                out = int(ratio.argmin())
                x = np.maximum(x - ratio[out] * step, 0)
                x[out] = ratio[out]
                patterns[out] = new
                inverse[out] /= step[out]
                step[out] = 0
                inverse -= np.outer(step, inverse[out])
                price = inverse.sum(0)
                entered += 1
            if entered:
                break
        if not entered or x.sum() - least <= gap * x.sum():
            break
    return patterns.astype(np.int64).reshape(m, m), x


def plan(counts: dict[int, int], length: int = LENGTH, grain: int = GRAIN, fill: float = FILL) -> tuple[list[tuple], int, dict[int, int]]:
    """(class, first rank, last rank, first sequence, per sequence, offset in classes' order) of each use; sequences; ranks used of each class.

    counts: remainders of each class (rounded up to ``grain``, in grains).
    """
    if not counts:
        return [], 0, {}
    sizes = np.array(sorted(counts), np.int64)
    patterns, x = cutting_stock(sizes, np.array([counts[int(s)] for s in sizes], np.float64), length // grain)
    rows, used, sequences = [], dict.fromkeys(map(int, sizes), 0), 0
    for pattern, times in zip(patterns, np.floor(x + 1e-6).astype(np.int64).tolist(), strict=True):
        if not times or (pattern * sizes).sum() * grain < fill * length:
            continue
        slot = 0
        for size, per in zip(sizes.tolist(), pattern.tolist(), strict=True):
            if per:
                rows.append((size, used[size], used[size] + times * per, sequences, per, slot))
                used[size] += times * per
                slot += per
        sequences += times
    assert all(used[s] <= counts[s] for s in used)
    return rows, sequences, used


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _th, _n (ids with the end id), _crcs (of each full stretch of ``length`` ids, then of the rest)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_chunks(tokenizer, "words")
        for batch in larger(batches, 2):
            ids, begin = chunks.gather(*chunks.texts(batch.column(2)))
            begin = begin.tolist()
            crcs = [[zlib.crc32(own[k : k + length]) for k in range(0, len(own), length)] for own in (np.append(ids[a:b], end_id).astype("<u4") for a, b in zip(begin, begin[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(begin) + 1), pa.array(crcs, pa.list_(pa.int64()))], names=["_id", "_th", "_n", "_crcs"])
        chunks.clear()

    return keyed(docs, id_col, text_col).mapInArrow(trimmed(run), "_id long, _th long, _n long, _crcs array<long>")


def ranked(counted: DataFrame, length: int, grain: int) -> tuple[DataFrame, dict[int, int]]:
    """Adds _rest, _class, _rank (within the class), _before (full sequences of documents ahead); and the count of each class."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(2).to_numpy() // length
            before = full + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(at + np.arange(len(batch))), pa.array(before)], names=[*batch.schema.names, "_part", "_at", "_ahead"])
            at, full = at + len(batch), full + int(n.sum())

    rest = F.col("_n") % length
    rows = counted.select("_id", "_th", "_n", "_crcs", F.ceil(rest / grain).cast("long").alias("_class"))
    rows = rows.repartitionByRange("_class", "_id", "_th").sortWithinPartitions("_class", "_id", "_th", "_n")
    rows = stored(rows.mapInArrow(trimmed(number), "_id long, _th long, _n long, _crcs array<long>, _class long, _part int, _at long, _ahead long"), "packing")
    spark = counted.sparkSession
    counts = {r["_class"]: r["n"] for r in rows.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # length / grain rows at most
    parts = sorted(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"_n div {length}")).alias("f")).collect())  # a row for each partition
    first, start, begin = {}, [], [0, 0]
    for p, n, f in parts:
        start.append((p, *begin))
        begin = [begin[0] + n, begin[1] + f]
    at = 0
    for c in sorted(counts):
        first[c], at = at, at + counts[c]
    ahead = spark.createDataFrame(start, "_part int, _rows long, _full long")
    class_start = spark.createDataFrame(sorted(first.items()), "_class long, _first long")
    rows = rows.join(F.broadcast(ahead), "_part").join(F.broadcast(class_start), "_class")
    return rows.select(
        "_id", "_th", "_n", "_crcs", "_class", (F.col("_n") % length).alias("_rest"),
        (F.col("_rows") + F.col("_at") - F.col("_first")).alias("_rank"), (F.col("_full") + F.col("_ahead")).alias("_before"),
    ), counts


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    rows, counts = ranked(stored(token_counts(docs, tokenizer, end_id, length, id_col, text_col), "tokens"), length, grain)
    uses, sequences, used = plan({c: n for c, n in counts.items() if c}, length, grain)
    # bounded: patterns times the items that a sequence can hold
    uses_df = spark.createDataFrame(uses, "_class long, _lo long, _hi long, _seq long, _per long, _slot long")
    placed = rows.join(F.broadcast(uses_df.withColumnRenamed("_class", "_c")), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left").drop("_c")
    nth = F.col("_rank") - F.col("_lo")
    # remainders of a pattern: where each starts depends on the true lengths of those before it, so a sequence's few pieces are summed
    in_pattern = placed.where(F.col("_lo").isNotNull()).select(
        "_id", "_th", "_n", "_rest", F.element_at("_crcs", -1).alias("_crc"),
        (F.col("_seq") + F.expr("(_rank - _lo) div _per")).alias("_sequence"), (F.col("_slot") + nth % F.col("_per")).alias("_place"),
    )
    from pyspark.sql import Window

    ahead = Window.partitionBy("_sequence").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    whole = in_pattern.select("_id", "_th", "_n", (F.col("_n") - F.col("_rest")).alias("_start"), F.col("_rest").alias("_length"), "_crc", "_sequence", F.coalesce(F.sum("_rest").over(ahead), F.lit(0)).cast("long").alias("_offset"))

    left = placed.where(F.col("_lo").isNull() & (F.col("_rest") > 0))
    totals = {r["_class"]: r["s"] for r in left.groupBy("_class").agg(F.sum("_rest").alias("s")).collect()}
    streamed, cut, total = _stream(left, totals, length, sequences)
    tail = total % length
    first_full = sequences + total // length + bin(tail).count("1")

    full = rows.where(F.col("_n") >= length).select("_id", "_th", "_n", "_before", F.posexplode(F.slice("_crcs", F.lit(1), F.expr(f"cast(_n div {length} as int)"))).alias("_k", "_crc"))
    full = full.select("_id", "_th", "_n", (F.col("_k").cast("long") * length).alias("_start"), F.lit(length).cast("long").alias("_length"), "_crc", (first_full + F.col("_before") + F.col("_k")).alias("_sequence"), F.lit(0).cast("long").alias("_offset"))
    pieces = whole.unionByName(full).unionByName(streamed)
    if cut is not None:
        pieces = pieces.unionByName(_checked(docs, cut, tokenizer, end_id, id_col, text_col))
    return pieces.select(
        id_back().alias("doc_id"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_crc").alias("ids_crc32"),
        F.col("_n").alias("doc_tokens"), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"),
    )


def _stream(left: DataFrame, totals: dict[int, int], length: int, sequences: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Pieces of the remainders that no pattern took: those left whole, those cut (without checksums), and the stream's tokens."""
    base, at = [], 0
    for c in sorted(totals):
        base.append((c, at))
        at += totals[c]
    from pyspark.sql import Window

    spark = left.sparkSession
    columns = ["_id", "_th", "_n", "_start", "_length", "_crc", "_sequence", "_offset"]
    if not at:
        return spark.createDataFrame([], "_id long, _th long, _n long, _start long, _length long, _crc long, _sequence long, _offset long"), None, 0
    bounds, full, rest = [], at // length, at % length
    place = full * length
    for b in range(length.bit_length(), -1, -1):
        if rest >> b & 1:
            bounds.append((place, full + len(bounds)))
            place += 1 << b
    # within a class true lengths differ by less than a grain: running sums by blocks of ranks, then within each block
    block = F.expr("_rank div 4096")
    rows = left.withColumn("_block", block)
    blocks = rows.groupBy("_class", "_block").agg(F.sum("_rest").alias("_sum"))
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy("_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.coalesce(F.sum("_rest").over(Window.partitionBy("_class", "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_run", run).join(blocks.select("_class", "_block", "_ahead"), ["_class", "_block"]).join(F.broadcast(spark.createDataFrame(base, "_class long, _base long")), "_class")
    rows = rows.select("_id", "_th", "_n", "_rest", F.element_at("_crcs", -1).alias("_whole"), (F.col("_base") + F.col("_ahead") + F.col("_run")).cast("long").alias("_p"))
    end = F.col("_p") + F.col("_rest")
    marks = F.array(*[F.lit(p).cast("long") for p, _ in bounds]) if bounds else F.array().cast("array<long>")
    regular = F.expr(f"sequence(_p div {length}, (_p + _rest) div {length})")
    inside = F.array_distinct(F.array_sort(F.filter(F.concat(F.transform(regular, lambda k: k * length), marks), lambda b: (b > F.col("_p")) & (b < end) & ((b <= full * length) | F.array_contains(marks, b)))))
    cuts = rows.withColumn("_cuts", F.concat(F.array("_p"), inside, F.array(end)))
    pieces = cuts.select("_id", "_th", "_n", "_rest", "_whole", "_p", F.size("_cuts").alias("_of"), F.explode(F.transform(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), lambda a, i: F.struct(a.alias("a"), F.element_at("_cuts", i + 2).alias("b")))).alias("_x"))
    a, b = F.col("_x.a"), F.col("_x.b")
    sequence, start = F.expr(f"_x.a div {length}"), (F.expr(f"_x.a div {length}") * length)
    for p, s in bounds:
        sequence, start = F.when(a >= p, s).otherwise(sequence), F.when(a >= p, p).otherwise(start)
    pieces = pieces.select("_id", "_th", "_n", (F.col("_n") - F.col("_rest") + a - F.col("_p")).alias("_start"), (b - a).alias("_length"), F.when(F.col("_of") == 2, F.col("_whole")).alias("_crc"), (sequences + sequence).cast("long").alias("_sequence"), (a - start).cast("long").alias("_offset"))
    pieces = stored(pieces, "packing-rest")
    return pieces.where(F.col("_crc").isNotNull()).select(*columns), pieces.where(F.col("_crc").isNull()).drop("_crc"), at


def _checked(docs: DataFrame, cut: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Checksums of pieces cut inside a remainder: their documents are encoded again."""
    jobs = cut.groupBy("_id", "_th").agg(F.collect_list(F.struct("_n", "_start", "_length", "_sequence", "_offset")).alias("_jobs"))
    texts = keyed(docs, id_col, text_col)
    # rows that repeat are encoded for the first only
    joined = texts.join(jobs.hint("merge"), ["_id", "_th"]).groupBy("_id", "_th").agg(F.first("_text").alias("_text"), F.first("_jobs").alias("_jobs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library_chunks(tokenizer, "words")
        for batch in larger(batches, 2):
            ids, begin = chunks.gather(*chunks.texts(batch.column(2)))
            out = []
            for k, jobs_ in enumerate(batch.column(3).to_pylist()):
                own = np.append(ids[begin[k] : begin[k + 1]], end_id).astype("<u4")
                out += [(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), j["_n"], j["_start"], j["_length"], zlib.crc32(own[j["_start"] : j["_start"] + j["_length"]]), j["_sequence"], j["_offset"]) for j in jobs_]
            names = ["_id", "_th", "_n", "_start", "_length", "_crc", "_sequence", "_offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 8)], names=names)
        chunks.clear()

    return joined.mapInArrow(trimmed(run), "_id long, _th long, _n long, _start long, _length long, _crc long, _sequence long, _offset long")
