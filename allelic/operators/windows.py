"""Sequences by chunk: rows meet the bases around their positions, never a whole sequence.

A sequence is cut into chunks that overlap by MARGIN bases, so a window of up to that many lies within one chunk and
takes one equi join on (key, part). Longer windows are put together from parts, each window once however many rows ask for it.

Shifts compare the flanks of a range with the range's own bases, repeated: a range moves right as long as what follows it
goes on with its own period, and left in the same way. Rows whose flank of NEAR bases is used up form a frontier; the next
window, FASTER times as long, is compared chunk by chunk, and the first difference is kept. A run of n bases takes about
log n rounds, and no row of any round holds more than a chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.functions.sequence import common_prefix
from allelic.sources.stage import stored

#: Bytes of a frontier that are sent to all tasks, so that the chunks needn't be moved for it.
SENT = 32 << 20
#: Bases of a chunk without its overlap, of the overlap, of the flanks looked at first, and by how much windows grow from round to round.
SIZE, MARGIN, NEAR, FASTER = 4096, 1024, 64, 16


def chunked_windows(sequences: DataFrame, key: str = "ac", seq: str = "seq", size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """key, part, bases (those of the part and ``margin`` more), size (bases of the whole sequence). An empty sequence has one empty part."""
    pieces = F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(.{{1,{size}}})"), 1)  # one pass; substr would start anew for each part
    rows = sequences.select(F.col(key).alias("key"), F.length(seq).alias("size"), F.when(F.length(seq) > 0, pieces).otherwise(F.array(F.lit(""))).alias("_p"))
    ahead = -(-margin // size)
    next_ = lambda i: F.concat(*[F.coalesce(F.get("_p", i + k), F.lit("")) for k in range(1, ahead + 1)]).substr(F.lit(1), F.lit(margin))
    return rows.select("key", "size", F.posexplode(F.transform("_p", lambda p, i: F.concat(p, next_(i)))).alias("part", "bases")).select("key", "part", "bases", "size")


def with_window(df: DataFrame, chunks: DataFrame, key: Column, start: Column, end: Column, to: str = "window", size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """Adds ``to``: struct(bases, start, size) of bases [start, end) of a sequence, clamped to it; null where there is no such sequence or nothing of it there.

    Windows of over ``margin`` bases have null bases here; see ``with_bases``. Rows without a key meet nothing; they are dealt by a number of
    their own, since by their key all of them would land in one task.
    """
    # rows carry no more than the number of their part, all else is there again behind the join
    a = F.greatest(start, F.lit(0)).cast("int")
    z = F.greatest(end, a).cast("int")
    own = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")
    rows = df.withColumn("_wpart", F.when(key.isNull(), own).otherwise(F.floor(a / size).cast("int")))
    parts = chunks.select(F.col("key").alias("_ckey"), F.col("part").alias("_cpart"), F.col("bases").alias("_cbases"), F.col("size").alias("_csize"))
    out = rows.join(parts.hint("shuffle_hash"), (key == F.col("_ckey")) & (F.col("_wpart") == F.col("_cpart")), "left")  # rows needn't be sorted
    bases = F.when(z - a <= margin, F.col("_cbases").substr(a - F.col("_wpart") * size + 1, z - a))
    made = F.when(F.col("_csize").isNotNull(), F.struct(bases.alias("bases"), a.alias("start"), F.col("_csize").alias("size")))
    return out.withColumn(to, made).drop("_wpart", "_ckey", "_cpart", "_cbases", "_csize")


def long_windows(asked: DataFrame, chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """key, start, end, bases of the distinct windows (key, start, end) asked for, of any length; empty where there is nothing."""
    wanted = asked.select("key", F.greatest("start", F.lit(0)).cast("int").alias("start"), F.col("end").cast("int").alias("end")).distinct()
    parts = wanted.withColumn("part", F.explode(F.sequence(F.expr(f"cast(start div {size} as int)"), F.expr(f"cast(greatest(end - 1, start) div {size} as int)"))))
    found = parts.join(chunks.select("key", "part", F.col("bases").substr(F.lit(1), F.lit(size)).alias("_b")), ["key", "part"], "left")
    low, high = F.greatest(F.col("start") - F.col("part") * size, F.lit(0)), F.least(F.col("end") - F.col("part") * size, F.lit(size))
    piece = F.coalesce(F.col("_b").substr(low + 1, F.greatest(high - low, F.lit(0))), F.lit(""))
    return found.groupBy("key", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", piece.alias("b")))), lambda x: x["b"]), "").alias("bases"))


def with_bases(df: DataFrame, chunks: DataFrame, key: Column, start: Column, end: Column, to: str = "bases", size: int = SIZE, margin: int = MARGIN) -> DataFrame:
    """Adds the bases [start, end) of a sequence as a text, windows of any length; what isn't there is the empty text. ``df`` should be stored: it is read again if any window is long."""
    out = with_window(df.withColumn("_bkey", key).withColumn("_ba", F.greatest(start, F.lit(0)).cast("int")).withColumn("_bz", end.cast("int")), chunks, F.col("_bkey"), F.col("_ba"), F.col("_bz"), "_bw", size, margin)
    out = out.withColumn(to, F.coalesce(F.col("_bw.bases"), F.lit("")))
    far = F.coalesce(F.col("_bkey").isNotNull() & (F.col("_bz") - F.col("_ba") > margin), F.lit(False))
    rows = out.drop("_bw")
    long = rows.where(far)
    if long.isEmpty():
        return rows.drop("_bkey", "_ba", "_bz")
    texts = long_windows(long.select(F.col("_bkey").alias("key"), F.col("_ba").alias("start"), F.col("_bz").alias("end")), chunks, size)
    texts = texts.select(F.col("key").alias("_bkey"), F.col("start").alias("_ba"), F.col("end").alias("_bz"), F.col("bases").alias("_long"))
    long = long.join(texts, ["_bkey", "_ba", "_bz"]).withColumn(to, F.col("_long")).drop("_long")
    return rows.where(~far).unionByName(long).drop("_bkey", "_ba", "_bz")


def repeated(unit: Column, phase: Column, n: Column) -> Column:
    """``n`` characters of a text that is repeated without end, from its character ``phase`` (from 0) on."""
    k = F.greatest(F.length(unit), F.lit(1))
    at = F.pmod(phase, k).cast("int")
    return F.repeat(unit, F.ceil((at + n) / k).cast("int")).substr(at + 1, n)


def agreeing(flank: Column, unit: Column, phase: Column | None = None) -> Column:
    """Leading characters of ``flank`` that go on with the period of ``unit``; 0 where there is no unit."""
    at = F.lit(0) if phase is None else phase
    # most rows differ in the first base
    first = flank.substr(F.lit(1), F.lit(1)) == unit.substr(F.pmod(at, F.greatest(F.length(unit), F.lit(1))).cast("int") + 1, F.lit(1))
    return F.when(F.coalesce((F.length(unit) > 0) & (flank != "") & first, F.lit(False)), common_prefix(flank, repeated(unit, at, F.length(flank)))).otherwise(0)


def runs(asked: DataFrame, chunks: DataFrame, begin: int = 0, width: int = NEAR, size: int = SIZE, faster: int = FASTER) -> DataFrame:
    """key, at, unit, right, n: how far the period of ``unit`` goes on from base ``at``, to the right (bases at, at + 1, ..) or to the left (at - 1, at - 2, .. against the reversed unit).

    ``asked`` has the distinct (key, at, unit, right), of which ``begin`` bases are known to agree. Each round compares windows of
    ``width`` bases, which grow ``faster`` times; only rows whose whole window agrees go on.
    """
    columns = ["key", "at", "unit", "right"]
    frontier, done, known = stored(asked.select(*columns).distinct(), "frontier"), [], begin
    parts = chunks.select("key", "part", F.col("bases").substr(F.lit(1), F.lit(size)).alias("_b"), "size")
    while (told := frontier.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("unit") + 100).alias("bytes")).first())["n"]:
        low = F.when(F.col("right"), F.col("at") + known).otherwise(F.greatest(F.col("at") - known - width, F.lit(0)))
        high = F.when(F.col("right"), F.col("at") + known + width).otherwise(F.greatest(F.col("at") - known, F.lit(0)))
        keys = frontier.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int"))
        keys = keys.withColumn("part", F.explode(F.sequence(F.expr(f"cast(_low div {size} as int)"), F.expr(f"cast(greatest(_high - 1, _low) div {size} as int)"))))
        few = told["bytes"] * (width // size + 2) <= SENT
        met = (F.broadcast(keys) if few else keys).join(parts, ["key", "part"])
        # this part's bases of the window, read away from ``at``, and how far they are from it
        a, z = F.greatest(F.col("_low") - F.col("part") * size, F.lit(0)), F.least(F.col("_high") - F.col("part") * size, F.length("_b"))
        there = F.col("_b").substr(a + 1, F.greatest(z - a, F.lit(0)))
        met = met.withColumn("_bases", F.when(F.col("right"), there).otherwise(F.reverse(there)))
        met = met.withColumn("_off", F.when(F.col("right"), F.col("part") * size + a - F.col("at")).otherwise(F.col("at") - F.col("part") * size - z).cast("int"))
        period = F.when(F.col("right"), F.col("unit")).otherwise(F.reverse("unit"))
        same = agreeing(F.col("_bases"), period, F.col("_off"))
        met = met.withColumn("_same", same).withColumn("_ends", F.when(F.col("_same") < F.length("_bases"), F.col("_off") + F.col("_same")))
        # without a difference the run reaches the window's end, or the sequence's
        found = met.groupBy(*columns).agg(F.min("_ends").alias("_ends"), F.max(F.col("_off") + F.length("_bases")).alias("_seen"))
        found = stored(found.withColumn("n", F.coalesce("_ends", "_seen")).withColumn("_on", F.col("_ends").isNull() & (F.col("_seen") == known + width)), "frontier")
        done.append(found.where(~F.col("_on")).select(*columns, "n"))
        # what meets no part at all ends where it was
        done.append(frontier.join(found, columns, "left_anti").select(*columns, F.lit(known).alias("n")))
        frontier, known, width = found.where("_on").select(*columns), known + width, width * faster
    return reduce(DataFrame.unionByName, done) if done else asked.select(*columns, F.lit(begin).alias("n")).limit(0)
