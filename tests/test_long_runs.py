"""Shifts and tracts over runs of more than 4096 units, and of random sequences, against brute force."""

import random

from pyspark.sql import functions as F

from allelic.functions.parse import with_variant
from allelic.operators import consequence, normalize


def brute_shifts(seq, at, base):
    right = left = 0
    while at + right < len(seq) and seq[at + right] == base:
        right += 1
    while left < at and seq[at - 1 - left] == base:
        left += 1
    return right, left


def brute_copies(seq, start, unit):
    n = 0
    while unit and seq.startswith(unit, start + n):
        n += len(unit)
    return n


def test_one_base_insertions(spark):
    rng = random.Random(1)
    cases = [("G" + "A" * 9001 + "C", 1, "A"), ("G" + "A" * 9001 + "C", 9002, "A"), ("A" * 5000, 2500, "A"), ("N" * 12000 + "C", 6000, "N"), ("GGG", 1, "A")]
    cases += [("".join(rng.choice("AC") for _ in range(90)), rng.randrange(1, 89), rng.choice("AC")) for _ in range(40)]
    rows = with_variant(spark.createDataFrame([(k, s, a, f"NC_1.1:g.{a}_{a + 1}ins{b}") for k, (s, a, b) in enumerate(cases)], "k int, seq string, at int, t string"), "t")
    e, at = F.col("variant.edit"), F.col("at")
    got = {r["k"]: (r["r"], r["l"]) for r in rows.select("k", normalize.shift_right(F.col("seq"), at, at, e).alias("r"), normalize.shift_left(F.col("seq"), at, at, e).alias("l")).collect()}
    assert got == {k: brute_shifts(*c) for k, c in enumerate(cases)}


def test_copies_of_a_unit(spark):
    rng = random.Random(2)
    cases = [("GG" + "AC" * 5000 + "A", 2, "AC"), ("A" * 9000, 7, "A"), ("ACGT", 0, "ACGTA"), ("ACAC", 4, "AC"), ("ACAC", 0, "")]
    cases += [("".join(rng.choice("AC") for _ in range(150)), rng.randrange(150), "".join(rng.choice("AC") for _ in range(rng.randrange(1, 4)))) for _ in range(40)]
    cases += [("G" + u * n + u[:1] + "T", 1, u) for u in ("A", "AC", "ACC") for n in (1, 2, 40, 70)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, seq string, start int, unit string")
    got = {r["k"]: r["n"] for r in rows.select("k", consequence._copies_from(F.col("seq"), F.col("start"), F.col("unit")).alias("n")).collect()}
    assert got == {k: brute_copies(*c) for k, c in enumerate(cases)}
