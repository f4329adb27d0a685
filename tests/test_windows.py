"""Windows over chunks and shifts by a frontier, against brute force on whole sequences; runs over borders of chunks, in g, c and n."""

import random

import pytest
from pyspark.sql import functions as F

from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant
from allelic.operators import normalize, windows
from allelic.operators.reference import Reference

TX = "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int"


def sequence(n, seed=1):
    """Random bases with long runs of one base and of units, over borders of chunks."""
    rnd, out = random.Random(seed), []
    while sum(map(len, out)) < n:
        kind = rnd.random()
        unit = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 7)))
        out.append(unit * rnd.randrange(20, 400) if kind < 0.2 else "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(5, 90))))
    return "".join(out)[:n]


def shifts(seq, s, e, kind, ref, alt):
    """Right and left, base by base."""
    right = left = 0
    if kind == "ins":
        while len(alt) == 1 and s + right < len(seq) and seq[s + right] == alt:
            right += 1
        while len(alt) == 1 and left < s and seq[s - 1 - left] == alt:
            left += 1
        return right, left
    first = ref[0] if ref else seq[s : s + 1]
    while e + right < len(seq) and (seq[s + right] if right else first) == seq[e + right]:
        right += 1
    while left < s and seq[s - 1 - left] == seq[e - 1 - left]:
        left += 1
    return right, left


@pytest.fixture(scope="module")
def long_seq():
    return sequence(30_000)


@pytest.mark.parametrize(("size", "margin"), [(64, 16), (16, 40), (5, 5)])
def test_windows(spark, size, margin):
    seqs = {"A": sequence(301), "B": "ACGT", "C": ""}
    chunks = windows.chunked_windows(spark.createDataFrame(list(seqs.items()), "ac string, seq string"), size=size, margin=margin).cache()
    asked = [(k, a, a + n) for k in ("A", "B", "C", "none") for a in (-3, 0, 1, 4, 15, 16, 63, 290, 300, 400) for n in (0, 1, margin, margin + 1, 200)]
    df = spark.createDataFrame(asked, "k string, a int, z int")
    got = {(r["k"], r["a"], r["z"]): r["w"] for r in windows.with_bases(df, chunks, F.col("k"), F.col("a"), F.col("z"), "w", size, margin).collect()}
    assert got == {(k, a, z): seqs.get(k, "")[max(a, 0) : max(z, 0)] for k, a, z in asked}


def test_runs_over_borders(spark, long_seq):
    seq, rnd = long_seq + "G" * 20_000, random.Random(4)
    chunks = windows.chunked_windows(spark.createDataFrame([("A", seq)], "ac string, seq string"), size=64, margin=16)
    asked = sorted({("A", at, seq[at : at + n] if right else seq[at - n : at], right) for n in (1, 2, 3, 5, 70) for at in [rnd.randrange(100, len(seq) - 100) for _ in range(40)] + [30_000, 30_001, len(seq) - 80] for right in (True, False)})

    def brute(at, unit, right):
        n = 0
        while (at + n < len(seq) and seq[at + n] == unit[n % len(unit)]) if right else (at - 1 - n >= 0 and seq[at - 1 - n] == unit[-1 - n % len(unit)]):
            n += 1
        return n

    got = {(r["at"], r["unit"], r["right"]): r["n"] for r in windows.runs(spark.createDataFrame(asked, "key string, at int, unit string, right boolean"), chunks, width=8, size=64, faster=3).collect()}
    assert got == {(at, unit, right): brute(at, unit, right) for _, at, unit, right in asked} and max(got.values()) > 19_000


def made(seq, coord, ac, at=0):
    """Texts of deletions, duplications, insertions and replacements at many places, with what is expected of them."""
    rnd, out = random.Random(7), []
    for _ in range(250):
        s = rnd.randrange(0, len(seq) - 1400)
        n = rnd.choice([1, 1, 2, 3, 4, 6, 64, 65, 1000])
        kind = rnd.choice(["del", "dup", "ins", "delins", "delstated", "inv"])
        p = lambda i: str(i + 1 - at)
        span = p(s) if n == 1 else f"{p(s)}_{p(s + n - 1)}"
        if kind == "ins":
            alt = rnd.choice([seq[s + 1], seq[s], "ACG", seq[s]])
            out.append((f"{ac}:{coord}.{p(s)}_{p(s + 1)}ins{alt}", s + 1, s + 1, "ins", "", alt))
        elif kind == "delstated":
            ref = rnd.choice([seq[s : s + n], "T" * n, "3"])
            out.append((f"{ac}:{coord}.{span}del{ref}", s, s + n, "del", ref, ""))
        else:
            alt = "A" * (n + 1) if kind == "delins" else ""
            out.append((f"{ac}:{coord}.{span}{kind}{alt}", s, s + n, kind, "", alt))
    return out


def reference(spark, seq):
    n = len(seq)
    models = spark.createDataFrame([("NM_1.1", "NC_1.1", "G", 1, 0, n - 1, [(0, n - 1, 1)], "NP_1.1", 1, n)], TX)
    return Reference(spark.createDataFrame([("NC_1.1", seq)], "ac string, seq string"), models)


@pytest.mark.parametrize("coord", ["g", "c", "n"])
def test_normalize(spark, long_seq, coord):
    ref, ac = reference(spark, long_seq), "NC_1.1" if coord == "g" else "NM_1.1"
    cases = [c for c in made(long_seq, coord, ac) if coord == "g" or c[3] != "ins"]  # on transcripts an insertion between two positions never moves
    rows = with_variant(spark.createDataFrame([(c[0],) for c in cases], "t string"), "t")
    got = {r["t"]: (r["at"], r["ref"]) for r in normalize.normalize(rows, ref).select("t", F.col("normal.start.base").alias("at"), F.col("normal.edit.ref").alias("ref")).collect()}
    for t, s, e, kind, stated, alt in cases:
        k = 0 if kind == "inv" else shifts(long_seq, s, e, kind, stated, alt)[0]
        first = s + k if kind == "ins" else s + k + 1
        assert got[t] == (first, long_seq[s + k : e + k] if kind in ("del", "dup") else {"ins": None, "inv": None, "delins": ""}[kind]), t


def test_unambiguous(spark, long_seq):
    ref, cases = reference(spark, long_seq), made(long_seq, "g", "NC_1.1")
    rows = with_variant(spark.createDataFrame([(c[0],) for c in cases], "t string"), "t")
    wide = {r["t"]: (r["r"]["start"], r["r"]["end"]) for r in normalize.with_unambiguous_range(rows, ref, to="r").select("t", "r").collect()}
    spdi = {r["t"]: r["spdi"] for r in normalize.to_spdi(rows, ref, unambiguous=True).collect()}
    for t, s, e, kind, stated, alt in cases:
        right, left = (0, 0) if kind == "inv" else shifts(long_seq, s, e, kind, stated, alt)
        assert wide[t] == (s - left, e + right), t
        if kind in ("del", "dup"):
            # after the move the stated bases are those of the sequence, so what a wrong one stopped goes on
            a, z = s + right, e + right
            on, back = shifts(long_seq, a, z, kind, "", "")
            low, high = a - back, z + on
            inner = long_seq[a:z] * 2 if kind == "dup" else ""
            assert spdi[t] == f"NC_1.1:{low}:{long_seq[low:high]}:{long_seq[low:a]}{inner}{long_seq[z:high]}", t


def test_long_insertion_is_a_duplication(spark, long_seq):
    at = 9000
    texts = [f"NC_1.1:g.{at}_{at + 1}ins{long_seq[at - n : at]}" for n in (1030, 2000)] + [f"NC_1.1:g.{at}_{at + 1}ins{'A' * 1500}"]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    got = {r["t"]: r["f"] for r in normalize.with_canonical(rows, reference(spark, long_seq), "variant", "w").select("t", format_variant(F.col("w")).alias("f")).collect()}
    for t, n in zip(texts, (1030, 2000, 0), strict=True):
        assert got[t] == (f"NC_1.1:g.{at - n + 1}_{at}dup{long_seq[at - n : at]}" if n else t)


def test_missing_sequences(spark):
    rows = with_variant(spark.createDataFrame([("NC_9.1:g.5del",), ("NC_1.1:g.900del",), ("NC_1.1:g.5del",), (None,), ("nonsense",)], "t string"), "t")
    ref = reference(spark, "ACGTTTTACG" * 5)
    got = {r["t"]: (r["spdi"], (r["spdi_error"] or {"kind": None})["kind"]) for r in normalize.to_spdi(rows, ref).collect()}
    assert got == {"NC_9.1:g.5del": (None, "DataProviderError"), "NC_1.1:g.900del": ("NC_1.1:899::", None), "NC_1.1:g.5del": ("NC_1.1:6:T:", None), None: (None, None), "nonsense": (None, None)}
    assert {r["t"]: r["f"] for r in normalize.normalize(rows, ref).select("t", format_variant(F.col("normal")).alias("f")).collect()}["NC_9.1:g.5del"] == "NC_9.1:g.5del"
