"""The batch solver against a walk over single pairs, and published pairs of variants with their levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant
from allelic.functions.solver import labels, unified
from allelic.functions.text import normal_text
from allelic.operators import equivalence
from allelic.operators.reference import Reference

TX = "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int"


def walk(a, b):
    """One pair, token by token, with a dictionary of aliases."""
    bound = {}

    def resolve(t):
        while t in bound:
            t = bound[t]
        return t

    for x, y in zip(a, b, strict=False):
        if "*" in (x, y):
            return True
        if "." in (x, y):
            continue
        x, y = resolve(x), resolve(y)
        if x == y:
            continue
        if x[0] == "?":
            bound[x] = y
        elif y[0] == "?":
            bound[y] = x
        else:
            return False
    return len(a) == len(b)


def test_solver_is_the_walk():
    rnd = random.Random(1)
    token = lambda: rnd.choice(["=A", "=C", "?1", "?2", "?3", "?4", "?5", "=AC", ".", "*"] if rnd.random() < 0.15 else ["=A", "?1", "?2", "?3", "?4", "?5", "?6", "=C"])
    pairs = []
    for _ in range(6000):
        a = [token() for _ in range(rnd.randrange(0, 7))]
        b = list(a) if rnd.random() < 0.3 else [token() for _ in range(len(a) if rnd.random() < 0.8 else rnd.randrange(0, 7))]
        pairs.append((a, b))
    # a long chain of unknowns, one shifted by one
    chain = [f"?{k}" for k in range(5000)]
    pairs += [(chain[:-1], chain[1:]), (["=A", *chain], [*chain, "=A"]), (["=A", *chain], [*chain, "=C"]), ([], []), ([], ["?1"])]
    got = unified([np.array(a, object) for a, _ in pairs], [np.array(b, object) for _, b in pairs])
    assert got.tolist() == [walk(a, b) for a, b in pairs] and 0.1 < got.mean() < 0.9
    assert unified([], []).tolist() == []


def test_labels():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 300, 200), rnd.integers(0, 300, 200)
    want = np.arange(300)
    for _ in range(300):
        for x, y in zip(a, b, strict=True):
            want[x] = want[y] = min(want[x], want[y])
    assert (labels(300, a, b) == want).all()


#: Published pairs: the protein (or the part that is known), both texts, and the levels that are right.
PROTEIN_PAIRS = [
    ("", "NP_0001.1:p.Ala201_Val202insGlyProGlyAla", "NP_0001.1:p.Gly198_Ala201dup", {"Analogous"}),
    ("X" * 163 + "AYR" + "X" * 30, "NP_001337263.1:p.Tyr165Ter", "NP_001337263.1:p.Ala164_Tyr165insTer", {"Analogous"}),
    ("M" * 3500, "NP_000042.3:p.Tyr1433_Lys1434delinsTer", "NP_000042.3:p.(Tyr1433_Val3056del)", {"Analogous", "Identity"}),
    ("X" * 489 + "PRS" + "X" * 100, "NP_001365049.1:p.490PRS[1]", "NP_001365049.1:p.=", {"Analogous"}),
    ("X" * 489 + "PRS" + "X" * 100, "NP_001365049.1:p.490PRS[2]", "NP_001365049.1:p.490_492dup", {"Analogous"}),
    ("X" * 96 + "R" + "X" * 100, "NP_001.1:p.Arg97ProfsTer4", "NP_001.1:p.Arg97delinsProAlaValTer", {"Analogous"}),
    ("X" * 96 + "R" + "X" * 100, "NP_001.1:p.Arg97ProfsTer4", "NP_001.1:p.Arg97delinsProAlaValLeuTer", {"Different"}),
    ("X" * 96 + "R" + "X" * 100, "NP_001.1:p.Arg97ProfsTer4", "NP_001.1:p.Arg97delinsLeuAlaValTer", {"Different"}),
    ("X" * 96 + "R" + "X" * 100, "NP_001.1:p.Arg97ProfsTer4", "NP_001.1:p.Arg97delinsProAlaValLys", {"Different"}),
    ("X" * 228 + "GP" * 8 + "X" * 100, "NP_001122316.1:p.229GP[2]", "NP_001122316.1:p.Gly233_Pro244del", {"Analogous"}),
    ("X" * 178 + "AP" * 12 + "X" * 100, "NP_000067.1:p.179_180AP[5]", "NP_000067.1:p.Ala189_Pro194del", {"Analogous", "Different"}),
    ("", "NP_1.1:p.Trp2Ter", "NP_1.1:p.Trp2*", {"Identity"}),
    ("", "NP_1.1:p.Lys5Asn", "NP_1.1:p.Glu5Asn", {"Different"}),
]


def levels(spark, pairs, proteins):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, s string, t string")
    rows = with_variant(with_variant(rows, "s", "x"), "t", "y")
    same = normal_text(format_variant(F.col("x"))) == normal_text(format_variant(F.col("y")))
    table = spark.createDataFrame(proteins, "ac string, residues string")
    return [r["level"] for r in equivalence.protein_pair_level(rows, "x", "y", "level", table, same).orderBy("k").collect()]


def test_published_protein_pairs(spark):
    # one accession for each pair, so that each has its own protein
    pairs, proteins = [], []
    for k, (residues, a, b, _) in enumerate(PROTEIN_PAIRS):
        ac = f"NP_{k}.1"
        pairs.append(tuple(f"{ac}:{t.split(':')[1]}" for t in (a, b)))
        proteins += [(ac, residues)] * bool(residues)
    for got, (_, a, b, right) in zip(levels(spark, pairs, proteins), PROTEIN_PAIRS, strict=True):
        assert got in right, (a, b, got)


def test_proteins_that_conflict(spark):
    proteins = [("NP_A.1", "MKTA"), ("NP_B.1", "MKTAYY"), ("NP_C.1", "MRTA")]
    pairs = [("NP_A.1:p.Thr3del", "NP_B.1:p.Thr3_Ala4delinsAla"), ("NP_A.1:p.Thr3del", "NP_C.1:p.Thr3_Ala4delinsAla"), ("NP_A.1:p.?", "NP_A.1:p.Lys2del"), ("NP_A.1:p.Lys2del", None)]
    assert levels(spark, pairs, proteins) == ["Analogous", "Different", "Different", None]


@pytest.mark.parametrize("strand", [1, -1])
def test_nucleotide_pairs(spark, strand):
    seq = "ACGTTTGACCA" + "ACGT" * 30
    n = len(seq)
    models = spark.createDataFrame([("NM_1.1", "NC_1.1", "G", strand, 4, n - 5, [(0, n - 1, strand)], "NP_1.1", 1, n)], TX)
    ref = Reference(spark.createDataFrame([("NC_1.1", seq)], "ac string, seq string"), models)
    # the minus strand counts from the other end
    at = lambda i: i + 1 if strand == 1 else n - i
    t = "T" if strand == 1 else "A"
    pairs = [
        (f"NM_1.1:c.{at(3)}del", f"NM_1.1:c.{at(5)}del", "Different"),  # bases in between are unknown, and their number differs by what is known
        (f"NM_1.1:c.{at(3)}del", f"NM_1.1:c.{at(4)}del", "Analogous"),
        (f"NM_1.1:c.{at(2)}del", f"NM_1.1:c.{at(3)}del", "Different"),
        (f"NM_1.1:c.{at(3)}dup", f"NM_1.1:c.{at(4)}dup", "Analogous"),
        (f"NM_1.1:c.{min(at(3), at(4))}_{max(at(3), at(4))}ins{t}", f"NM_1.1:c.{at(4)}dup", None),
        ("NM_9.1:c.5del", "NM_1.1:c.5del", "Different"),
        (f"NM_1.1:n.{at(2)}del", f"NM_1.1:n.{at(3)}del", "Analogous"),
    ]
    rows = with_variant(with_variant(spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "_row int, s string, t string"), "s", "x"), "t", "y")
    got = {r["_row"]: r["near"] for r in equivalence.nucleotide_pair_level(rows, ref, "x", "y", "near").collect()}
    want = {k: right for k, (_, _, right) in enumerate(pairs)}
    assert got[5] is None and got[1] and got[3] and got[6] and not got[2]
    assert set(got) == set(want)
