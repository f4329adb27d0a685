import pytest
from pyspark.sql import functions as F

from allelic.functions import coordinates, sequence
from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant
from allelic.functions.unify import protein_level, unified
from allelic.operators.consequence import c_to_p
from allelic.plans import queries

ROUND_TRIP = [
    "NC_000001.11:g.1234_2345del", "NM_004006.3:r.123_127delinsag", "NP_003997.1:p.Trp24Cys", "NP_003997.1:p.(Trp24Cys)", "NM_01234.5(BOGUS):c.65A>C", "NP_0123456.1:p.Arg97ProfsTer23",
    "NC_000005.9:g.(90136803_90144453)_(90159675_90261231)dup", "NM_1.1:c.-5+3A>G", "NM_1.1:c.*1_*3del", "NM_1.1:c.4GCT[5]", "NP_1.1:p.0", "NP_1.1:p.(=)", "NP_1.1:p.Ter110GlnextTer17",
]
CHANGED = {
    "NP_003997.1:p.W24*": "NP_003997.1:p.Trp24Ter", "NM_1.1 : c. 1 A > G": "NM_1.1:c.1A>G", "NP_1.1:p.Met1?": "NP_1.1:p.Met1Xaa", "NP_1.1:p.0?": "NP_1.1:p.0Xaa", "NM_1.1:c.5copy3": "NM_1.1:c.5unknown_na_edit",
    "NC_1.1:g.1_(21_30)del": "NC_1.1:g.(1)_(21_30)del", "NM_1.1:r.(5a>u)": "NM_1.1:r.5a>u",
}
REFUSED = ["NP_1.1:p.Xaa5Gly", "NM_1.1(1BOGUS):c.1A>G", "NM_1.1(BO-):c.1A>G", "NP_1.1:p.fs", "", "NM_1.1:o.1A>G"]


def test_parse_and_format(spark):
    texts = [*ROUND_TRIP, *CHANGED, *REFUSED]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("t", format_variant(F.col("variant")).alias("o"), "variant_error.kind").collect()
    found = {r["t"]: r["o"] for r in rows}
    assert found == {t: t for t in ROUND_TRIP} | CHANGED | dict.fromkeys(REFUSED)
    assert all((r["kind"] == "PestError") == (r["o"] is None) for r in rows)


def test_consequences(spark):
    rows = with_variant(spark.createDataFrame([(k,) for k in [*queries.EXPECTED, "NM_999999.1:c.6+1A>T", "NM_999999.1:c.6C>T", "NM_1.1:c.1A>T"]], "hgvs string"), "hgvs")
    got = {r["hgvs"]: (r["protein"], r["protein_error"] and r["protein_error"]["kind"]) for r in c_to_p(rows, queries.toy_reference(spark)).collect()}
    assert {k: got[k][0] for k in queries.EXPECTED} == {k: f"MOCK:{v}" for k, v in queries.EXPECTED.items()}
    assert [got[k][1] for k in ("NM_999999.1:c.6+1A>T", "NM_999999.1:c.6C>T", "NM_1.1:c.1A>T")] == ["UnsupportedOperation", "TranscriptMismatch", "DataProviderError"]


def test_residues_and_coordinates(spark):
    rows = spark.createDataFrame([("AlaCysAsp",), ("ACD",), ("AlaCD",), ("",)], "t string").select(sequence.residues(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows] == [["A", "C", "D"], ["A", "C", "D"], None, []]
    one = spark.range(1).select(coordinates.cigar_length(coordinates.cigar(F.lit("3=2N=X=3N=I=D=")), "=MXDN").alias("ref"), coordinates.cigar_text(coordinates.cigar(F.lit("3=2N=X"))).alias("text")).first()
    assert (one["ref"], one["text"]) == (15, "3=2N=X")


def test_unification():
    u, is_ = lambda i: ("at", i), lambda c: ("is", c)
    assert not unified([u(10), u(10)], [is_("G"), is_("A")])
    assert unified([u(1), u(2), is_("A")], [is_("A"), u(1), u(2)])
    p = lambda first, aa, kind, last=None, last_aa=None, **e: {"start": {"base": first, "aa": aa}, "end": {"base": last, "aa": last_aa} if last else None, "edit": {"type": kind, "ref": None, "alt": None, "term": None, "length": None, "max": None, "value": None} | e}
    assert protein_level("", p(201, "Ala", "Ins", 202, "Val", alt="GlyProGlyAla"), p(198, "Gly", "Dup", 201, "Ala")) == "Analogous"
    assert protein_level("X" * 228 + "GP" * 8 + "X" * 100, p(229, "", "Repeat", ref="GP", max=2), p(233, "Gly", "Del", 244, "Pro")) == "Analogous"


@pytest.mark.parametrize("name", ["q_revcomp", "q_translate", "q_normalize", "q_g_to_n", "q_failure_categories"])
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
