"""Edits, re-application of SPDI texts, equivalence of pairs and the batch job, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from allelic.functions import edits
from allelic.functions.parse import VARIANT, with_variant
from allelic.operators.equivalence import equivalence_level
from allelic.operators.normalize import spdi_differences, spdi_equivalent
from allelic.operators.reference import Reference
from allelic.operators.validate import validate
from allelic.plans import queries


@pytest.fixture(scope="module")
def parsed(spark):
    texts = ["NC_1.1:g.5_7del", "NC_1.1:g.5_7delACG", "NC_1.1:g.5_7del3", "NC_1.1:g.5_6insACG", "NC_1.1:g.5_7dup", "NC_1.1:g.5_7inv3", "NC_1.1:g.5A>G", "NC_1.1:g.5_7AC[4]", "NM_1.1:c.-2_3del", "NM_1.1:c.5+1_8del", "NM_1.1:c.5_*8del", "NP_1.1:p.(=)", "NP_1.1:p.Lys2=", "NP_1.1:p.Lys2Asn"]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    v = F.col("variant")
    rows = rows.select("t", v.alias("v"), edits.edit_lengths(v["edit"], F.lit(3)).alias("n"), edits.edit_turned(v["edit"]).alias("rc"), edits.is_identity(v["edit"]).alias("same"), edits.variant_length(v).alias("len"), F.from_json(edits.variant_json(v), VARIANT).alias("back"))
    return {r["t"][7:]: r for r in rows.collect()}


def test_edits(parsed):
    lengths = {t: r["n"] and tuple(r["n"]) for t, r in parsed.items() if t.startswith("g.")}
    assert lengths == {"g.5_7del": (3, 0), "g.5_7delACG": (3, 0), "g.5_7del3": (3, 0), "g.5_6insACG": (0, 3), "g.5_7dup": (0, 3), "g.5_7inv3": (3, 3), "g.5A>G": (1, 1), "g.5_7AC[4]": None}
    assert parsed["g.5_7delACG"]["rc"]["ref"] == "CGT" and parsed["g.5_6insACG"]["rc"]["alt"] == "CGT" and parsed["g.5_7del3"]["rc"]["ref"] == "3" and parsed["g.5_7AC[4]"]["rc"]["ref"] == "GT"
    assert [parsed[t]["same"] for t in ("p.(=)", "p.Lys2=", "p.Lys2Asn")] == [True, True, False]
    assert parsed["c.-2_3del"]["len"]["length"] == 5 and parsed["g.5_7del"]["len"]["length"] == 3
    assert parsed["c.5+1_8del"]["len"]["error"] and parsed["c.5_*8del"]["len"]["error"] and parsed["p.(=)"]["len"] is None
    assert all(r["back"] == r["v"] for r in parsed.values())


def test_reapplied(spark):
    seq = "ACGTTTTTACG" + "G" * 200
    rows = [("S:3:T:", "S:6:T:", True), ("S:3:T:", "S:8:A:", False), ("S:3:T:", "R:6:T:", False), ("S:3::T", "S:8::T", True), ("bad", "S:3:T:", False), ("S:x:T:", "S:3:T:", False), ("ERR:a", "S:3:T:", None), (None, "S:3:T:", None), ("S:3:T:", "S:3:T:", None)]
    df = spark.createDataFrame([(a, b, seq) for a, b, _ in rows], "ours_spdi string, spdi string, seq string")
    got = df.select("ours_spdi", "spdi", spdi_equivalent(F.col("ours_spdi"), F.col("spdi"), F.col("seq")).alias("e")).collect()
    want = {(a, b): e for a, b, e in rows if e is not None}
    assert {k: r["e"] for r in got if (k := (r["ours_spdi"], r["spdi"])) in want} == want
    models = queries.toy_reference(spark)
    ref = Reference(spark.createDataFrame([("S", seq)], "ac string, seq string"), models.transcripts, models.spliced)
    assert tuple(spdi_differences(df, ref).first()) == (6, 2, 4)


def test_pairs(spark):
    pairs = {
        ("NM_999999.1:c.6A>T", "NM_999999.1:c.6A>T"): "Identity", ("NM_999999.1:c.6A>T", "NM_999999.1:c.6A>C"): "Different", ("NM_999999.1:c.6A>T", "MOCK:p.(Lys2Asn)"): "Identity", ("NM_999999.1:c.6A>T", "MOCK:p.Lys2Asn"): "Analogous",
        # all toy transcripts are of gene G and share one reference: the first pair that is equivalent has another accession
        ("G:c.6A>T", "NM_999999.1:c.6A>T"): "Analogous", ("NOGENE:c.6A>T", "NM_999999.1:c.6A>T"): "Different", ("MOCK:p.Lys2Asn", "MOCK:p.Lys2Ter"): "Different", ("none", "MOCK:p.Lys2Asn"): None,
    }
    df = with_variant(with_variant(spark.createDataFrame(list(pairs), "ta string, tb string"), "ta", "a"), "tb", "b")
    got = equivalence_level(df, queries.toy_reference(spark)).collect()
    assert len(got) == len(pairs) and {(r["ta"], r["tb"]): r["level"] for r in got} == pairs


def test_batch_job(spark):
    rows = [("NM_999999.1:c.6A>T", "MOCK:p.(Lys2Asn)", "Identity"), ("NM_999999.1:c.6A>T", "MOCK:p.Lys2Ter", "Different"), ("NM_999999.1:c.6C>T", "MOCK:p.Lys2Asn", "Unknown"), ("zz", None, "Unknown"), ("NM_999999.1:c.10_12del", "x", "ERR:Parse error: x")]
    got = validate(spark.createDataFrame([r[:2] for r in rows], "variant_nuc string, variant_prot string"), queries.toy_reference(spark)).collect()
    assert {(r["variant_nuc"], r["variant_prot"]): r["equivalence_level"] for r in got} == {r[:2]: r[2] for r in rows}
    ours = {r["variant_nuc"]: r["ours_p"] for r in got}
    assert ours["NM_999999.1:c.10_12del"] == "p.(Lys4del)" and ours["NM_999999.1:c.6C>T"].startswith("ERR:TranscriptMismatch:") and ours["zz"].startswith("ERR:Parse error")
    # the toy reference has no genomic sequence
    assert {r["ours_spdi"][:4] for r in got} == {"ERR:"}
