"""What each base of a transcript goes through: read and mapped by compiled steps, a part of the variant through one lookup, no window where the bases are stated."""

import re

import pytest
from pyspark.sql import functions as F

from allelic.functions.format import format_column
from allelic.functions.parse import with_variant
from allelic.operators import mapping, normalize
from allelic.operators.reference import Reference

SEQ = "ACGTTGCAAGGCTTACCGATTGACCAGTAACGTAGCTTGA"


@pytest.fixture(scope="module")
def reference(spark):
    sequences = spark.createDataFrame([("NC_1.1", SEQ)], "ac string, seq string")
    exon = "array<struct<start0:int,end0:int,strand:int>>"
    rows = [("NM_1.1", "NC_1.1", "G", 1, 2, 13, [(2, 9, 1), (15, 24, 1)], "NP_1.1", 3, 25), ("NM_2.1", "NC_1.1", "H", -1, 2, 13, [(15, 24, -1), (2, 9, -1)], "NP_2.1", 3, 25), ("NM_3.1", "NC_9.1", "I", 1, 0, 5, [(0, 9, 1)], None, 1, 10)]
    transcripts = spark.createDataFrame(rows, f"ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons {exon}, protein string, tx_start int, tx_end int")
    return Reference(sequences, transcripts)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["g", "m", "c", "n"])
def test_read_by_compiled_steps(spark, kind):
    rows = with_variant(spark.createDataFrame([("NM_1.1:c.5A>C",)], "t string"), "t", kinds=kind).select("variant")
    assert not re.search(r"\b(transform|filter)\(", _plan(rows))


def test_texts_without_a_match(spark):
    texts = ["NM_1.1:c.5A>C", "NM_1.1:c.*5-3_*7+2del", "NM_1.1:n.5A>C", "no\u0001such\u0001text", "", None]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t", kinds="c").select("t", format_column("variant").alias("text")).collect()
    assert [r["text"] for r in rows] == [*texts[:2], None, None, None, None]


def test_a_part_of_the_variant_goes_through_the_lookup(spark, reference):
    rows = with_variant(spark.createDataFrame([("NM_1.1:c.3C>A",), ("NM_2.1:c.1_2del",), ("NM_1.1:c.99A>T",), ("NM_7.1:c.1A>T",)], "t string"), "t", kinds="c")
    assert [r["g"] for r in mapping.c_to_g(rows, reference).select("t", format_column("genomic").alias("g")).orderBy("t").collect()] == ["NC_1.1:g.7C>A", None, "NC_1.1:g.22_23del", None]
    plan = _plan(mapping.c_to_g(rows.select("variant"), reference).select(format_column("genomic").alias("g")))
    join = plan[plan.index("Join ") :]
    assert "_asked" in join.split("\n")[1] and " AS variant#" not in join.split("\n")[1]


def test_raw_form(spark, reference, monkeypatch):
    want = {
        "NM_1.1:c.3C>A": "NC_1.1:4:C:A", "NM_2.1:n.1A>T": "NC_1.1:24:A:T", "NM_1.1:n.9_10del": "NC_1.1:15:CC:", "NM_1.1:n.8+2del": f"NC_1.1:11:{SEQ[11]}:", "NM_1.1:n.-2A>C": "NC_1.1:0:A:C", "NC_1.1:g.5T>G": "NC_1.1:4:T:G",
        "NC_1.1:m.5T>G": "NC_1.1:4:T:G", "NC_1.1:g.3_6inv": f"NC_1.1:2:{SEQ[2:6]}:CAAC", "NC_1.1:g.4_5insGG": "NC_1.1:3::GG", "NC_1.1:g.4_5dup": "NC_1.1:5::TT", "NC_1.1:g.5=": "NC_1.1:5::",
        "NC_9.1:g.5T>G": "no such sequence", "NC_1.1:g.9999T>G": "no such sequence", "NM_3.1:c.1A>C": "no such sequence", "NM_9.1:c.1A>C": "no such transcript", "NP_1.1:p.Lys2Asn": "protein variants", "NP_1.1:p.?": "requires a position", "none": None,
    }
    met = []
    looked_up = normalize.with_bases
    monkeypatch.setattr(normalize, "with_bases", lambda df, *a, **k: met.append({r["t"] for r in df.select("t").collect()}) or looked_up(df, *a, **k))
    rows = with_variant(spark.createDataFrame([(t,) for t in want], "t string"), "t")
    for r in normalize.raw_spdi(rows, reference).select("t", F.coalesce("spdi", "spdi_error.message").alias("told")).collect():
        assert (r["told"] or "").endswith(want[r["t"]] or "") and (r["told"] is None) == (want[r["t"]] is None), r
    # only what states no bases looks for them
    assert met == [{"NM_1.1:n.9_10del", "NM_1.1:n.8+2del", "NC_1.1:g.3_6inv", "NC_1.1:g.4_5dup", "NC_1.1:g.5="}]
