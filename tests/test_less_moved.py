"""Tables are built when they are asked for, rows meet no more windows than they must, and those that they don't meet give the same."""

import itertools

import pytest
from pyspark.sql import functions as F

from allelic.functions.parse import with_variant
from allelic.operators import normalize, windows
from allelic.operators.reference import Reference
from allelic.plans import synth

SEQ = "GATTTACAACAACAGGGGGTCTCTCTAAC" + "CA" * 60 + "TTGACG"
MODEL = "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int"


@pytest.fixture(scope="module")
def reference(spark):
    return Reference(spark.createDataFrame([("NC_1.1", SEQ)], "ac string, seq string"), spark.createDataFrame([], MODEL))


def _variants(spark):
    at = [*range(1, 32), 60, 100, 148, len(SEQ) - 1]
    out = []
    for p, n in itertools.product(at, (1, 2, 3)):
        q, own = p + n - 1, SEQ[p - 1 : p + n - 1]
        span = f"{p}_{q}" if n > 1 else f"{p}"
        out += [f"{span}del", f"{span}del{own}", f"{span}delT", f"{span}dup", f"{span}inv", f"{span}delins{own}A", f"{span}del{own}ins{own[0]}", f"{span}delAinsTT", f"{span}{own}[0]", f"{span}{own}[3]", f"{p}_{p + 1}ins{own}", f"{p}_{p + 2}insA", f"{p}_{p + 1}ins{own[0]}", f"{p}{own[0]}>{'A' if own[0] == 'C' else 'C'}"]
    texts = sorted({f"NC_1.1:g.{x}" for x in out} | {"NC_1.1:g.0_1insA", "NC_1.1:g.1_2insA", "NC_9.1:g.5del", "NM_1.1:c.5del", "NP_1.1:p.Lys5del"})
    return with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


def test_second_shift_is_told_by_the_first(spark, reference, monkeypatch):
    passes = []
    shift = normalize.with_shift
    monkeypatch.setattr(normalize, "with_shift", lambda df, *a, **k: passes.append(df.count()) or shift(df, *a, **k))
    rows = _variants(spark)
    got = {r["t"]: (r["s"], r["s_error"]) for r in normalize.to_spdi(rows, reference, to="s", unambiguous=True).collect()}
    assert len(passes) == 2 and passes[1] < passes[0] / 2

    def whole(df, reference):
        out = df.withColumn("_r", F.when(F.col("_known"), normalize.genomic_range(F.col("_m"), insertion_at_end=False)))
        return shift(out.drop("_shift"), reference.windows, F.col("_m.ac"), F.col("_m.edit"), F.col("_r.start"), F.col("_r.end"), "_shift")

    monkeypatch.setattr(normalize, "_with_wide_shift", whole)
    want = {r["t"]: (r["s"], r["s_error"]) for r in normalize.to_spdi(rows, reference, to="s", unambiguous=True).collect()}
    assert len(want) > 800 and got == want


def test_insertions_meet_their_own_window_once(spark, reference, monkeypatch):
    met = []
    looked_up = normalize.with_bases
    monkeypatch.setattr(normalize, "with_bases", lambda df, *a, **k: met.append({r["t"] for r in df.select("t").collect()}) or looked_up(df, *a, **k))
    texts = ["NC_1.1:g.9_10insCAA", "NC_1.1:g.15_16insG", "NC_1.1:g.4_5insAT", "NC_1.1:g.1_2insGATTA", "NC_1.1:g.9_12insC", f"NC_1.1:g.149_150ins{'CA' * 40}"]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    kinds = {r["t"]: r["k"] for r in normalize.with_canonical(rows, reference, "variant", "to").select("t", F.col("to.edit.type").alias("k")).collect()}
    assert kinds == dict(zip(texts, ["Dup", "Dup", "Ins", "Ins", "Ins", "Dup"], strict=True))
    assert met == [set(texts[4:])]


def test_small_frontiers_are_sent(spark, reference, monkeypatch):
    asked = spark.createDataFrame([("NC_1.1", 31, "CA", True), ("NC_1.1", 31, "AC", False), ("NC_9.1", 5, "A", True)], "key string, at int, unit string, right boolean")
    plain = lambda: sorted(map(tuple, windows.runs(asked, reference.windows).select("at", "right", "n").collect()))
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr(windows.F, "broadcast", lambda df: sent.append(1) or broadcast(df))
    want = plain()
    assert sent
    monkeypatch.setattr(windows, "SENT", 0)
    sent.clear()
    assert plain() == want and not sent


def test_tables_are_built_when_asked_for(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "the quick brown fox jumps over the lazy dog " * 9) for k in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    built = []
    once = synth.once
    monkeypatch.setattr(synth, "once", lambda df, sf_dir, name: built.append(name) or once(df, sf_dir, name))
    r = synth.reference(spark, str(tmp_path))
    assert set(built) == {"genome"}
    r.proteins.count()
    assert {"transcripts", "spliced", "best", "proteins"} <= set(built) and "windows" not in built
    built.clear()
    synth.reference(spark, str(tmp_path), of_transcripts=False).windows.count()
    assert set(built) == {"genome", "sequence windows"}


def test_pairs_on_one_transcript_take_one_lookup(spark, monkeypatch):
    from allelic.operators import equivalence

    seq = "ACGTTGCAAGGCTTACCGATTGACCAGTAACGTAGCTTGA" * 80
    size = len(seq) // 2
    models = [(f"N{k}.1", "NC_1.1", "G", s, 0, 2 * size - 1, [(0, size - 1, s), (size, 2 * size - 1, s)][::s], None, 1, 2 * size) for k, s in ((1, 1), (2, -1))]
    models.append(("N3.1", "NC_1.1", "G", 1, 0, size - 1, [(0, size - 1, 1)], None, 1, size))
    r = Reference(spark.createDataFrame([("NC_1.1", seq)], "ac string, seq string"), spark.createDataFrame(models, MODEL))
    edits = ["5del", "6del", "5_6del", "5_6dup", "6_7insAC", "9_10inv", "5delinsGA", "5_6GT[3]", "2500del"]
    pairs = [(f"{a}:{c}.{x}", f"{b}:{c}.{y}") for c in "cn" for a, b in (("N1.1", "N1.1"), ("N2.1", "N2.1"), ("N1.1", "N3.1")) for x in edits for y in edits if not (b == "N3.1" and y == "2500del")]
    pairs.append(("N1.1:c.5del", "N9.1:c.5del"))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "_row long, s string, t string")
    rows = with_variant(with_variant(rows, "s", "x", kinds="cn"), "t", "y", kinds="cn").select("_row", "x", "y").cache()
    looked_up, transcript = [], equivalence.with_transcript
    monkeypatch.setattr(equivalence, "with_transcript", lambda df, *a: looked_up.append(df.count()) or transcript(df, *a))
    got = {p["_row"]: p["near"] for p in equivalence.nucleotide_pairs(rows, r, "x", "y", "near").collect()}
    assert looked_up == [4 * 81, 2 * 72 + 1, 2 * 72 + 1]
    # each pair apart: every side looks up its own bases
    monkeypatch.setattr(equivalence, "MARGIN", -1)
    want = {p["_row"]: p["near"] for p in equivalence.nucleotide_pairs(rows, r, "x", "y", "near").collect()}
    assert got == want and len(got) == len(pairs) - 1 and 0 < sum(got.values()) < len(got)
    # no side of a pair of non-coding variants meets the sequences
    monkeypatch.setattr(equivalence, "_told", None)
    assert len(equivalence.nucleotide_pairs(rows.where("x.coord = 'n'"), r, "x", "y", "near").collect()) == 2 * 81 + 72


def test_proteins_by_window(spark, monkeypatch):
    """Pairs on one protein meet a stretch of it, with what whole proteins tell."""
    from allelic.functions.format import format_variant
    from allelic.operators import equivalence

    protein = "MKKLANNGGGSTKKLAGWW*" + "ACDEFGHIKL" * 30
    proteins = spark.createDataFrame([("NP_1.1", protein), ("NP_2.1", protein[:30]), ("NP_3.1", "M-K")], "ac string, residues string")
    edits = ["Lys2del", "Lys3del", "Asn6dup", "Asn6_Asn7insAsn", "Gly8_Gly9dup", "Asn6Asp", "Trp18_Trp19delinsTer", "Gly8[3]", "Lys13fs", "Ala300del", "Lys2="]
    acs = [("NP_1.1", "NP_1.1"), ("NP_1.1", "NP_2.1"), ("NP_3.1", "NP_3.1"), ("NP_9.1", "NP_9.1")]
    rows = [(i, f"{a}:p.{s}", f"{b}:p.{t}") for i, (a, b, s, t) in enumerate((a, b, s, t) for a, b in acs for s in edits for t in edits)]
    rows = with_variant(with_variant(spark.createDataFrame(rows, "i int, s string, t string"), "s", "x", kinds="p"), "t", "y", kinds="p").select("i", "x", "y").cache()
    same = format_variant(F.col("x")) == format_variant(F.col("y"))
    levels = lambda: {r["i"]: r["level"] for r in equivalence.protein_pair_level(rows, "x", "y", "level", proteins, same).select("i", "level").collect()}
    whole, met = equivalence._in_proteins, []
    monkeypatch.setattr(equivalence, "_in_proteins", lambda df, *k: met.append(df.count()) or whole(df, *k))
    got = levels()
    assert 0 < met[0] < len(got) / 2
    monkeypatch.setattr(equivalence, "MARGIN", -1)
    assert got == levels() and set(got.values()) == {"Identity", "Analogous", "Different"} and len(got) == 484
