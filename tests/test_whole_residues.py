"""q_residue_names names and reads back whole translations."""

from pyspark.sql import functions as F

from allelic.functions import sequence
from allelic.plans import queries, synth

TEXTS = [(0, "the lazy dog " * 10000), (1, "abcd" * 60), (2, "ab")]


def test_whole_translations(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table, names, want = sequence.codons(), sequence.NAMES | {"*": "Ter"}, {}
    for r in synth.genome(spark, str(tmp_path)).collect():
        residues = [table[r["seq"][k : k + 3]] for k in range(0, len(r["seq"]) - 2, 3)]
        want[r["ac"]] = ("".join(names[c] for c in residues), len(residues))
    assert max(n for _, n in want.values()) > 30000
    assert {r["ac"]: (r["named"], r["n_residues"]) for r in queries.q_residue_names(spark, str(tmp_path)).collect()} == want


def test_names_read_back(spark):
    rows = spark.createDataFrame([("AlaTerxaa" * 20000,), ("AlaTerX" * 20000,)], "t string")
    assert [r["n"] for r in rows.select(F.size(sequence.residues(F.col("t"))).alias("n")).collect()] in ([60000, -1], [60000, None])
