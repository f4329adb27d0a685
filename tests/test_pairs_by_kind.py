"""Pairs of all kinds together; what is the same is looked up nowhere, and rows without a key are dealt to all tasks."""

from pyspark.sql import functions as F

from allelic.functions.parse import with_variant
from allelic.operators import equivalence, windows
from allelic.operators.reference import Reference

SEQ = "ACGTTTGCAACCGGTATAGGCATCAT" * 3
MODEL = "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int"


def reference(spark):
    rows = [("NM_1.1", "NC_1.1", "GENEA", 1, 0, 59, [(0, 59, 1)], "NP_1.1", 1, 60)]
    return Reference(spark.createDataFrame([("NC_1.1", SEQ)], "ac string, seq string"), spark.createDataFrame(rows, MODEL))


def test_each_kind(spark, monkeypatch):
    pairs = [
        ("NC_1.1:g.4del", "NC_1.1:g.5del", "Analogous"), ("NC_1.1:g.4del", "NC_1.1:g.7del", "Different"), ("NC_1.1:g.4del", "NC_1.1:g.4del", "Identity"), ("NC_1.1:g.4del", "NC_2.1:g.4del", "Different"),
        ("NC_1.1:g.4del", "NM_1.1:c.6del", "Analogous"), ("NM_1.1:n.4del", "NC_1.1:g.7del", "Different"), ("NM_9.1:c.4del", "NC_1.1:g.4del", "Different"), ("GENEA:c.4del", "NC_1.1:g.5del", "Analogous"),
        ("GENEA:c.4del", "NM_1.1:c.4del", "Identity"), ("GENEZ:c.4del", "NM_1.1:c.4del", "Different"), ("NM_1.1:c.4del", "NM_1.1:c.4del", "Identity"), ("NC_1.1:m.4del", "NC_1.1:g.4del", "Different"), (None, "NC_1.1:g.4del", None),
    ]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, s string, t string, want string")
    rows = with_variant(with_variant(rows, "s", "a"), "t", "b")
    seen = []

    def canonical(df, *more):
        seen.append(df.count())
        return with_canonical(df, *more)

    with_canonical = equivalence.with_canonical
    monkeypatch.setattr(equivalence, "with_canonical", canonical)
    got = equivalence.equivalence_level(rows, reference(spark)).orderBy("k").collect()
    assert [(r["s"], r["t"], r["level"]) for r in got] == pairs
    # pairs of one text aren't among those compared: three genomic ones, two sides each, two with a transcript and one with a gene; of an unknown transcript only the other side
    assert seen == [13]


def test_rows_without_a_key_are_dealt(spark):
    rows = spark.range(400, numPartitions=4).select("id", F.when(F.col("id") == 7, "NC_1.1").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = windows.with_window(rows, windows.chunked_windows(spark.createDataFrame([("NC_1.1", SEQ)], "ac string, seq string")), F.col("key"), F.lit(3), F.lit(7))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = r.select("id", "window.bases", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(x["id"] for x in got) == list(range(400)) and [x["bases"] for x in got if x["bases"]] == [SEQ[3:7]]
    # 399 rows without a key, over more than one of the four tasks
    assert len({x["task"] for x in got if x["bases"] is None}) > 1


def test_settled_protein_pairs_meet_no_proteins(spark):
    rows = spark.createDataFrame([(1, "NP_1.1:p.Lys2Asn", "NP_1.1:p.Glu2Asn"), (2, "NP_1.1:p.Lys2del", "NP_1.1:p.Lys2del"), (3, "NP_1.1:p.Lys2del", None), (4, "NP_1.1:p.Lys2del", "NP_1.1:p.Lys3del")], "k int, s string, t string")
    rows = with_variant(with_variant(rows, "s", "x", kinds="p"), "t", "y", kinds="p")
    proteins = spark.createDataFrame([("NP_1.1", "MKKA")], "ac string, residues string")
    level = lambda df: equivalence.protein_pair_level(df, "x", "y", "level", proteins, F.col("s") == F.col("t"))
    settled = level(rows.where("k < 4"))
    assert "Join" not in settled._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["level"] for r in settled.collect()} == {1: "Different", 2: "Identity", 3: None}
    assert {r["k"]: r["level"] for r in level(rows).collect()} == {1: "Different", 2: "Identity", 3: None, 4: "Analogous"}
