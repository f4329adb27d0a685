"""Lookups of transcripts sort no rows and move each once."""

from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant
from allelic.operators import mapping
from allelic.operators.reference import Reference
from pyspark.sql import functions as F

MODEL = "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_transcripts_by_one_hash_join(spark):
    model = lambda ac, on, a: (ac, on, "G", 1, 0, 29, [(a, a + 29, 1)], "NP_1.1", a + 1, a + 30)
    models = spark.createDataFrame([model("NM_1.1", "NC_000001.1", 10), model("NM_1.1", "NC_9.1", 100), model("NM_2.1", "NC_9.1", 100)], MODEL)
    r = Reference(spark.createDataFrame([], "ac string, seq string"), models, spark.createDataFrame([], "ac string, reference string, tx_seq string"))
    texts = ["NC_000001.1:g.12A>G", "NC_9.1:g.103_104del", "NC_5.1:g.15del"]
    rows = with_variant(spark.createDataFrame([(t,) for t in texts], "hgvs string"), "hgvs", kinds="g")
    one = mapping.g_to_c(rows, r, F.lit("NM_1.1")).select("hgvs", format_variant(F.col("coding")).alias("c"))
    # on the reference asked for, else on the preferred one
    assert dict(one.collect()) == {texts[0]: "NM_1.1:c.2A>G", texts[1]: "NM_1.1:c.3_4del", texts[2]: "NM_1.1:c.5del"}
    every = mapping.g_to_c_all(rows, r).select("hgvs", format_variant(F.col("coding")).alias("c"))
    assert sorted(map(tuple, every.collect())) == [(texts[0], "NM_1.1:c.2A>G"), (texts[1], "NM_1.1:c.3_4del"), (texts[1], "NM_2.1:c.3_4del")]
    for df in (one, every):
        assert "ShuffledHashJoin" in planned(df)[1]
    assert planned(one)[0].count("Join LeftOuter") == 1
