"""Rows that ask for no transcript meet no join, the others the same one as before."""

from pyspark.sql import functions as F

from allelic.operators.reference import with_transcript, with_transcript_where_asked
from allelic.plans.queries import toy_reference


def test_rows_without_an_accession(spark):
    r = toy_reference(spark)
    rows = spark.createDataFrame([(1, "T1.1"), (2, None), (3, "none"), (4, None)], "k int, ac string")
    told = lambda df: sorted((x["k"], x["tx"] and x["tx"]["ac"]) for x in df.collect())
    assert told(with_transcript_where_asked(rows, r, F.col("ac"))) == told(with_transcript(rows, r, F.col("ac"))) == [(1, "T1.1"), (2, None), (3, None), (4, None)]
    none = with_transcript_where_asked(rows.where("ac is null"), r, F.col("ac"))
    assert told(none) == [(2, None), (4, None)] and "Join" not in none._jdf.queryExecution().optimizedPlan().toString()
