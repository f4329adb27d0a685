"""Common affixes: texts compared in one place give the same as character by character, empty and null ones too."""

from pyspark.sql import functions as F

from allelic.functions import sequence


def test_stripped(spark):
    texts = ["", "A", "AC", "CA", "ACGT", "ACGA", "TACGA", "AAAA", "é𝄞A", "é𝄞C", None]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    rows = rows.withColumn("p", sequence.common_prefix(F.col("x"), F.col("y"))).withColumn("s", sequence.stripped(F.lit(7), F.col("x"), F.col("y")))
    for r in rows.where("x is not null and y is not null").collect():
        x, y, p = r["x"], r["y"], 0
        while p < min(len(x), len(y)) and x[p] == y[p]:
            p += 1
        assert r["p"] == p
        x, y, e = x[p:], y[p:], 0
        while e < min(len(x), len(y)) and x[-1 - e] == y[-1 - e]:
            e += 1
        assert tuple(r["s"]) == (7 + p, x[: len(x) - e], y[: len(y) - e])
