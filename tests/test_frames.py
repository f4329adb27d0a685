"""Altered transcripts are read from the frames of the unaltered one."""

import os.path

from pyspark.sql import functions as F

from allelic.functions.sequence import codons, common_prefix
from allelic.operators.consequence import read_altered, with_frames


def _read(s):
    return "".join(codons().get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))


def test_altered_transcripts(spark):
    seq = "ACNATGGCTAGCTTACGATAGCCGTAaC"
    rows = [(seq, first, left, bases, right) for first in (0, 4, 5) for left in range(len(seq) + 1) for right in range(left, min(left + 5, len(seq)) + 1) for bases in ("", "G", "TA", "TAG", "ACGT")]
    x = F.struct("left", "bases", "right")
    out = with_frames(spark.createDataFrame(rows, "tx_seq string, first int, left int, bases string, right int")).withColumn("read", read_altered(F.col("tx_seq"), F.col("frames"), F.col("first"), x)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["read"] == _read((seq[: r["left"]] + r["bases"] + seq[r["right"] :])[r["first"] :]), r


def test_prefix_of_long_texts(spark):
    base = "ACGGT" * 60
    rows = [(base[:n], base[:k] + x + base[k:m]) for n in (0, 1, 63, 64, 65, 128, 300) for m in (n, n + 1) for k in (0, 1, min(63, n), min(64, n), n) for x in ("", "N")]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", common_prefix(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["n"] == len(os.path.commonprefix([r["a"], r["b"]]))
