"""Caches, fixtures, histories, phases, parents by line order, and the batch job on a stream."""

import json
import random

from pyspark.sql import functions as F

from allelic.functions.format import format_variant
from allelic.functions.parse import with_variant
from allelic.operators import history, mapping, windows
from allelic.operators.consequence import c_to_p
from allelic.sources import cache, files
from allelic.streaming.variants import batches_to


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_live_record_replay(spark):
    rnd = random.Random(1)
    seq = "".join(rnd.choice("ACGT") for _ in range(9000))
    chunks = windows.chunked_windows(spark.createDataFrame([("A", seq)], "ac string, seq string"))
    asked = [("A", a, a + n) for a, n in [(0, 5), (4090, 20), (10, 8000), (8990, 50), (5, 0)]] + [("none", 3, 9), ("A", 0, 5)]
    df = spark.createDataFrame(asked, "key string, start int, end int")
    none = spark.createDataFrame([], "key string, start int, end int, bases string")
    live, same = cache.look_up(df, none, chunks, "live")
    want = sorted({(k, a, z, seq[a:z] if k == "A" else "") for k, a, z in asked})
    assert rows_of(live) == want and same.count() == 0
    first, kept = cache.look_up(df.where("start < 10"), none, chunks, "record")
    second, full = cache.look_up(df, kept, chunks, "record")
    assert rows_of(second) == want and full.count() == len(want) and kept.count() == rows_of(first).__len__()
    assert rows_of(cache.look_up(df, full, None, "replay")[0]) == want
    # what the cache lacks is empty, not an error
    partial = {tuple(r)[:3]: r["bases"] for r in cache.look_up(df, kept, None, "replay")[0].collect()}
    assert partial["A", 10, 8010] == "" and partial["A", 0, 5] == seq[:5]


def test_fixture(spark, tmp_path):
    plus = "AAAAATGCGTACGTAGCTAGCTAGCTAGCTAGTAAGCGCTAGCTAGCTAGCTAGCTACGTACTGCATAAAAA"
    exon = lambda a, z, s, e: {"transcript_start": a, "transcript_end": z, "reference_start": s, "reference_end": e, "cigar": "36=", "alt_strand": 1}
    model = lambda ac, strand, exons: {"ac": ac, "gene": "G", "cds_start_index": 4, "cds_end_index": 67, "strand": strand, "reference_accession": "NC_TOY.1", "exons": exons}
    told = {
        "sequences": {"NC_TOY.1": "A" * 25 + "ATGCG" + "A" * 253, "NM_PLUS.1": plus, "NM_MINUS.1": plus},
        "transcripts": {"NM_PLUS.1": model("NM_PLUS.1", 1, [exon(0, 36, 20, 56), exon(36, 72, 200, 236)]), "NM_MINUS.1": model("NM_MINUS.1", -1, [exon(0, 36, 200, 236), exon(36, 72, 20, 56)])},
    }
    (tmp_path / "f.json").write_text(json.dumps(told, indent=1))
    ref = files.read_fixture(spark, str(tmp_path / "f.json"))
    assert ref.sequences.count() == 3 and {r["ac"]: r["strand"] for r in ref.transcripts.collect()} == {"NM_PLUS.1": 1, "NM_MINUS.1": -1}
    text = lambda df, c: {r["t"]: r["f"] for r in df.select("t", format_variant(F.col(c)).alias("f")).collect()}
    g = with_variant(spark.createDataFrame([("NC_TOY.1:g.25A>T",)], "t string"), "t")
    assert text(mapping.g_to_c(g, ref, F.lit("NM_PLUS.1")), "coding") == {"NC_TOY.1:g.25A>T": "NM_PLUS.1:c.1A>T"}
    # positions by the exon's strand, edits by the transcript's
    back = with_variant(spark.createDataFrame([("NC_TOY.1:g.236T>G",)], "t string"), "t")
    assert text(mapping.g_to_c(back, ref, F.lit("NM_MINUS.1")), "coding") == {"NC_TOY.1:g.236T>G": "NM_MINUS.1:c.32A>C"}
    c = with_variant(spark.createDataFrame([("NM_PLUS.1:c.1A>T",)], "t string"), "t")
    assert c_to_p(c, ref).first()["protein"] == "NP_PLUS.1:p.(Met1Leu)"


def test_phases(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for tx in range(40):
        strand, at, parts = rnd.choice("+-"), 1, []
        for _ in range(rnd.randrange(1, 8)):
            at += rnd.randrange(5, 50)
            parts.append((at, at := at + rnd.randrange(0, 30)))
        phase = 0
        for s, e in sorted(parts, reverse=strand == "-"):
            want[tx, s] = phase
            phase = (3 - (e - s + 1 - phase) % 3) % 3
        rows += [(tx, s, e, strand) for s, e in parts]
    got = files.cds_phases(spark.createDataFrame(rows, "tx int, start int, end int, strand string"), ["tx"])
    assert {(r["tx"], r["start"]): r["phase"] for r in got.collect()} == want


def test_parents_seen_so_far(spark, tmp_path):
    line = lambda kind, a, z, attr: f"NC_1\tRefSeq\t{kind}\t{a}\t{z}\t.\t+\t.\t{attr}"
    lines = [
        line("exon", 1, 10, "ID=e1;Parent=t1"), line("mRNA", 1, 50, "ID=t1;transcript_id=X1.1"), line("exon", 21, 50, "ID=e2;Parent=t1"),
        line("mRNA", 100, 150, "ID=t2;transcript_id=X2.1"), line("exon", 100, 150, "ID=e3;Parent=t2"),
    ]
    (tmp_path / "a.gff").write_text("\n".join(lines) + "\n")
    rows = spark.read.csv(str(tmp_path / "a.gff"), sep="\t", schema=files.GFF)
    rows = files.in_input_order(rows)
    pairs = F.map_from_entries(F.transform(F.split("attributes", ";"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).alias("v"))))
    rows = rows.withColumn("attr", pairs)
    starts = lambda df: {r["ac"]: [e["start0"] for e in r["exons"]] for r in df.collect()}
    assert starts(files.transcripts_of(rows)) == {"X1.1": [0, 20], "X2.1": [99]}
    assert starts(files.transcripts_of(rows, seen_so_far=True)) == {"X1.1": [20], "X2.1": [99]}


def test_history(spark, tmp_path):
    path, kind = str(tmp_path / "h"), "commit string, date string, total int"
    old = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-02-01", 2), (None, "2024-02-02", 3)], kind)
    new = spark.createDataFrame([("b", "2024-03-01", 5), ("c", None, 7), ("b", "2024-02-15", 6)], kind)
    assert history.read_history(spark, path) is None
    assert history.add_to_history(spark, path, old) and history.add_to_history(spark, path, new) and not history.add_to_history(spark, path, new)
    found = [tuple(r) for r in history.latest_first(history.read_history(spark, path)).select("commit", "date", "total").collect()]
    assert found == [("b", "2024-03-01", 5), ("a", "2024-01-01", 1), ("c", None, 7)]
    runs = spark.createDataFrame([("v1", "1", 1), ("v1", "2", 2), ("v2", "3", 3), (None, "4", 4)], "version string, date string, n int")
    assert [tuple(r) for r in history.first_of_each(runs, "version").collect()] == [("v1", "2", 2), ("v2", "3", 3)]


def test_batch_job_on_a_stream(spark, tmp_path):
    source, out, mark = (tmp_path / x for x in ("in", "out", "mark"))
    source.mkdir()
    job = lambda df: with_variant(df, "hgvs").select("hgvs", F.col("variant").isNotNull().alias("ok"))

    def run():
        batches_to(spark.readStream.csv(str(source), sep="\t", schema="hgvs string"), job, str(out), str(mark)).awaitTermination(120)
        return sorted((r["hgvs"], r["ok"]) for r in spark.read.parquet(str(out)).collect())

    (source / "1.tsv").write_text("NC_1.1:g.5del\nnonsense\n")
    first = run()
    assert first == [("NC_1.1:g.5del", True), ("nonsense", False)]
    (source / "2.tsv").write_text("NC_1.1:g.6del\n")
    assert run() == sorted([*first, ("NC_1.1:g.6del", True)])
    # the last batch failed before it was marked as done: it runs again and overwrites its rows
    for name in (mark / "commits").iterdir():
        if name.name.strip(".").startswith("1"):
            name.unlink()
    assert run() == sorted([*first, ("NC_1.1:g.6del", True)])
