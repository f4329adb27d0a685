"""The derived reference takes all letters of every document."""

from allelic.functions.sequence import codons
from allelic.plans import queries, synth

TEXTS = {0: "Ab, c! " * 3000, 1: "x" * 99 + "Yz", 2: "q" * 114, 3: "The quick brown fox. " * 7, 4: "Short one.", 5: "", 6: None, 7: "d" * 100}


def tables(spark, folder):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(o, n, p) for o in range(1, 9) for n in range(1, 8) for p in range(8)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def bases(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in (text or "").lower() if "a" <= c <= "z")


def test_whole_sequences(spark, tmp_path):
    d = tables(spark, tmp_path)
    assert {r["doc_id"]: r["seq"] for r in synth.genome(spark, d).collect()} == {i: bases(t) for i, t in TEXTS.items()}
    assert len(bases(TEXTS[0])) == 9000
    table = codons()
    want = {i: "".join(table[s[k : k + 3]] for k in range(0, len(s) - 2, 3)) for i, s in ((i, bases(t)) for i, t in TEXTS.items())}
    assert {int(r["ac"][3:9]): r["residues"] for r in queries.q_translate(spark, d).collect()} == want


def test_variants_and_transcripts_where_defined(spark, tmp_path):
    d = tables(spark, tmp_path)
    size = {i: len(bases(t)) for i, t in TEXTS.items()}
    rows = synth.variants(spark, d).collect()
    assert len(rows) == 8 * 7 * sum(n > 100 for n in size.values()) and {r["doc_id"] for r in rows} == {0, 1, 2, 3}
    assert all(r["pos0"] == (r["l_orderkey"] * 31 + r["l_partkey"] * 7 + r["l_linenumber"]) % (size[r["doc_id"]] - 100) for r in rows)
    # the bound of transcripts leaves out none whose exons lie within the sequence
    fits = lambda n: n // 6 > 0 and all(20 + 2 * (m // 3) + m // 6 <= m for m in range(n, n + 12))
    assert min(n for n in range(1, 500) if fits(n)) == synth.FOR_EXONS
    made = synth.transcripts(synth.genome(spark, d)).collect()
    assert {r["doc_id"] for r in made} == {i for i, n in size.items() if n >= 115}
    assert all(0 <= e["start0"] <= e["end0"] < size[r["doc_id"]] for r in made for e in r["exons"])
