"""q_residue_names and its SQL agree on documents without a codon: no residues, so no names."""

import duckdb

from allelic.plans import queries


def test_texts_without_codons(spark, tmp_path):
    texts = spark.createDataFrame([(0, ""), (1, None), (2, "12 34"), (3, "ab"), (4, "abcdef")], "doc_id long, text string")
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["ac"]: (r["named"], r["n_residues"]) for r in queries.q_residue_names(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    db.execute("CREATE VIEW lineitem AS SELECT 0 AS l_orderkey, 0 AS l_linenumber, 0 AS l_partkey")
    assert {a: (n, k) for a, n, k in db.execute(queries.SQL["q_residue_names"]).fetchall()} == got
    assert [got[f"NC_00000{i}.1"] for i in range(4)] == [("", 0)] * 4
