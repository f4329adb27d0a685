"""The registered queries and the pipeline on small tables of their own, against brute force; texts of some MB; values at the ends of their types."""

import hashlib
import zlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from allelic.llm import ann, bpe, line_dedup, ngram_join, packing, quality, queries, suffix_dedup, token_output, topk  # noqa: E402
from allelic.llm.common import scratch_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k * 7919 % 1009}" for k in range(300)]
PASSAGE = " ".join(f"p{k * 31 % 97}q" for k in range(70))
OWN = [" ".join(f"{c}{k * 17 % 211}" for k in range(200)) for c in "xy"]


def texts():
    rows = [(k, f"doc {k} " + " ".join(WORDS[k * 3 % 200 :][:40]) + ".\nline two of all\nline three of all\nline four of all\nend " + WORDS[k]) for k in range(40)]
    rows += [(100 + k, " ".join(["SHOUT!!"] * (20 + k))) for k in range(25)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " more"), (202, OWN[0] + " " + PASSAGE), (203, PASSAGE + " " + OWN[1]), (204, None), (205, ""), (206, "é" * 50), (210, " ".join(WORDS[150:270])), (211, " ".join([*WORDS[150:269], "other"])), (3, rows[3][1]), (None, "no id here")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, ["en", "de"][(i or 0) % 2], "s", len(t or "")) for i, t in texts()], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 125 else 1, 0) for i, _ in texts() if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=8).tolist()) for k in range(160)] + [(400, [1e307] * 8), (401, [-1e307, 1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 2.25]), (402, None), (403, [1.0] * 7 + [float("nan")]), (404, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_op1(spark, folder):
    docs = docs_of(spark, folder)
    rows = queries.op1_quality(spark, folder).collect()
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stats = quality.statistics(F.col("text"))
    plain = docs.select("doc_id", *[c.cast("double").alias(k) for k, c in stats.items()]).collect()
    want = model.scores(np.array([[r[k] for k in stats] for r in plain]), list(stats))
    key = lambda p: (p[0] or -1, p[1])
    got = sorted(((r["doc_id"], round(r["score"], 9)) for r in rows), key=key)
    assert got == sorted(((r["doc_id"], round(s, 9)) for r, s in zip(plain, want.tolist(), strict=True)), key=key)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    # the fit itself: the lasso leaves no rule whose weight could fall to a lower loss, and shouting is told from prose
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and (r["doc_id"] < 40 or 100 <= r["doc_id"] < 125)]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)


def test_lasso_is_optimal():
    rng = np.random.default_rng(4)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + 0.2)))).astype(float)
    penalty = 5e-3
    b, w = quality.lasso_logistic(z, y, penalty, 4000)
    grad = z.T @ (1 / (1 + np.exp(-(b + z @ w))) - y) / len(y)
    # conditions of the optimum: a weight's gradient is the penalty against its sign, that of a zero is within it
    assert np.allclose(grad[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(grad[w == 0]) <= penalty + 1e-6).all() and (w == 0).any() and w[0] > 0 > w[1]


def test_op7(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op7_bpe(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_op8(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(queries.op8_token_output(spark, folder).collect(), key=lambda r: r["start"])
    own = {}
    for i, t in texts():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    assert len(rows) == len(texts()) and all((r["n_tokens"], r["ids_crc32"]) in own[r["doc_id"]] for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_ids_wider_than_two_bytes(spark, tmp_path):
    """A vocabulary of over 65,536 ids is written in four bytes, whatever the caller says nothing of."""
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {k: v if len(k) > 1 else v + 70_000 for k, v in spec["model"]["vocab"].items()}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec))
    assert token_output.vocabulary_size(str(path)) > 70_000
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(path))
    docs = spark.createDataFrame([(1, "x y z?!"), (2, "~")], "doc_id long, text string")
    place = scratch_path(spark, "wide")
    got = {r["doc_id"]: r["ids_crc32"] for r in token_output.read_tokens(spark, token_output.write_tokens(docs, place, str(path)), place).collect()}
    assert got == {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ((1, "x y z?!"), (2, "~"))}


def test_op5_beyond_doubles(spark, folder):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    from fractions import Fraction

    whole = {i: [floor(256 * Fraction(x)) for x in v] for i, v in rows.items() if v is not None and np.isfinite(v).all()}
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-held(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, queries.op5_exact_topk(spark, folder).collect())) == sorted(want)
    assert topk.floored(np.array([[1e307, 0.5]]), 256.0).tolist() == [[floor(256 * Fraction(1e307)), 128]]


def test_op10(spark, folder):
    rows = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None}
    valid = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    best = {q: [i for _, i in sorted((-float(ann.cosines(valid[q], v)), i) for i, v in valid.items() if i != q)[:5]] for q in valid if q % 50 == 0}
    got = {}
    for r in queries.op10_ann(spark, folder).collect():
        assert r["score"] == pytest.approx(float(ann.cosines(valid[r["query_id"]], valid[r["vec_id"]])), abs=1e-12)
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == best  # fewer rows than a shortlist: all are scored


def test_pipeline(spark, folder):
    """Each stage on all that the one before kept; its decisions, and whole tokens at the end."""
    docs = docs_of(spark, folder)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    key = lambda df: sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect()))
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {(r["doc_id"]) for r in quality.score_documents(docs, model).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in kept[1].collect()} == good and not any(100 <= (i or 0) < 125 for i in good)
    # windows of three lines: of those that all prose shares the first stays
    lines = [(t or "").split("\n") for _, t in key(kept[2])]
    assert sum("line three of all" in x for x in lines) == 1 and key(kept[2]) == key(line_dedup.clean_documents(kept[1]))
    # one of each class of near duplicates: the first of two that differ in a word is there
    ids = [i for i, _ in key(kept[3])]
    assert 210 in ids and 211 not in ids and len(ids) == ngram_join.similarity_join(kept[2]).select("class_id").distinct().count()
    # repeated strings of 100 bytes: of the passage one is left
    assert key(kept[4]) == key(suffix_dedup.clean_documents(kept[3])) and sum(PASSAGE in t for _, t in key(kept[4])) == 1
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = {}
    for i, t in key(kept[4]):
        whole.setdefault(i, np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    seen = {}
    for r in pieces:
        i = r["doc_id"] if r["doc_id"] is not None else -1
        assert zlib.crc32(whole[i][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(whole[i])
        seen[i] = seen.get(i, 0) + r["length"]
    assert seen == {i: len(x) for i, x in whole.items()}
    for s in {r["sequence_id"] for r in pieces}:
        own = sorted((r["offset"], r["length"]) for r in pieces if r["sequence_id"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 2048


def test_stages_on_empty_tables(spark, folder):
    none = docs_of(spark, folder).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_texts_of_five_mb(spark):
    """One text of 5 MB, lines and words repeated in it, beside small ones."""
    long = "\n".join(f"row {k} of a long text {k * 7919 % 99_991}" for k in range(170_000))
    rows = [(1, "small one"), (2, long), (3, "row 5 of a long text 39595\nrow 6 of a long text 47514\nrow 7 of a long text 55433")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 5_000_000
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[3]["n_removed"] == 3 and lines[2]["n_removed"] == 0 and lines[2]["text"] == long
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got[1] == (9, 0) and got[2][0] == len(long) and got[3] == (len(rows[2][1]), 0)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tok.encode(long, add_special_tokens=False).ids
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert found[2]["n_tokens"] == len(ids) and found[2]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 3 and all(r["n"] == r["m"] for r in pieces)


def test_removed_lines_in_one_pass(spark):
    """Half of 60,000 lines go: the time must not grow with the square of the lines."""
    import time

    block = "\n".join(f"line number {k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, block), (2, block + "\n" + "\n".join(f"other {k}" for k in range(30_000)))], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert rows == {1: 0, 2: 30_000} and time.time() - began < 60
