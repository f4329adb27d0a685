"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from allelic.llm import ann, bpe, line_dedup, ngram_join, packing, quality, substring_dedup, suffix_dedup, token_output, topk  # noqa: E402
from allelic.llm.chunks import library_chunks  # noqa: E402
from allelic.llm.common import scratch_path  # noqa: E402

WORDS = [f"w{i * 7919 % 1009}" for i in range(400)]
PASSAGE = " ".join(WORDS[:60])
TEXTS = [
    (1, "first line here\nsecond line here\nthird line here\n" + PASSAGE), (2, "other\nfirst line here\nsecond line here\nthird line here\nend " + PASSAGE), (3, None), (4, ""), (5, " ".join(WORDS * 10)),
    (6, " ".join(WORDS[100:200])), (7, " ".join(WORDS[100:198] + ["x", "y"])), (7, "another text under one id é " + PASSAGE), (8, "one"), (9, "one"), (9, "one"), (None, PASSAGE), (10, "é" * 400), (11, "a  b \n c<|endoftext|>  don't\t\n\n x"),
]
ROW = "doc_id long, text string, lang string, source string, n_chars long, _id string, rank int"


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts], ROW)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark).cache()


def brute_bytes(texts, least=100):
    """(id, text) -> removed bytes; of rows of one id, in the order of the texts' hashes that the operator gives."""
    seen, out = set(), {}
    for i, t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - least + 1):
            w = data[s : s + least]
            gone[s : s + least] |= w in seen
            seen.add(w)
        out[i, t] = gone
    return out


def ordered(docs):
    """Distinct (id, text) in the operators' order: null ids first, then id, then hash of the text."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]


@pytest.mark.parametrize("hot", [8192, 1])
def test_suffix_dedup(docs, hot):
    want = sorted(
        (str(i), len(g), int(g.sum()), hashlib.sha256(bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])).hexdigest()) for (i, t), g in brute_bytes(ordered(docs)).items()
    )
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(docs, hot=hot).collect()]
    assert len(got) == len(TEXTS) and sorted(set(got)) == sorted(set(want))


def test_suffix_clean_keeps_characters(docs):
    rows = suffix_dedup.clean_documents(docs)
    assert rows.columns == docs.columns and rows.count() == len(TEXTS)
    assert all("�" not in (r["text"] or "") for r in rows.collect())


def test_line_dedup(docs):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).where("doc_id in (1, 2, 3, 4)").collect()}
    assert rows[1]["n_removed"] == 0 and rows[2]["removed_lines"] == "1,2,3" and rows[2]["text"] == "other\nend " + PASSAGE and rows[3]["text"] == ""
    clean = line_dedup.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) and clean.where("doc_id = 3 and text is null").count() == 1


def test_substring_dedup(spark):
    rows = {r["doc_id"]: r for r in substring_dedup.dedup_units(docs_of(spark, [(1, PASSAGE), (2, "a\n" + PASSAGE.upper() + " \nb"), (3, None), (4, "b")])).collect()}
    assert rows[2]["text"] == "a\nb" and rows[2]["removed_spans"] == f"2-{len(PASSAGE) + 4}" and rows[1]["n_removed"] == rows[3]["n_removed"] == rows[4]["n_removed"] == 0


def test_ngram_join(docs):
    rows = ngram_join.similarity_join(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["class_id"] for r in by[6]} == {6} and {r["n_links"] for r in by[6]} == {1} and 6 in {r["class_id"] for r in by[7]}
    assert {(r["class_id"], r["n_copies"]) for k in (8, 9) for r in by[k]} == {(8, 2)} and by[3][0]["class_id"] == 3 and by[4][0]["class_id"] == 4
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (8, 9)").count() == 1 and kept.where("doc_id in (3, 4)").count() == 2


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of near copies larger than a block: every link counts, as by brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = [(i, " ".join(WORDS[:150] + [f"v{i}"] * (i % 3) + WORDS[150 + i % 5 : 160])) for i in range(24)]
    sets = {i: set(ngram_join.shingles(t).tolist()) for i, t in texts}
    links = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    rows = ngram_join.similarity_join(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == links and {r["class_id"] for r in rows} == {0}


def test_ngram_join_keeps_one_row(spark):
    """Rows equal in id and text but not in other columns: the same one stays, in any order."""
    rows = docs_of(spark, [(1, "a b c d e f g")]).unionAll(docs_of(spark, [(1, "a b c d e f g")]).withColumn("source", F.lit("t"))).unionAll(docs_of(spark, [(2, None)]))
    forth = ngram_join.keep_first(rows).collect()
    assert sorted(map(repr, forth)) == sorted(map(repr, ngram_join.keep_first(rows.orderBy(F.col("source").desc())).collect())) and len(forth) == 2
    assert ngram_join.keep_first(docs_of(spark, [])).count() == 0


def test_banding():
    bands, rows = ngram_join.banding()
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_bpe_and_files(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    texts = [t or "" for _, t in TEXTS] + ["  a   b", "x  y", "日本語 テキスト", "aaaa" * 200, "\r\n x\r\n\r\n"]
    bpe_, chunks = bpe.coder(path)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for c in (chunks, library_chunks(path, "byte_level")):
        ids, begin = c.gather(*c.texts(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == want
    assert bpe_.decode(ids, begin) == [tokenizer.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.round_trip(docs, path).where("round_trip").count() == len(TEXTS)
    folder = scratch_path(spark, "test")
    back = token_output.read_tokens(spark, token_output.write_tokens(docs, folder, path, seq_len=16), folder).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(back, sorted(((i, t) for i, t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        assert (r["doc_id"], r["start"]) == (i, at)
        at += r["n_tokens"]
    of = {t or "": np.array([*e.ids, 2], "<u4") for t, e in zip([t for _, t in TEXTS], tokenizer.encode_batch([t or "" for _, t in TEXTS], add_special_tokens=False), strict=True)}
    assert sorted(r["ids_crc32"] for r in back) == sorted(zlib.crc32(of[t or ""].tobytes()) for _, t in TEXTS)


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length=64, grain=2).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert sum(r["length"] for r in rows) == total
    ids = np.array([*tokenizer.encode(" ".join(WORDS * 10), add_special_tokens=False).ids, 1], "<u4")
    assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows if r["doc_id"] == 5)


def test_packing_places_every_id_once(spark):
    """Pieces tile their documents with the library's ids; ends of 2048 and powers of two, ties and repeated lengths."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    texts = [(i, " ".join(["the"] * n)) for i, n in enumerate([0, 1, 63, 64, 62, 127, 128, 30, 30, 30, 15, 7, 3, 500])] + [(20, None), (21, " ".join(WORDS))]
    rows = packing.pack(docs_of(spark, texts), path, length=64, grain=2).collect()
    pieces, filled = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 64
    padding = sum(64 - n for n in sizes if n & (n - 1))
    assert padding <= 0.05 * sum(sizes)


def vectors_of(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)] + [(301, None, 0), (302, [None] * 8, 0), (303, [float("nan")] * 8, 0), (304, [0.0] * 8, 0), (305, [1.0] * 3, 0)]
    rows += [(310 + k, rows[7][1], 0) for k in range(40)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), {i: np.array(v) for i, v, _ in rows if v is not None and len(v) == 8 and None not in v and not np.isnan(v).any()}


def test_searches(spark):
    frame, valid = vectors_of(spark)
    queries = frame.where("vec_id % 50 = 0")
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in valid.items()}
    want = [(q, k + 1, c, -s) for q in valid if q % 50 == 0 for k, (s, c) in enumerate(sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5])]
    assert sorted(map(tuple, topk.exact_top_k(frame, queries).collect())) == sorted(want)
    near = ann.nearest(frame, queries).collect()
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    best = {q: {c for _, c in sorted((-round(cos(valid[q], v), 9), c) for c, v in valid.items() if c != q and v.any())[:5]} for q in valid if q % 50 == 0}
    found = {(r["query_id"], r["vec_id"]) for r in near}
    assert sum(len(best[q] & {c for p, c in found if p == q}) for q in best) >= 0.9 * 5 * len(best)
    assert all(abs(r["score"] - cos(valid[r["query_id"]], valid[r["vec_id"]])) < 1e-12 for r in near)


@pytest.mark.parametrize("sizes", [(65_536, 262_144), (2, 50)])
def test_search_in_tiles(spark, monkeypatch, sizes):
    """Several blocks of queries and shards, query ids that repeat: as by brute force."""
    from allelic.llm import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", sizes[0])
    monkeypatch.setattr(vectors, "SHARD", sizes[1])
    frame, valid = vectors_of(spark)
    queries = frame.where("vec_id % 50 = 0")
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in valid.items()}
    want = [(q, k + 1, c, -s) for q in valid if q % 50 == 0 for k, (s, c) in enumerate(sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5])]
    assert sorted(map(tuple, topk.exact_top_k(frame, queries.unionAll(queries)).collect())) == sorted(want)


def test_codes_rank(spark):
    """Few of many candidates are scored exactly, so the codes alone must find the nearest."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").coalesce(1)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(frame, frame.where("vec_id % 200 = 0"), shortlist=40).collect()}
    hits = 0
    for q in range(0, 4000, 200):
        s = u @ u[q]
        s[q] = -2
        hits += sum((q, c) in found for c in np.argsort(-s)[:5].tolist())
    assert hits >= 0.9 * 5 * 20


def test_compiled_rules_score_as_the_model(spark):
    """The one column expression gives what the model computes in numpy on the same statistics; nulls and empty texts get a score."""
    good = [(i, " ".join(WORDS[i : i + 60])) for i in range(150)]
    bad = [(1000 + i, " ".join(["SHOUT!!"] * (20 + i % 30))) for i in range(60)]
    docs = docs_of(spark, [*good, *bad, (None, None), (5000, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(3, None, 0), (7, 2, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    stats = quality.statistics(F.col("text"))
    names = list(stats)
    plain = docs.select("doc_id", *[c.cast("double").alias(k) for k, c in stats.items()]).collect()
    scores = model.scores(np.array([[r[k] for k in names] for r in plain]), names)
    key = lambda p: (p[0] is not None, p[0] or 0)
    want = sorted(zip([r["doc_id"] for r in plain], scores.tolist(), strict=True), key=key)
    got = sorted([(r["doc_id"], r["score"]) for r in rows], key=key)
    assert model.rules and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert len(rows) == 212 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality(spark):
    good = [(i, " ".join(WORDS[i : i + 60])) for i in range(150)]
    bad = [(1000 + i, " ".join(["SHOUT!!"] * 40)) for i in range(60)]
    docs = docs_of(spark, [*good, *bad, (None, None), (5000, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).join(labels.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect()
    assert all(r["predicted"] == r["quality"] for r in rows if r["held_out"]) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.fit(docs, labels.where("false")).scores(np.zeros((1, 1)), ["x"])[0] == 0.5


def test_quality_fit_is_bounded(spark, monkeypatch):
    """Repeated ids don't widen the sample; null, other and repeated labels are allowed; no labels, no documents."""
    texts = docs_of(spark, [(i % 5 * 7 + 1, f"{'word ' * (i % 9)}{i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (8, None), (15, 5)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_rules", lambda x, y, names: seen.append(len(y)) or quality.RuleModel(0.0))
    quality.fit(texts, labels, sample=20)
    quality.fit(texts.limit(0), labels)
    quality.fit(texts, labels.limit(0))
    assert 0 < seen[0] <= 20 and seen[1:] == [0, 0]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    frame, _ = vectors_of(spark)
    folder = scratch_path(spark, "none")
    for rows in (
        line_dedup.dedup_lines(none), substring_dedup.dedup_units(none), suffix_dedup.dedup_bytes(none), ngram_join.similarity_join(none), packing.pack(none, word), bpe.round_trip(none, byte),
        token_output.read_tokens(spark, token_output.write_tokens(none, folder, byte), folder), topk.exact_top_k(frame.limit(0), frame.limit(0)), ann.nearest(frame.limit(0), frame.limit(0)),
    ):
        assert rows.count() == 0
