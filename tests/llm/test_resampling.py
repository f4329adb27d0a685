"""Importance resampling against brute force, and the tournament tree alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from allelic.llm import resampling
from allelic.llm.queries import op12_resampling

SCHEMA = "doc_id long, text string, score string, rank int, run int, n_features string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "n") for i, t in rows], SCHEMA)


def brute(docs, target, percent=10, least=20):
    def found(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for _, x in rows for w in found(x)) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10000)) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, x in docs:
        w = found(x)
        weight = sum(gain(bucket(v)) for v in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=str)


def made(n=500, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta9", "ÉTÉ", "été", "x-y", "c's", "日本語", "gamma\n", f"w{rnd.randrange(90)}"]) for _ in range(rnd.randrange(0, 60)))) for i in range(n)]
    # repeated rows, one id with several texts, nulls, empty texts, and a very long text
    return rows + rows[:40] + [(7, "one " * 25), (7, "two " * 25), (None, "none " * 30), (None, None), (501, None), (502, ""), (503, "Long été " * 700_000)]


TARGET = [(1, "alpha été " * 40), (2, None), (3, "w1 w2 w3")]


@pytest.mark.parametrize(("range_rows", "run_rows", "percent"), [(4096, 1 << 18, 10), (7, 5, 10), (1, 1, 100), (3, 50, 0)])
def test_against_brute_force(spark, range_rows, run_rows, percent):
    docs = made()
    got = resampling.resample(frame(spark, docs).repartition(5), frame(spark, TARGET), percent=percent, range_rows=range_rows, run_rows=run_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, TARGET, percent)


def test_slices_keep_words(monkeypatch):
    text = "Één woord, and-more   日本語 x1".encode()
    want = [w for part in resampling.words(text) for w in part]
    for size in range(1, 12):
        monkeypatch.setattr(resampling, "SLICE", size)
        assert [w for part in resampling.words(text) for w in part] == want


def test_merge_opens_blocks_in_order():
    rnd = random.Random(2)
    runs = [sorted((rnd.randrange(40), rnd.randrange(3)) for _ in range(rnd.randrange(1, 60))) for _ in range(9)]
    blocks = sorted(((run[a : a + 4], (k, 0)) for k, run in enumerate(runs) for a in range(0, len(run), 4)), key=lambda b: b[0][0])
    everything = sorted(r for run in runs for r in run)
    assert list(resampling.merged((k, b) for b, k in blocks)) == everything
    for stop in (0, 1, 17, 10**6):
        got = list(resampling.merged(((k, b) for b, k in blocks), stop))
        assert got[:stop] == everything[:stop] and sorted(got) == everything


def test_empty_tables(spark):
    none = frame(spark, [])
    assert resampling.resample(none, none).count() == 0
    docs = [(1, "a b"), (2, None)]
    assert sorted((tuple(r) for r in resampling.resample(frame(spark, docs), none).collect()), key=str) == brute(docs, [])


def test_registered_query(spark, tmp_path):
    docs = made(120)
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, TARGET).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(r) for r in op12_resampling(spark, str(tmp_path)).collect()), key=str) == brute(docs, TARGET)
