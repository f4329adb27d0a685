"""Substring dedup against brute force: by passages as registered, and every repeated unit with min_words=1."""

import random

import pytest

from allelic.llm import queries, substring_dedup
from allelic.llm.substring_dedup import ENDS, dedup_units, units_of, words_of

RND = random.Random(7)
SENTENCES = [" ".join(RND.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n)) + RND.choice(".!?") for n in (1, 2, 4, 7, 9, 12, 16, 25) for _ in range(4)]


def texts():
    made = [(i, "".join(RND.choice(SENTENCES) + RND.choice([" ", "\n", "\n\n", "  "]) for _ in range(RND.randint(0, 14)))) for i in range(60)]
    passage = " ".join(SENTENCES[8:24])
    made += [(100, f"own words here {passage} and more"), (101, f"Others. {passage.upper()} tail"), (102, None), (103, ""), (104, "\n\n \n"), (105, "日本語の文章です。" * 30), (106, "前。" + "日本語の文章です。" * 30), (107, "x" * 300_000 + " " + passage)]
    return [*made, made[3], made[3]]


def brute(rows, unit, min_words):
    """id -> n_removed, n_left, text; ids are of one text each."""
    seen, want = set(), {}
    short = min(3, min_words)
    for i, t in sorted(dict(rows).items()):
        t = t or ""
        units, later = units_of(t, ENDS[unit]), []
        for k, (_, _, form) in enumerate(units):
            if form in seen:
                later.append(k)
            seen.add(form)
        gone, k = set(), 0
        while k < len(units):
            run = []
            while k < len(units) and k in later:
                run.append(k)
                k += 1
            if run and sum(w for w in (words_of(units[j][2]) for j in run) if w >= short) >= min_words:
                gone.update(run)
            k += 1
        places = {p for j in gone for p in range(units[j][0], units[j][1])}
        want[i] = (len(gone), len(later) - len(gone), "".join(c for p, c in enumerate(t) if p not in places))
    return want


@pytest.mark.parametrize(("unit", "min_words"), [("sentence", 20), ("sentence", 1), ("line", 1), ("line", 8), ("paragraph", 5)])
def test_against_brute_force(spark, unit, min_words):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, rank int, _digest string").repartition(5)
    got = dedup_units(docs, unit=unit, min_words=min_words).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_removed"], r["n_left"], r["text"]) for r in got} == brute(rows, unit, min_words)
    whole = dict(rows)
    for r in got:
        spans = [tuple(map(int, s.split("-"))) for s in r["removed_spans"].split(",") if s]
        assert sum(b - a for a, b in spans) == r["removed_chars"] == len(whole[r["doc_id"]] or "") - len(r["text"])


def test_held_units_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 3)
    rows = texts()
    got = dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_left"], r["text"]) for r in got} == brute(rows, "sentence", 20)


def test_ties_and_null_ids(spark):
    line = " ".join(SENTENCES[20:28])
    got = dedup_units(spark.createDataFrame([(None, line), (5, line + "\nb"), (5, line + "\na"), (4, line)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_removed"] > 0) for r in got} == {(None, False), (5, True), (4, True)}


def test_short_and_unspaced_lines_go(spark):
    """With min_words=1 short lines go, and long ones without spaces."""
    long = "日本語" * 40
    rows = [(1, f"All rights reserved.\n\n{long}\nown"), (2, f"x\n\n\n{long}\nall  rights RESERVED. "), (3, "x"), (4, None), (5, "\n")]
    got = {r["doc_id"]: r for r in dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), unit="line", min_words=1).collect()}
    assert {i: (r["n_removed"], r["n_left"], r["text"]) for i, r in got.items()} == brute(rows, "line", 1)
    assert [got[i]["n_removed"] for i in range(1, 6)] == [0, 2, 1, 0, 0]


def test_query_takes_whole_table(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_substring_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_left"], r["text"]) for r in got} == brute(rows, "sentence", 20)
