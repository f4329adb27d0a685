"""Character models against a plain Kneser-Ney, predictions on held-out rows, and the defined results."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from allelic.llm import language_id
from allelic.llm.queries import op11_language_id

SYLLABLES = {"aa": ["ka", "lo", "mi", "ту"], "bb": ["str", "ein", "é", "och"], "cc": ["ka", "str", "ñu", "ya"]}
SCHEMA = "doc_id long, text string, lang string, source string, key long, letters string, gram string, n long"


def text_of(lang, rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "! 12"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, "clash", "g", 2) for i, t, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, text_of(x := rnd.choice(list(SYLLABLES)), rnd, rnd.randrange(2, 40)), x) for i in range(400)]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, " 12 !? ", "bb"), (None, text_of("bb", rnd, 9), "bb"), (403, text_of("cc", rnd, 9), None), (404, "word " * 400_000, None), (5, rows[5][1], rows[5][2])]
    return frame(spark, rows)


class Plain:
    """Interpolated Kneser-Ney over dictionaries; contexts are tuples, None stands for a separator."""

    def __init__(self, sequences, size):
        tables = [Counter() for _ in range(5)]
        for s in sequences:
            padded = [None] * 3 + s
            for k in range(3, len(padded)):
                tables[4][tuple(padded[k - 3 : k + 1])] += 1
        for order in (3, 2, 1):
            for g in tables[order + 1]:
                tables[order][g[1:]] += 1
        self.tables, self.size = tables, size
        self.discount = [0] + [min(max(self.d(tables[k]), 0.1), 0.9) for k in range(1, 5)]
        self.total, self.kinds = defaultdict(int), defaultdict(int)
        for order in range(1, 5):
            for g, n in tables[order].items():
                self.total[order, g[:-1]] += n
                self.kinds[order, g[:-1]] += 1

    @staticmethod
    def d(table):
        a, b = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        return a / (a + 2 * b) if a + b else 0.5

    def p(self, g):
        order = len(g)
        if not order:
            return 1 / self.size
        total = self.total[order, g[:-1]]
        if not total:
            return self.p(g[1:])
        d = self.discount[order]
        return max(self.tables[order][g] - d, 0) / total + d * self.kinds[order, g[:-1]] / total * self.p(g[1:])


def sequence(text):
    out = []
    for c in text.lower():
        if c.isalpha() or (out and out[-1] is not None):
            out.append(c if c.isalpha() else None)
    return out if out and out[-1] is None else [*out, None]


def test_model_is_kneser_ney(spark, docs):
    rows = [(r["lang"], r["text"]) for r in docs.where("doc_id < 150").collect()]
    model = language_id.build(language_id.count_grams(spark.createDataFrame(rows, "lang string, text string")))
    assert model.langs == sorted(SYLLABLES)
    size = len({c for _, t in rows for c in sequence(t)}) + 1
    plain = {x: Plain([sequence(t) for lang, t in rows if lang == x], size) for x in model.langs}
    tests = [r["text"] for r in docs.where("doc_id between 150 and 180").collect()] + ["unseen жжж kaqq", "k"]
    bits, letters = model.cross_entropies(tests)
    assert letters.all()
    for k, t in enumerate(tests):
        s = [None] * 3 + sequence(t)
        for j, x in enumerate(model.langs):
            want = -sum(math.log2(plain[x].p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)
            assert bits[k, j] == pytest.approx(want, rel=1e-4)
    # each alone, and in slices, as all together
    alone = np.vstack([model.cross_entropies([t])[0] for t in tests])
    assert np.allclose(alone, bits)


def test_slices(monkeypatch, spark, docs):
    rows = [(r["lang"], r["text"]) for r in docs.where("doc_id < 60").collect()]
    texts = [t for _, t in rows] + ["", "!", "a"]
    counted = {tuple(r) for r in language_id.count_grams(spark.createDataFrame(rows, "lang string, text string")).collect()}
    model = language_id.build(spark.createDataFrame(list(counted), "lang string, gram long, n long"))
    want = model.cross_entropies(texts)
    monkeypatch.setattr(language_id, "SLICE", 7)
    got = model.cross_entropies(texts)
    assert np.allclose(want[0], got[0], atol=1e-5) and (want[1] == got[1]).all()


def test_fewer_keys_still_tell(spark, docs):
    model = language_id.fit(docs, ngrams=60)
    assert max(len(level.keys) for level in model.levels) == 60
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9


def test_held_out_and_defined_results(spark, docs):
    found = language_id.identify(docs, language_id.fit(docs))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["rejected"] for i in (400, 401, 402))
    assert by[None]["lang_pred"] == "bb" and not by[None]["held_out"] and by[403]["lang_pred"] == "cc" and by[404]["rejected"]
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 50 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_no_learning_rows(spark):
    empty = frame(spark, [(1, "some text", None), (2, None, None)])
    rows = language_id.identify(empty, language_id.fit(empty)).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2
    none = frame(spark, [])
    assert language_id.identify(none, language_id.fit(none)).count() == 0


def test_registered_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_language_id(spark, str(tmp_path))
    assert got.count() == docs.count() and {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)


def test_fewer_keys_change_no_score(spark, docs):
    """What the arrays don't hold is looked up in the tables: a bound on the arrays changes no result."""
    other = frame(spark, [(9000, "unseen жжж kaqq", None), (9001, "kakakaka strañu", None), (9001, "kakakaka strañu", None), (9002, "", None), (9003, None, None)])
    some = docs.where("doc_id is null or doc_id <> 404").unionByName(other)
    whole, fewer = language_id.fit(docs), language_id.fit(docs, ngrams=60)
    assert whole.rest is None and fewer.rest is not None and max(len(level.keys) for level in fewer.levels) == 60
    assert fewer.temperature == pytest.approx(whole.temperature) and np.allclose(fewer.limits, whole.limits, rtol=1e-4)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"])
    want, got = (sorted(language_id.identify(some, m).collect(), key=key) for m in (whole, fewer))
    assert len(want) == len(got) == some.count()
    for a, b in zip(want, got, strict=True):
        assert (a["doc_id"], a["held_out"], a["lang_pred"], a["rejected"]) == (b["doc_id"], b["held_out"], b["lang_pred"], b["rejected"])
        assert a["score"] == pytest.approx(b["score"], abs=1e-4)
        assert a["cross_entropy"] == (None if a["cross_entropy"] is None else pytest.approx(b["cross_entropy"], rel=1e-4)) if b["cross_entropy"] is not None else a["cross_entropy"] is None


def test_sums_leave_nothing_out(monkeypatch, spark, docs):
    """Each 4-gram of each text is in the sums or among those for the tables, in slices as well."""
    model = language_id.fit(docs, ngrams=40)
    texts = ["", "kalo kalo mi", "", "!", "strein och", "ту"]
    whole = model.sums(texts)
    monkeypatch.setattr(language_id, "SLICE", 5)
    sliced = model.sums(texts)
    assert np.allclose(whole[0], sliced[0], atol=1e-5) and (whole[1] == sliced[1]).all()
    count = lambda s: sum((Counter({(int(t), int(g)): int(n)}) for t, g, n in zip(*s[3], strict=True)), Counter())
    assert count(whole) == count(sliced) and {t for t, _ in count(whole)} <= {1, 3, 4, 5}
