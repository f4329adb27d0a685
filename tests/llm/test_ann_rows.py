"""op10_ann on rows that codes alone can't part: tight groups, rows about one mean, many copies, components of unlike size."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("allelic.llm")

from allelic.llm import ann, vectors  # noqa: E402


def _rows(kind: str, n: int = 6000, dim: int = 32) -> np.ndarray:
    rng = np.random.default_rng(11)
    if kind == "tight":  # two directions, each with thousands of rows close to it
        return rng.normal(size=(2, dim))[rng.integers(0, 2, n)] + 1e-3 * rng.normal(size=(n, dim))
    if kind == "mean":
        return 5 * rng.normal(size=dim) + 0.3 * rng.normal(size=(n, dim))
    if kind == "copies":
        m = rng.normal(size=(n, dim))
        m[rng.permutation(n)[: n // 2]] = m[0]
        return m
    return rng.normal(size=(n, dim)) * np.geomspace(1, 1e-4, dim)


@pytest.mark.parametrize("kind", ["tight", "mean", "copies", "uneven"])
@pytest.mark.parametrize("element", ["float", "double"])
def test_every_nearest_row_is_found(spark, monkeypatch, kind, element):
    monkeypatch.setattr(vectors, "SHARD", 2500)
    m = _rows(kind)
    m = m.astype(np.float32).astype(np.float64) if element == "float" else m
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], f"vec_id long, embedding array<{element}>")
    got: dict = {}
    for r in ann.nearest(frame, frame.where("vec_id % 300 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, len(m), 300):
        s = ann.cosines(np.broadcast_to(m[q], m.shape), m)
        best = [i for i in np.lexsort((np.arange(len(m)), -s)).tolist() if i != q][:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, s[i]) for i in best]
