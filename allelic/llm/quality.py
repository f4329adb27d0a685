"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on statistics of labelled texts; every path from a root to a node is a rule (a
conjunction of comparisons). A lasso logistic regression over the rules keeps few of them, and those are compiled into
one Spark column: the score is computed where the text is read, without Python or a shuffle.

The model is fitted on at most ``sample`` labelled rows (smallest hashes of the id), never on held-out ones (crc32 of the
id's text divisible by FOLDS). Statistics are of the whole text; id, language, source and labels are no inputs.

Defined results: a null or empty text has statistics of 0 (shares) or of an empty text and is scored as such; without
labels, or with labels of one class, every score is the smoothed share of label 1 (0.5 without any); a null id is
never held out and has no label; repeated rows give a row each; an empty table gives none; labels other than 0 and 1 are
not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import row_with

FOLDS, SAMPLE, THRESHOLD = 5, 12_000, 0.3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
SIGNS = {"bang": "!", "pipe": "|", "stop": ".,", "sign": "#$%&*+=@^~<>\\_{}[]"}


def statistics(text: Column) -> dict[str, Column]:
    """Name -> double column."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words, lines = F.split(t, " "), F.split(t, "\n")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    out = {
        "length": F.length(t).cast("double"),
        "word_length": n / n_words,
        "line_length": n / n_lines,
        "upper": (F.length(t) - F.length(F.translate(t, UPPER, ""))) / n,
        "digits": (F.length(t) - F.length(F.translate(t, "0123456789", ""))) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }
    # per word, so that long and short texts compare
    return out | {k: (F.length(t) - F.length(F.translate(t, s, ""))) / n_words for k, s in SIGNS.items()}


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class RuleModel:
    """intercept + sum of the weights of the rules that hold; a rule: ((statistic, at most?, bound), ...)."""

    intercept: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, of columns that hold the statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, below, bound in conditions:
                holds = holds & ((stats[name] <= bound) if below else (stats[name] > bound))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x, names) for r, w in self.rules), np.zeros(len(x))))))


def holds(rule: tuple, x: np.ndarray, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, below, bound in rule:
        v = x[:, names.index(name)]
        ok &= (v <= bound) if below else (v > bound)
    return ok


def _grow(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, names: list[str], least: int, paths: set, values: np.ndarray) -> None:
    """One regression tree on the gradients; adds its paths, and its leaves' steps to ``values``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 2 * least:
        for j, cut in enumerate(bins):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[rows, j], side="left")
            n, gs, hs = (np.cumsum(np.bincount(at, w, len(cut) + 1))[:-1] for w in (None, grad[rows], hess[rows]))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cut[k]))
    if best[1] < 0:
        values[rows] += 0.3 * g / (h + 1)
        return
    _, j, bound = best
    under = x[rows, j] <= bound
    for below, part in ((True, rows[under]), (False, rows[~under])):
        grown = _joined(path, (names[j], below, bound))
        paths.add(grown)
        _grow(x, bins, grad, hess, part, grown, depth - 1, names, least, paths, values)


def _joined(path: tuple, new: tuple[str, bool, float]) -> tuple:
    """A conjunction with one condition more; a looser one on the same side goes."""
    return tuple(sorted([c for c in path if c[:2] != new[:2]] + [new]))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Intercept and weights: accelerated proximal gradient with an unpenalised intercept."""
    n, m = z.shape
    a = np.column_stack([np.ones(n), z])
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / max(float(np.linalg.norm(a @ v) ** 2), 1e-9)
    w = last = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        u = 0.5 * (1 + np.sqrt(1 + 4 * t * t))
        ahead = w + (t - 1) / u * (w - last)
        step = ahead - size * (a.T @ (1 / (1 + np.exp(-np.clip(a @ ahead, -40, 40))) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        new[0] = step[0]
        last, w, t = w, new, u
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 4e-4) -> RuleModel:
    """Rules from boosted trees, weighted by the lasso."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))))
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    bins = [(b[1:] + b[:-1]) / 2 if len(b) > 1 else b[b < c.max()] for b, c in zip(bins, x.T, strict=True)]
    share = y.mean()
    margin, paths, rng = np.full(len(y), np.log(share / (1 - share))), set(), np.random.default_rng(7)
    least = max(2, len(y) // 1000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        values = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(2, len(y) * 4 // 5), replace=False))
        _grow(x, bins, y - p, p * (1 - p), rows, (), depth, names, least, paths, values)
        margin = margin + values
    rules = sorted(paths)
    z = np.column_stack([holds(r, x, names) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)  # of rules that hold for the same rows, one
    keep = sorted(first, key=lambda i: (len(rules[i]), rules[i]))
    intercept, weights = lasso_logistic(z[:, keep], y.astype(np.float64), penalty)
    return RuleModel(intercept, [(rules[i], float(w)) for i, w in zip(keep, weights, strict=True) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """A model of the labels of rows that are not held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & ~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    stats = statistics(F.col("_text"))
    names = list(stats)
    rows = texts.join(F.broadcast(known), "_id").select("_id", "_y", *[c.alias(k) for k, c in stats.items()])
    # an id that repeats, among documents or labels, multiplies rows; the bound holds for them too
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_y", *names).limit(sample).toArrow()
    x = np.column_stack([rows.column(k).to_numpy() for k in names]) if rows.num_rows else np.zeros((0, len(names)))
    order = np.lexsort((*x.T, rows.column("_y").to_numpy()))  # the order of arrival must not matter
    return fit_rules(x[order], rows.column("_y").to_numpy()[order], names)


def _scored(docs: DataFrame, model: RuleModel, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    used = {c[0] for rule, _ in model.rules for c in rule}
    stats = {k: c for k, c in statistics(text).items() if k in used}
    # one array element holds the statistics, so a filter on the score doesn't compute them for every rule anew
    held = F.array(F.struct(F.lit(0).alias("none"), *[c.alias(k) for k, c in stats.items()]))
    score = F.get(F.transform(held, lambda s: model.column({k: s[k] for k in stats})), F.lit(0))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), score.alias("_score"))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    own = F.col("_row").getField(id_col)
    return _scored(docs, model, id_col, text_col).select(
        own.cast("long").alias("doc_id"), held_out(own).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    return _scored(docs, model, id_col, text_col).where(F.col("_score") >= threshold).select(*row_with(docs, {}))
