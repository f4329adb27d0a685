"""Language identification by interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Texts become lower-case letters and marks; every run of other characters is one separator. A character's code has 16 bits (those
beyond the basic plane are hashed into them), so four of them are a 64-bit key. Counts of all 4-grams of all learning rows are
gathered per language in Spark; counts of lower orders are those of Kneser-Ney: how many different characters precede. Each order is
discounted by its counts of ones and twos and interpolated with the next lower one, the lowest with the uniform distribution.

For each order the keys of all languages form one sorted array with a row of log probabilities, a column a language;
contexts have such arrays of backoff weights. A text's cross-entropies in all languages come from one binary search a character, and
further ones only for 4-grams that no language has. The lowest cross-entropy a character wins.

Tasks hold at most ``ngrams`` keys and contexts of each order, the most frequent ones: 12 bytes and 4 more for each language a key. All
others are in tables of probabilities that Spark computes and joins: of a text's 4-grams that the arrays can't settle each distinct one is looked
up there once, and what it gives is added. The bound decides where a 4-gram is looked up, never what it counts.

Some learning rows are left out of the counts: on at most CALIBRATION of them the temperature that turns cross-entropies into a score is
chosen, and for each language the limit above which a text is marked as ``rejected`` (the QUANTILE of its own texts).

Learning rows have a language and are not held out (crc32 of the id's text divisible by FOLDS). All of them are counted.

Defined results: a null text, a text without letters, and any text where there are no learning rows: ``und`` with score 0, not rejected; ties go to the
first language in order; a null id is never held out and learned from; repeated rows give a row each; an empty table gives none. Other columns play no part.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import bounded_batches, stored, trimmed
from allelic.llm.quality import held_out

ORDER, NGRAMS, CALIBRATION, QUANTILE = 4, 1 << 17, 2_000, 0.995
UNKNOWN = "und"
#: Characters of a text, or codes, looked at together.
SLICE = 1 << 19
#: Of probabilities, so that they have a logarithm.
LEAST = 1e-30
BITS = np.uint64(16)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its code (0: a separator), and whether it is a letter."""
    code, letter = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] in "LM":
            low = ord(c.lower()[0])
            code[i] = low if low < 0x10000 else 1 + low * 40503 % 0xFFFF
            letter[i] = c.isalpha()
    return code, letter


def codes_of(text: str) -> tuple[np.ndarray, bool]:
    """Codes of a text with a separator at its end, and whether it has a letter."""
    code, letter = _tables()
    parts, letters = [], False
    for a in range(0, len(text), SLICE):
        points = np.frombuffer(text[a : a + SLICE].encode("utf-32-le"), np.uint32)
        letters = letters or bool(letter[points].any())
        parts.append(code[points])
    parts.append(np.zeros(1, np.uint16))
    found = np.concatenate(parts)
    before = np.empty_like(found)
    before[0], before[1:] = 0, found[:-1]
    return found[(found != 0) | (before != 0)], letters


def grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """4-grams that end at each code, in slices (first position, keys); before the start of a text there are separators."""
    begin = np.zeros(len(codes), bool)
    begin[starts[starts < len(codes)]] = True
    for a in range(0, len(codes), SLICE):
        b, low = min(len(codes), a + SLICE), max(0, a - ORDER + 1)
        part, first = codes[low:b].astype(np.uint64), begin[low:b]
        key, inside = part.copy(), np.ones(b - low, bool)
        for k in range(1, ORDER):
            # inside: the k-th code before still belongs to the text
            inside[k:] &= ~first[1 : b - low - k + 1]
            inside[:k] = False
            moved = np.zeros_like(part)
            moved[k:] = part[: len(part) - k]
            key |= np.where(inside, moved, np.uint64(0)) << np.uint64(16 * k)
        yield a, key[a - low :]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    found, at = np.unique(k, return_inverse=True)
    return found, np.bincount(at, c, len(found)).astype(np.int64)


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, gram, n of rows (lang, text); a task sends each 4-gram of a language once."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            if new := waiting.pop(lang, None):
                k, n = np.unique(np.concatenate(new), return_counts=True)
                old = sums.get(lang)
                sums[lang] = (k, n) if old is None else _summed([old[0], k], [old[1], n])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, _ = codes_of(text)
                for _, keys in grams(codes, np.zeros(1, np.int64)):
                    waiting.setdefault(lang, []).append(keys)
                    if sum(map(len, waiting[lang])) > 4 * SLICE:
                        add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, (k, n) in sums.items():
            for a in range(0, len(k), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[part])), pa.array(k[part].view(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """One order: sorted keys with log2 probabilities, sorted contexts with log2 backoff weights; a column for each language. all_*: nothing of them is left to the tables."""

    keys: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    all_keys: bool = True
    all_contexts: bool = True


@dataclass
class LanguageModel:
    """levels[0] has single characters; floor: log2 probability of a character that is in none; rest: the tables, where levels don't hold everything."""

    langs: list[str]
    levels: list[Level]
    floor: np.ndarray
    temperature: float = 1.0
    limits: np.ndarray | None = None
    rest: Tables | None = None

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 of the probability of each key's last character after the others, in every language; NaN where only the tables know it."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs))).astype(np.float32)
        level = self.levels[order - 1]
        keys = keys & np.uint64((1 << 16 * order) - 1)
        at, found = _find(level.keys, keys)
        out = level.logs[at] if len(level.keys) else np.zeros((len(keys), len(self.langs)), np.float32)
        if not found.all():
            rest = np.flatnonzero(~found)
            if not level.all_keys:
                out[rest] = np.nan
                return out
            # what no language has is often met again
            distinct, back = np.unique(keys[rest], return_inverse=True)
            lower = self.log_probabilities(distinct, order - 1)
            where, known = _find(level.contexts, distinct >> BITS)
            if known.any():
                lower = lower + np.where(known[:, None], level.backoff[where], np.float32(0))
            if not level.all_contexts:
                lower = np.where(known[:, None], lower, np.float32(np.nan))
            out[rest] = lower[back]
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its log2 probabilities in each language, its length in codes and whether it has letters; (text, 4-gram, times) of what only the tables know, which isn't in the sums."""
        parts, letters = zip(*(codes_of(t) for t in texts), strict=True)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        total = np.zeros((len(texts), len(self.langs)))
        open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, keys in grams(np.concatenate(parts), starts):
            logs = self.log_probabilities(keys)
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, a + len(keys), "left")
            while sizes[first] == 0:
                first -= 1
            held = np.flatnonzero(sizes[first:last]) + first
            unknown = np.isnan(logs[:, 0])
            if unknown.any():
                at = np.flatnonzero(unknown)
                logs = np.where(unknown[:, None], np.float32(0), logs)
                # starts of texts without codes are those of the next one
                own = held[np.searchsorted(starts[held], a + at, "right") - 1]
                order = np.lexsort((keys[at], own))
                own, gram = own[order], keys[at][order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])]))
                open_.append((own[new], gram[new], np.diff(np.append(new, len(own)))))
            total[held] += np.add.reduceat(logs, np.maximum(starts[held] - a, 0), axis=0, dtype=np.float64)
        empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return total, sizes, np.array(letters), tuple(map(np.concatenate, zip(*open_, strict=True))) if open_ else empty

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, and whether it has letters; of a model that holds everything."""
        total, sizes, letters, (open_, _, _) = self.sums(texts)
        if len(open_):
            raise ValueError("the model's tables are needed")
        return -total / np.maximum(sizes, 1)[:, None], letters


@dataclass
class Tables:
    """Of each order, the lowest first, (key, p) of all keys and (key, backoff) of all contexts, arrays by language, and whether both are small enough to be sent; the probability of a character that is in none."""

    levels: list[tuple[DataFrame, DataFrame, bool, bool]]
    floor: float
    size: int

    def of(self, asked: DataFrame) -> DataFrame:
        """gram, logs of distinct 4-grams (gram): those of the highest order that has them, times the backoff weights of the orders above."""
        times = lambda x, y: F.when(y.isNull(), x).otherwise(F.zip_with(x, y, lambda a, b: a * b))
        rows = asked.withColumn("_p", F.array_repeat(F.lit(self.floor), self.size))
        for order, (keys, contexts, few_keys, few_contexts) in enumerate(self.levels, 1):
            sent = lambda df, few: F.broadcast(df) if few else df
            own = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < ORDER else F.col("gram")
            rows = rows.withColumn("_key", own).withColumn("_context", F.shiftrightunsigned(own, 16))
            rows = rows.join(sent(keys.select(F.col("key").alias("_key"), F.col("p").alias("_own")), few_keys), "_key", "left")
            rows = rows.join(sent(contexts.select(F.col("key").alias("_context"), "backoff"), few_contexts), "_context", "left")
            rows = rows.select("gram", F.coalesce("_own", times(F.col("_p"), F.col("backoff"))).alias("_p"))
        return rows.select("gram", F.transform("_p", lambda x: F.log2(F.greatest(x, F.lit(LEAST)))).alias("logs"))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _sorted(rows: DataFrame, ngrams: int, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, at most ``ngrams``, those that are most frequent in all languages together, and log2 of a column of arrays."""
    found = rows.orderBy(F.desc("n"), "key").limit(ngrams).select("key", column).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = np.array(found.column(column).to_pylist(), float).reshape(len(keys), width)
    return keys[order], np.log2(np.maximum(values[order], LEAST)).astype(np.float32)


def build(counts: DataFrame, ngrams: int = NGRAMS) -> LanguageModel:
    """The model of counts (lang, gram, n); Spark computes the probabilities of all keys of an order from those of the order below."""
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return LanguageModel([], [], np.zeros(0))
    tables, now = [], counts.select("lang", F.col("gram").alias("key"), "n")
    for order in range(ORDER, 0, -1):
        tables.insert(0, now)
        if order > 1:
            # how many characters precede: the kinds of the next higher order
            now = stored(now.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n")), "grams")
    size = tables[0].select("key").distinct().count() + 1
    model = LanguageModel(langs, [], np.full(len(langs), -np.log2(size)))
    each = F.sequence(F.lit(0), F.lit(len(langs) - 1))
    # what a row of a key has by language, as a map
    by_language = lambda value: F.map_from_entries(F.collect_list(F.struct((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("at"), value.alias("v"))))
    levels, lower = [], None
    for order, table in enumerate(tables, 1):
        ones = {r["lang"]: (r["a"], r["b"]) for r in table.where("n <= 2").groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()}
        discount = np.array([a / (a + 2 * b) if (a := ones.get(x, (0, 0))[0]) + (b := ones.get(x, (0, 0))[1]) else 0.5 for x in langs])
        d = F.array(*map(F.lit, np.clip(discount, 0.1, 0.9).tolist()))
        contexts = table.groupBy("lang", F.shiftrightunsigned("key", 16).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        contexts = contexts.groupBy("key").agg(F.sum("n").alias("n"), by_language(F.struct("n", "kinds")).alias("of"))
        told = lambda i: F.try_element_at("of", i)
        contexts = contexts.select("key", "n", F.transform(each, lambda i: F.coalesce(told(i)["n"], F.lit(0))).alias("totals"), F.transform(each, lambda i: F.coalesce(F.get(d, i) * told(i)["kinds"] / told(i)["n"], F.lit(1.0))).alias("backoff"))  # noqa: B023
        contexts = stored(contexts, "contexts")
        few_contexts = contexts.count() <= ngrams
        sent = lambda df, few: F.broadcast(df) if few else df
        keys = table.groupBy("key").agg(F.sum("n").alias("n"), by_language(F.col("n")).alias("of")).withColumn("_context", F.shiftrightunsigned("key", 16))
        keys = keys.join(sent(contexts.select(F.col("key").alias("_context"), "totals", "backoff"), few_contexts), "_context")
        if lower is None:
            keys = keys.withColumn("_p", F.array_repeat(F.lit(1 / size), len(langs)))
        else:
            below = lower[0].select(F.col("key").alias("_below"), F.col("p").alias("_p"))
            keys = keys.withColumn("_below", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))).join(sent(below, lower[2]), "_below")
        n, total = lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0)), lambda i: F.get("totals", i)
        p = lambda i: F.when(total(i) > 0, F.greatest(n(i) - F.get(d, i), F.lit(0.0)) / total(i)).otherwise(0.0) + F.get("backoff", i) * F.get("_p", i)  # noqa: E731, B023
        keys = stored(keys.select("key", "n", F.transform(each, p).alias("p")), "keys")
        lower = (keys, contexts, keys.count() <= ngrams, few_contexts)
        levels.append(lower)
        (own, logs), (ctx, backoff) = _sorted(keys, ngrams, "p", len(langs)), _sorted(contexts, ngrams, "backoff", len(langs))
        model.levels.append(Level(own, logs, ctx, backoff, lower[2], few_contexts))
    if not all(few_keys and few_contexts for _, _, few_keys, few_contexts in levels):
        model.rest = Tables(levels, 1 / size, len(langs))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ngrams: int = NGRAMS, calibration: int = CALIBRATION) -> LanguageModel:
    """A model of the rows of ``docs`` that have a language and are not held out."""
    own: Column = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    left_out = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("calibration")), F.lit(16)) == 0
    model = build(stored(count_grams(rows.where(~left_out).select("lang", "text")), "grams"), ngrams)
    if not model.langs:
        return model
    # the rows are chosen by their ids alone; their texts are scored where they are
    chosen = rows.where(left_out).select("id", "lang", F.xxhash64("text").alias("h")).orderBy(F.xxhash64("id"), "id", "h", "lang").limit(calibration)
    picked = rows.where(left_out).join(F.broadcast(chosen.select("id").distinct()), "id").select("id", "lang", "text")  # at most `calibration` ids
    found = _entropies(picked.select(F.col("lang").alias("key"), "text"), model).where("letters").limit(4 * calibration).toArrow()
    known = [i for i, x in enumerate(found.column("key").to_pylist()) if x in model.langs]
    if known:
        truth = np.searchsorted(model.langs, np.array(found.column("key").to_pylist(), str)[known])
        bits = np.array(found.column("bits").to_pylist())[known]
        likelihood = lambda t: float(np.log(_shares(bits, t)[np.arange(len(truth)), truth] + 1e-9).sum())
        model.temperature = float(max(np.geomspace(0.25, 64, 49), key=likelihood))
        own_bits = bits[np.arange(len(truth)), truth]
        model.limits = np.array([np.quantile(own_bits[truth == k], QUANTILE) if (truth == k).any() else np.inf for k in range(len(model.langs))])
    return model


def _shares(bits: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp2(-temperature * (bits - bits.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def _groups(texts: list[str]) -> Iterator[slice]:
    """Texts of some hundred thousand characters together."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield slice(a, k + 1)
            a, size = k + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def _entropies(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """key, bits (an array, by language), letters of rows (key, text). Rows are stored where the model has tables."""
    sent = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _groups(texts):
                total, sizes, letters, (at, gram, n) = sent.value.sums(texts[part])
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(sizes) + 1))
                open_ = pa.StructArray.from_arrays([pa.array(gram[order].view(np.int64)), pa.array(n[order])], names=["gram", "n"])
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), open_)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(sizes), pa.array(letters), rest], names=["key", "sums", "size", "letters", "rest"])

    bounded_batches(rows.sparkSession)
    found = rows.mapInArrow(score, f"key {dict(rows.dtypes)['key']}, sums array<double>, size long, letters boolean, rest array<struct<gram:long,n:long>>")
    bits = lambda sums: F.transform(sums, lambda x: -x / F.greatest(F.col("size"), F.lit(1))).alias("bits")
    if model.rest is None:
        return found.select("key", bits(F.col("sums")), "letters")
    # rows may repeat in their key, so they are numbered
    found = stored(found.withColumn("_row", F.monotonically_increasing_id()), "sums")
    open_ = found.select("_row", F.explode("rest").alias("_r")).select("_row", "_r.gram", "_r.n")
    logs = stored(model.rest.of(open_.select("gram").distinct()), "logs")
    added = open_.join(logs, "gram").groupBy("_row").agg(F.array(*[F.sum(F.col("n") * F.get("logs", F.lit(i))) for i in range(len(model.langs))]).alias("_added"))
    sums = F.coalesce(F.zip_with("sums", "_added", lambda x, y: x + y), F.col("sums"))
    return found.drop("rest").join(added, "_row", "left").select("key", bits(sums), "letters")


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy (bits a character), rejected of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if not model.langs:
        return rows.select(F.col("key").cast("long").alias("doc_id"), held_out(F.col("key")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    limits = np.full(len(model.langs), np.inf) if model.limits is None else model.limits
    least = F.array_min("bits")
    at = F.array_position("bits", least).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    share = 1 / F.aggregate("bits", F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), F.lit(-model.temperature) * (b - least)))
    found = _entropies(rows, model)
    when = lambda c, other: F.when(F.col("letters"), c).otherwise(other)
    return found.select(
        F.col("key").cast("long").alias("doc_id"), held_out(F.col("key")).alias("held_out"), when(of(model.langs), F.lit(UNKNOWN)).alias("lang_pred"), when(share, F.lit(0.0)).alias("score"),
        when(least, F.lit(None).cast("double")).alias("cross_entropy"), when(least > of(map(float, limits)), F.lit(False)).alias("rejected"),
    )
