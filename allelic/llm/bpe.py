"""Byte-level BPE, encoding and decoding, by speculation and verification.

A greedy longest match proposes tokens for each distinct word. A proposal is the encoding if and only if each of its
tokens encodes to itself and every two neighbours are compatible: no merge across their border would have been made
before the merges that built them. Compatibility of all distinct pairs of a batch is tested at once in arrays, by
walking down the right spine of the left token and the left spine of the right one, latest merge first. Only words with
a failing pair are merged exactly.

Defined results: a null text counts as empty; empty texts have no ids and the hash of nothing; special tokens in a text
become their ids; a null id stays null; repeated rows give a row each; an empty table gives none. No data is moved
between tasks; a batch of texts and a cache of bounded size are in memory.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.chunks import CACHE, Chunks, byte_level_pieces, larger, ragged
from allelic.llm.common import bounded_batches, trimmed

#: Words of more bytes are walked one by one when tokens are proposed, and exact merging of them keeps a heap; the results are the same.
LONG = 256


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sign = byte_signs()
        as_bytes = lambda s: bytes(sign[c] for c in s)
        self.id_of = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for k, v in self.id_of.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lens = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.starts = np.cumsum(self.lens) - self.lens
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.left, self.right, self.born = (np.full(size, -1, np.int64) for _ in range(3))
        unsure = np.zeros(size, bool)
        for r, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            x, y, z = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if (x, y) in self.rank:
                continue
            self.rank[x, y], self.made[x, y] = r, z
            if self.born[z] >= 0:
                unsure[z] = True  # two ways to make it: never taken on trust
            else:
                self.left[z], self.right[z], self.born[z] = x, y, r
        self.size = size
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.sound = ~unsure
        for z in np.argsort(self.born, kind="stable"):
            if self.born[z] >= 0:
                self.sound[z] &= self.sound[self.left[z]] and self.sound[self.right[z]]
        merged = np.flatnonzero(self.born >= 0)
        self.sound[merged] &= self.compatible(self.left[merged], self.right[merged], self.born[merged])
        for z in merged[np.argsort(self.born[merged])]:
            self.sound[z] &= self.sound[self.left[z]] and self.sound[self.right[z]]
        self.sound[[v for v in self.special.values()]] = False
        self._trie()
        self.good = np.zeros(0, np.int64)
        self.bad = np.zeros(0, np.int64)

    def _trie(self) -> None:
        """step[row of a node, byte]: number of the child or 0; token[node]; row[node]: -1 without children. Node 0 stands for none, 1 for the root."""
        number: dict[bytes, int] = {b"": 1}
        for k in sorted(self.id_of):
            for n in range(1, len(k) + 1):
                number.setdefault(k[:n], len(number) + 1)
        parents = {k[:-1] for k in number if k}
        self.token, self.row = np.full(len(number) + 1, -1, np.int32), np.full(len(number) + 1, -1, np.int32)
        for i, k in enumerate(sorted(parents)):
            self.row[number[k]] = i
        self.step = np.zeros((len(parents), 256), np.int32)
        for k, i in number.items():
            if k:
                self.step[self.row[number[k[:-1]]], k[-1]] = i
            self.token[i] = self.id_of.get(k, -1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay apart side by side (or stay so until merge ``before``)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossed = self.pair_rank(x, y) < limit[live]
            ok[live[crossed]] = False
            whole = (self.born[x] < 0) & (self.born[y] < 0)
            live = live[~crossed & ~whole]
            x, y = a[live], b[live]
            undo_left = self.born[x] > self.born[y]
            # of two equal merges the left one comes first: it beats one that takes b, not one that took a
            limit[live] = np.where(undo_left, self.born[x], self.born[y] + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, the word and the token, in order; short words advance together, a byte of each a step."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if long:
            walks = [self._walk(words[i]) for i in long]
            found.append((np.repeat(np.array(long, np.int64), [len(x) for x in walks]), np.array(list(chain.from_iterable(walks)), np.int32)))
            words = [b"" if len(w) > LONG else w for w in words]
        data = np.frombuffer(b"".join(words), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(lens)
        word = np.flatnonzero(lens)
        at = (end - lens)[word]
        end = end[word]
        row, best, upto = np.full(len(word), self.row[1]), np.full(len(word), -1, np.int32), at.copy()
        while len(word):
            child = self.step[row, data[at]]
            token = self.token[child]
            at = at + 1
            hit = token >= 0
            best, upto = np.where(hit, token, best), np.where(hit, at, upto)
            row = self.row[child]
            over = (row < 0) | (at == end)
            found.append((word[over], best[over]))
            at, row = np.where(over, upto, at), np.where(over, self.row[1], row)
            live = ~over | (upto < end)
            best = np.where(over, -1, best)
            word, at, end, row, best, upto = (x[live] for x in (word, at, end, row, best, upto))
        owner, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order].astype(np.int64)

    def _walk(self, word: bytes) -> list[int]:
        """Greedy longest matches of one word."""
        out, at = [], 0
        while at < len(word):
            node, k, best, upto = 1, at, -1, at + 1
            while k < len(word) and self.row[node] >= 0 and (node := int(self.step[self.row[node], word[k]])):
                k += 1
                if self.token[node] >= 0:
                    best, upto = int(self.token[node]), k
            out.append(best)
            at = upto
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.rank)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [made[ids[i], ids[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in near linear time."""
        after, prior = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.rank[p], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heapq.heapify(heap)
        dead = [False] * len(ids)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], dead[j], after[i] = self.made[p], True, after[j]
            if after[i] >= 0:
                prior[after[i]] = i
            for k in (prior[i], i):
                if k >= 0 and after[k] >= 0 and (q := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[q], k, q))
        return [t for t, d in zip(ids, dead, strict=True) if not d]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Which of the distinct pair keys are compatible."""
        new = keys[~(np.isin(keys, self.good, assume_unique=True) | np.isin(keys, self.bad, assume_unique=True))]
        if len(new):
            if len(self.good) + len(self.bad) > 4 * CACHE:
                self.good, self.bad, new = np.zeros(0, np.int64), np.zeros(0, np.int64), keys
            ok = self.compatible(new // self.size, new % self.size)
            self.good, self.bad = np.union1d(self.good, new[ok]), np.union1d(self.bad, new[~ok])
        return np.isin(keys, self.good, assume_unique=True)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        failing = np.zeros(len(words), bool)
        owner, flat = self.propose(words)
        failing[owner[~self.sound[flat]]] = True
        inside = owner[1:] == owner[:-1]
        keys, back = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        failing[owner[1:][inside][~self._known(keys)[back]]] = True
        if failing.any():
            keep = ~failing[owner]
            redo = np.flatnonzero(failing)
            exact = [self.merge(words[i]) for i in redo.tolist()]
            owner = np.concatenate([owner[keep], np.repeat(redo, [len(x) for x in exact])])
            flat = np.concatenate([flat[keep], np.fromiter((t for x in exact for t in x), np.int64)])
            order = np.argsort(owner, kind="stable")
            owner, flat = owner[order], flat[order]
        return flat, np.bincount(owner, minlength=len(words))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of texts; a special token has its one id."""
        ids, lens = self.encode_words([b"" if p in self.special else p.encode("utf-8", "replace") for p in pieces])
        for i, p in enumerate(pieces):
            if p in self.special:
                ids, lens[i] = np.insert(ids, int(lens[:i].sum()), self.special[p]), 1
        return ids, lens

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[str]:
        """Texts of several id sequences, whose bounds are ``begin``."""
        data, ends = ragged(self.flat, self.starts[ids], self.lens[ids])
        whole, bounds = data.tobytes(), np.concatenate([[0], ends])[begin].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


_OPEN: dict[str, tuple[ByteBPE, Chunks]] = {}


def coder(path: str) -> tuple[ByteBPE, Chunks]:
    """One vocabulary and cache a process."""
    if path not in _OPEN:
        bpe = ByteBPE(path)
        _OPEN[path] = bpe, Chunks(bpe.encode_pieces, byte_level_pieces, "byte_level", sorted(bpe.special, key=len, reverse=True), texts=True)
    return _OPEN[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: token ids of each text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = coder(path)
        for batch in larger(batches, 1):
            ids, begin = chunks.gather(*chunks.texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])
        chunks.clear()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text out of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(path)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            begin = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.decode(lists.values.to_numpy().astype(np.int64), begin.astype(np.int64)), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text), round_trip (whether that is the text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunks = coder(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch in larger(batches, 1):
            slots, bounds = chunks.texts(batch.column(1))
            ids, begin = chunks.gather(slots, bounds)
            decoded = bpe.decode(ids, begin)
            text_of, slots = chunks.decimal.__getitem__, slots.tolist()
            names = [sha(",".join(filter(None, map(text_of, slots[a:b]))).encode()) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            same = [x == (y or "") for x, y in zip(decoded, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(begin)), pa.array(names, pa.string()), pa.array([sha(x.encode()) for x in decoded], pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )
        chunks.clear()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
