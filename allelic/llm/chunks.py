"""Token ids of whole texts through the distinct chunks that they consist of.

A chunk is a stretch of text at whose ends every tokenization of the vocabulary at hand has a boundary, so its ids do
not depend on its surroundings. Texts are cut into chunks in arrays; each distinct chunk is cut, once, into the pieces
of the vocabulary's pattern (most are one piece), which the encoder given encodes, and the ids of a text are gathered
from its chunks'. The cache of a worker process is of bounded size in entries and in bytes, and is emptied at a task's end.

* ``byte_level``: a chunk starts at a space that a non-space character follows, at a line break, and at and behind a run
  of signs; the pattern of byte-level vocabularies ends a piece at each of these, whatever stands left of it.
* ``words``: white space is dropped by the vocabulary; a chunk lies between two spaces or runs of signs.

Special tokens are chunks of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks that a worker process remembers, and their ids and letters together.
CACHE, CACHE_BYTES = 500_000, 1 << 26
#: Bytes of texts that are looked up at once.
TOGETHER_BYTES = 1 << 23
#: Words encoded in one text.
TOGETHER = 1000
#: Unicode's White_Space, as the vocabulary's pattern has it.
WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
#: Parts chunks while a text is cut in arrays.
MARK = "\x01"
#: Texts in which white space meets white space (but for two line breaks, or one and a space), ends the text, or is another than space and line break, and texts with the mark: they are cut one by one.
ODD = r"[\x01\t\r\x{0b}\x{0c}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| (?:[ \n]|$)|\n\n[ \n]|\n$"

#: Texts with such characters keep signs and letters together; runs of signs.
QUOTE, INTRICATE, SIGNS = "'", r"['\x{130}\x{17f}\x{250}-\x{10ffff}]", r"([^\s\x{0b}\x{85}\p{Z}\p{L}\p{N}]+)"

#: Encodes distinct pieces: all their ids in one array, and how many each has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Store:
    """Id sequences by string, in two flat arrays."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.ids, self.used, self.letters = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.lens, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, new: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(new) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.ids[self.used : self.used + total] = ids
        self.starts[self.n : self.n + len(new)] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(new)] = lens
        self.slot.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.used, self.n, self.letters = self.used + total, self.n + len(new), self.letters + sum(map(len, new))

    def full(self) -> bool:
        return self.n > CACHE or 4 * self.used + self.letters > CACHE_BYTES


class Chunks:
    """split: the pieces of a chunk that the vocabulary encodes each on its own; encode: ids of distinct pieces."""

    def __init__(self, encode: Encoder, split: Callable[[str], list[str]], kind: str, specials: list[str], texts: bool = False):
        self.encode, self.split, self.kind, self.keep_text = encode, split, kind, texts
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.special_re2 = "|".join("".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s) for s in specials)
        self.specials = set(specials)
        self.clear()

    def clear(self) -> None:
        self.store = Store()
        self.decimal: list[str] = []

    def _add(self, new: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        if self.keep_text:
            numbers, ends = list(map(str, ids.tolist())), np.cumsum(lens).tolist()
            self.decimal.extend([",".join(numbers[a:b]) for a, b in zip([0, *ends], ends, strict=False)])
        self.store.add(new, ids, lens)

    def slots(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks; those that are new are encoded, of several pieces through their pieces."""
        get = self.store.slot.get
        out = np.fromiter([get(c, -1) for c in chunks], np.int64, len(chunks))
        if (missing := np.flatnonzero(out < 0)).size:
            whole, parted, cut = [], [], []
            for c in dict.fromkeys([chunks[i] for i in missing]):
                parts = (c,) if c in self.specials else self.split(c)
                if len(parts) == 1 and parts[0] == c:
                    whole.append(c)
                else:
                    parted.append(c)
                    cut.append(parts)
            slot = self.store.slot
            whole += [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in slot]
            whole = list(dict.fromkeys(whole))
            if whole:
                self._add(whole, *self.encode(whole))
            if parted:
                own = np.fromiter([slot[p] for p in chain.from_iterable(cut)], np.int64)
                ids, ends = ragged(self.store.ids, self.store.starts[own], self.store.lens[own])
                ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, cut)])]
                self._add(parted, ids, np.diff(ends))
            out[missing] = [slot[chunks[i]] for i in missing]
        return out

    def _cut(self, text: str) -> list[str]:
        if self.special is None:
            parts = [text]
        else:
            parts, at = [], 0
            for m in self.special.finditer(text):
                parts += [text[at : m.start()], m[0]]
                at = m.end()
            parts.append(text[at:])
        out: list[str] = []
        for k, part in enumerate(parts):
            out += [part] if k % 2 else CHUNK.findall(part) if self.kind == "byte_level" else part.split(" ")
        return out or [""]

    def _marked(self, texts: pa.Array) -> pa.Array:
        """Texts with marks between their chunks; empty chunks may arise, which have no ids."""
        intricate = pc.match_substring(texts, QUOTE) if self.kind == "byte_level" else pc.match_substring_regex(texts, INTRICATE)
        if self.kind == "words":
            # fewer distinct chunks: lower case, and runs of signs apart, where no contraction or composition can be
            apart = pc.replace_substring_regex(pc.utf8_lower(texts), SIGNS, r" \1 ")
            return pc.replace_substring(pc.if_else(intricate, texts, apart), " ", MARK)
        apart = pc.replace_substring_regex(texts, SIGNS, MARK + r"\1" + MARK)
        out = pc.replace_substring(pc.if_else(intricate, texts, apart), "\n", MARK + "\n" + MARK)
        return pc.replace_substring(pc.replace_substring(out, " ", MARK + " "), MARK + " " + MARK, MARK + " ")

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, and where each text's begin (one more than texts)."""
        if self.store.full():
            self.clear()
        texts = texts.fill_null("").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD if self.kind == "byte_level" else MARK).to_numpy(zero_copy_only=False)
        if self.special_re2:
            odd |= pc.match_substring_regex(texts, self.special_re2).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(self._marked(texts.filter(pa.array(~odd))), MARK)
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        coded = lists.flatten().dictionary_encode()
        flat = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        if not odd.any():
            return flat, begin
        parts: list = [None] * len(texts)
        for k, row in enumerate(np.flatnonzero(~odd)):
            parts[row] = flat[begin[k] : begin[k + 1]]
        for row in np.flatnonzero(odd):
            parts[row] = self.slots(self._cut(texts[int(row)].as_py()))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def gather(self, slots: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        ids, ends = ragged(self.store.ids, self.store.starts[slots], self.store.lens[slots])
        return ids, np.concatenate([[0], ends])[begin]


def larger(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about TOGETHER_BYTES of column ``text``: chunks are looked up once for each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
            at = upto
            if size >= TOGETHER_BYTES or at < len(batch):
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: The split patterns of the two kinds of vocabulary.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORDS = regex.compile(r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_level_pieces(chunk: str) -> list[str]:
    return [chunk] if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha() else BYTE_LEVEL.findall(chunk)


def word_pieces(chunk: str) -> list[str]:
    """The vocabulary normalises to lower case before it splits; below U+0250 (but for two letters) that changes no split."""
    if chunk and (max(chunk) >= "\u0250" or "\u0130" in chunk or "\u017f" in chunk):
        return [chunk]
    chunk = chunk.lower()
    return [chunk] if chunk.isalpha() else WORDS.findall(chunk)


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after the other, and where each ends."""
    ends = np.cumsum(lens, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(total)], ends


_OPEN: dict[tuple, Chunks] = {}


def library_chunks(path: str, kind: str) -> Chunks:
    """Chunks encoded by the tokenizers library with the vocabulary file at ``path``; one cache a process."""
    if (path, kind) not in _OPEN:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        specials = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        batch = getattr(tok, "encode_batch_fast", tok.encode_batch)

        vocabulary = tok.get_vocab()
        edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids at which a word starts (byte level) or ends (words)
        edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if kind == "byte_level" else t.endswith("</w>"))]] = True
        between = "" if kind == "byte_level" else " "

        def alone(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in batch(pieces, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

        def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Words of letters in one text, which costs less than a text each; cut where a word starts or ends."""
            ids = np.array(batch([between.join(words)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(edge[ids])
            if len(at) != len(words):
                return alone(words)
            return ids, np.diff(at, append=len(ids)) if kind == "byte_level" else np.diff(at, prepend=-1)

        def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            word = np.fromiter((c[:1] == " " and c[1:].isalpha() if kind == "byte_level" else c.isalpha() and max(c) < "\u0250" for c in new), bool, len(new))
            order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
            words, n = [new[k] for k in order.tolist()], int(word.sum())
            parts = [together(words[at : min(n, at + TOGETHER)]) for at in range(0, n, TOGETHER)] + [alone(words[n:])]
            ids, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
            back = np.argsort(order)
            return ragged(ids, (np.cumsum(lens) - lens)[back], lens[back])[0], lens[back]

        _OPEN[path, kind] = Chunks(encode, byte_level_pieces if kind == "byte_level" else word_pieces, kind, specials)
    return _OPEN[path, kind]
