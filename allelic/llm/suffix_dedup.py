"""Suffix-array dedup: removes every byte that a string of ``least`` bytes covers which also starts earlier.

Equal strings are brought together, then told apart by a Burrows-Wheeler transform:

1. In every window of ``least`` bytes the k-byte string of the smallest hash is its anchor. Equal windows have equal
   anchors, so only anchors whose hash occurs more than once can lie in repeated windows; the others are dropped early
   (about one anchor for every 35 to 40 bytes is looked at).
2. The bytes around a repeated anchor (all windows that chose it) are its context. Contexts are grouped by anchor.
   Equal contexts of a task are merged before they are sent.
3. A block of contexts is concatenated; its suffixes are sorted and the Burrows-Wheeler transform gives the backward
   extension of any interval of suffixes. Intervals are extended breadth first, all of one length at a time: a round
   finds the borders between neighbours whose common prefix is one longer than in the round before, and only the parts
   of intervals that were just split (but for the largest of each) are extended again. After ``least`` - 1 rounds it
   stops; what no border parts shares ``least`` bytes, and all but the earliest window of such a group are marked.
4. Marked windows merge into spans, which are cut out.

Contexts of anchors with more than HOT occurrences (of a passage that a large share of all documents holds) are cut into
parts of PART windows by their distance from the anchor. The windows of a part share ``least`` - PART + 1 bytes, and parts
are grouped by these instead of the anchor: what surrounds the passage in each document parts the groups, and what is left
of a group differs in so few bytes that merging equal parts in each task bounds it. The transform settles them like the others.

Defined results: a null text counts as empty; windows do not cross documents; texts of fewer than ``least`` bytes stay;
a null id sorts first; rows equal in id and text are one document (neither is earlier); rows of one id with different
texts are ordered by a hash of the text; an empty table gives no rows. ``clean_documents`` keeps whole characters: of a
character cut by a span's end, all bytes stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import bounded_batches, id_back, keyed, row_with, stored, trimmed

LEAST = 100
#: Bytes of an anchor.
ANCHOR = 20
#: Occurrences up to which an anchor's contexts are grouped by the anchor; windows of a part of the contexts of others.
HOT, PART = 2048, 3
#: Windows hashed at once; bytes of a block of contexts; bytes of contexts a task holds before it sends them.
SLICE, BLOCK, HELD = 1 << 22, 1 << 20, 1 << 25
_BYTE = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string: strings of 1, 2, 4, ... bytes by doubling, put together by the bits of k."""
    n = len(data) - k + 1
    have, size, factor = _BYTE[data], 1, int(_A)
    out, done = np.zeros(n, np.uint64), 0
    while True:
        if k & size:
            out = out * np.uint64(factor) + have[done : done + n]
            done += size
        if size * 2 > k:
            break
        have = have[:-size] * np.uint64(factor) + have[size:]
        factor, size = factor * factor % 2**64, size * 2
    out ^= out >> np.uint64(32)
    out *= _M
    out ^= out >> np.uint64(29)
    return out


def anchors(data: np.ndarray, bounds: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """Of concatenated texts: document, hash, place of the anchor, first and last window that chose it (places in their text)."""
    found = []
    for at in range(0, max(0, len(data) - least + 1), SLICE):
        part = data[at : at + SLICE + least - 1]
        n = len(part) - least + 1
        h = gram_hashes(part, k)
        low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width, size = least - k + 1, 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[width - size : width - size + n])
        chosen = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        # windows that cross a border between texts choose none
        for b in bounds[(bounds > at) & (bounds < at + n + least)].tolist():
            chosen[max(0, b - at - least + 1) : max(0, b - at)] = -1
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        first, last = first[chosen[first] >= 0], last[chosen[first] >= 0]
        place = chosen[first]
        doc = np.searchsorted(bounds, first + at, side="right") - 1
        shift = at - bounds[doc]
        found.append((doc, h[place].view(np.int64), place + shift, first + shift, last + shift))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and bounds of stretches of texts of about SLICE bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


class Places:
    """Packs an anchor's place and the windows that chose it into a long, under 16 bits of the text's hash."""

    def __init__(self, least: int):
        if not 1 <= least <= 255:
            raise ValueError("strings of 1 to 255 bytes are looked for")
        self.bits = least.bit_length()
        self.mask, self.top = (1 << self.bits) - 1, 46

    def pack(self, tag: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (tag << self.top) | (place << (2 * self.bits)) | ((place - first) << self.bits) | (last - first)

    def unpack(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the anchor in its context, first and last window."""
        shift = (packed >> self.bits) & self.mask
        first = (packed >> (2 * self.bits)) - shift
        return shift, first, first + (packed & self.mask)


def _tag(th):
    """16 bits of a text's hash, of a column or an array: they part texts of one id well enough for grouping."""
    return F.shiftrightunsigned(th, 48) if not isinstance(th, np.ndarray) else (th.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def _anchor_rows(texts: DataFrame, least: int, k: int) -> DataFrame:
    places = Places(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), _tag(batch.column(1).to_numpy())
            for row, data, bounds in _texts(batch.column(2)):
                doc, h, place, first, last = anchors(data, bounds, least, k)
                doc = doc + row
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[doc]), pa.array(places.pack(tags[doc], place, first, last))], names=["_h", "_id", "_p"])

    return texts.select("_id", "_th", "_text").mapInArrow(trimmed(run), "_h long, _id long, _p long")


CONTEXT = "_id long, _th long, _p long, _wide boolean, _bytes binary"
SPAN = "_id long, _th long, _from long, _to long"


def _contexts(listed: DataFrame, least: int, part: int) -> DataFrame:
    """Contexts of the listed anchors, those of frequent anchors in parts. Of equal ones of a task the earliest is sent; the others are repeated for sure and come without bytes, as stretches of windows."""
    places = Places(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: tuple[dict, dict] = ({}, {})  # by frequency of the anchor: (windows ahead of it, bytes) -> id, hash, first window
        sure: list[tuple] = []  # id, hash, first and last window
        held = 0

        def earliest(first: dict, key: tuple, own: tuple) -> bool:
            """Keeps the earlier of equal contexts; whether the key is new."""
            had = first.setdefault(key, own)
            if had is own:
                return True
            if own != had:
                if own < had:
                    first[key], own = own, had
                i, t, a = own
                z = a + len(key[1]) - least
                if sure and sure[-1][:2] == (i, t) and sure[-1][2] <= a <= sure[-1][3] + 1 and z - sure[-1][2] <= places.mask:
                    sure[-1] = (i, t, sure[-1][2], max(z, sure[-1][3]))
                else:
                    sure.append((i, t, a, z))
            return False

        def parts() -> dict:
            found: dict[tuple, tuple] = {}
            for (shift, data), (i, t, a) in whole[1].items():
                at, n = 0, len(data) - least + 1
                while at < n:
                    upto = min(n, at + (shift - at) % part + 1)  # to the next multiple of ``part`` windows ahead of the anchor
                    earliest(found, (shift - at, data[at : upto - 1 + least]), (i, t, a + at))
                    at = upto
            return found

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for wide, first in ((False, whole[0]), (True, parts())):
                rows += [(i, t, (a + shift) << (2 * places.bits) | shift << places.bits | (len(data) - least), wide, data) for (shift, data), (i, t, a) in first.items()]
            rows += [(i, t, a << (2 * places.bits) | (z - a), False, None) for i, t, a, z in sure]
            for x in (*whole, sure):
                x.clear()
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_id", "_th", "_p", "_wide", "_bytes"])

        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(3), batch.column(4))]
            for row, (i, t, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                data = text.encode()
                for first, (offsets, values) in zip(whole, lists, strict=True):
                    for shift, s, e in zip(*(x.tolist() for x in places.unpack(np.sort(values[offsets[row] : offsets[row + 1]]))), strict=True):
                        own = data[s : e + least]
                        # shorter ones are of another text of this id
                        if len(own) == e + least - s and earliest(first, (shift, own), (i, t, s)):
                            held += len(own) + 200
                        else:
                            held += 20
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    return listed.mapInArrow(trimmed(run), CONTEXT)


def prefix_borders(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes (by their first bytes, more than ``least``) and, for each in that order, whether its common prefix with the one before is under ``least``."""
    n = len(text)
    order = _sorted_suffixes(text, least)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    back = rank[order - 1]  # where the suffix one byte longer stands: the backward extension
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    head = text[order]
    border[1:n] = head[1:] != head[:-1]
    stamp, mark = 0, np.full(n + 2, -1, np.int64)
    old, new = np.array([0, n]), np.flatnonzero(border[:n])[1:]
    for _ in range(least - 1):
        if not len(new):
            break
        at = np.flatnonzero(border)
        # the intervals on both sides of a new border, without the largest part of each interval that was split
        side = np.searchsorted(at, new)
        part = _distinct(np.concatenate([side - 1, side]))
        start, end = at[part], at[part + 1]
        parent = np.searchsorted(old, start, side="right")
        size = end - start
        by = np.lexsort((size, parent))
        largest = np.concatenate([parent[by][1:] != parent[by][:-1], [True]])
        by = by[~largest]
        start, size = start[by], size[by]
        ends = np.cumsum(size)
        own = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        to = back[own]
        mark[to + 1] = np.repeat(stamp + np.arange(len(start)), size)
        stamp += len(start)
        label = mark[to + 1]
        found = np.concatenate([to[mark[to] != label], (to + 1)[mark[to + 2] != label]])
        old = at
        new = _distinct(found[~border[found]])
        border[new] = True
    return order, border[:n]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sorted_suffixes(text: np.ndarray, least: int) -> np.ndarray:
    """Suffixes sorted by at least ``least`` + 1 bytes, by prefix doubling from eight bytes on."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    size = 8
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if size > least or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        key = rank * np.int64(n + 2) + after
        size *= 2


def later_windows(contexts: list[tuple[tuple[int, int, int], bytes]], least: int) -> list[tuple[int, int, int, int]]:
    """(id, th, from, to) of stretches of windows that start earlier in another of the contexts ((id, th, first window), bytes)."""
    lens = np.fromiter((len(c) for _, c in contexts), np.int64, len(contexts))
    starts = np.cumsum(lens + 1) - lens - 1
    text = np.frombuffer(b"\0".join(c for _, c in contexts) + b"\0", np.uint8)
    order, border = prefix_borders(text, least)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(border)
    docs = {d: k for k, d in enumerate(sorted({o[:2] for o, _ in contexts}))}
    counts = lens - least + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = starts[owner] + shift
    first = np.fromiter((o[2] for o, _ in contexts), np.int64, len(contexts))
    rank = np.fromiter((docs[o[:2]] for o, _ in contexts), np.int64, len(contexts))
    key = (rank[owner] << np.int64(40)) | (first[owner] + shift)
    g = group[window]
    earliest = np.full(len(text) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, g, key)
    late = key > earliest[g]
    edge = np.flatnonzero(np.concatenate([[True], (late[1:] != late[:-1]) | (owner[1:] != owner[:-1])])) if len(late) else np.zeros(0, np.int64)
    last = np.concatenate([edge[1:], [len(late)]]) - 1
    return [(*contexts[owner[a]][0][:2], int(first[owner[a]] + shift[a]), int(first[owner[a]] + shift[b] + least)) for a, b in zip(edge.tolist(), last.tolist(), strict=True) if late[a]]


def _spans(contexts: DataFrame, least: int, k: int, part: int) -> DataFrame:
    """Spans of repeated windows, out of contexts grouped by anchor, or by what the windows of a part share."""
    places = Places(least)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["_id", "_th", "_from", "_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block: list[tuple] = []
        group: dict[tuple, tuple] = {}
        size, now = 0, None

        def close() -> int:
            """Ends a group: one of several contexts joins the block."""
            got = 0
            if len(group) > 1:
                block.extend((o, key[1]) for key, o in group.items())
                got = sum(len(key[1]) for key in group)
            group.clear()
            return got

        for batch in batches:
            shifts, firsts, lasts = (x.tolist() for x in places.unpack(batch.column(3).to_numpy()))
            for g, i, t, shift, s, e, data in zip(*(batch.column(c).to_pylist() for c in range(3)), shifts, firsts, lasts, batch.column(4).to_pylist(), strict=True):
                if data is None:
                    out.append((i, t, s, e + least))
                    continue
                if g != now:
                    size += close()
                    now = g
                    if size > BLOCK:
                        out += later_windows(block, least)
                        block.clear()
                        size = 0
                key, own = (shift, data), (i, t, s)
                had = group.get(key)
                if had is None:
                    group[key] = own
                elif own != had:
                    if own < had:
                        group[key], own = own, had
                    out.append((*own, own[2] + len(data)))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        close()
        if block:
            out += later_windows(block, least)
        if out:
            yield batch_of(out)

    shift = F.shiftright("_p", places.bits).bitwiseAND(places.mask)
    shared = F.when(F.col("_wide"), F.col("_bytes").substr((shift % part + 1).cast("int"), F.lit(least - part + 1))).otherwise(F.col("_bytes").substr((shift + 1).cast("int"), F.lit(k)))
    anchor = F.when(F.col("_bytes").isNotNull(), F.xxhash64("_wide", F.floor(shift / part) * F.col("_wide").cast("int"), shared)).otherwise(F.xxhash64("_id", "_p"))
    # the hash is computed on both sides of the exchange, not sent
    grouped = contexts.repartition(anchor).select(anchor.alias("_g"), "_id", "_th", "_p", "_bytes").sortWithinPartitions("_g")
    return grouped.mapInArrow(trimmed(run), SPAN)


def _tagged(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    return keyed(docs, id_col, text_col, carry).withColumn("_t", _tag(F.col("_th")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """_id, _th, _from, _to: stretches of bytes to remove; they may overlap."""
    bounded_batches(docs.sparkSession)
    texts = _tagged(docs, id_col, text_col)
    anchor = min(anchor, least)
    found = _anchor_rows(texts, least, anchor)
    repeated = stored(found.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "anchors")

    # the anchors' places are found once, for frequent and other anchors together
    top = Places(least).top
    own = found.join(repeated.select("_h", (F.col("_n") > hot).alias("_hot")).hint("merge"), "_h")
    own = own.select("_id", F.shiftright("_p", top).alias("_t"), F.col("_p").bitwiseAND((1 << top) - 1).alias("_p"), "_hot")
    own = own.groupBy("_id", "_t").agg(F.collect_list(F.when(~F.col("_hot"), F.col("_p"))).alias("_list"), F.collect_list(F.when(F.col("_hot"), F.col("_p"))).alias("_frequent"))
    listed = texts.join(own.hint("merge"), ["_id", "_t"]).select("_id", "_th", "_text", "_list", "_frequent")
    part = min(PART, least)
    return _spans(_contexts(listed, least, part), least, anchor, part)


def merged_spans(found: list | None, n: int) -> list[tuple[int, int]]:
    """Disjoint spans, ascending; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["_from"], min(x["_to"], n)) for x in found or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    bounds = [0, *(p for s in spans for p in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character loses a part of its bytes."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, id_col: str, text_col: str, least: int, hot: int, carry: bool) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, least, hot=hot).withColumn("_t", _tag(F.col("_th"))).groupBy("_id", "_t").agg(F.collect_list(F.struct("_th", "_from", "_to")).alias("_list"))
    rows = _tagged(docs, id_col, text_col, carry).join(spans.hint("merge"), ["_id", "_t"], "left")
    return rows.withColumn("_list", F.filter("_list", lambda s: s["_th"] == F.col("_th")))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans ("from-to" in bytes, to exclusive, joined by commas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                spans = merged_spans(found, len(data))
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest(), ",".join(f"{a}-{b}" for a, b in spans)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"])

    rows = _with_spans(docs, id_col, text_col, least, hot, False).select(id_back().alias("doc_id"), "_text", "_list")
    return rows.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated bytes gone from the text (whole characters); all rows and columns stay."""

    @F.pandas_udf("string")
    def kept(texts, lists):
        import pandas as pd

        out = []
        for text, found in zip(texts, lists, strict=True):
            if found is None or not len(found):
                out.append(text)
                continue
            data = text.encode()
            out.append(without(data, whole_characters(data, merged_spans(list(found), len(data)))).decode())
        return pd.Series(out, dtype=object)

    rows = _with_spans(docs, id_col, text_col, least, hot, True).select("_row", (F.size("_list") > 0).alias("_hit"), kept("_text", "_list").alias("_kept"))
    changed = {text_col: F.when(F.col("_hit"), F.col("_kept")).otherwise(F.col("_row").getField(text_col))}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.col("_hit"), F.length("_kept")).otherwise(F.col("_row").getField(count_col))
    return rows.select(*row_with(docs, changed))
