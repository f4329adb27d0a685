"""Substring dedup by hashing lines, the sentences of lines, or paragraphs.

A text is cut into units; each reaches to the start of the next one, so its line break or space belongs to it. A unit is
normalised (lower case, white space runs to one space, ends trimmed) and hashed to 128 bits; digests of all units that
aren't blank are grouped over the whole corpus. The earliest ranked occurrence (smallest document id, then first in its
text) of a unit stays. Of the others, those go that form a passage: a run of units one after the other, each of which
occurred earlier, of at least ``min_words`` words together. Removed stretches are reported as offsets into the original
text.

Units are lines cut at the ends of sentences (``sentence``), whole lines (``line``) or paragraphs parted by blank lines.
Passages that stand inside a line are found by its sentences only. Words are parted by white space, but a unit counts at
least one word for each eight characters, so text without spaces is measured too. Units of under SHORT words may lie in a
passage but don't add to it. ``min_words=1`` is the exact way for every repeated unit: short lines (licenses, names,
greetings) recur by chance or by right, and with a larger bound they stay; ``n_left`` counts those.

Defined results: a null text counts as empty; blank units are never removed on their own; a null id sorts first; rows
equal in id and text are one document, rows of one id with different texts are ordered by a hash of the text; an empty
table gives an empty result.

At scale: a text is cut once. Of equal units of a task the earliest is sent, the others are repeated for sure and travel
under keys of their own, so a line that a third of all documents hold reaches a task as one row for each task before it.
The text itself is moved once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelic.llm.common import bounded_batches, id_back, keyed, trimmed

#: Words a run of repeated units needs to be a passage; words below which a unit adds nothing to a run; characters that count as a word.
MIN_WORDS, SHORT, CHARS = 20, 3, 8
#: Where a unit ends.
ENDS = {"sentence": re.compile("[.!?][ \t\n]|\n|[。！？]"), "line": re.compile("\n"), "paragraph": re.compile("\n[ \t]*\n")}
#: Distinct units that a task holds before it sends them; rows of a batch.
HELD, ROWS = 200_000, 16_384
UNIT = "_digest binary, _sure boolean, _id long, _th long, _at int, _from int, _to int, _words int"


def units_of(text: str, ends: re.Pattern) -> list[tuple[int, int, str]]:
    """First character, end (the start of the next) and normalised form of the units that aren't blank."""
    bounds = [0, *(m.end() for m in ends.finditer(text)), len(text)]
    found = [(a, form) for a, b in zip(bounds, bounds[1:], strict=False) if (form := " ".join(text[a:b].lower().split()))]
    return [(a, b, form) for (a, form), b in zip(found, [*(a for a, _ in found[1:]), len(text)], strict=False)]


def words_of(form: str) -> int:
    return max(form.count(" ") + 1, -(-len(form) // CHARS))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence") -> DataFrame:
    """_id, _th, _at (number of the unit), _from, _to, _words of the units that occurred earlier."""
    bounded_batches(docs.sparkSession)
    ends = ENDS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        sure: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(d, False, *own) for d, own in first.items()] + [(b"%d:%d" % own[1:3], True, *own) for own in sure]
            first.clear()
            sure.clear()
            for at in range(0, len(rows), ROWS):
                cols = list(zip(*rows[at : at + ROWS], strict=True))
                kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_digest", "_sure", "_id", "_th", "_at", "_from", "_to", "_words"])

        for batch in batches:
            for i, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, (a, b, form) in enumerate(units_of(text, ends)):
                    digest, own = xxhash.xxh3_128_digest(form.encode()), (i, t, at, a, b, words_of(form))
                    had = first.setdefault(digest, own)
                    if had is not own and had != own:
                        if own < had:
                            first[digest], own = own, had
                        sure.append(own)
                if len(first) + len(sure) > HELD:
                    yield from flush()
        yield from flush()

    rows = keyed(docs, id_col, text_col).mapInArrow(trimmed(run), UNIT)
    # equal rows of a repeated document are of one rank
    ranked = rows.withColumn("_rank", F.rank().over(Window.partitionBy("_digest").orderBy("_id", "_th", "_at")))
    return ranked.where(F.col("_sure") | (F.col("_rank") > 1)).select("_id", "_th", "_at", "_from", "_to", "_words")


def passages(units: list[tuple[int, int, int, int]], min_words: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of the runs of at least ``min_words`` words among repeated units (number, from, to, words), and the units in them."""
    spans: list[tuple[int, int]] = []
    count, run = 0, []
    short = min(SHORT, min_words)
    for u in [*sorted(set(units)), None]:
        if run and (u is None or u[0] != run[-1][0] + 1):
            if sum(w for *_, w in run if w >= short) >= min_words:
                spans.append((run[0][1], run[-1][2]))
                count += len(run)
            run = []
        run.append(u)
    return spans, count


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_units, n_removed (units), n_left (units that occurred earlier but are in no passage), removed_chars, removed_spans ("from-to" of each passage in the original text, to exclusive), text."""
    ends = ENDS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                units = [(u["_at"], u["_from"], u["_to"], u["_words"]) for u in found or []]
                spans, count = passages(units, min_words)
                bounds = [0, *(p for s in spans for p in s), len(text)]
                kept = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if spans else text
                rows.append((len(units_of(text, ends)), count, len(set(units)) - count, len(text) - len(kept), ",".join(f"{a}-{b}" for a, b in spans), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_units", "n_removed", "n_left", "removed_chars", "removed_spans", "text"])

    found = repeated_units(docs, id_col, text_col, unit).groupBy("_id", "_th").agg(F.collect_list(F.struct("_at", "_from", "_to", "_words")).alias("_list"))
    rows = keyed(docs, id_col, text_col).join(found.hint("merge"), ["_id", "_th"], "left").select(id_back().alias("doc_id"), "_text", "_list")
    return rows.mapInArrow(trimmed(run), "doc_id long, n_units long, n_removed long, n_left long, removed_chars long, removed_spans string, text string")


ORACLE_SQL = f"""
WITH p AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?][ \\t\\n]|\\n|[。！？])', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents
), u AS (
  SELECT doc_id, i, raw, text, CAST(coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS raw FROM p)
), f AS (
  SELECT *, trim(regexp_replace(lower(raw), '[\\s]+', ' ', 'g')) AS t FROM u
), n AS (
  SELECT doc_id, a, t, row_number() OVER o AS nth, coalesce(lead(a) OVER o, length(text)) AS b, greatest(length(t) - length(replace(t, ' ', '')) + 1, (length(t) + {CHARS - 1}) // {CHARS}) AS w
  FROM f WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, nth) AS k FROM n
), g AS (
  SELECT doc_id, min(a) AS a, max(b) AS b, count(*) AS c, sum(CASE WHEN w >= {SHORT} THEN w ELSE 0 END) >= {MIN_WORDS} AS passage
  FROM (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r WHERE k > 1) GROUP BY doc_id, run
), s AS (
  SELECT doc_id, CAST(coalesce(sum(c) FILTER (passage), 0) AS BIGINT) AS n_removed, CAST(coalesce(sum(c) FILTER (NOT passage), 0) AS BIGINT) AS n_left, CAST(coalesce(sum(b - a) FILTER (passage), 0) AS BIGINT) AS removed_chars,
    coalesce(string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) FILTER (passage), '') AS removed_spans
  FROM g GROUP BY doc_id
), x AS (
  SELECT u.doc_id, string_agg(u.raw, '' ORDER BY u.i) FILTER (g.a IS NULL) AS text FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.passage AND u.a >= g.a AND u.a < g.b GROUP BY u.doc_id
), c AS (SELECT doc_id, count(*) AS n_units FROM n GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_left, 0) AS n_left, coalesce(removed_chars, 0) AS removed_chars, coalesce(removed_spans, '') AS removed_spans, coalesce(x.text, '') AS text
FROM p LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN x USING (doc_id)
"""
