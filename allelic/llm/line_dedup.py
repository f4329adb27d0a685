"""Line dedup: overlapping windows of three lines, found again anywhere in the corpus; DataFrame functions only.

Every three consecutive lines of a document are a window. The first occurrence of a window (smallest document id, then
first line) stays; every later one covers its three lines, covered lines merge where windows overlap, and covered lines
are removed. The other lines keep their order and their line breaks.

Defined results: a null text counts as empty and stays null where rows are returned; documents of under three lines have
no window and stay as they are; windows of blank lines only are not looked at; windows are compared exactly (two 64-bit
hashes), without normalising; a null id sorts first; rows equal in id and text are one document, rows of one id with
different texts are ordered by a hash of the text; an empty table gives an empty result.

At scale: windows are counted with a partial aggregation per task, so a window that a third of all documents share
arrives as one row a task; the join that finds later occurrences is a sort-merge join, whose hot keys Spark splits;
the text itself is moved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import id_back, keyed, row_with

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """_id, _th and ``_starts``: first lines (from 0) of the document's windows that occurred earlier."""
    lines = F.col("_lines")
    keys = F.transform(
        F.sequence(F.lit(0), F.size(lines) - window),
        lambda i: _key([F.element_at(lines, (i + k + 1).cast("int")) for k in range(window)]),
    )
    windows = (
        keyed(docs, id_col, text_col)
        .select("_id", "_th", _lines(F.col("_text")).alias("_lines"))
        .where(F.size("_lines") >= window)
        .select("_id", "_th", F.posexplode(keys).alias("_at", "_key"))
        .where(F.col("_key").isNotNull())
        .select("_id", "_th", "_at", F.col("_key.a").alias("_ka"), F.col("_key.b").alias("_kb"))
    )
    first = (
        windows.groupBy("_ka", "_kb")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_th", "_at")).alias("_first"))
        .where("_n > 1")
        .select("_ka", "_kb", "_first")
    )
    later = windows.join(first.hint("merge"), ["_ka", "_kb"]).where(F.struct("_id", "_th", "_at") > F.col("_first"))
    return later.groupBy("_id", "_th").agg(F.collect_set("_at").alias("_starts"))


def _key(lines: list[Column]) -> Column:
    text = F.concat_ws("\n", *lines)
    return F.when(F.length(F.trim(F.regexp_replace(text, r"\s+", ""))) > 0, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("w"), text).alias("b")))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """_id, _row, ``_kept`` (the remaining text), ``_n_lines``, ``_removed`` (numbers of removed lines, ascending)."""
    marked = keyed(docs, id_col, text_col, carry=True).join(covered_lines(docs, id_col, text_col, window).hint("merge"), ["_id", "_th"], "left")
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: s + k)))))
    return marked.select(
        "_id", "_row", "_text",
        F.coalesce(removed, F.array().cast("array<int>")).alias("_removed"),
    ).select(
        "_id", "_row", "_removed",
        F.size(_lines(F.col("_text"))).alias("_n_lines"),
        F.when(F.size("_removed") == 0, F.col("_text")).otherwise(_without(F.col("_text"), F.col("_removed"))).alias("_kept"),
    )


def _without(text: Column, removed: Column) -> Column:
    """The lines of other numbers; the numbers are parted by a hash set and each line is taken by its place, so a text's lines are gone through once."""

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    # bound to a name: the text is split once, not for each line
    return F.transform(F.array(_lines(text)), kept)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed_lines (comma-separated line numbers from 0), text."""
    return dedup_rows(docs, id_col, text_col, window).select(
        id_back().alias("doc_id"),
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.size("_removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.col("_removed").cast("array<string>")).alias("removed_lines"),
        F.col("_kept").alias("text"),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated lines gone from the text; all rows and columns stay."""
    changed = {text_col: F.when(F.size("_removed") > 0, F.col("_kept")).otherwise(F.col("_row").getField(text_col))}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.size("_removed") > 0, F.length("_kept")).otherwise(F.col("_row").getField(count_col))
    return dedup_rows(docs, id_col, text_col).select(*row_with(docs, changed))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, unnest(range(len(l) - 2)) AS s, l FROM d WHERE len(l) >= 3
), k AS (
  SELECT doc_id, s, l[s + 1] || chr(10) || l[s + 2] || chr(10) || l[s + 3] AS t FROM w
), r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM k WHERE length(regexp_replace(t, '[\\s]', '', 'g')) > 0
), c AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list([s, s + 1, s + 2])))) AS g FROM r WHERE n > 1 GROUP BY doc_id
), j AS (
  SELECT d.doc_id, d.l, coalesce(c.g, []) AS g FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(g) AS BIGINT) AS n_removed,
  array_to_string(g, ',') AS removed_lines,
  coalesce(array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(g, i)), lambda i: l[i + 1]), chr(10)), '') AS text
FROM j
"""
