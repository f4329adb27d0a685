"""Connected components of a graph of documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelic.llm.common import stored

#: A document: id and hash of the text.
NODE = "struct<_id:bigint,_th:bigint>"


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (u, v) but the roots themselves.

    Each round links every node's larger neighbours to its least neighbour, then every node and its smaller neighbours
    to the least of those; a component of n nodes needs about log n rounds. Least neighbours are aggregated in part
    before the shuffle, so a node with very many neighbours arrives as a row a task. Rounds are written to the shared
    folder.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (mark := _mark(now)) != before and mark[0]:
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
