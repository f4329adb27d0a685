"""Coordinates: conversions between numberings, interval lengths, and alignments in CIGAR form.

Columns that end in 0 count from 0; texts count genomic and protein positions from 1, and transcript positions without
a zero (-1 is followed by 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of_genomic(pos: Column) -> Column:
    return pos - 1


def genomic_of_index(i: Column) -> Column:
    return i + 1


def index_of_transcript(pos: Column) -> Column:
    return F.when(pos > 0, pos - 1).otherwise(pos)


def transcript_of_index(i: Column) -> Column:
    return F.when(i >= 0, i + 1).otherwise(i)


def n_to_c(n: Column, cds_start: Column, cds_end: Column) -> Column:
    """struct(base0, anchor) of a transcript index; cds_end is that of the last coding base."""
    coding = cds_start.isNotNull() & cds_end.isNotNull()
    return F.struct(
        F.when(coding & (n > cds_end), n - cds_end - 1).when(coding, n - cds_start).otherwise(n).cast("int").alias("base0"),
        F.when(coding & (n > cds_end), "CdsEnd").when(coding, "CdsStart").otherwise("TranscriptStart").alias("anchor"),
    )


def c_to_n(base0: Column, anchor: Column, cds_start: Column, cds_end: Column) -> Column:
    """Transcript index; null where the coding region isn't known."""
    return F.when(anchor == "CdsStart", cds_start + base0).when(anchor == "CdsEnd", cds_end + 1 + base0).otherwise(base0)


def interval_length(start: Column, end: Column) -> Column:
    """Bases from start to end, both included; one without end."""
    return F.coalesce(end, start) - start + 1


def cigar(text: Column) -> Column:
    """array(struct(len, op)); a missing count is 1."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]*[=MXIDN])"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(F.length(p) == 1, F.lit(1)).otherwise(p.substr(F.lit(1), F.length(p) - 1).cast("int")).alias("len"), F.right(p, F.lit(1)).alias("op")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(F.when(o["len"] == 1, "").otherwise(o["len"].cast("string")), o["op"])), "")


def cigar_length(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of operations of those kinds: =MXDN for the reference of an alignment, =MXI for its target."""
    return F.aggregate(F.filter(ops, lambda o: F.contains(F.lit(kinds), o["op"])), F.lit(0), lambda a, o: a + o["len"])


#: Operations that advance each side when positions are mapped.
MAP_REF, MAP_TARGET = "=MXIN", "=MXD"


def cigar_map(ops: Column, pos: Column, at_end: bool = False, backwards: bool = False, strict: bool = True) -> Column:
    """struct(pos, offset, op) of a position on the other side; null beyond the alignment, or without ``strict`` by its first or last operation.

    An intron (N) is split between its neighbours, by the nearer; in an operation that only one side has, the mapped
    position is the last before it, or with ``at_end`` the first behind it.
    """
    own, other = (MAP_TARGET, MAP_REF) if backwards else (MAP_REF, MAP_TARGET)
    step = lambda o, kinds: F.when(F.contains(F.lit(kinds), o["op"]), o["len"]).otherwise(0)
    empty = F.array().cast("array<struct<a:int,b:int,x:int,op:string,len:int>>")
    marks = F.aggregate(
        ops, F.struct(F.lit(0).alias("a"), F.lit(0).alias("x"), empty.alias("all")),
        lambda s, o: F.struct(
            (s["a"] + step(o, own)).alias("a"), (s["x"] + step(o, other)).alias("x"),
            F.concat(s["all"], F.array(F.struct(s["a"].alias("a"), (s["a"] + step(o, own)).alias("b"), s["x"].alias("x"), o["op"].alias("op"), o["len"].alias("len")))).alias("all"),
        ),
    )

    def found(m: Column) -> Column:
        # the operation that the position is in; its last one from the end on
        hit = F.coalesce(F.get(F.filter(m["all"], lambda x: pos < x["b"]), F.lit(0)), F.get(m["all"], F.size(m["all"]) - 1))
        return F.when((pos >= 0) & (pos <= m["a"]), hit) if strict else hit

    hit = F.transform(F.array(marks), found)
    return F.transform(hit, lambda m: F.when(m.isNotNull(), _mapped(m, pos, at_end)))[0]


def _mapped(m: Column, pos: Column, at_end: bool) -> Column:
    into = pos - m["a"]
    one_sided = m["op"].isin("D", "I")
    near = into < m["len"] - into
    place = (
        F.when(m["op"].isin("=", "M", "X"), m["x"] + into)
        .when(m["op"] == "N", F.when(near, m["x"] - 1).otherwise(m["x"]))
        .when(one_sided, m["x"] if at_end else m["x"] - 1)
    )
    offset = F.when((m["op"] == "N") & near, into + 1).when(m["op"] == "N", into - m["len"]).otherwise(0)
    return F.struct(place.cast("int").alias("pos"), offset.cast("int").alias("offset"), m["op"].alias("op"))
