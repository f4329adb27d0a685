"""Mapping of positions and variants between reference, transcript and coding coordinates.

A transcript's exons are an array of at most some hundreds; walking it is a fold inside one expression, so mapping a
variant costs one equi join and a projection, whatever the number of transcripts on its chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.functions.coordinates import c_to_n, index_of_transcript, n_to_c, transcript_of_index
from allelic.functions.parse import POSITION, VARIANT, computed_once, own_step
from allelic.functions.sequence import reverse_complement
from allelic.operators.reference import Reference, error, overlapping, with_transcript, with_transcript_where_asked

FAR = 2**31 - 1


def g_to_n(exons: Column, g: Column) -> Column:
    """struct(n, offset) of a reference index: in an exon, else by the nearest exon border (the first in transcript order of equally near ones)."""
    start = F.struct(F.lit(0).alias("ahead"), F.lit(None).cast("int").alias("n"), F.lit(0).alias("near"), F.lit(FAR).alias("off"))

    def step(s: Column, e: Column) -> Column:
        into = F.when(e["strand"] == 1, g - e["start0"]).otherwise(e["end0"] - g)
        inside = (g >= e["start0"]) & (g <= e["end0"])
        nearer = F.least(F.abs(g - e["start0"]), F.abs(g - e["end0"])) < F.abs(s["off"])
        before = g < e["start0"]
        edge = F.when(before, e["start0"]).otherwise(e["end0"])
        return F.struct(
            (s["ahead"] + e["end0"] - e["start0"] + 1).cast("int").alias("ahead"),
            F.coalesce(s["n"], F.when(inside, s["ahead"] + into)).cast("int").alias("n"),
            F.when(nearer, s["ahead"] + F.when(before, 0).otherwise(e["end0"] - e["start0"])).otherwise(s["near"]).cast("int").alias("near"),
            F.when(nearer, F.when(e["strand"] == 1, g - edge).otherwise(edge - g)).otherwise(s["off"]).cast("int").alias("off"),
        )

    return F.aggregate(exons, start, step, lambda s: F.struct(F.coalesce(s["n"], s["near"]).alias("n"), F.when(s["n"].isNotNull(), 0).otherwise(s["off"]).alias("offset")))


def n_to_g(exons: Column, n: Column, offset: Column) -> Column:
    """Reference index of a transcript index and offset; null outside the exons."""
    start = F.struct(F.lit(0).alias("ahead"), F.lit(None).cast("int").alias("g"))

    def step(s: Column, e: Column) -> Column:
        size, into = e["end0"] - e["start0"] + 1, n - s["ahead"]
        here = (into >= 0) & (into < size)
        off = F.coalesce(offset, F.lit(0))
        g = F.when(e["strand"] == 1, e["start0"] + into + off).otherwise(e["end0"] - into - off)
        return F.struct((s["ahead"] + size).cast("int").alias("ahead"), F.coalesce(s["g"], F.when(here, g)).cast("int").alias("g"))

    return F.aggregate(exons, start, step, lambda s: s["g"])


def n_to_g_extended(exons: Column, n: Column, offset: Column) -> Column:
    """The same without bounds: before the first and behind the last exon the count goes on along the strand."""
    first, last = F.get(exons, F.lit(0)), F.get(exons, F.size(exons) - 1)
    total = F.aggregate(exons, F.lit(0), lambda s, e: (s + e["end0"] - e["start0"] + 1).cast("int"))
    off = F.coalesce(offset, F.lit(0))
    over = n - total + 1
    before = F.when(first["strand"] == 1, first["start0"] + n + off).otherwise(first["end0"] - n - off)
    behind = F.when(last["strand"] == 1, last["end0"] + over + off).otherwise(last["start0"] - over - off)
    return F.when(n < 0, before).when(n >= total, behind).otherwise(n_to_g(exons, n, offset)).cast("int")


def exon_offsets(transcripts: DataFrame) -> DataFrame:
    """ac, reference, ord, start0, end0, ahead: exons with the number of transcript bases ahead of each."""
    from pyspark.sql import Window

    rows = transcripts.select("ac", "reference", F.posexplode("exons").alias("ord", "e")).select("ac", "reference", "ord", "e.start0", "e.end0")
    ahead = Window.partitionBy("ac", "reference").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ahead", F.coalesce(F.sum(F.col("end0") - F.col("start0") + 1).over(ahead), F.lit(0)).cast("int"))


def _struct_position(base: Column, offset: Column, anchor: Column) -> Column:
    return F.struct(base.cast("int").alias("base"), offset.cast("int").alias("offset"), anchor.cast("string").alias("anchor"), F.lit(None).cast("string").alias("aa"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("uncertain"))


def _mapped_edit(e: Column, strand: Column) -> Column:
    """On the minus strand, all stated sequences reverse complemented (numbers too are reversed: they are texts here)."""
    turn = lambda x: F.when(strand == -1, reverse_complement(x)).otherwise(x)
    return F.when(strand == -1, e.withField("ref", turn(e["ref"])).withField("alt", turn(e["alt"]))).otherwise(e)


def _moved(v: Column, coord: str, ac: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.struct(
        F.lit(coord).alias("coord"), ac.alias("ac"), v["gene"].alias("gene"), start.cast(POSITION).alias("start"), end.cast(POSITION).alias("end"),
        F.lit(False).alias("uncertain"), v["predicted"].alias("predicted"), _mapped_edit(v["edit"], strand).alias("edit"),
    ).cast(VARIANT)


def _coding_position(exons: Column, pos: Column, cds_start: Column, cds_end: Column) -> Column:
    """Position on the coding sequence of a position on the reference."""

    def of_n(x: Column) -> Column:
        return computed_once(n_to_c(x["n"], cds_start, cds_end), lambda c: _struct_position(transcript_of_index(c["base0"]), F.when(x["offset"] != 0, x["offset"]), c["anchor"]))

    return F.when(pos.isNotNull(), computed_once(g_to_n(exons, pos - 1), of_n))


def _asked(v: Column) -> Column:
    """What a coding variant is made of: a third of the variant struct, for the way through a join."""
    genomic = v.isNotNull() & (v["coord"] == "g") & v["start"].isNotNull()
    return F.when(genomic, F.struct(v["start"]["base"].alias("start"), v["end"]["base"].alias("end"), v["gene"].alias("gene"), v["predicted"].alias("predicted"), v["edit"].alias("edit")))


def _coding(df: DataFrame, asked: str, to: str) -> DataFrame:
    v, tx = F.col(asked), F.col("tx")
    place = lambda p: _coding_position(tx["exons"], v[p], tx["cds_start"], tx["cds_end"])
    made = _moved(v, "c", tx["ac"], place("start"), place("end"), tx["strand"])
    return df.withColumn(to, F.when(v.isNotNull() & tx.isNotNull(), made))


def g_to_c(df: DataFrame, reference: Reference, transcript: Column, variant: str = "variant", to: str = "coding") -> DataFrame:
    """Adds the variant on a transcript's coding sequence. On a minus strand start and end keep their order, so start is the larger."""
    v = F.col(variant)
    rows = with_transcript(df.withColumn("_asked", _asked(v)), reference, transcript, v["ac"])
    out = _coding(rows, "_asked", to)
    why = F.when(F.col("tx").isNull(), error("DataProviderError", "Data provider error: no such transcript")).when(F.col(f"{variant}.start").isNull(), error("ValidationError", "Validation error: Missing genomic position"))
    return out.withColumn(f"{to}_error", F.when(F.col(to).isNull(), why)).drop("tx", "_asked")


def g_to_c_all(df: DataFrame, reference: Reference, variant: str = "variant", to: str = "coding") -> DataFrame:
    """A row for each transcript that the variant's interval meets, with the variant on it; those that fail are left out.

    The interval is half open from 0, the transcripts' bounds are closed from 1; both are compared as they are.
    """
    v = F.col(variant)
    rows = df.withColumn("_asked", _asked(v)).withColumn("_chrom", v["ac"]).where("_asked is not null")
    rows = rows.withColumn("_start", F.col("_asked.start") - 1).withColumn("_end", F.coalesce("_asked.end", "_asked.start"))
    return _coding(overlapping(rows, reference.transcripts, "_chrom", "_start", "_end"), "_asked", to).drop("tx", "_asked", "_chrom", "_start", "_end")


def _asked_of_transcript(v: Column, *coords: str) -> Column:
    """What a genomic variant is made of: a part of the variant struct, for the way through a join."""
    place = lambda p: F.when(v[p].isNotNull(), F.struct(*[v[p][x].alias(x) for x in ("base", "offset", "anchor")])).alias(p)
    return F.when(v.isNotNull() & v["coord"].isin(*coords), F.struct(place("start"), place("end"), v["gene"].alias("gene"), v["predicted"].alias("predicted"), v["edit"].alias("edit")))


def _genomic(df: DataFrame, asked: str, to: str) -> DataFrame:
    v, tx = F.col(asked), F.col("tx")
    n = lambda p: c_to_n(index_of_transcript(v[p]["base"]), v[p]["anchor"], tx["cds_start"], tx["cds_end"])
    place = lambda p, i: F.when(v[p].isNotNull(), n_to_g(tx["exons"], F.col(i), v[p]["offset"]))
    # columns of their own: within the walk over the exons they would be computed for each
    df = df.withColumn("_n", n("start")).withColumn("_m", n("end")).withColumn("_a", place("start", "_n")).withColumn("_b", place("end", "_m"))
    a, b = F.col("_a"), F.col("_b")
    position = lambda g: _struct_position(g + 1, F.lit(None), F.lit(None))
    made = _moved(v, "g", tx["reference"], position(F.when(b.isNotNull(), F.least(a, b)).otherwise(a)), F.when(b.isNotNull(), position(F.greatest(a, b))), tx["strand"])
    ok = v.isNotNull() & a.isNotNull() & (v["end"].isNull() | b.isNotNull())
    return df.withColumn(to, F.when(own_step(ok), made)).drop("_a", "_b", "_n", "_m")


def _with_reason(df: DataFrame, variant: str, to: str) -> DataFrame:
    v, tx = F.col(variant), F.col("tx")
    why = (
        F.when(tx.isNull(), error("DataProviderError", "Data provider error: no such transcript"))
        .when((v["start"]["anchor"] == "CdsStart") & tx["cds_start"].isNull(), error("ValidationError", "Validation error: Missing CDS start"))
        .when((v["start"]["anchor"] == "CdsEnd") & tx["cds_end"].isNull(), error("ValidationError", "Validation error: Missing CDS end"))
        .otherwise(error("ValidationError", "Validation error: Transcript position out of exon bounds"))
    )
    return df.withColumn(f"{to}_error", F.when(v.isNotNull() & F.col(to).isNull(), why)).drop("tx")


def _to_genome(df: DataFrame, reference: Reference, on: Column | None, variant: str, to: str, coord: str) -> DataFrame:
    v = F.col(variant)
    rows = with_transcript(df.withColumn("_asked", _asked_of_transcript(v, coord)), reference, v["ac"], on)
    return _with_reason(_genomic(rows, "_asked", to).drop("_asked"), variant, to)


def c_to_g(df: DataFrame, reference: Reference, on: Column | None = None, variant: str = "variant", to: str = "genomic") -> DataFrame:
    """Adds the variant on the reference sequence; start and end ascend."""
    return _to_genome(df, reference, on, variant, to, "c")


def n_to_g_variant(df: DataFrame, reference: Reference, on: Column | None = None, variant: str = "variant", to: str = "genomic") -> DataFrame:
    """The same for variants on a transcript's own numbering."""
    return _to_genome(df, reference, on, variant, to, "n")


def on_genome(df: DataFrame, reference: Reference, variant: str, to: str, errors: bool = False) -> DataFrame:
    """Adds the variant on the reference sequence: genomic ones as they are, coding and transcript ones mapped, in one lookup; with ``errors`` also ``<to>_error``."""
    v = F.col(variant)
    out = with_transcript_where_asked(df, reference, F.when(v["coord"].isin("c", "n"), v["ac"])).withColumn("_cn", F.when(v["coord"].isin("c", "n"), v))
    out = _with_reason(_genomic(out.withColumn("_asked", _asked_of_transcript(v, "c", "n")), "_asked", "_gcn").drop("_asked"), "_cn", "_gcn")
    out = out.withColumn(to, F.coalesce(F.when(v["coord"] == "g", v), F.col("_gcn"))).withColumnRenamed("_gcn_error", f"{to}_error").drop("_cn", "_gcn")
    return out if errors else out.drop(f"{to}_error")
