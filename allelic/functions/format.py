"""Variant structs to texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelic.functions.parse import computed_once, own_step
from allelic.functions.sequence import named


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _name_of_code(c: Column) -> Column:
    """One-letter codes are named, all else stays."""
    return F.when(F.length(c) == 1, named(c)).otherwise(c)


def _in_parens(test: Column, text: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def format_position(p: Column, coord: Column) -> Column:
    base = p["base"].cast("string")
    simple = F.concat(base, _or_empty(F.concat(F.lit("_"), p["end"].cast("string"))))
    offset = F.concat(F.when(p["anchor"] == "CdsEnd", "*").otherwise(""), base, _or_empty(F.concat(F.when(p["offset"] >= 0, "+").otherwise(""), p["offset"].cast("string"))))
    residue = F.concat(_or_empty(_name_of_code(p["aa"])), base)
    return _in_parens(p["uncertain"], F.when(coord.isin("g", "m"), simple).when(coord == "p", residue).otherwise(offset))


def format_interval(v: Column) -> Column:
    """Empty where the variant has no position."""
    start, end = format_position(v["start"], v["coord"]), format_position(v["end"], v["coord"])
    return F.when(v["start"].isNull(), "").otherwise(_in_parens(v["uncertain"], F.concat(start, _or_empty(F.concat(F.lit("_"), end)))))


def _repeat(e: Column) -> Column:
    return F.concat(_or_empty(e["ref"]), F.lit("["), e["min"].cast("string"), F.when(e["min"] == e["max"], "").otherwise(F.concat(F.lit("_"), e["max"].cast("string"))), F.lit("]"))


def format_na_edit(e: Column) -> Column:
    """Text of a nucleotide edit; null for null."""
    ref, alt = e["ref"], e["alt"]
    both = (
        F.when(ref.isNull() & alt.isNull(), "=").when(ref.isNull(), F.concat(F.lit("ins"), alt)).when(alt.isNull(), F.concat(F.lit("del"), ref))
        .when(ref == alt, "=").when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(ref, F.lit(">"), alt)).otherwise(F.concat(F.lit("del"), ref, F.lit("ins"), alt))
    )
    kind = e["type"]
    return (
        F.when(kind == "RefAlt", both).when(kind.isin("Del", "Dup", "Inv"), F.concat(F.lower(kind), _or_empty(ref))).when(kind == "Ins", F.concat(F.lit("ins"), _or_empty(alt)))
        .when(kind == "Repeat", _repeat(e)).when(kind == "None", "=").when(kind.isNotNull(), "unknown_na_edit")
    )


def format_aa_edit(e: Column, full: bool = False) -> Column:
    """Of protein variants: deletions and their kind don't tell the residues that they replace, but with ``full``."""
    kind, alt, term = e["type"], _name_of_code(e["alt"]), _name_of_code(e["term"])
    length = _or_empty(e["length"])
    ref, raw = e["ref"], e["alt"]
    both = (
        F.when(raw.isNull(), F.lit("del")).when(ref.isNull(), F.concat(F.lit("delins"), F.when(raw == "*", "Ter").otherwise(raw))).when(ref == raw, "=")
        .when(ref == "", F.concat(F.lit("ins"), raw)).when(raw == "", F.concat(F.lit("del"), ref)).otherwise(F.concat(F.lit("del"), ref, F.lit("ins"), raw))
    )
    gone = F.concat(F.lit("del"), _or_empty(ref) if full else F.lit(""))
    return (
        F.when(kind == "Subst", alt).when(kind == "Del", gone).when(kind == "Ins", F.concat(F.lit("ins"), raw)).when(kind == "DelIns", F.concat(gone, F.lit("ins"), raw)).when(kind == "Dup", "dup")
        .when(kind == "Identity", "=").when(kind == "RefAlt", both)
        .when(kind == "Fs", F.concat(F.when(raw == "", "fs").otherwise(F.concat(alt, F.lit("fs"), _or_empty(term))), length))
        .when(kind == "Ext", F.concat(_or_empty(alt), F.lit("ext"), _or_empty(term), length))
        .when(kind == "Repeat", _repeat(e)).when(kind == "Special", e["value"]).otherwise("unknown_aa_edit")
    )


def format_variant(v: Column) -> Column:
    """Text of a variant struct; null for null."""
    return computed_once(v, _text)


def format_column(name: str) -> Column:
    """The same of a column, which nothing has to compute once: compiled code."""
    return F.when(own_step(F.col(name).isNotNull()), _text(F.col(name)))


def _text(v: Column) -> Column:
    edit = F.when(v["coord"] == "p", format_aa_edit(v["edit"])).otherwise(format_na_edit(v["edit"]))
    body = _in_parens(v["predicted"], F.concat(format_interval(v), edit))
    return F.concat(v["ac"], _or_empty(F.concat(F.lit("("), v["gene"], F.lit(")"))), F.lit(":"), v["coord"], F.lit("."), body)
