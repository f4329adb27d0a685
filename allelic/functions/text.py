"""Texts of variants, as reports compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelic.functions.sequence import NAMES


def normal_text(s: Column) -> Column:
    """Without parentheses and question marks, all residue names replaced by codes wherever they stand."""
    out = F.translate(s, "()?", "")
    for code, name in (NAMES | {"*": "Ter", "B": "Asx", "Z": "Glx", "X": "Xaa"}).items():
        out = F.replace(out, F.lit(name), F.lit(code))
    return out


def clean_protein(s: Column) -> Column:
    """What follows the last colon, without parentheses, Ter as *."""
    return F.replace(F.translate(F.element_at(F.split(s, ":"), -1), "()", ""), F.lit("Ter"), F.lit("*"))


def clean_silent(s: Column) -> Column:
    """The same, any silent change of one residue as p.=."""
    return F.regexp_replace(clean_protein(s), r"^p\.[A-Z][a-z]{2}[0-9]+=$", "p.=")


def exact_match(a: Column, truth: Column) -> Column:
    """Equal once cleaned; null and errors never match."""
    bad = a.isNull() | a.startswith("ERR") | truth.isNull()
    return F.when(bad, F.lit(False)).otherwise(clean_protein(a) == clean_protein(truth))


def fuzzy_match(a: Column, truth: Column) -> Column:
    """Equal, or both with Ter, fs or =; errors and nulls never match."""
    x, y = (F.translate(F.element_at(F.split(c, ":"), -1), "()", "") for c in (a, truth))
    both = lambda t: F.contains(x, F.lit(t)) & F.contains(y, F.lit(t))
    return F.when(a.isNull() | truth.isNull() | a.startswith("ERR:"), F.lit(False)).otherwise((x == y) | both("Ter") | both("fs") | both("="))


def edit_kind(s: Column) -> Column:
    """Kind of a nucleotide edit by the marks in its text; the first that is there counts."""
    out = F.lit("Unknown")
    for mark, kind in ((">", "subst"), ("[", "repeat"), ("ins", "ins"), ("del", "del"), ("delins", "delins"), ("dup", "dup")):
        out = F.when(F.contains(s, F.lit(mark)), kind).otherwise(out)
    return out


def spdi_difference(ours: Column, truth: Column) -> Column:
    """Why a position-deletion-insertion text isn't the true one: its error, or the first part that differs."""
    a, b = F.split(ours, ":"), F.split(truth, ":")
    out = F.lit("Other")
    for i, name in reversed(list(enumerate(("Accession Mismatch", "Position Mismatch", "Reference Seq Mismatch", "Alternate Seq Mismatch")))):
        out = F.when(F.get(a, F.lit(i)) != F.get(b, F.lit(i)), name).otherwise(out)
    return F.when(ours.startswith("ERR:"), F.concat(F.lit("Error: "), F.get(a, F.lit(1)))).when(ours == "PANIC", "Panic").when((F.size(a) != 4) | (F.size(b) != 4), "Malformed SPDI").otherwise(out)


def identifier_type(s: Column) -> Column:
    """What an identifier names, by its prefix; without colon and known prefix it is a gene."""
    return (
        F.when(F.substring(s, 1, 3).isin("NC_", "NW_", "NT_"), "genomic_accession")
        .when(F.substring(s, 1, 3).isin("NM_", "NR_", "XM_", "XR_"), "transcript_accession")
        .when(F.substring(s, 1, 3).isin("NP_", "XP_"), "protein_accession")
        .when(~F.contains(s, F.lit(":")), "gene_symbol")
        .otherwise("unknown")
    )
