"""Sequences of bases and residues as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code in TCAG order.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Three-letter names of residues by their one-letter codes.
NAMES = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr",
}
#: Codes that name no single residue, read but not written.
OTHERS = {"B": "Asx", "Z": "Glx", "X": "Xaa", "U": "Sec"}


def codons() -> dict[str, str]:
    return {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(s: Column) -> Column:
    """Bases complemented and reversed; U counts as T, case stays, other signs stay."""
    return F.reverse(F.translate(s, "ACGTacgtUu", "TGCAtgcaAa"))


def transcribe(s: Column) -> Column:
    """T becomes U, case stays."""
    return F.translate(s, "Tt", "Uu")


def back_transcribe(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def piece(s: Column, start: Column, end: Column) -> Column:
    """Bases start .. end (from 0, end exclusive), clamped to the sequence."""
    a = F.greatest(start, F.lit(0))
    return s.substr(a + 1, F.greatest(end - a, F.lit(0)))


def spliced(pieces: Column) -> Column:
    """The pieces of an array one after the other."""
    return F.array_join(pieces, "")


def translated(s: Column) -> Column:
    """One-letter residues of whole codons; reading goes on behind stops, codons that aren't upper-case ACGT give X."""
    table = codons()
    # a codon's place in the text of all of them, four characters each, is that of its residue; 0 is what isn't there
    told = ["X"] * (4 * len(table) + 1)
    told[1::4] = table.values()
    residue = lambda codon: F.get(F.array(*map(F.lit, told)), F.instr(F.lit(",".join(table)), codon))

    # cut in one pass: substr of a long text goes through it from its start
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.{3})"), 1), residue), "")


def translated_to_stop(s: Column) -> Column:
    """Residues of the upper-cased sequence up to the first stop, stop included."""
    p = translated(F.upper(s))
    return F.when(F.instr(p, "*") > 0, F.concat(F.substring_index(p, "*", 1), F.lit("*"))).otherwise(p)


def named(code: Column) -> Column:
    """Three-letter name of a one-letter code; * is Ter, all else Xaa."""
    known = NAMES | {"*": "Ter"}
    at = F.instr(F.lit("".join(known)), code)
    return F.when(at > 0, F.lit("".join(known.values())).substr(at * 3 - 2, F.lit(3))).when(code.isNotNull(), "Xaa")


def named_all(codes: Column) -> Column:
    """Names of a string of codes, joined."""
    return F.array_join(F.transform(F.filter(F.split(codes, ""), lambda c: c != ""), named), "")


def residue_code(name: Column) -> Column:
    """One-letter code of a residue's name in any case; ter, stop and * are *, one letter is upper-cased, all else X."""
    table = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (v.lower(), k)], F.lit("asx"), F.lit("B"), F.lit("glx"), F.lit("Z"))
    low = F.lower(name)
    return F.when(low.isin("ter", "stop", "*"), "*").when(F.length(name) == 1, F.upper(name)).otherwise(F.coalesce(table[low], F.lit("X")))


def residues(text: Column) -> Column:
    """Codes of a string of names only, or of codes only; null where it is neither (names in any case, codes in upper case)."""
    three = "|".join(v.lower() for v in [*NAMES.values(), *OTHERS.values(), "Ter"])
    table = F.create_map(*[F.lit(x) for k, v in (NAMES | OTHERS | {"*": "Ter"}).items() for x in (v.lower(), k)])
    by_name = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({three})"), 1), lambda x: table[x])
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.lower(text).rlike(f"^(?:{three})++$"), by_name)
        .when(text.rlike(f"^[{''.join([*NAMES, *OTHERS])}*]+$"), F.filter(F.split(text, ""), lambda c: c != ""))
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that are equal; found by halving, so texts are compared piece against piece, never character by character. Both are computed once."""

    def found(t: Column) -> Column:
        x, y, n = t["x"], t["y"], t["n"]
        # the largest power of 2 up to n, and all below it; equal ends count whole, so the sum is cut to n
        sizes = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda p: F.pow(F.lit(2), p).cast("int"))
        same = lambda k, m: x.substr(k + 1, m) == y.substr(k + 1, m)
        halved = F.aggregate(sizes, F.lit(0), lambda k, m: k + F.when(same(k, m), m).otherwise(0), lambda k: F.least(k, n))
        # most texts differ in the first character
        differ = x.substr(F.lit(1), F.lit(1)) != y.substr(F.lit(1), F.lit(1))
        return F.when((n == 0) | differ, F.lit(0)).when(x.isNull() | y.isNull(), n).otherwise(halved).cast("int")

    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"), F.least(F.length(a), F.length(b)).alias("n"))), found)[0]


def common_prefix_flat(a: Column, b: Column) -> Column:
    """The same character by character, without nested lambdas: arguments of Python functions that hold those aren't recognized by Spark."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(a.substr(F.lit(1), n), ""), F.split(b.substr(F.lit(1), n), ""), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    # most texts differ in the first character
    differ = a.substr(F.lit(1), F.lit(1)) != b.substr(F.lit(1), F.lit(1))
    return F.when((n == 0) | differ, F.lit(0)).otherwise(F.when(at > 0, at.cast("int") - 1).otherwise(n)).cast("int")


def stripped(start: Column, ref: Column, alt: Column) -> Column:
    """struct(start, ref, alt) without the common prefix, then without the common suffix; each is compared once."""
    ahead = lambda p: F.struct((start + p).cast("int").alias("start"), ref.substr(p + 1, F.length(ref)).alias("ref"), alt.substr(p + 1, F.length(alt)).alias("alt"))
    return F.transform(F.transform(F.array(common_prefix(ref, alt)), ahead), _without_suffix)[0]


def _without_suffix(v: Column) -> Column:
    cut = lambda x, s: x.substr(F.lit(1), F.length(x) - s)
    made = lambda s: F.struct(v["start"].alias("start"), cut(v["ref"], s).alias("ref"), cut(v["alt"], s).alias("alt"))
    return F.transform(F.array(common_prefix(F.reverse(v["ref"]), F.reverse(v["alt"]))), made)[0]
