"""Variant texts to structs: one anchored pattern for each kind of coordinate.

A pattern is matched once: the text is replaced by its groups, parted by a control character, and split. Tokens are
atomic groups, so no token gives back what it has taken, and alternatives keep their order. White space may stand
between tokens. A text that no pattern matches has a null variant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = "struct<base:int,offset:int,anchor:string,aa:string,end:int,uncertain:boolean>"
EDIT = "struct<type:string,ref:string,alt:string,term:string,length:string,min:int,max:int,copy:int,value:string>"
VARIANT = f"struct<coord:string,ac:string,gene:string,start:{POSITION},end:{POSITION},uncertain:boolean,predicted:boolean,edit:{EDIT}>"

W = r"[ \t]*+"
SEP = "\u0001"
Built = Callable[[Column], Column]
#: Names and codes of residues and of a stop, in the order in which they are tried.
AA3 = "Ala|Cys|Asp|Glu|Phe|Gly|His|Ile|Lys|Leu|Met|Asn|Pro|Gln|Arg|Ser|Thr|Val|Trp|Tyr|Asx|Glx|Xaa|Sec"
AA1 = "[ACDEFGHIKLMNPQRSTVWYBZXU]"
STOP = "Ter|X|\\*"
AAT = f"(?>Ter|{AA3}|X|\\*|{AA1})"
SEQ = f"(?>(?>Ter|{AA3})++|(?>X|\\*|{AA1})++)"
NUM = "[0-9]++"
HEAD = rf"^{W}([A-Za-z](?>[A-Za-z0-9_-]*)(?:\.[0-9]++)?){W}(?:\({W}([A-Za-z](?>(?:[A-Za-z0-9]|[-_.](?=[A-Za-z0-9]))*)){W}\){W})?:{W}"


def _na_edit(letters: str, copies: bool, bare_identity: bool) -> tuple[str, int]:
    """Pattern of nucleotide edits, and its number of groups."""
    d = f"(?>[{letters}]+)"
    counted = rf"(?:\[{W}({NUM}){W}\]|\({W}({NUM}){W}_{W}({NUM}){W}\))"
    options = [
        rf"({d}){W}>{W}({d})",
        rf"(del){W}({NUM}|{d})?{W}ins{W}({d})",
        rf"(del){W}({NUM}|{d})?",
        rf"(ins){W}({d})",
        rf"(dup){W}({d})?",
        rf"(inv){W}({NUM}|{d})?",
        rf"(con){W}[A-Za-z][^:]*:{W}[cgmnrp]{W}\..+",
        rf"({d})?{W}{counted}",
        *([rf"(copy){W}({NUM})"] if copies else []),
        rf"({d}){'?' if bare_identity else ''}{W}(=)",
    ]
    return "(?:" + "|".join(options) + ")", 22 if copies else 20


def _when(*cases: tuple[Column, Column], other: Column | None = None) -> Column:
    out = other if other is not None else F.lit(None)
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def _edit(kind: Column, **parts: Column) -> Column:
    kinds = {"type": "string", "ref": "string", "alt": "string", "term": "string", "length": "string", "min": "int", "max": "int", "copy": "int", "value": "string"}
    return F.struct(*[parts.get(k, kind if k == "type" else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _position(base: Column, offset: Column | None = None, anchor: Column | None = None, aa: Column | None = None, end: Column | None = None, uncertain: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        base.cast("int").alias("base"), (offset if offset is not None else none).cast("int").alias("offset"), (anchor if anchor is not None else none).cast("string").alias("anchor"),
        (aa if aa is not None else none).cast("string").alias("aa"), (end if end is not None else none).cast("int").alias("end"), (uncertain if uncertain is not None else F.lit(False)).alias("uncertain"),
    )


def _none(x: Column) -> Column:
    return F.when(x != "", x)


def _number(x: Column) -> Column:
    """Of digits with a sign; what doesn't fit is 0."""
    return F.coalesce(F.replace(x, F.lit("+"), F.lit("")).try_cast("int"), F.lit(0))


def _groups(text: Column, pattern: str, count: int) -> Column:
    # bound to a name: the pattern is matched once
    return F.get(F.filter(F.array(_parts(text, pattern, count)), lambda g: F.size(g) == count), F.lit(0))


def _parts(text: Column, pattern: str, count: int) -> Column:
    """The groups of a text that the pattern matches; of others an array of another size."""
    # a number ends at the control character: $12 is never $1 and a 2
    return F.split(F.regexp_replace(text, pattern, SEP.join(f"${i}" for i in range(1, count + 1))), SEP)


def _built_na_edit(x: list[Column]) -> Column:
    """Struct of the edit with those groups."""
    bracket, low, high = _number(x[15]), _number(x[16]), _number(x[17])
    # a lower bound of 0 is lost: the upper one takes its place
    least = F.when(x[15] != "", bracket).when(low == 0, high).otherwise(low)
    most = F.when(x[15] != "", bracket).otherwise(high)
    cases = [
        (x[0] != "", _edit(F.lit("RefAlt"), ref=x[0], alt=x[1])),
        (x[2] != "", _edit(F.lit("RefAlt"), ref=x[3], alt=x[4])),
        (x[5] != "", _edit(F.lit("Del"), ref=_none(x[6]))),
        (x[7] != "", _edit(F.lit("Ins"), alt=x[8])),
        (x[9] != "", _edit(F.lit("Dup"), ref=_none(x[10]))),
        (x[11] != "", _edit(F.lit("Inv"), ref=_none(x[12]))),
        (x[13] != "", _edit(F.lit("None"))),
        ((x[15] != "") | (x[16] != ""), _edit(F.lit("Repeat"), ref=_none(x[14]), min=least, max=most)),
    ]
    if len(x) == 22:
        cases.append((x[18] != "", _edit(F.lit("NACopy"), copy=_number(x[19]))))
    return _when(*cases, other=_edit(F.lit("RefAlt"), ref=_none(x[-2]), alt=_none(x[-2])))


DNA, RNA = ("ACGTNacgtn", True, True), ("ACGUNacgun", False, False)
SIMPLE = rf"({NUM}|\?)"
OFFSET = rf"(\*)?{W}([+-]?{NUM}){W}([+-]?{NUM})?"


def _simple(coord: str) -> tuple[list[str], int, Built]:
    """g and m: the pattern, its number of groups, and what is made of them."""
    two = rf"{SIMPLE}(?:{W}_{W}{SIMPLE})?"
    edit, n = _na_edit(*DNA)
    if coord == "g":
        place = rf"(?:\({W}{two}{W}\){W}_{W}\({W}{two}{W}\)|{two}{W}_{W}\({W}{two}{W}\)|\({W}{two}{W}\){W}_{W}{two}|\({W}{two}{W}\)|{two})"
        k = 16
    else:
        place, k = rf"(?:{two}|(\(){W}{two}{W}\))", 5
    known = lambda x: F.when(x == "?", 0).otherwise(_number(x))

    def built(v: Column) -> Column:
        x = [v[i] for i in range(2 + k + n)]
        p = x[2 : 2 + k]
        if coord == "g":
            both = lambda i: _position(known(p[i]), end=F.when(p[i + 1] != "", known(p[i + 1])), uncertain=F.lit(True))
            start = _when(*[(p[i] != "", both(i)) for i in (0, 4, 8, 12)], other=_position(known(p[14]), uncertain=p[14] == "?"))
            end = _when(*[(p[i] != "", both(i + 2)) for i in (0, 4, 8)], (p[12] != "", F.lit(None)), (p[15] != "", _position(known(p[15]), uncertain=p[15] == "?")))
            unsure = F.lit(False)
        else:
            first, second = F.concat(p[0], p[3]), F.concat(p[1], p[4])
            start = _position(known(first), uncertain=first == "?")
            end = F.when(second != "", _position(known(second), uncertain=second == "?"))
            unsure = (p[2] != "") & (second == "")
        return _variant(coord, x, start, end, unsure, F.lit(False), _built_na_edit(x[2 + k :]))

    return [rf"{HEAD}{coord}{W}\.{W}{place}{W}{edit}{W}$"], 2 + k + n, built


def _offset(coord: str) -> tuple[list[str], int, Built]:
    """c, n and r: the patterns in their order, their number of groups, and what is made of them; only c counts from the end of the coding region (*)."""
    one = OFFSET if coord == "c" else OFFSET.replace(r"(\*)?", "()")
    two = rf"{one}(?:{W}_{W}{one})?"
    edit, n = _na_edit(*(RNA if coord == "r" else DNA))
    place = rf"(?:{two}|\({W}{two}{W}\))"
    body = rf"{place}{W}{edit}"
    patterns = [rf"{HEAD}{coord}{W}\.{W}{body}{W}$"]
    if coord == "r":  # parentheses around all are read, not kept
        patterns.append(rf"{HEAD}{coord}{W}\.{W}\({W}{body}{W}\){W}$")
    anchor = F.lit("CdsStart" if coord == "c" else "TranscriptStart")

    def built(v: Column) -> Column:
        x = [v[i] for i in range(14 + n)]
        p = [F.concat(x[2 + i], x[8 + i]) for i in range(6)]
        place = lambda i: _position(_number(p[i + 1]), F.when(p[i + 2] != "", _number(p[i + 2])), F.when(p[i] == "*", "CdsEnd").otherwise(anchor))
        return _variant(coord, x, place(0), F.when(p[4] != "", place(3)), F.when((x[9] != ""), F.lit(coord != "r")).otherwise(F.lit(False)), F.lit(False), _built_na_edit(x[14:]))

    return patterns, 14 + n, built


def parse_protein(text: Column) -> Column:
    """The variant struct of a protein variant's text, null if it isn't one."""
    one = rf"((?>{STOP}|{AA3}|{AA1}))?{W}({NUM})"
    two = rf"{one}(?:{W}_{W}{one})?"
    counted = rf"(?:\[{W}({NUM}){W}\]|\({W}({NUM}){W}_{W}({NUM}){W}\))"
    edit = "(?:" + "|".join([
        rf"({AAT})?{W}(fs){W}(?:((?>{STOP})){W}([+-]?{NUM}|\?)?)?",
        rf"({AAT})?{W}(ext){W}((?>{STOP}|{AA3}|{AA1}))?{W}([+-]?{NUM}|\?)?",
        rf"({SEQ}|{NUM})?{W}{counted}",
        "(=)",
        rf"({AAT}|\?)",
        rf"(delins){W}({SEQ})",
        "(del)",
        rf"(ins){W}({SEQ})",
        "(dup)",
    ]) + ")"
    place = rf"(?:{two}|(\(){W}{two}{W}\))"
    g = _groups(text, rf"{HEAD}p{W}\.{W}(\({W})?{place}{W}{edit}{W}(\){W})?$", 33)
    special = _groups(text, rf"{HEAD}p{W}\.{W}(=|\({W}={W}\)|0{W}\?|0|\?){W}$", 3)

    def built(v: Column) -> Column:
        x = [v[i] for i in range(33)]
        p = [F.concat(x[3 + i], x[8 + i]) for i in range(4)]
        e = x[12:32]
        bracket, low, high = _number(e[9]), _number(e[10]), _number(e[11])
        least = F.when(e[9] != "", bracket).when(low == 0, high).otherwise(low)
        fs_term = _none(e[2])
        edit = _when(
            (e[1] != "", _edit(F.lit("Fs"), ref=F.lit(""), alt=e[0], term=fs_term, length=F.when(e[2] != "", e[3]))),
            # without a residue behind "ext" the number stands where the residue would
            (e[5] != "", _edit(F.lit("Ext"), ref=F.lit(""), alt=e[4], term=F.when(e[6] != "", e[6]).otherwise(e[7]), length=F.when(e[6] != "", e[7]))),
            ((e[9] != "") | (e[10] != ""), _edit(F.lit("Repeat"), ref=_none(F.when(e[8].rlike("^[0-9]"), "").otherwise(e[8])), min=least, max=F.when(e[9] != "", bracket).otherwise(high))),
            (e[12] != "", _edit(F.lit("Identity"))),
            (e[13] != "", _edit(F.lit("Subst"), ref=F.lit(""), alt=e[13])),
            (e[14] != "", _edit(F.lit("DelIns"), ref=F.lit(""), alt=e[15])),
            (e[16] != "", _edit(F.lit("Del"), ref=F.lit(""))),
            (e[17] != "", _edit(F.lit("Ins"), alt=e[18])),
            other=_edit(F.lit("Dup")),
        )
        place = lambda i: _position(_number(p[i + 1]), aa=p[i])
        found = _variant("p", x, place(0), F.when(p[3] != "", place(2)), x[7] != "", (x[2] != "") & (x[32] != ""), edit)
        return F.when((x[2] != "") == (x[32] != ""), found)

    def plain(v: Column) -> Column:
        value = F.translate(v[2], "() \t", "")
        return _variant("p", [v[0], v[1]], F.lit(None), F.lit(None), F.lit(False), v[2].startswith("("), _edit(F.lit("Special"), value=value))

    return F.coalesce(computed_once(g, built), computed_once(special, plain))


def computed_once(value: Column, made) -> Column:
    """made(value), with value computed once; null where it is null."""
    return F.get(F.transform(F.filter(F.array(value), lambda v: v.isNotNull()), made), F.lit(0))


def own_step(test: Column) -> Column:
    """The condition of a large expression over plain columns, as a higher-order function: that keeps it out of whole-stage code, where it would be one method that is too large for the JVM to compile."""
    return F.exists(F.array(test), lambda x: x)


def _variant(coord: str, x: list[Column], start: Column, end: Column, unsure: Column, predicted: Column, edit: Column) -> Column:
    return F.struct(F.lit(coord).alias("coord"), x[0].alias("ac"), _none(x[1]).alias("gene"), start.cast(POSITION).alias("start"), end.cast(POSITION).alias("end"), unsure.alias("uncertain"), predicted.alias("predicted"), edit.alias("edit")).cast(VARIANT)


def _nucleotide(coord: str) -> tuple[list[str], int, Built]:
    return _simple(coord) if coord in "gm" else _offset(coord)


def _read(text: Column, coord: str) -> Column:
    if coord == "p":
        return parse_protein(text)
    patterns, count, built = _nucleotide(coord)
    return computed_once(F.coalesce(*[_groups(text, p, count) for p in patterns]), built)


def parse_variant(text: Column, kinds: str = "gmcnrp") -> Column:
    """The variant struct of a text, null if it isn't one of those kinds. The expression grows with the kinds; where all texts are of one kind it is a sixth."""
    if len(kinds) == 1:
        return _read(text, kinds)
    kind = F.regexp_extract(text, rf"{HEAD}([cgmnrp]){W}\.", 3)
    return _when(*[(kind == k, _read(text, k)) for k in kinds])


@lru_cache(maxsize=64)
def _parsed(column: str, session: int, kinds: str) -> Column:
    """The expression for a column of that name, built once: it has some thousand nodes."""
    return parse_variant(F.col(column), kinds)


@lru_cache(maxsize=64)
def _from_parts(column: str, session: int, coord: str) -> Column:
    """The same over a column of groups."""
    _, count, built = _nucleotide(coord)
    return F.when(own_step(F.size(column) == count), built(F.col(column)))


def with_variant(df: DataFrame, text: str, to: str = "variant", kinds: str = "gmcnrp") -> DataFrame:
    """Adds the variant struct, and ``<to>_error`` where the text isn't a variant of one of ``kinds``."""
    # the random number, never under 0, keeps the optimizer from copying the large expression into filters and joins
    once, session = lambda c: F.when(F.rand(0) >= 0, c), id(df.sparkSession._jvm)
    if kinds in ("g", "m", "c", "n"):
        # in two steps: groups in a column are taken by compiled code, those bound within an expression are not
        (pattern,), count, _ = _nucleotide(kinds)
        df = df.withColumn("_parts", once(_parts(F.col(text), pattern, count))).withColumn(to, once(_from_parts("_parts", session, kinds))).drop("_parts")
    else:
        df = df.withColumn(to, once(_parsed(text, session, kinds)))
    return df.withColumn(f"{to}_error", F.when(F.col(to).isNull() & F.col(text).isNotNull(), F.struct(F.lit("PestError").alias("kind"), F.concat(F.lit("Parse error: "), F.col(text)).alias("message"))))
