"""Normalization: shifting, implied sequences, duplications, stated references, and position-deletion-insertion form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelic.functions.coordinates import c_to_n, index_of_transcript
from allelic.functions.parse import computed_once, own_step
from allelic.functions.sequence import common_prefix, piece, reverse_complement, stripped
from allelic.operators.mapping import n_to_g_extended, on_genome
from allelic.operators.reference import Reference, error, spliced_key, with_sequence, with_transcript, with_transcript_where_asked
from allelic.operators.windows import FASTER, MARGIN, NEAR, SIZE, agreeing, long_windows, repeated, runs, with_bases, with_window
from allelic.sources.stage import stored

def _prefix(a: Column, b: Column) -> Column:
    """The common prefix of long texts, of which most differ within the first NEAR characters."""
    near = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), common_prefix(t["a"].substr(F.lit(1), F.lit(NEAR)), t["b"].substr(F.lit(1), F.lit(NEAR))).alias("n"))
    found = lambda t: F.when(t["n"] < NEAR, t["n"]).otherwise(common_prefix(t["a"], t["b"]))
    return F.transform(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), near), found)[0]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _moves_as_deletion(e: Column, start: Column, end: Column) -> Column:
    ref, alt = _text(e["ref"]), _text(e["alt"])
    return (
        F.when((e["type"] == "RefAlt") & (ref == alt), False).when(e["type"].isin("Del", "Dup"), True)
        .when(e["type"] == "RefAlt", ((ref != "") & (alt == "")) | (end - start != F.length(alt))).when(e["type"] == "Repeat", e["max"] == 0).otherwise(False)
    )


def shift_right(seq: Column, start: Column, end: Column, e: Column) -> Column:
    """How far an edit of [start, end) can move towards the 3' end.

    What moves like a deletion goes on while the base that it leaves equals the one that it takes, which is the common
    prefix of the sequence from its start and from its end; the first comparison uses the stated bases. Of insertions,
    only one base moves, over its like.
    """
    taken = seq.substr(end + 1, F.lit(1))
    stated = F.when(_text(e["ref"]) != "", e["ref"]).otherwise(piece(seq, start, end))
    deletion = F.when((stated == "") | (taken == "") | (stated.substr(F.lit(1), F.lit(1)) != taken), 0).otherwise(1 + _prefix(seq.substr(start + 2, F.length(seq)), seq.substr(end + 2, F.length(seq))))
    rest = seq.substr(end + 1, F.length(seq))
    insertion = F.length(rest) - F.length(F.ltrim(rest, e["alt"]))
    one = (e["type"] == "Ins") & (start == end) & (F.length(e["alt"]) == 1)
    return F.when(_moves_as_deletion(e, start, end), deletion).when(one, insertion).otherwise(0).cast("int")


def shift_left(seq: Column, start: Column, end: Column, e: Column) -> Column:
    """The same towards the 5' end, over the common suffix of the sequence up to its start and up to its end."""
    before, upto = F.reverse(seq.substr(F.lit(1), start)), F.reverse(seq.substr(F.lit(1), end))
    one = (e["type"] == "Ins") & (start == end) & (F.length(e["alt"]) == 1)
    insertion = F.length(before) - F.length(F.ltrim(before, e["alt"]))
    return F.when(_moves_as_deletion(e, start, end), _prefix(before, upto)).when(one, insertion).otherwise(0).cast("int")


def changes_length(e: Column, start: Column, end: Column) -> Column:
    return F.when(e["type"] == "RefAlt", end - start != F.length(_text(e["alt"]))).otherwise(e["type"].isin("Del", "Ins", "Dup", "Repeat"))


def unambiguous_range(seq: Column, start: Column, end: Column, e: Column) -> Column:
    """struct(start, end): all places that the edit could have."""
    wide = changes_length(e, start, end)
    return F.struct((start - F.when(wide, shift_left(seq, start, end, e)).otherwise(0)).cast("int").alias("start"), (end + F.when(wide, shift_right(seq, start, end, e)).otherwise(0)).cast("int").alias("end"))


def genomic_range(v: Column, insertion_at_end: bool = True) -> Column:
    """struct(start, end), half open from 0; of an insertion between two positions both are that of the second."""
    a, b = v["start"]["base"] - 1, v["end"]["base"] - 1
    ins = v["edit"]["type"] == "Ins"
    return F.struct(
        (F.when(ins & b.isNotNull(), b).otherwise(a) if insertion_at_end else a).cast("int").alias("start"),
        F.when(b.isNull(), a + 1).when(ins, b).otherwise(b + 1).cast("int").alias("end"),
    )


def transcript_range(v: Column, tx: Column) -> Column:
    """struct(start, end) on the transcript; offsets into introns are not looked at."""
    n = lambda p: c_to_n(index_of_transcript(v[p]["base"]), v[p]["anchor"], tx["cds_start"], tx["cds_end"])
    start = n("start")
    return F.struct(start.cast("int").alias("start"), (F.when(v["end"].isNotNull(), n("end")).otherwise(start) + 1).cast("int").alias("end"))


def _shifted(v: Column, seq: Column, start: Column, end: Column, width: Column) -> Column:
    """The variant moved right, with the bases that a deletion or duplication takes there. ``width`` of those, from the new start."""

    def moved(k: Column) -> Column:
        out = v.withField("start", v["start"].withField("base", v["start"]["base"] + k))
        out = out.withField("end", F.when(v["end"].isNotNull(), v["end"].withField("base", v["end"]["base"] + k)))
        bases = piece(seq, start + k, start + k + width)
        return out.withField("edit", F.when(v["edit"]["type"].isin("Del", "Dup"), v["edit"].withField("ref", bases)).otherwise(v["edit"]))

    return computed_once(shift_right(seq, start, end, v["edit"]), moved)


def normalize_genomic(v: Column, seq: Column) -> Column:
    return computed_once(genomic_range(v), lambda r: _shifted(v, seq, r["start"], r["end"], r["end"] - r["start"]))


def normalize_transcript(v: Column, tx: Column) -> Column:
    def moved(r: Column) -> Column:
        ins = v["edit"]["type"] == "Ins"
        return _shifted(v, tx["tx_seq"], r["start"], F.when(ins, r["end"] - 1).otherwise(r["end"]), r["end"] - r["start"])

    return computed_once(transcript_range(v, tx), moved)


#: Stands in for the transcript of variants that need none.
NO_TRANSCRIPT = "struct<ac:string,reference:string,cds_start:int,cds_end:int>"
#: Of ranges that are looked at together with their flanks, at most so many bases.
SHORT = MARGIN - 2 * NEAR


def _one_base(e: Column, a: Column, z: Column) -> Column:
    return F.coalesce((e["type"] == "Ins") & (a == z) & (F.length(e["alt"]) == 1), F.lit(False))


def with_shift(df: DataFrame, chunks: DataFrame, key: Column, edit: Column, start: Column, end: Column, to: str = "shift") -> DataFrame:
    """Adds struct(own, unit, before, right, left, size) of an edit of [start, end): its bases, those with the stated first one, the base in front (of insertions as many as they have, up to NEAR), how far it can move either way, and the sequence's length. Null where there is no such sequence.

    The closed form of ``shift_right`` and ``shift_left`` over windows: the bases behind the range go on with its own period. Rows are stored;
    ranges of over SHORT bases, and those that use up a flank, are looked up on their own.
    """
    a, z, e = start.cast("int"), end.cast("int"), edit
    long = z - F.greatest(a, F.lit(0)) > SHORT
    # of a long range only the sequence's length is asked for here
    rows = with_window(df, chunks, F.when(a.isNotNull(), key), a - NEAR, F.when(long, a - NEAR).otherwise(z + NEAR), "_sw")
    w = F.col("_sw")
    own = piece(w["bases"], F.greatest(a, F.lit(0)) - w["start"], z - w["start"])
    ahead, behind = F.reverse(piece(w["bases"], F.lit(0), a - w["start"])), w["bases"].substr(F.greatest(z, F.lit(0)) - w["start"] + 1, F.lit(NEAR))
    rows = rows.select("*", own.alias("_own"), ahead.alias("_ahead"), behind.alias("_behind"), long.alias("_long"))
    rows = rows.withColumn("_moves", F.coalesce(_moves_as_deletion(e, a, z), F.lit(False))).withColumn("_one", _one_base(e, a, z))
    stated = F.when(_text(e["ref"]) != "", e["ref"].substr(F.lit(1), F.lit(1))).otherwise(F.col("_own").substr(F.lit(1), F.lit(1)))
    unit = F.when(F.col("_one"), e["alt"]).when(F.col("_moves"), F.concat(stated, F.col("_own").substr(F.lit(2), F.greatest(F.length("_own") - 1, F.lit(0)))))
    back = F.when(F.col("_one"), e["alt"]).when(F.col("_moves"), F.col("_own"))
    moving = F.col("_moves") | F.col("_one")
    rows = rows.withColumn("_unit", unit).withColumn("_back", back)
    rows = rows.withColumn("_right", F.when(moving & ~F.col("_long"), agreeing(F.col("_behind"), F.col("_unit"))).otherwise(0)).withColumn("_left", F.when(moving & ~F.col("_long"), agreeing(F.col("_ahead"), F.reverse("_back"))).otherwise(0))
    open_ = lambda side: moving & (F.col(f"_{side}") == NEAR)
    known = w.isNotNull()
    before = F.reverse(F.col("_ahead").substr(F.lit(1), F.when(e["type"] == "Ins", F.length(e["alt"])).otherwise(1)))
    rows = rows.select(
        *df.columns, "_own", F.when(F.col("_moves") & (F.col("_unit") != F.col("_own")), F.col("_unit")).alias("_other"), before.alias("_before"), "_right", "_left", w["size"].alias("_size"),
        F.coalesce(known & F.col("_long"), F.lit(False)).alias("_far"), F.coalesce(known & open_("right"), F.lit(False)).alias("_more_right"), F.coalesce(known & open_("left"), F.lit(False)).alias("_more_left"),
    )
    rows = stored(rows, "shifts")
    told = rows.agg(F.max("_far"), F.max("_more_right"), F.max("_more_left")).first()
    if any(told):
        rows = _looked_up(rows, chunks, key, e, a, z, *map(bool, told))
    unit = F.when(_one_base(e, a, z), e["alt"]).when(F.coalesce(_moves_as_deletion(e, a, z), F.lit(False)), F.coalesce("_other", "_own"))
    made = F.when(F.col("_size").isNotNull(), F.struct(F.col("_own").alias("own"), unit.alias("unit"), F.col("_before").alias("before"), F.col("_right").cast("int").alias("right"), F.col("_left").cast("int").alias("left"), F.col("_size").alias("size")))
    return rows.select(*df.columns, made.alias(to))


def _looked_up(rows: DataFrame, chunks: DataFrame, key: Column, edit: Column, a: Column, z: Column, far: bool, more_right: bool, more_left: bool) -> DataFrame:
    """The rows with long ranges' bases, and with the runs of those that use up their flanks."""
    flag = F.col("_far") | F.col("_more_right") | F.col("_more_left")
    near, open_ = rows.where(~flag), rows.where(flag)
    open_ = open_.withColumn("_sk", key).withColumn("_se", edit).withColumn("_sa", a).withColumn("_sz", z)
    open_ = open_.withColumn("_moves", F.coalesce(_moves_as_deletion(F.col("_se"), F.col("_sa"), F.col("_sz")), F.lit(False))).withColumn("_one", _one_base(F.col("_se"), F.col("_sa"), F.col("_sz")))
    e = F.col("_se")
    if far:
        texts = long_windows(open_.where("_far").select(F.col("_sk").alias("key"), F.col("_sa").alias("start"), F.col("_sz").alias("end")), chunks)
        texts = texts.select(F.col("key").alias("_sk"), F.greatest("start", F.lit(0)).alias("_from"), F.col("end").alias("_sz"), F.col("bases").alias("_text"))
        open_ = open_.withColumn("_from", F.greatest("_sa", F.lit(0))).join(texts, ["_sk", "_from", "_sz"], "left").drop("_from")
        open_ = open_.withColumn("_own", F.when(F.col("_far"), F.coalesce("_text", F.lit(""))).otherwise(F.col("_own"))).drop("_text")
        stated = F.when(_text(e["ref"]) != "", e["ref"].substr(F.lit(1), F.lit(1))).otherwise(F.col("_own").substr(F.lit(1), F.lit(1)))
        open_ = open_.withColumn("_other", F.when(F.col("_far") & F.col("_moves"), F.concat(stated, F.expr("substring(_own, 2)"))).otherwise(F.col("_other")))
        open_ = stored(open_, "shifts")
    open_ = open_.withColumn("_unit", F.when(F.col("_one"), e["alt"]).when(F.col("_moves"), F.coalesce("_other", "_own"))).withColumn("_back", F.when(F.col("_one"), e["alt"]).when(F.col("_moves"), F.col("_own")))
    for side, at, unit in (("right", "_sz", "_unit"), ("left", "_sa", "_back")):
        for ask, begin, width in ((F.col("_far") & F.col("_moves"), 0, NEAR), (~F.col("_far") & F.col(f"_more_{side}"), NEAR, NEAR * FASTER)):
            asked = open_.where(ask & (F.length(unit) > 0)).select(F.col("_sk").alias("key"), F.col(at).alias("at"), F.col(unit).alias("unit"), F.lit(side == "right").alias("right"))
            if (begin and (more_right if side == "right" else more_left)) or (not begin and far):
                found = runs(asked, chunks, begin, width).select(F.col("key").alias("_sk"), F.col("at").alias(at), F.col("unit").alias(unit), F.col("n").alias("_n"), F.lit(True).alias("_hit"))
                open_ = open_.withColumn("_ask", ask).join(found.withColumn("_ask", F.lit(True)), ["_sk", at, unit, "_ask"], "left")
                open_ = open_.withColumn(f"_{side}", F.when(F.col("_hit"), F.col("_n")).otherwise(F.col(f"_{side}"))).drop("_n", "_hit", "_ask")
    return near.unionByName(open_.select(*near.columns))


def with_unambiguous_range(df: DataFrame, reference: Reference, variant: str = "variant", to: str = "range") -> DataFrame:
    """Adds struct(start, end): all places that a genomic variant's edit could have. Rows are stored."""
    v = F.col(variant)
    rows = df.withColumn("_r", F.when((v["coord"] == "g") & v["start"].isNotNull(), genomic_range(v)))
    rows = with_shift(rows, reference.windows, F.when(F.col("_r").isNotNull(), v["ac"]), v["edit"], F.col("_r.start"), F.col("_r.end"), "_shift")
    a, z, s = F.col("_r.start"), F.col("_r.end"), F.col("_shift")
    wide = changes_length(v["edit"], a, z)
    made = F.struct((a - F.when(wide, s["left"]).otherwise(0)).cast("int").alias("start"), (z + F.when(wide, s["right"]).otherwise(0)).cast("int").alias("end"))
    return rows.withColumn(to, F.when(s.isNotNull(), made)).drop("_r", "_shift")


def _at(v: Column, shift: Column) -> Column:
    """The variant moved right as far as it can; deletions and duplications state the bases there."""
    k = F.coalesce(shift["right"], F.lit(0))
    out = v.withField("start", v["start"].withField("base", v["start"]["base"] + k))
    out = out.withField("end", F.when(v["end"].isNotNull(), v["end"].withField("base", v["end"]["base"] + k)))
    return out.withField("edit", F.when(v["edit"]["type"].isin("Del", "Dup"), v["edit"].withField("ref", moved_bases(shift))).otherwise(v["edit"]))


def moved_bases(shift: Column) -> Column:
    """The bases of the range that an edit has after its move: those of its own period."""
    return F.when(shift["right"] > 0, repeated(F.coalesce(shift["unit"], shift["own"]), shift["right"], F.length(shift["own"]))).otherwise(shift["own"])


def normalized(df: DataFrame, reference: Reference, variant: str, to: str, shift: str = "_shift") -> DataFrame:
    """Adds the variant shifted towards the 3' end, and its shift; a transcript's variant has its ranges on ``tx``. Rows are stored."""
    v, tx = F.col(variant), F.col("tx")
    genomic, on_tx = v["coord"] == "g", v["coord"].isin("c", "n")
    known = v["start"].isNotNull() & (genomic | (on_tx & tx.isNotNull()))
    ins = v["edit"]["type"] == "Ins"
    of_tx = transcript_range(v, tx)
    placed = F.when(genomic, genomic_range(v)).otherwise(F.struct(of_tx["start"].alias("start"), F.when(ins, of_tx["end"] - 1).otherwise(of_tx["end"]).cast("int").alias("end")))
    rows = df.withColumn("_range", F.when(known, placed))
    key = F.when(genomic, v["ac"]).otherwise(spliced_key(tx["ac"], tx["reference"]))
    rows = with_shift(rows, reference.windows, F.when(known, key), v["edit"], F.col("_range.start"), F.col("_range.end"), shift)
    s = F.col(shift)
    return rows.withColumn(to, F.when(s.isNotNull(), computed_once(F.struct(v.alias("v"), s.alias("s")), lambda x: _at(x["v"], x["s"]))).otherwise(v)).drop("_range")


def normalize(df: DataFrame, reference: Reference, variant: str = "variant", to: str = "normal") -> DataFrame:
    """Adds the variant shifted towards the 3' end; of genomic, coding and transcript variants with a position and a known sequence, others as they are."""
    v = F.col(variant)
    out = with_transcript_where_asked(df, reference, F.when(v["coord"].isin("c", "n"), v["ac"]))
    return normalized(out, reference, variant, to).drop("_shift", "tx")


def fill_implied(v: Column, seq: Column) -> Column:
    """Deletions and duplications without stated bases get those of the sequence (genomic ranges)."""
    implied = v["edit"]["type"].isin("Del", "Dup") & v["edit"]["ref"].isNull()
    return F.when(implied, computed_once(genomic_range(v), lambda r: v.withField("edit", v["edit"].withField("ref", piece(seq, r["start"], r["end"]))))).otherwise(v)


def insertion_as_duplication(v: Column, seq: Column) -> Column:
    """An insertion of the very bases in front of it is their duplication (genomic ranges)."""
    at = v["start"]["base"]
    return as_duplication(v, piece(seq, at - F.length(v["edit"]["alt"]), at))


def as_duplication(v: Column, before: Column) -> Column:
    """The same by the bases in front of the insertion, as many as it has."""
    alt = v["edit"]["alt"]
    n, at = F.length(alt), v["start"]["base"]
    same = (v["edit"]["type"] == "Ins") & v["start"].isNotNull() & (n > 0) & (at >= n) & (before == alt)
    dup = v.withField("start", v["start"].withField("base", (at - n + 1).cast("int")))
    dup = dup.withField("end", F.when(n > 1, v["start"].withField("base", at)))
    dup = dup.withField("edit", v["edit"].withField("type", F.lit("Dup")).withField("ref", alt).withField("alt", F.lit(None).cast("string")))
    return F.when(same, dup).otherwise(v)


def with_canonical(df: DataFrame, reference: Reference, variant: str, to: str) -> DataFrame:
    """Adds the genomic variant normalized, with stated bases, and as a duplication where it is one. Rows are stored."""
    m, s = F.col("_m"), F.col("_shift")
    rows = normalized(df.withColumn("tx", F.lit(None).cast(NO_TRANSCRIPT)), reference, variant, "_m").drop("tx")
    v = F.col(variant)
    ins, n = (v["edit"]["type"] == "Ins") & s.isNotNull(), F.length(v["edit"]["alt"])
    # the shift's window has what is in front of an insertion of some bases; one that has moved stands behind its like
    met = (v["end"]["base"] == v["start"]["base"] + 1) & (n <= NEAR)
    made = lambda before: F.when(ins, computed_once(F.struct(m.alias("v"), before.alias("b")), lambda x: as_duplication(x["v"], x["b"]))).otherwise(m)
    near = rows.withColumn(to, made(F.when(s["right"] > 0, v["edit"]["alt"]).otherwise(s["before"])))
    open_ = F.coalesce(ins & ~F.coalesce(met, F.lit(False)), F.lit(False))
    if rows.where(open_).isEmpty():
        return near.drop("_m", "_shift")
    at = m["start"]["base"]
    far = with_bases(stored(rows.where(open_), "canonical"), reference.windows, m["ac"], at - F.length(m["edit"]["alt"]), at, "_before").withColumn(to, made(F.col("_before"))).drop("_before")
    return near.where(~open_).unionByName(far).drop("_m", "_shift")


def states_reference(v: Column, seq: Column, start: Column, end: Column) -> Column:
    """Whether the stated bases of a substitution or replacement are those of the sequence; true where none are stated, null where the sequence is too short."""
    ref = v["edit"]["ref"]
    stated = (v["edit"]["type"] == "RefAlt") & (_text(ref) != "") & ~ref.rlike("^[0-9]+$")
    return F.when(~stated, True).when(end <= F.length(seq), piece(seq, start, end) == ref)


def _written(ac: Column, pos: Column, deleted: Column, inserted: Column) -> Column:
    return F.concat_ws(":", ac, pos.cast("string"), deleted, inserted)


def genomic_spdi(v: Column, seq: Column) -> Column:
    """ac:position:deleted:inserted of a genomic variant as it stands; null for edits without such a form."""
    return spdi_text(v, piece(seq, v["start"]["base"] - 1, F.coalesce(v["end"]["base"], v["start"]["base"])))


def spdi_text(v: Column, bases: Column) -> Column:
    """The same of a variant over those bases."""
    e = v["edit"]
    a, b = v["start"]["base"] - 1, F.coalesce(v["end"]["base"], v["start"]["base"])
    ref = F.when(_text(e["ref"]) != "", e["ref"]).otherwise(bases)
    minimal = lambda alt: computed_once(stripped(a, ref, alt), lambda s: _written(v["ac"], s["start"], s["ref"], s["alt"]))
    # of two different bases nothing is stripped
    single = (e["type"] == "RefAlt") & (F.length(e["ref"]) == 1) & (F.length(e["alt"]) == 1) & (e["ref"] != e["alt"])
    return (
        F.when(single, _written(v["ac"], a, e["ref"], e["alt"])).when(e["type"] == "RefAlt", minimal(F.when(e["ref"].isNull() & e["alt"].isNull(), ref).otherwise(_text(e["alt"])))).when(e["type"] == "Del", _written(v["ac"], a, ref, F.lit("")))
        .when(e["type"] == "Ins", _written(v["ac"], a, F.lit(""), e["alt"])).when(e["type"] == "Dup", _written(v["ac"], b, F.lit(""), ref))
        .when(e["type"] == "Repeat", minimal(F.repeat(ref, e["max"]))).when(e["type"] == "Inv", minimal(reverse_complement(ref)))
    )


def unambiguous_spdi(v: Column, seq: Column) -> Column:
    """The same over all places that the edit could have."""

    def made(r: Column) -> Column:
        e, a, b = v["edit"], r["start"], r["end"]
        unit = piece(seq, a, b)
        alt = (
            F.when(e["type"] == "RefAlt", _text(e["alt"])).when(e["type"] == "Ins", e["alt"]).when(e["type"] == "Del", "").when(e["type"] == "Dup", F.concat(e["ref"], e["ref"]))
            .when(e["type"] == "Repeat", F.repeat(F.coalesce(e["ref"], unit), e["max"])).when(e["type"] == "Inv", reverse_complement(unit))
        )
        # the range of an insertion starts at the base in front of it, which the text then replaces
        return computed_once(unambiguous_range(seq, a, b, e), lambda u: _written(v["ac"], u["start"], piece(seq, u["start"], u["end"]), F.concat(piece(seq, u["start"], a), alt, piece(seq, b, u["end"]))))

    return computed_once(genomic_range(v, insertion_at_end=False), made)


def _wide_text(v: Column, r: Column, s: Column) -> Column:
    """Over all places that the edit of a range could have, from its shift there."""
    e, own = v["edit"], s["own"]
    alt = (
        F.when(e["type"] == "RefAlt", _text(e["alt"])).when(e["type"] == "Ins", e["alt"]).when(e["type"] == "Del", "").when(e["type"] == "Dup", F.concat(e["ref"], e["ref"]))
        .when(e["type"] == "Repeat", F.repeat(F.coalesce(e["ref"], own), e["max"])).when(e["type"] == "Inv", reverse_complement(own))
    )
    wide = changes_length(e, r["start"], r["end"])
    left, right = (F.when(wide, s[side]).otherwise(0) for side in ("left", "right"))
    before, behind = F.reverse(repeated(F.reverse(own), F.lit(0), left)), repeated(F.coalesce(s["unit"], own), F.lit(0), right)
    return _written(v["ac"], r["start"] - left, F.concat(before, own, behind), F.concat(before, alt, behind))


def _with_wide_shift(df: DataFrame, reference: Reference) -> DataFrame:
    """The range ``_r`` of the normalized variant ``_m`` and its shift there, in place of the shift of ``_g``.

    Most are told by the shift that was: what has moved as far as it could moves no further, and back over what it passed. Only edits whose
    stated bases differ from the sequence's, replacements that have moved, and insertions between bases that aren't neighbours meet the sequence again.
    """
    m, v, s = F.col("_m"), F.col("_g"), F.col("_shift")
    out = df.withColumn("_r", F.when(F.col("_known"), genomic_range(m, insertion_at_end=False)))
    ins, both = v["edit"]["type"] == "Ins", v["end"]["base"].isNotNull()
    agrees = s["unit"].isNull() | ins | (s["unit"] == s["own"])
    stays = (s["right"] == 0) | v["edit"]["type"].isin("Del", "Dup", "Ins")
    told = F.coalesce(~F.col("_known") | (agrees & stays & (~ins | ~both | (v["end"]["base"] == v["start"]["base"] + 1))), F.lit(False))
    own = F.when(ins & both, F.when(s["right"] > 0, v["edit"]["alt"]).otherwise(F.right(s["before"], F.lit(1)))).otherwise(moved_bases(s))
    none = ins & both
    made = F.struct(
        own.alias("own"), F.when(~none & s["unit"].isNotNull(), own).alias("unit"), s["before"].alias("before"), F.lit(0).alias("right"),
        F.when(none, 0).otherwise(s["left"] + s["right"]).cast("int").alias("left"), s["size"].alias("size"),
    )
    open_ = out.where(~told)
    if open_.isEmpty():
        return out.withColumn("_shift", F.when(s.isNotNull(), made))
    near = out.where(told).withColumn("_shift", F.when(s.isNotNull(), made))
    again = with_shift(stored(open_.drop("_shift"), "again"), reference.windows, m["ac"], m["edit"], F.col("_r.start"), F.col("_r.end"), "_shift")
    return near.unionByName(again)


def to_spdi(df: DataFrame, reference: Reference, variant: str = "variant", to: str = "spdi", unambiguous: bool = False) -> DataFrame:
    """Adds the text of genomic, coding and transcript variants, mapped to the reference and normalized; others get an error. Rows are stored."""
    v = F.col(variant)
    out = on_genome(df, reference, variant, "_g", errors=True)
    g = F.col("_g")
    # a genomic variant is carried once
    out = out.withColumn("_else", F.when(v["coord"] != "g", v)).drop(variant)
    # variants on the genome need no transcript
    out = normalized(out.withColumn("tx", F.lit(None).cast(NO_TRANSCRIPT)), reference, "_g", "_m").drop("tx")
    out = out.withColumn(variant, F.coalesce("_else", "_g")).drop("_else").withColumn("_known", F.col("_shift").isNotNull())
    if unambiguous:
        out = _with_wide_shift(out, reference)
        made = computed_once(F.struct(F.col("_m").alias("v"), F.col("_r").alias("r"), F.col("_shift").alias("s")), lambda x: _wide_text(x["v"], x["r"], x["s"]))
    else:
        made = spdi_text(F.col("_m"), moved_bases(F.col("_shift")))
    out = out.withColumn(to, F.when(F.col("_known"), made)).drop("_m", "_shift", "_r")
    why = F.when(~v["coord"].isin("g", "c", "n"), error("UnsupportedOperation", "Unsupported operation: SPDI only for genomic/coding/non-coding")).otherwise(
        F.coalesce(
            "_g_error", F.when(g.isNotNull() & g["start"].isNull(), error("ValidationError", "Validation error: Missing genomic position")),
            F.when(g.isNotNull() & ~F.col("_known"), error("DataProviderError", "Data provider error: no such sequence")),
            error("UnsupportedOperation", "Unsupported operation: no SPDI for this edit"),
        )
    )
    return out.withColumn(f"{to}_error", F.when(v.isNotNull() & F.col(to).isNull(), why)).drop("_g", "_g_error", "_known")


def raw_spdi(df: DataFrame, reference: Reference, variant: str = "variant", to: str = "spdi", keep: bool = True) -> DataFrame:
    """Adds the text of a variant as it is stored: nothing is shifted, and nothing turned on the minus strand.

    Of c, n and r variants the stated position counts as a transcript index, whatever its anchor, and goes to the
    reference with its offset, beyond the exons as well; g and m variants stay where they are, p variants get an error.
    Rows meet one table, of transcripts and of sequences with their lengths; only edits that don't state their bases meet the sequences. Rows are stored,
    without the variant if it isn't to be kept.
    """
    v = F.col(variant)
    on_transcript, stays = v["coord"].isin("c", "n", "r"), v["coord"].isin("g", "m")
    sizes = reference.windows.where("part = 0").select(F.col("key").alias("_sac"), F.col("size").alias("_size"))
    models = reference.best.select(F.col("ac").alias("_mac"), F.struct("reference", "exons").alias("_model"), F.col("reference").alias("_sac")).join(sizes, "_sac", "left")
    table = models.select(F.lit(True).alias("_mtx"), "_mac", "_model", "_size").unionByName(sizes.select(F.lit(False).alias("_mtx"), F.col("_sac").alias("_mac"), F.lit(None).cast(dict(models.dtypes)["_model"]).alias("_model"), "_size"))
    # rows that ask for nothing are dealt by numbers of their own
    own = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("string")
    place = lambda p: F.when(v[p].isNotNull(), F.struct(F.when(on_transcript, index_of_transcript(v[p]["base"])).otherwise(v[p]["base"] - 1).alias("at"), v[p]["offset"].alias("offset"))).alias(p)
    asked = F.when(on_transcript | stays, F.struct(v["coord"].alias("coord"), v["ac"].alias("ac"), place("start"), place("end"), v["edit"].alias("edit")))
    lack = F.when(v["start"].isNull(), "position").when(~(stays | on_transcript), "kind").when(v.isNotNull(), "")
    out = df.withColumn("_asked", asked).withColumn("_rtx", on_transcript).withColumn("_lack", F.when(v.isNotNull(), lack)).withColumn("_key", F.coalesce(F.col("_asked.ac"), own))
    out = out if keep else out.drop(variant)
    out = out.join(table.hint("shuffle_hash"), (F.col("_key") == F.col("_mac")) & (F.col("_rtx") == F.col("_mtx")), "left")  # models are small beside the rows
    x, model = F.col("_asked"), F.col("_model")
    to_genome = lambda p: F.when(F.col("_rtx"), n_to_g_extended(model["exons"], x[p]["at"], x[p]["offset"])).otherwise(x[p]["at"])
    out = out.withColumn("_a", to_genome("start")).withColumn("_b", F.when(x["end"].isNotNull(), to_genome("end")))
    found = x["start"].isNotNull() & (~F.col("_rtx") | model.isNotNull())
    end = F.coalesce("_b", "_a")
    first, last = F.when(F.col("_rtx"), F.least("_a", end)).otherwise(F.col("_a")), F.when(F.col("_rtx"), F.greatest("_a", end)).otherwise(end) + 1
    out = out.withColumn("_first", first.cast("int")).withColumn("_last", F.when(x["end"].isNotNull(), last).otherwise(first + 1).cast("int"))
    # the chunk that the first base would be in
    known = found & F.col("_size").isNotNull() & (F.floor(F.greatest("_first", F.lit(0)) / SIZE) < F.greatest(F.ceil(F.col("_size") / SIZE), F.lit(1)))
    made = F.struct(F.when(F.col("_rtx"), model["reference"]).otherwise(x["ac"]).alias("ac"), F.struct((F.col("_first") + 1).alias("base")).alias("start"), F.struct(F.col("_last").alias("base")).alias("end"), x["edit"].alias("edit"))
    out = out.withColumn("_g", F.when(own_step(known), made)).withColumn("_open", F.coalesce((_text(x["edit"]["ref"]) == "") & x["edit"]["type"].isin("RefAlt", "Del", "Dup", "Repeat", "Inv") & F.col("_g").isNotNull(), F.lit(False)))
    none = error("UnsupportedOperation", "Unsupported operation: no SPDI for this edit")
    why = (
        F.when(F.col("_lack") == "position", error("ValidationError", "Validation error: SPDI requires a position"))
        .when(F.col("_lack") == "kind", error("UnsupportedOperation", "Unsupported operation: SPDI not supported for protein variants"))
        .when(F.col("_rtx") & model.isNull(), error("DataProviderError", "Data provider error: no such transcript"))
        .when(F.col("_g").isNull(), error("DataProviderError", "Data provider error: no such sequence"))
        .otherwise(none)
    )
    out = out.withColumn(to, F.when(~F.col("_open"), spdi_text(F.col("_g"), F.lit(""))))
    out = out.withColumn(f"{to}_error", F.when(F.col("_lack").isNotNull() & F.col(to).isNull() & ~F.col("_open"), why)).withColumn("_g", F.when(F.col("_open"), F.col("_g")))
    columns = [*(c for c in df.columns if keep or c != variant), to, f"{to}_error"]
    out = stored(out.select(*columns, "_g", "_open", "_first", "_last"), "raw")
    told, open_ = out.where("not _open").select(*columns), out.where("_open")
    if open_.isEmpty():
        return told
    open_ = with_bases(open_, reference.windows, F.col("_g.ac"), F.col("_first"), F.col("_last"), "_bases").withColumn(to, spdi_text(F.col("_g"), F.col("_bases")))
    return told.unionByName(open_.withColumn(f"{to}_error", F.when(F.col(to).isNull(), none)).select(*columns))


def baseline_spdi(v: Column, seq: Column) -> Column:
    """The text that a comparison gives to genomic variants of another library: an absent or counted reference is read over the interval, insertions stand at their first flanking base.

    Edits without an alternative (dup, inv) give ``ERR:SPDI``, those without a reference of their own ``UnsupportedType``.
    """
    e, first = v["edit"], v["start"]["base"]
    stated = F.when(~_text(e["ref"]).rlike("^[0-9]*$"), e["ref"]).otherwise(piece(seq, first - 1, F.coalesce(v["end"]["base"], first)))
    ins = e["type"] == "Ins"
    written = _written(v["ac"], F.when(ins, first).otherwise(first - 1), stated, _text(e["alt"]))
    return F.when(v["start"].isNull() | e["type"].isin("Dup", "Inv"), "ERR:SPDI").when(e["type"].isin("RefAlt", "Del", "Ins"), written).otherwise("UnsupportedType")


def _two_texts(ours: Column, truth: Column, around: int) -> tuple[Column, Column, Column, dict[str, Column]]:
    """Whether two texts can be compared, the window that covers both, and their parts."""
    part = lambda x, k: F.get(F.split(x, ":"), F.lit(k))
    at = lambda x: part(x, 1).try_cast("int")
    low = F.greatest(F.least(at(ours), at(truth)) - around, F.lit(0))
    high = F.greatest(at(ours) + F.length(part(ours, 2)), at(truth) + F.length(part(truth, 2))) + around
    readable = (F.size(F.split(ours, ":")) == 4) & (F.size(F.split(truth, ":")) == 4) & at(ours).isNotNull() & at(truth).isNotNull() & (part(ours, 0) == part(truth, 0))
    return F.coalesce(readable, F.lit(False)), low, high, {"at": at, "part": part}


def _same_after(ours: Column, truth: Column, bases: Column, low: Column, tools: dict) -> Column:
    at, part = tools["at"], tools["part"]
    applied = lambda x, w: F.concat(piece(w["bases"], F.lit(0), at(x) - w["low"]), part(x, 3), w["bases"].substr(at(x) - w["low"] + F.length(part(x, 2)) + 1, F.length(w["bases"])))
    return computed_once(F.struct(bases.alias("bases"), low.alias("low")), lambda w: applied(ours, w) == applied(truth, w))


def spdi_equivalent(ours: Column, truth: Column, seq: Column, around: int = 50) -> Column:
    """Whether two texts change the sequence in the same way: both are applied to the window that covers them and ``around`` bases on each side. False for different accessions and texts that can't be read, null without a sequence."""
    readable, low, high, tools = _two_texts(ours, truth, around)
    return F.when(~readable, False).when(seq.isNotNull(), _same_after(ours, truth, piece(seq, low, high), low, tools))


def spdi_differences(df: DataFrame, reference: Reference, ours: str = "ours_spdi", truth: str = "spdi") -> DataFrame:
    """mismatches, equivalent, real: one row of counts over pairs of texts that differ; absent texts and errors don't count."""
    told = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).startswith("ERR:")
    readable, low, high, tools = _two_texts(F.col(ours), F.col(truth), 50)
    rows = df.where(told(ours) & told(truth) & (F.col(ours) != F.col(truth))).select(ours, truth, readable.alias("_ok"), low.alias("_low"), high.alias("_high"))
    rows = stored(rows.withColumn("_key", F.when(F.col("_ok"), F.substring_index(F.col(truth), ":", 1))), "texts")
    rows = with_bases(with_window(rows, reference.windows, F.col("_key"), F.col("_low"), F.col("_low"), "_w"), reference.windows, F.col("_key"), F.col("_low"), F.col("_high"), "_bases")
    same = F.coalesce(F.col("_w").isNotNull() & _same_after(F.col(ours), F.col(truth), F.col("_bases"), F.col("_low"), tools), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("mismatches"), F.count_if(same).alias("equivalent"), F.count_if(~same).alias("real"))
