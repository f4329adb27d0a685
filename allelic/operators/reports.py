"""Reports on validated variants.

A validated row has the truth (variant_nuc, variant_prot, spdi) and what two tools made of it: ours_p, ours_spdi,
theirs_p and theirs_spdi, where errors are texts that start with ERR. Rules are ordered: the first that holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelic.functions.text import clean_protein, clean_silent, edit_kind, exact_match, fuzzy_match, spdi_difference


def _has(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(part)), F.lit(False))


def accuracy(df: DataFrame, ours: str, theirs: str, truth: str) -> DataFrame:
    """total, ours_ok, theirs_ok, ours_pct, theirs_pct, ours_leads: one row."""
    a, b = exact_match(F.col(ours), F.col(truth)), exact_match(F.col(theirs), F.col(truth))
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("ours_ok"), F.count_if(b).alias("theirs_ok"))
    share = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("total"), F.lit(1)), 2)
    return out.select("*", share("ours_ok").alias("ours_pct"), share("theirs_ok").alias("theirs_pct"), (F.col("ours_ok") >= F.col("theirs_ok")).alias("ours_leads"))


def contingency(df: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    """outcome (both, ours_only, theirs_only, neither), n."""
    outcome = F.when(ours & theirs, "both").when(ours, "ours_only").when(theirs, "theirs_only").otherwise("neither")
    return df.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def identity_counts(df: DataFrame, ours_level: str = "ours_level", theirs_level: str = "theirs_level") -> DataFrame:
    """total, ours_identity, ours_analogous, theirs_identity, theirs_analogous: cleaned texts that are equal, and others whose level is Identity or Analogous; one row."""
    counts = [F.count(F.lit(1)).alias("total")]
    for who, level in (("ours", ours_level), ("theirs", theirs_level)):
        p, t = F.coalesce(F.col(f"{who}_p"), F.lit("")), F.coalesce("variant_prot", F.lit(""))
        plain = lambda c: F.when(c.startswith("ERR:") | (c == "ERR"), c).otherwise(clean_protein(c))
        same = plain(p) == plain(t)
        usable = (p != "") & ~p.startswith("ERR") & (t != "") & ~t.startswith("ERR")
        counts += [F.count_if(same).alias(f"{who}_identity"), F.count_if(~same & usable & F.coalesce(F.col(level).isin("Identity", "Analogous"), F.lit(False))).alias(f"{who}_analogous")]
    return df.agg(*counts)


def failure_category(df: DataFrame) -> Column:
    """Why our protein text or SPDI isn't the true one."""
    ours, nuc, p, spdi = F.col("ours_p"), F.col("variant_nuc"), F.col("variant_prot"), F.col("spdi")
    wrong_p, wrong_s = ~fuzzy_match(ours, p), ~F.col("ours_spdi").eqNullSafe(spdi)
    return (
        F.when(ours.startswith("ERR:RefMismatch"), "RefSeq Data Mismatch").when(ours.startswith("ERR:Validate"), "Coordinate Out of Bounds").when(ours.startswith("ERR:Parse"), "Parsing Error")
        .when(wrong_p & wrong_s & _has(p, "Ter") & ~_has(ours, "Ter"), "Protein: Stop Codon Logic").when(wrong_p & wrong_s & _has(p, "fs") & ~_has(ours, "fs"), "Protein: Frameshift Logic")
        .when(wrong_p & wrong_s & _has(spdi, "del") & _has(spdi, "ins"), "Complex Indel").when(wrong_p & wrong_s, "General Mapping Failure")
        .when(wrong_p & _has(ours, "Ter?"), "Protein: Uncertain Stop").when(wrong_p, "Protein: Translation/Formatting")
        .when(wrong_s & (_has(spdi, "dup") | _has(nuc, "dup")), "Genomic: Duplication Shifting").when(wrong_s, "Genomic: Normalization/Projection").otherwise("Unknown")
    )


def classification(level_truth: str = "level_truth", level_theirs: str = "level_theirs", consistent: str = "consistent") -> Column:
    """Class of a validated row with the levels of our text against the truth's and the other tool's (null where they can't be compared), and whether the nucleotide variant gives our text."""
    ours, theirs, truth, nuc = (F.coalesce(c, F.lit("")) for c in ("ours_p", "theirs_p", "variant_prot", "variant_nuc"))
    a, b, t = (clean_silent(c) for c in (ours, theirs, truth))
    near = lambda c: F.coalesce(F.col(c).isin("Identity", "Analogous"), F.lit(False))
    sure = F.when(F.col(consistent), "(Consistent)").otherwise("(Inconsistent)")
    failed = (ours == "ERR") | ours.startswith("ERR:")
    last = F.when(F.contains(ours, F.lit(":")), F.ltrim(F.element_at(F.split(ours, ":"), -1))).otherwise("Generic")
    either = lambda part: F.contains(ours, F.lit(part)) | F.contains(truth, F.lit(part))
    return (
        F.when((a != "") & (a == t), F.concat(F.lit("ClinVar Match "), sure))
        .when(near(level_truth), F.concat(F.lit("Biological Equivalence ("), F.col(level_truth), F.lit(") "), sure, F.lit(" - ClinVar")))
        .when((a != "") & (a == b), "Parity Match (Not Analogous to GT)").when(near(level_theirs), F.concat(F.lit("Biological Equivalence ("), F.col(level_theirs), F.lit(") - Parity")))
        .when(failed & F.contains(ours, F.lit("Transcript")) & F.contains(ours, F.lit("not found")), "Provider Error (Missing Transcript)")
        .when(failed & F.contains(ours, F.lit("TranscriptMismatch")), "Error: Reference sequence mismatch").when(failed, F.concat(F.lit("Error: "), last))
        .when(either("fs"), "Frameshift Difference").when(either("delins"), "AA Mismatch (delins)")
        .when(F.contains(nuc, F.lit("[")) | F.contains(nuc, F.lit("dup")), "Repeat/Duplication Mismatch").when(either("*"), "Nonsense Notation Mismatch").otherwise("Other Mismatch")
    )


def is_success(category: Column) -> Column:
    """Whether a class counts as a success."""
    return F.contains(category, F.lit("ClinVar")) & (F.contains(category, F.lit("Match")) | F.contains(category, F.lit("Biological Equivalence")))


def class_counts(df: DataFrame, category: Column) -> DataFrame:
    """category, n, success, share: percent of all rows for successes, of all failures for the others."""
    out = df.select(category.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("success", is_success(F.col("category")))
    # the window runs over one row for each category
    side = Window.partitionBy("success")
    whole = F.when(F.col("success"), F.sum("n").over(Window.partitionBy(F.lit(1)))).otherwise(F.sum("n").over(side))
    return out.withColumn("share", F.round(100.0 * F.col("n") / whole, 2))


def categories(df: DataFrame, category: Column) -> DataFrame:
    """category, n, share (percent of all rows)."""
    out = df.select(category.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over one row for each category
    return out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def samples(df: DataFrame, category: Column, order: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each category."""
    ranked = df.withColumn("category", category).withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def of_category(df: DataFrame, category: Column, wanted: str, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows of one category."""
    return df.where(category == wanted).orderBy(*order).limit(n)


def disagreements(df: DataFrame) -> DataFrame:
    """Rows whose protein text (fuzzily) or SPDI of ours isn't the true one."""
    return df.where(~fuzzy_match(F.col("ours_p"), F.col("variant_prot")) | ~F.col("ours_spdi").eqNullSafe(F.col("spdi")))


def first_failures(df: DataFrame, ours_ok: Column, theirs_ok: Column, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows that only the other tool gets right."""
    return df.where(theirs_ok & ~ours_ok).orderBy(*order).limit(n)


def spdi_reasons(df: DataFrame) -> DataFrame:
    """reason, n: of wrong SPDI texts the unsupported operations, other errors, and real mismatches (also by the kind of edit)."""
    ours = F.col("ours_spdi")
    head = "ERR:Unsupported operation: "
    reasons = (
        F.when(ours.startswith("ERR:Unsupported operation"), F.array(F.when(ours.startswith(head), F.substring_index(F.substring(ours, len(head) + 1, 1 << 30), head, 1)).otherwise("")))
        .when(ours.startswith("ERR:"), F.array(F.concat(F.lit("Other ERR: "), F.get(F.split(ours, ":"), F.lit(1)))))
        .otherwise(F.array(F.lit("Real Mismatch"), F.concat(F.lit("Mismatch: "), edit_kind(F.col("variant_nuc")))))
    )
    return df.where(~ours.eqNullSafe(F.col("spdi"))).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def real_mismatches(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows with a wrong SPDI text that isn't an error."""
    return df.where(~F.col("ours_spdi").eqNullSafe(F.col("spdi")) & ~F.col("ours_spdi").startswith("ERR:")).orderBy(*order).limit(n)


def other_tool(ours: Column, theirs: Column, truth: Column) -> Column:
    """What the other tool does where our SPDI text is wrong."""
    return F.when(theirs == truth, "Matched ClinVar").when(theirs == ours, "Shared Mismatch").when(theirs.startswith("ERR:"), "Error").otherwise("Unique Mismatch")


def spdi_mismatches(df: DataFrame) -> DataFrame:
    """category, behaviour, n: of wrong SPDI texts the first part that differs, and what the other tool does."""
    rows = df.where(~F.col("ours_spdi").eqNullSafe(F.col("spdi")))
    return rows.groupBy(spdi_difference(F.col("ours_spdi"), F.col("spdi")).alias("category"), other_tool(F.col("ours_spdi"), F.col("theirs_spdi"), F.col("spdi")).alias("behaviour")).agg(F.count(F.lit(1)).alias("n"))


def unsupported(df: DataFrame) -> DataFrame:
    """behaviour, n: what the other tool does where we don't support the operation."""
    theirs = F.col("theirs_spdi")
    outcome = F.when(theirs == F.col("spdi"), "Matched ClinVar").when(theirs.startswith("ERR:"), "Error").otherwise("Unique Mismatch")
    return df.where(F.col("ours_spdi").startswith("ERR:Unsupported operation")).groupBy(outcome.alias("behaviour")).agg(F.count(F.lit(1)).alias("n"))


def latest_by(df: DataFrame, key: str, newest: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(newest).desc()))).where("_n = 1").drop("_n")


def stats_json(counts: DataFrame) -> DataFrame:
    """One row with the counts as a JSON object."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("stats"))
