"""Reference data as a bundle of DataFrames, and the lookups that are joins on them.

* sequences: ac, seq
* transcripts: ac, reference, gene, strand, cds_start, cds_end (index of the last coding base), exons (in transcript
  order: start0 and end0 on the reference, both included, and strand), protein, tx_start and tx_end (from 1)
* spliced: ac, reference, tx_seq
* best: the transcripts' rows, one for each accession (see ``preferred``)
* proteins: ac, residues: what the preferred transcripts code for
* windows: key, part, bases, size: both kinds of sequences by chunk; spliced ones have the key ``spliced_key``

All lookups are equi joins on accessions, so Catalyst broadcasts a bundle that is small and shuffles one that is not.
Lookups that find nothing leave nulls; operators turn those into error structs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from allelic.functions.sequence import piece, reverse_complement, spliced, translated
from allelic.operators.windows import chunked_windows
from allelic.sources.stage import stored

Table = DataFrame | Callable[[], DataFrame]

class Reference:
    """Each table is a DataFrame or a function that gives one, called when the table is first asked for: what nothing asks for isn't built."""

    def __init__(self, sequences: Table, transcripts: Table, spliced: Table | None = None, windows: Table | None = None, best: Table | None = None, proteins: Table | None = None):
        self._tables = {
            "sequences": sequences, "transcripts": transcripts,
            "spliced": spliced if spliced is not None else lambda: splice(self.transcripts, self.sequences),
            "windows": windows if windows is not None else lambda: windows_of(self.sequences, self.spliced),
            "best": best if best is not None else lambda: preferred(self.transcripts),
            "proteins": proteins if proteins is not None else lambda: coded_proteins(self.best, self.spliced),
        }

    def _table(self, name: str) -> DataFrame:
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    sequences = property(lambda self: self._table("sequences"))
    transcripts = property(lambda self: self._table("transcripts"))
    spliced = property(lambda self: self._table("spliced"))
    windows = property(lambda self: self._table("windows"))
    best = property(lambda self: self._table("best"))
    proteins = property(lambda self: self._table("proteins"))


def spliced_key(ac: Column, reference: Column) -> Column:
    """Of a transcript's sequence among the chunks: a transcript has one for each sequence that it lies on."""
    return F.concat(ac, F.lit("@"), reference)


def windows_of(sequences: DataFrame, spliced: DataFrame) -> DataFrame:
    """The chunks of reference sequences and of spliced ones."""
    tx = spliced.select(spliced_key(F.col("ac"), F.col("reference")).alias("ac"), F.col("tx_seq").alias("seq"))
    return chunked_windows(sequences.select("ac", "seq")).unionByName(chunked_windows(tx.where("seq is not null")))


def coded_proteins(best: DataFrame, spliced: DataFrame) -> DataFrame:
    """ac, residues of each protein: the coding region of its transcript (of several the first), translated to its end, the stop included."""
    # models are small beside the sequences, which then needn't be sorted
    rows = best.where("protein is not null and cds_start is not null and cds_end is not null").hint("shuffle_hash").join(spliced, ["ac", "reference"])
    coding = F.upper(piece(F.col("tx_seq"), F.col("cds_start"), F.col("cds_end") + 1))
    return rows.groupBy(F.col("protein").alias("ac")).agg(F.min_by(translated(coding), F.col("ac")).alias("residues"))


def error(kind: str, message: Column | str) -> Column:
    """An error as a value."""
    return F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def splice(transcripts: DataFrame, sequences: DataFrame) -> DataFrame:
    """ac, reference, tx_seq: the exons' bases in transcript order, reverse complemented on minus exons."""
    rows = transcripts.select("ac", "reference", "exons").hint("shuffle_hash").join(sequences.select(F.col("ac").alias("reference"), "seq"), "reference")
    bases = F.transform("exons", lambda e: F.when(e["strand"] == -1, reverse_complement(F.col("seq").substr(e["start0"] + 1, e["end0"] - e["start0"] + 1))).otherwise(F.col("seq").substr(e["start0"] + 1, e["end0"] - e["start0"] + 1)))
    return rows.select("ac", "reference", spliced(bases).alias("tx_seq"))


def preferred(transcripts: DataFrame) -> DataFrame:
    """One row for each accession: on the first primary chromosome (NC_0000..), else on the first reference."""
    rank = F.when(F.col("reference").startswith("NC_0000"), 0).otherwise(1)
    best = transcripts.groupBy("ac").agg(F.min_by(F.struct(*transcripts.columns), F.struct(rank, "reference")).alias("_best"))
    return best.select("_best.*")


def with_transcript(df: DataFrame, reference: Reference, ac: Column, on: Column | None = None, sequence: bool = False, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``tx`` (a transcript's row as a struct, null if there is none): that on the reference asked for, else the preferred one; with what ``made`` adds to each transcript with its sequence."""
    rows, best = reference.transcripts, reference.best
    if sequence:
        rows, best = (x.join(reference.spliced, ["ac", "reference"], "left") for x in (rows, best))
    if made is not None:
        rows, best = made(rows), made(best)
    columns = rows.columns
    best = best.select(F.col("ac").alias("_ac"), F.struct(*columns).alias("_best"))
    out = df.withColumn("_key", ac)
    if not sequence:
        best = best.hint("shuffle_hash")  # models are small beside the rows, which then needn't be sorted
    if on is None:
        return out.join(best, F.col("_key") == F.col("_ac"), "left").withColumnRenamed("_best", "tx").drop("_key", "_ac")
    exact = rows.select(F.col("ac").alias("_xac"), F.col("reference").alias("_xref"), F.struct(*columns).alias("_exact"))
    out = out.withColumn("_on", on)
    if sequence:
        out = out.join(exact, (F.col("_key") == F.col("_xac")) & (F.col("_on") == F.col("_xref")), "left").join(best, F.col("_key") == F.col("_ac"), "left")
        return out.withColumn("tx", F.coalesce("_exact", "_best")).drop("_key", "_ac", "_best", "_on", "_xac", "_xref", "_exact")
    # a transcript lies on few references: its rows are put together, so that each row of ``df`` is moved once
    placed = exact.groupBy(F.col("_xac").alias("_ac")).agg(F.array_sort(F.collect_list("_exact")).alias("_all"))
    both = best.join(placed, "_ac", "full").hint("shuffle_hash")
    out = out.join(both.withColumnRenamed("_ac", "_mac"), F.col("_key") == F.col("_mac"), "left")
    here = F.get(F.filter("_all", lambda x: x["reference"] == F.col("_on")), F.lit(0))
    return out.withColumn("tx", F.coalesce(here, F.col("_best"))).drop("_key", "_mac", "_best", "_on", "_all")


def with_transcript_where_asked(df: DataFrame, reference: Reference, ac: Column) -> DataFrame:
    """The same where ``ac`` isn't null. Rows without one meet no join: they would all have one key, which lands in one task. Rows are stored."""
    rows = stored(df.withColumn("_asked", ac), "asked")
    some, none = rows.where("_asked is not null"), rows.where("_asked is null").drop("_asked")
    none = none.withColumn("tx", F.lit(None).cast(StructType([StructField(f.name, f.dataType) for f in reference.best.schema])))
    return none if some.isEmpty() else with_transcript(some, reference, F.col("_asked")).drop("_asked").unionByName(none)


def with_sequence(df: DataFrame, reference: Reference, ac: Column, to: str = "seq") -> DataFrame:
    """Adds the sequence of an accession."""
    return df.withColumn("_key", ac).join(reference.sequences.select(F.col("ac").alias("_ac"), F.col("seq").alias(to)), F.col("_key") == F.col("_ac"), "left").drop("_key", "_ac")


def overlapping(df: DataFrame, transcripts: DataFrame, chrom: str, start: str, end: str, bin_size: int = 1 << 16) -> DataFrame:
    """Joins each row with the transcripts on ``chrom`` that its interval meets (both sides from 1, both included).

    Intervals are dealt into bins; bins are equi-joined and the condition is checked again in the first bin that both
    sides share, so each pair comes once and no side is scanned for every row of the other.
    """
    left = df.withColumn("_on", F.col(chrom)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    right = transcripts.withColumn("_tbin", F.explode(F.sequence(F.floor(F.col("tx_start") / bin_size), F.floor(F.col("tx_end") / bin_size))))
    right = right.select(F.col("reference").alias("_ref"), "_tbin", F.struct(*transcripts.columns).alias("tx")).hint("shuffle_hash")  # rows needn't be sorted
    on = (F.col("_on") == F.col("_ref")) & (F.col("_bin") == F.col("_tbin"))
    met = (F.col(start) <= F.col("tx.tx_end")) & (F.col(end) >= F.col("tx.tx_start"))
    first = F.col("_bin") == F.greatest(F.floor(F.col(start) / bin_size), F.floor(F.col("tx.tx_start") / bin_size))
    return left.join(right, on).where(met & first).drop("_bin", "_tbin", "_on", "_ref")


def symbols_expanded(df: DataFrame, transcripts: DataFrame, symbol: Column, target: str = "transcript") -> DataFrame:
    """Adds ``accession``: of a gene the accessions of its transcripts (or their proteins), else the text itself; 1 row to many."""
    of_gene = transcripts.select(F.col("gene").alias("_gene"), F.col("ac" if target == "transcript" else "protein").alias("_found")).where("_gene is not null and _found is not null").distinct()
    return df.withColumn("_symbol", symbol).join(of_gene, F.col("_symbol") == F.col("_gene"), "left").withColumn("accession", F.coalesce("_found", "_symbol")).drop("_symbol", "_gene", "_found")
