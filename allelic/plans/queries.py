"""Queries of the variant engine over the input tables, each with SQL that computes the same another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelic.functions import coordinates, sequence, text
from allelic.functions.format import format_column, format_variant
from allelic.functions.parse import with_variant
from allelic.operators import consequence, equivalence, mapping, normalize, reports, validate, windows
from allelic.operators import reference as ref
from allelic.plans import synth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(body: str) -> str:
    return f"WITH {synth.SQL} {body}"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_variant(synth.variant_texts(spark, sf_dir), "hgvs", kinds="g")


def _genomic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ref.Reference]:
    """Keys and variants alone, and what genomic variants are looked up in."""
    return _parsed(spark, sf_dir).select(*KEY, "variant"), synth.reference(spark, sf_dir, of_transcripts=False)


def _with_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole sequences, for functions of a sequence."""
    return with_variant(synth.variants(spark, sf_dir), "hgvs", kinds="g")


# scalar functions of sequences


@query(_with("SELECT ac, reverse(translate(seq, 'ACGTacgtUu', 'TGCAtgcaAa')) AS rc, translate(seq, 'Tt', 'Uu') AS rna FROM genome"))
def q_revcomp(spark, sf_dir):
    return synth.genome(spark, sf_dir).select("ac", sequence.reverse_complement(F.col("seq")).alias("rc"), sequence.transcribe(F.col("seq")).alias("rna"))


_CODON_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sequence.codons().items()) + "}"


def _translate_sql(seq: str) -> str:
    return f"array_to_string(list_transform(range(length({seq}) // 3), lambda i: coalesce({_CODON_SQL}[substring({seq}, CAST(3 * i + 1 AS BIGINT), 3)], 'X')), '')"


@query(_with(f"SELECT ac, p AS residues, CASE WHEN instr(p, '*') > 0 THEN substring(p, 1, instr(p, '*')) ELSE p END AS to_stop FROM (SELECT ac, {_translate_sql('seq')} AS p FROM genome)"))
def q_translate(spark, sf_dir):
    s = F.col("seq")
    return synth.genome(spark, sf_dir).select("ac", sequence.translated(s).alias("residues"), sequence.translated_to_stop(s).alias("to_stop"))


_NAMES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (sequence.NAMES | {"*": "Ter"}).items()) + "}"


@query(_with(f"SELECT ac, array_to_string(list_transform(list_filter(string_split(p, ''), lambda c: c <> ''), lambda c: coalesce({_NAMES_SQL}[c], 'Xaa')), '') AS named, len(p) AS n_residues FROM (SELECT ac, {_translate_sql('seq')} AS p FROM genome)"))
def q_residue_names(spark, sf_dir):
    """Names of codes, and codes of names again."""
    rows = synth.genome(spark, sf_dir).select("ac", sequence.translated(F.col("seq")).alias("p"))
    rows = rows.select("ac", sequence.named_all(F.col("p")).alias("named"))
    return rows.select("ac", "named", F.size(sequence.residues(F.col("named"))).cast("long").alias("n_residues"))


@query("SELECT p_partkey, substring(p_type, 1, 3) AS name, CASE WHEN lower(substring(p_type, 1, 3)) = 'pro' THEN 'P' ELSE 'X' END AS code FROM part")
def q_residue_code(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.substring("p_type", 1, 3).alias("name"), sequence.residue_code(F.substring("p_type", 1, 3)).alias("code"))


def _lcp(a: str, b: str) -> str:
    """Common prefix; compared in full only if the first 24 are equal."""

    def full(a: str, b: str) -> str:
        return f"coalesce(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, CAST(i AS BIGINT), 1) = substring({b}, CAST(i AS BIGINT), 1)), false) - 1, least(length({a}), length({b})))"

    x, y = f"substring({a}, 1, 24)", f"substring({b}, 1, 24)"
    return f"CASE WHEN {x} = {y} THEN {full(a, b)} ELSE {full(x, y)} END"


@query(_with(f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(pos0 + p AS INTEGER) AS s_start, substring(r, 1, length(r) - s) AS s_ref, substring(a, 1, length(a) - s) AS s_alt FROM (
  SELECT *, {_lcp('reverse(r)', 'reverse(a)')} AS s FROM (
    SELECT *, substring(x, p + 1) AS r, substring(y, p + 1) AS a FROM (
      SELECT *, {_lcp('x', 'y')} AS p FROM (SELECT *, substring(seq, pos0 + 1, 12) AS x, substring(seq, pos0 + 1 + len, 12) AS y FROM v))))"""))
def q_strip_affixes(spark, sf_dir):
    near, at = F.col("near"), F.col("ahead")
    s = sequence.stripped(F.col("pos0"), near.substr(at + 1, F.lit(12)), near.substr(at + 1 + F.col("len"), F.lit(12)))
    return synth.variant_rows(spark, sf_dir).withColumn("s", s).select(*KEY, F.col("s.start").alias("s_start"), F.col("s.ref").alias("s_ref"), F.col("s.alt").alias("s_alt"))


@query(_with("SELECT l_orderkey, l_linenumber, l_partkey, reverse(translate(alt, 'ACGT', 'TGCA')) AS alt_rc FROM v"))
def q_complement_edit(spark, sf_dir):
    return _parsed(spark, sf_dir).select(*KEY, sequence.reverse_complement(F.col("variant.edit.alt")).alias("alt_rc"))


# parsing and formatting


@query(_with("""
SELECT l_orderkey, l_linenumber, l_partkey, 'g' AS coord, ac, CAST(pos0 + 1 AS INTEGER) AS first,
  CAST(CASE WHEN kind = 2 THEN pos0 + 2 WHEN len > 1 AND kind <> 0 THEN pos0 + len ELSE 0 END AS INTEGER) AS last,
  CASE kind WHEN 0 THEN 'RefAlt' WHEN 1 THEN 'Del' WHEN 2 THEN 'Ins' WHEN 3 THEN 'Dup' WHEN 4 THEN 'Inv' WHEN 5 THEN 'RefAlt' ELSE 'Repeat' END AS edit,
  CASE kind WHEN 0 THEN substring(ref, 1, 1) WHEN 5 THEN '' WHEN 6 THEN ref END AS ref, alt FROM v"""))
def q_parse_g(spark, sf_dir):
    v = F.col("variant")
    return _parsed(spark, sf_dir).select(*KEY, v["coord"].alias("coord"), v["ac"].alias("ac"), v["start"]["base"].alias("first"), F.coalesce(v["end"]["base"], F.lit(0)).alias("last"), v["edit"]["type"].alias("edit"), v["edit"]["ref"].alias("ref"), v["edit"]["alt"].alias("alt"))


_C_TEXTS = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '-' WHEN o_orderkey % 3 = 1 THEN '' ELSE '*' END AS lead, CAST(1 + o_custkey % 500 AS INTEGER) AS b,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 40 - 20 AS INTEGER) END AS off FROM orders"""


@query(f"""
SELECT o_orderkey, CASE WHEN lead = '-' THEN -b ELSE b END AS base, coalesce(off, 0) AS offset, CASE WHEN lead = '*' THEN 'CdsEnd' ELSE 'CdsStart' END AS anchor,
  'NM_1.2(GENE-A):c.' || lead || CAST(b AS VARCHAR) || coalesce(CASE WHEN off >= 0 THEN '+' ELSE '' END || CAST(off AS VARCHAR), '') || 'A>G' AS text FROM ({_C_TEXTS})""")
def q_parse_c(spark, sf_dir):
    """Coding positions with offsets, read and written again."""
    rows = _c_texts(spark, sf_dir)
    rows = with_variant(rows, "t")
    v = F.col("variant")
    return rows.select("o_orderkey", v["start"]["base"].alias("base"), F.coalesce(v["start"]["offset"], F.lit(0)).alias("offset"), v["start"]["anchor"].alias("anchor"), format_variant(v).alias("text"))


def _c_texts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lead = F.when(F.col("o_orderkey") % 3 == 0, "-").when(F.col("o_orderkey") % 3 == 1, "").otherwise("*")
    off = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 40 - 20)
    return o.select("o_orderkey", F.concat(F.lit("NM_1.2(GENE-A):c."), lead, (1 + F.col("o_custkey") % 500).cast("string"), F.coalesce(F.concat(F.when(off >= 0, "+").otherwise(""), off.cast("string")), F.lit("")), F.lit("A>G")).alias("t"))


_AA = "".join(sequence.NAMES)


@query(f"""
SELECT o_orderkey, 'NP_1.1:p.' || CASE WHEN k = 0 THEN '(' ELSE '' END || a || CAST(b AS VARCHAR) ||
  CASE o_orderkey % 5 WHEN 0 THEN z WHEN 1 THEN 'del' WHEN 2 THEN z || 'fsTer' || CAST(b AS VARCHAR) WHEN 3 THEN 'Ter' ELSE '=' END || CASE WHEN k = 0 THEN ')' ELSE '' END AS text FROM (
  SELECT o_orderkey, o_orderkey % 2 AS k, 1 + o_custkey % 900 AS b, {_NAMES_SQL}[substring('{_AA}', CAST(1 + o_orderkey % 20 AS BIGINT), 1)] AS a, {_NAMES_SQL}[substring('{_AA}', CAST(1 + o_custkey % 20 AS BIGINT), 1)] AS z FROM orders)""")
def q_parse_p(spark, sf_dir):
    """Protein variants in one-letter codes, written with names."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, z = F.lit(_AA).substr((1 + F.col("o_orderkey") % 20).cast("int"), F.lit(1)), F.lit(_AA).substr((1 + F.col("o_custkey") % 20).cast("int"), F.lit(1))
    b, m = (1 + F.col("o_custkey") % 900).cast("string"), F.col("o_orderkey") % 5
    edit = F.when(m == 0, z).when(m == 1, "del").when(m == 2, F.concat(z, F.lit("fs*"), b)).when(m == 3, "*").otherwise("=")
    k = F.col("o_orderkey") % 2 == 0
    rows = o.select("o_orderkey", F.concat(F.lit("NP_1.1:p."), F.when(k, "(").otherwise(""), a, b, edit, F.when(k, ")").otherwise("")).alias("t"))
    return with_variant(rows, "t").select("o_orderkey", format_variant(F.col("variant")).alias("text"))


@query(_with("""SELECT l_orderkey, l_linenumber, l_partkey, ac || ':g.' || CASE kind
  WHEN 0 THEN p || substring(ref, 1, 1) || '>' || alt WHEN 1 THEN s || 'del' WHEN 2 THEN p || '_' || CAST(pos0 + 2 AS VARCHAR) || 'ins' || alt WHEN 3 THEN s || 'dup' WHEN 4 THEN s || 'inv'
  WHEN 5 THEN s || 'delins' || alt ELSE s || ref || '[3]' END AS text FROM (
  SELECT *, CAST(pos0 + 1 AS VARCHAR) AS p, CAST(pos0 + 1 AS VARCHAR) || CASE WHEN len > 1 THEN '_' || CAST(pos0 + len AS VARCHAR) ELSE '' END AS s FROM v)"""))
def q_format_roundtrip(spark, sf_dir):
    return _parsed(spark, sf_dir).select(*KEY, format_variant(F.col("variant")).alias("text"))


# coordinates


@query("SELECT event_id, CAST(user_id AS INTEGER) - 50 AS i, CASE WHEN user_id - 50 >= 0 THEN CAST(user_id AS INTEGER) - 49 ELSE CAST(user_id AS INTEGER) - 50 END AS hgvs, CAST(user_id AS INTEGER) - 50 AS back FROM events")
def q_coord_zero_skip(spark, sf_dir):
    i = F.col("user_id").cast("int") - 50
    h = coordinates.transcript_of_index(i)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", i.alias("i"), h.alias("hgvs"), coordinates.index_of_transcript(h).alias("back"))


@query(_with("""SELECT tx_ac AS ac, CAST(o AS INTEGER) AS ord, CAST(20 + k * th AS INTEGER) AS start0, CAST(20 + k * th + sz - 1 AS INTEGER) AS end0, CAST(o * sz AS INTEGER) AS ahead FROM (
  SELECT *, CASE WHEN strand = 1 THEN o ELSE 2 - o END AS k FROM (SELECT *, unnest([0, 1, 2]) AS o FROM tx))"""))
def q_exon_offsets(spark, sf_dir):
    return mapping.exon_offsets(synth.transcripts(synth.genome(spark, sf_dir))).drop("reference")


_G_TO_N = """
SELECT l_orderkey, l_linenumber, l_partkey, n, o FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY inside DESC, d, ord) AS r FROM (
    SELECT rid, l_orderkey, l_linenumber, l_partkey, ord, CASE WHEN g BETWEEN s AND e THEN 1 ELSE 0 END AS inside, least(abs(g - s), abs(g - e)) AS d,
      CASE WHEN g BETWEEN s AND e THEN ord * sz + CASE WHEN strand = 1 THEN g - s ELSE e - g END WHEN g < s THEN ord * sz ELSE ord * sz + sz - 1 END AS n,
      CASE WHEN g BETWEEN s AND e THEN 0 WHEN strand = 1 THEN CASE WHEN g < s THEN g - s ELSE g - e END ELSE CASE WHEN g < s THEN s - g ELSE e - g END END AS o
    FROM (SELECT q.rid, q.l_orderkey, q.l_linenumber, q.l_partkey, q.pos0 AS g, t.strand, t.sz, x AS ord, 20 + CASE WHEN t.strand = 1 THEN x ELSE 2 - x END * t.th AS s, 20 + CASE WHEN t.strand = 1 THEN x ELSE 2 - x END * t.th + t.sz - 1 AS e
      FROM (SELECT *, row_number() OVER () AS rid FROM v) q JOIN tx t USING (doc_id), (SELECT unnest([0, 1, 2]) AS x)))) WHERE r = 1"""


def _mapped(spark, sf_dir):
    r = synth.transcripts(synth.genome(spark, sf_dir))
    return synth.variant_rows(spark, sf_dir).join(r.drop("ac", "reference"), "doc_id").withColumn("m", mapping.g_to_n(F.col("exons"), F.col("pos0")))


@query(_with(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(n AS INTEGER) AS n, CAST(o AS INTEGER) AS offset FROM ({_G_TO_N})"))
def q_g_to_n(spark, sf_dir):
    return _mapped(spark, sf_dir).select(*KEY, F.col("m.n").alias("n"), F.col("m.offset").alias("offset"))


@query(_with("""SELECT tx_ac, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n > cds_end THEN n - cds_end - 1 ELSE n - cds_start END AS INTEGER) AS base0, CASE WHEN n > cds_end THEN 'CdsEnd' ELSE 'CdsStart' END AS anchor, CAST(n AS INTEGER) AS back
  FROM (SELECT *, unnest(range(0, tx_len)) AS n FROM tx)"""))
def q_n_to_c(spark, sf_dir):
    rows = synth.transcripts(synth.genome(spark, sf_dir)).join(synth.genome(spark, sf_dir).select(F.col("ac").alias("reference"), F.length("seq").alias("size")), "reference")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), (3 * F.expr("size div 6") - 1).cast("int")))).withColumn("c", coordinates.n_to_c(F.col("n"), F.col("cds_start"), F.col("cds_end")))
    back = coordinates.c_to_n(F.col("c.base0"), F.col("c.anchor"), F.col("cds_start"), F.col("cds_end"))
    return rows.select(F.col("ac").alias("tx_ac"), "n", F.col("c.base0").alias("base0"), F.col("c.anchor").alias("anchor"), back.alias("back"))


@query(_with("""SELECT tx_ac, CAST(n AS INTEGER) AS n, CAST(CASE WHEN strand = 1 THEN 20 + k * th + i ELSE 20 + (2 - k) * th + sz - 1 - i END AS INTEGER) AS g FROM (
  SELECT *, n // sz AS k, n % sz AS i FROM (SELECT *, unnest(range(0, tx_len)) AS n FROM tx))"""))
def q_n_to_g(spark, sf_dir):
    g = synth.genome(spark, sf_dir)
    rows = synth.transcripts(g).join(g.select(F.col("ac").alias("reference"), F.length("seq").alias("size")), "reference")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), (3 * F.expr("size div 6") - 1).cast("int"))))
    return rows.select(F.col("ac").alias("tx_ac"), "n", mapping.n_to_g(F.col("exons"), F.col("n"), F.lit(0)).alias("g"))


def _coding_text(where: str, join: str) -> str:
    """Texts of variants on coding sequences, row by row: of the three exons the one that a position is in, else the nearest (of equally near ones the first), is the least of a list; no window, no join but that with the transcript."""
    start = "20 + CASE WHEN strand = 1 THEN x ELSE 2 - x END * th"
    nearest = lambda g: f"list_min(list_transform([0, 1, 2], lambda x: [CASE WHEN {g} BETWEEN {start} AND {start} + sz - 1 THEN 0 ELSE 1 END, least(abs({g} - ({start})), abs({g} - ({start} + sz - 1))), x]))[3]"

    def index(g: str, s: str, x: str) -> str:
        e = f"({s} + sz - 1)"
        n = f"{x} * sz + CASE WHEN {g} BETWEEN {s} AND {e} THEN CASE WHEN strand = 1 THEN {g} - {s} ELSE {e} - {g} END WHEN {g} < {s} THEN 0 ELSE sz - 1 END"
        o = f"CASE WHEN {g} BETWEEN {s} AND {e} THEN 0 ELSE strand * CASE WHEN {g} < {s} THEN {g} - {s} ELSE {g} - {e} END END"
        return f"{n} AS n{x[1]}, {o} AS o{x[1]}"

    place = lambda k: f"""CASE WHEN n{k} > cds_end THEN '*' || CAST(n{k} - cds_end AS VARCHAR) ELSE CAST(CASE WHEN n{k} - cds_start >= 0 THEN n{k} - cds_start + 1 ELSE n{k} - cds_start END AS VARCHAR) END || CASE WHEN o{k} > 0 THEN '+' || CAST(o{k} AS VARCHAR) WHEN o{k} < 0 THEN CAST(o{k} AS VARCHAR) ELSE '' END"""
    turned = lambda x: f"CASE WHEN strand = 1 THEN {x} ELSE reverse(translate({x}, 'ACGT', 'TGCA')) END"
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, tx_ac || ':c.' || {place(1)} || CASE WHEN g2 IS NULL THEN '' ELSE '_' || {place(2)} END || CASE kind WHEN 0 THEN {turned('substring(ref, 1, 1)')} || '>' || {turned('alt')} WHEN 1 THEN 'del' WHEN 2 THEN 'ins' || {turned('alt')}
  WHEN 3 THEN 'dup' WHEN 4 THEN 'inv' WHEN 5 THEN 'delins' || {turned('alt')} ELSE {turned('ref')} || '[3]' END AS coding FROM (
  SELECT *, {index('g1', 's1', 'x1')}, {index('g2', 's2', 'x2')} FROM (
    SELECT *, 20 + CASE WHEN strand = 1 THEN x1 ELSE 2 - x1 END * th AS s1, 20 + CASE WHEN strand = 1 THEN x2 ELSE 2 - x2 END * th AS s2 FROM (
      SELECT *, {nearest('g1')} AS x1, {nearest('g2')} AS x2 FROM (
        SELECT l_orderkey, l_linenumber, l_partkey, len, kind, ref, alt, tx_ac, strand, sz, th, cds_start, cds_end, pos0 AS g1, CASE WHEN kind = 2 THEN pos0 + 1 WHEN len > 1 AND kind <> 0 THEN pos0 + len - 1 END AS g2
        FROM v {join} (SELECT doc_id, tx_ac, strand, sz, th, cds_start, cds_end FROM tx) USING (doc_id) {where}))))"""


_G_TO_C_TEXT = _coding_text("", "LEFT JOIN")
#: The same for variants that meet the transcript.
_G_TO_C_ALL_TEXT = _coding_text("WHERE pos0 <= 20 + 2 * th + sz AND (CASE WHEN kind = 2 THEN pos0 + 2 WHEN len > 1 AND kind <> 0 THEN pos0 + len ELSE pos0 + 1 END) >= 21", "JOIN")


@query(_with(_G_TO_C_TEXT))
def q_g_to_c(spark, sf_dir):
    rows = _parsed(spark, sf_dir)
    tx = F.concat(F.lit("NM_"), F.substring("ac", 4, 100))
    return mapping.g_to_c(rows, synth.reference(spark, sf_dir), tx).select(*KEY, format_variant(F.col("coding")).alias("coding"))


@query(_with("SELECT l_orderkey, l_linenumber, l_partkey, CAST(count(*) AS BIGINT) AS n FROM v JOIN tx USING (doc_id) WHERE pos0 <= 20 + 2 * th + sz AND (CASE WHEN kind = 2 THEN pos0 + 2 WHEN len > 1 AND kind <> 0 THEN pos0 + len ELSE pos0 + 1 END) >= 21 GROUP BY ALL"))
def q_region_overlap_counts(spark, sf_dir):
    """Transcripts that each variant meets, by an interval join on bins."""
    rows = synth.variant_rows(spark, sf_dir)
    width = F.when(F.col("kind") == 2, 2).when((F.col("len") > 1) & (F.col("kind") != 0), F.col("len")).otherwise(1)
    rows = rows.select(*KEY, F.col("ac").alias("chrom"), F.col("pos0").alias("first"), (F.col("pos0") + width).alias("last"))
    return ref.overlapping(rows, synth.transcripts(synth.genome(spark, sf_dir)), "chrom", "first", "last", 512).groupBy(*KEY).agg(F.count("tx").alias("n"))


@query(_with("""SELECT tx_ac, ac || ':g.' || CAST(CASE WHEN strand = 1 THEN 21 + k * th + i ELSE 20 + (2 - k) * th + sz - i END AS VARCHAR) ||
  CASE WHEN strand = 1 THEN b || '>' || translate(b, 'ACGT', 'CGTA') ELSE translate(b, 'ACGT', 'TGCA') || '>' || translate(translate(b, 'ACGT', 'CGTA'), 'ACGT', 'TGCA') END AS genomic
  FROM (SELECT *, n // sz AS k, n % sz AS i, substring(tx_seq, n + 1, 1) AS b FROM (SELECT *, CAST(unnest(range(cds_start, cds_end + 1)) AS INTEGER) AS n FROM txs))"""))
def q_c_to_g(spark, sf_dir):
    # the variant itself isn't needed behind the lookup
    rows = with_variant(_c_substitutions(spark, sf_dir), "hgvs", kinds="c").select("variant", F.col("variant.ac").alias("tx_ac"))
    return mapping.c_to_g(rows, synth.reference(spark, sf_dir)).select("tx_ac", format_column("genomic").alias("genomic"))


def _c_substitutions(spark, sf_dir):
    rows, b = synth.coding_bases(spark, sf_dir), F.col("b")
    return rows.withColumn("hgvs", F.concat("ac", F.lit(":c."), (F.col("n") - F.col("cds_start") + 1).cast("string"), b, F.lit(">"), F.translate(b, "ACGT", "CGTA")))


# consequences


#: Published examples: transcripts (bounds of the coding region, bases) and the consequences expected of variants.
TOY = {
    "NM_999999.1": (9, 39, "AAAATCAAAATGAAAGCGAAAGCGTTTCGCGCGAAATAGGGG"),
    "NM_999997.1": (9, 39, "AAAATCAAAATGAAAGCGAAAGCGTTTCGCGTAGAATAGAGGAGGCAGTTTCGC"),
    "NM_999996.1": (9, 39, "AAAATCAAAATGAAATCGAAAGCGTTTCGCGCGAAATAGAGGAGGCAGTTTCGC"),
    "NM_999995.1": (9, 42, "AAAATCAAAATGAAAAAATCGAAAGCGTTTCGCGCGAAATAGAGGAGGCAGTTTCGC"),
    "NM_999994.1": (9, 45, "AAAATCAAAATGAAAAAAAAATCGAAAGCGTTTCGCGCGAAATAGAGGAGGCAGTTTCGC"),
    "NM_999993.1": (9, 39, "AAAATCAAAATGGGGAGGGCCCGGCAGCCAGCTTTATAGAGGAGGCAGTTTCGC"),
    "T1.1": (10, 19, "A" * 10 + "ATGAAATAG" + "ATGC" * 20),
    "T2.1": (0, 18, "ATGCAACAAGATGATTAA"),
    "T3.1": (0, 18, "ATGGCTGCATGCGATTAA"),
    "T6.1": (10, 50, "A" * 10 + "ATG" + "ATGC" * 25),
    "T8.1": (10, 20, "A" * 10 + "ATGGGGCCCAAA" + "A" * 100),
}
EXPECTED = {
    "NM_999999.1:c.6A>G": "p.(Lys2=)",
    "NM_999999.1:c.6A>T": "p.(Lys2Asn)",
    "NM_999996.1:c.8C>A": "p.(Ser3Ter)",
    "NM_999999.1:c.6_7insGGG": "p.(Lys2_Ala3insGly)",
    "NM_999999.1:c.22_23insT": "p.(Ala8ValfsTer?)",
    "NM_999999.1:c.8_9insTT": "p.(Lys4Ter)",
    "NM_999999.1:c.10_12del": "p.(Lys4del)",
    "NM_999999.1:c.4_15del": "p.(Lys2_Ala5del)",
    "NM_999995.1:c.4_6del": "p.(Lys3del)",
    "NM_999994.1:c.4_9del": "p.(Lys3_Lys4del)",
    "NM_999999.1:c.5_7del": "p.(Lys2_Ala3delinsThr)",
    "NM_999993.1:c.13_24del": "p.(Arg5_Ala8del)",
    "NM_999999.1:c.11_12del": "p.(Lys4SerfsTer?)",
    "NM_999997.1:c.7del": "p.(Ala3ArgfsTer6)",
    "NM_999999.1:c.11_12delinsTCCCA": "p.(Lys4delinsIlePro)",
    "NM_999999.1:c.11_18delinsTCCCA": "p.(Lys4_Phe6delinsIlePro)",
    "T1.1:c.4A>T": "p.(Lys2Ter)",
    "T2.1:c.4_9delinsCATTAA": "p.(Gln2_Gln3delinsHisTer)",
    "T3.1:c.4_6del": "p.(Ala3del)",
    "T3.1:c.15T>G": "p.(Asp5Glu)",
    "T6.1:c.1A>T": "p.(Met1Leu)",
    "T8.1:c.1A>G": "p.(Met1Val)",
}


def toy_reference(spark: SparkSession) -> ref.Reference:
    rows = [(k, "REF", "G", 1, a, z, [(0, len(s) - 1, 1)], "MOCK", 1, len(s)) for k, (a, z, s) in TOY.items()]
    models = spark.createDataFrame(rows, "ac string, reference string, gene string, strand int, cds_start int, cds_end int, exons array<struct<start0:int,end0:int,strand:int>>, protein string, tx_start int, tx_end int")
    spliced = spark.createDataFrame([(k, "REF", s) for k, (_, _, s) in TOY.items()], "ac string, reference string, tx_seq string")
    return ref.Reference(spark.createDataFrame([], "ac string, seq string"), models, spliced)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'MOCK:{v}')" for k, v in EXPECTED.items()) + ") t(hgvs, protein)")
def q_c_to_p_toy(spark, sf_dir):
    """Consequences of the published examples."""
    rows = with_variant(spark.createDataFrame([(k,) for k in EXPECTED], "hgvs string"), "hgvs")
    return consequence.c_to_p(rows, toy_reference(spark)).select("hgvs", "protein")


# normalization


_SHIFT = f"""
SELECT *, CASE WHEN kind IN (1, 3, 5) THEN {_lcp('substring(seq, s + 1)', 'substring(seq, e + 1)')}
  WHEN kind = 2 AND length(alt) = 1 THEN length(substring(seq, s + 1)) - length(ltrim(substring(seq, s + 1), alt)) ELSE 0 END AS k
FROM (SELECT *, CASE WHEN kind = 2 THEN pos0 + 1 ELSE pos0 END AS s, CASE WHEN kind = 2 THEN pos0 + 1 WHEN kind = 0 THEN pos0 + 1 ELSE pos0 + len END AS e FROM v)"""


@query(_with(f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(pos0 + 1 + k AS INTEGER) AS first,
  CASE WHEN kind IN (1, 3) THEN substring(seq, s + k + 1, len) WHEN kind = 0 THEN substring(ref, 1, 1) WHEN kind = 5 THEN '' WHEN kind = 6 THEN ref END AS ref FROM ({_SHIFT})"""))
def q_normalize(spark, sf_dir):
    return normalize.normalize(*_genomic(spark, sf_dir)).select(*KEY, F.col("normal.start.base").alias("first"), F.col("normal.edit.ref").alias("ref"))


_LEFT = f"""CASE WHEN kind IN (1, 3, 5) THEN {_lcp('reverse(substring(seq, 1, s))', 'reverse(substring(seq, 1, e))')}
  WHEN kind = 2 AND length(alt) = 1 THEN s - length(rtrim(substring(seq, 1, s), alt)) ELSE 0 END"""


@query(_with(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(s - {_LEFT} AS INTEGER) AS u_start, CAST(e + k AS INTEGER) AS u_end FROM ({_SHIFT})"))
def q_unambiguous_range(spark, sf_dir):
    rows = normalize.with_unambiguous_range(*_genomic(spark, sf_dir), to="u")
    return rows.select(*KEY, F.col("u.start").alias("u_start"), F.col("u.end").alias("u_end"))


@query(_with("""SELECT l_orderkey, l_linenumber, l_partkey, pos0 + 1 >= len AND substring(seq, pos0 + 2 - len, len) = alt AS is_dup FROM v WHERE kind = 2"""))
def q_ins_to_dup(spark, sf_dir):
    rows = _with_sequences(spark, sf_dir).where("kind = 2")
    return rows.select(*KEY, (normalize.insertion_as_duplication(F.col("variant"), F.col("seq"))["edit"]["type"] == "Dup").alias("is_dup"))


@query(_with("SELECT l_orderkey, l_linenumber, l_partkey, ref FROM v WHERE kind IN (1, 3)"))
def q_fill_implicit(spark, sf_dir):
    rows = _with_sequences(spark, sf_dir).where("kind in (1, 3)")
    return rows.select(*KEY, normalize.fill_implied(F.col("variant"), F.col("seq"))["edit"]["ref"].alias("ref"))


@query(_with("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN kind = 0 THEN substring(seq, pos0 + 2, 1) = substring(ref, 1, 1) ELSE true END AS valid FROM v"))
def q_validate_reference(spark, sf_dir):
    """Stated bases against the sequence one base further on: a window of at most 4 bases, which one chunk holds."""
    v, r = F.col("variant"), F.col("r")
    rows = _parsed(spark, sf_dir).withColumn("r", normalize.genomic_range(v))
    rows = rows.select(*KEY, "r", v["ac"].alias("ac"), F.struct(F.struct(v["edit"]["type"].alias("type"), v["edit"]["ref"].alias("ref")).alias("edit")).alias("variant"))
    rows = windows.with_window(rows, synth.sequence_windows(spark, sf_dir), F.col("ac"), r["start"] + 1, r["end"] + 1)
    return rows.select(*KEY, normalize.states_reference(v, F.col("window.bases"), F.lit(0), r["end"] - r["start"]).alias("valid"))


#: Without the common prefix, then without the common suffix.
_MINIMAL = f"""
SELECT *, CAST(pos0 + k + p AS VARCHAR) || ':' || substring(r, 1, length(r) - x) || ':' || substring(a, 1, length(a) - x) AS minimal FROM (
  SELECT *, {_lcp('reverse(r)', 'reverse(a)')} AS x FROM (
    SELECT * REPLACE (substring(r, p + 1) AS r, substring(a, p + 1) AS a) FROM (
      SELECT *, {_lcp('r', 'a')} AS p FROM (
        SELECT *, CASE kind WHEN 0 THEN substring(ref, 1, 1) WHEN 5 THEN substring(seq, s + k + 1, len) ELSE ref END AS r,
          CASE kind WHEN 4 THEN reverse(translate(ref, 'ACGT', 'TGCA')) WHEN 6 THEN repeat(ref, 3) ELSE alt END AS a FROM ({_SHIFT})))))"""


@query(_with(f"""SELECT l_orderkey, l_linenumber, l_partkey, ac || ':' || CASE kind
  WHEN 1 THEN CAST(s + k AS VARCHAR) || ':' || substring(seq, s + k + 1, len) || ':' WHEN 2 THEN CAST(pos0 + k AS VARCHAR) || '::' || alt WHEN 3 THEN CAST(e + k AS VARCHAR) || '::' || substring(seq, s + k + 1, len) ELSE minimal END AS spdi
  FROM ({_MINIMAL})"""))
def q_spdi(spark, sf_dir):
    return normalize.to_spdi(*_genomic(spark, sf_dir)).select(*KEY, "spdi")


#: An insertion replaces the base in front of it.
@query(_with(f"""SELECT l_orderkey, l_linenumber, l_partkey, ac || ':' || CASE
  WHEN kind IN (1, 3, 5) THEN CAST(s - w AS VARCHAR) || ':' || substring(seq, s - w + 1, e + k - s + w) || ':' || substring(seq, s - w + 1, k + w) || CASE kind WHEN 1 THEN '' WHEN 5 THEN alt ELSE repeat(substring(seq, s + k + 1, len), 2) END
  WHEN kind = 2 THEN CAST(pos0 + k AS VARCHAR) || ':' || substring(seq, pos0 + k + 1, 1) || ':' || alt
  ELSE CAST(pos0 AS VARCHAR) || ':' || CASE kind WHEN 0 THEN substring(ref, 1, 1) || ':' || alt WHEN 4 THEN ref || ':' || reverse(translate(ref, 'ACGT', 'TGCA')) ELSE ref || ':' || repeat(ref, 3) END END AS spdi
  FROM (SELECT *, {_LEFT} AS w FROM ({_SHIFT}))"""))
def q_spdi_unambiguous(spark, sf_dir):
    return normalize.to_spdi(*_genomic(spark, sf_dir), unambiguous=True).select(*KEY, "spdi")


# lookups and texts


@query("""SELECT DISTINCT id, CASE WHEN id LIKE 'NC\\_%' ESCAPE '\\' THEN 'genomic_accession' WHEN id LIKE 'NM\\_%' ESCAPE '\\' THEN 'transcript_accession' WHEN id LIKE 'NP\\_%' ESCAPE '\\' THEN 'protein_accession' WHEN id NOT LIKE '%:%' THEN 'gene_symbol' ELSE 'unknown' END AS kind
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'NC_' WHEN 1 THEN 'NM_' WHEN 2 THEN 'NP_' WHEN 3 THEN 'GENE' ELSE 'a:' END || CAST(c_custkey AS VARCHAR) AS id FROM customer)""")
def q_identifier_type(spark, sf_dir):
    m = F.col("c_custkey") % 5
    lead = F.when(m == 0, "NC_").when(m == 1, "NM_").when(m == 2, "NP_").when(m == 3, "GENE").otherwise("a:")
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(lead, F.col("c_custkey").cast("string")).alias("id")).distinct()
    return ids.select("id", text.identifier_type(F.col("id")).alias("kind"))


@query(_with("SELECT o_orderkey, s AS symbol, coalesce(tx_ac, s) AS accession FROM (SELECT o_orderkey, 'GENE' || CAST(o_custkey % 400 AS VARCHAR) AS s FROM orders) LEFT JOIN tx ON gene = s"))
def q_symbol_expand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("GENE"), (F.col("o_custkey") % 400).cast("string")).alias("symbol"))
    return ref.symbols_expanded(rows, synth.transcripts(synth.genome(spark, sf_dir)), F.col("symbol"))


_NORMAL_SQL = "translate({0}, '()?', '')"
for _c, _n in (sequence.NAMES | {"*": "Ter", "B": "Asx", "Z": "Glx", "X": "Xaa"}).items():
    _NORMAL_SQL = f"replace({_NORMAL_SQL}, '{_n}', '{_c}')"
_P_TEXT = f"""'NP_1.1:p.(' || {_NAMES_SQL}[substring('{_AA}', CAST(1 + o_orderkey % 20 AS BIGINT), 1)] || CAST(1 + o_custkey % 900 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN 'Ter' WHEN o_orderkey % 3 = 1 THEN '=' ELSE 'ValfsTer?' END || ')'"""


@query(f"""SELECT o_orderkey, {_NORMAL_SQL.format('t')} AS normal, replace(translate(string_split(t, ':')[-1], '()', ''), 'Ter', '*') AS clean,
  regexp_replace(replace(translate(string_split(t, ':')[-1], '()', ''), 'Ter', '*'), '^p\\.[A-Z][a-z]{{2}}[0-9]+=$', 'p.=') AS silent FROM (SELECT o_orderkey, {_P_TEXT} AS t FROM orders)""")
def q_clean_texts(spark, sf_dir):
    t = F.col("t")
    return _p_texts(spark, sf_dir).select("o_orderkey", text.normal_text(t).alias("normal"), text.clean_protein(t).alias("clean"), text.clean_silent(t).alias("silent"))


def _p_texts(spark, sf_dir):
    m = F.col("o_orderkey") % 3
    name = sequence.named(F.lit(_AA).substr((1 + F.col("o_orderkey") % 20).cast("int"), F.lit(1)))
    edit = F.when(m == 0, "Ter").when(m == 1, "=").otherwise("ValfsTer?")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("NP_1.1:p.("), name, (1 + F.col("o_custkey") % 900).cast("string"), edit, F.lit(")")).alias("t"))


# equivalence and reports


def _validated(spark, sf_dir):
    """Validated rows of orders: the truth, ours and theirs, some of them wrong or errors."""
    k, b = F.col("o_orderkey"), (1 + F.col("o_custkey") % 900).cast("string")
    rows = _p_texts(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey").withColumnRenamed("t", "variant_prot")
    plain = F.element_at(F.split("variant_prot", ":"), -1)
    ours = F.when(k % 11 == 0, "ERR:RefMismatch: x").when(k % 11 == 1, "ERR:Validate: y").when(k % 11 == 2, "ERR:Parse: z").when(k % 11 == 3, F.replace(plain, F.lit("Ter"), F.lit("del"))).when(k % 11 == 4, F.replace(plain, F.lit("fs"), F.lit("ins"))).when(k % 11 == 5, "p.(Met1Ter?)").when(k % 11 == 6, "ERR:Transcript NM_1 not found").otherwise(plain)
    theirs = F.when(k % 4 == 0, "ERR:other").when(k % 4 == 1, F.replace(plain, F.lit("="), F.lit("Ala"))).otherwise(plain)
    m = k % 7
    edit = F.when(m == 0, "dup").when(m == 1, "delinsAG").when(m == 2, "del").when(m == 3, "insT").when(m == 4, "A[3]").when(m == 5, "A>G").otherwise("=")
    spdi = F.concat(F.lit("NC_1.1:"), b, F.when(k % 5 == 0, ":del:ins").when(k % 5 == 1, ":dup:A").otherwise(":A:G"))
    n = k % 9
    ours_spdi = (
        F.when(n == 0, "ERR:Unsupported operation: no such edit").when(n == 1, "ERR:Other:foo").when(n == 2, "PANIC").when(n == 3, "bad:1").when(n == 4, F.concat(F.lit("NC_2.1:"), b, F.lit(":A:G")))
        .when(n == 5, F.concat(F.lit("NC_1.1:1"), b, F.lit(":A:G"))).when(n == 6, F.concat(F.lit("NC_1.1:"), b, F.lit(":T:G"))).when(n == 7, F.concat(spdi, F.lit("G"))).otherwise(spdi)
    )
    rows = rows.select("o_orderkey", F.concat(F.lit("NM_1.1:c."), b, edit).alias("variant_nuc"), "variant_prot", spdi.alias("spdi"), ours.alias("ours_p"), theirs.alias("theirs_p"), ours_spdi.alias("ours_spdi"))
    return rows.withColumn("theirs_spdi", F.when(k % 4 == 0, F.col("spdi")).when(k % 4 == 1, F.col("ours_spdi")).when(k % 4 == 2, "ERR:z").otherwise("NC_9.1:1:A:G"))


_VALIDATED = f"""
t AS (SELECT *, string_split(variant_prot, ':')[-1] AS plain FROM (SELECT o_orderkey, o_orderkey AS k, CAST(1 + o_custkey % 900 AS VARCHAR) AS b, {_P_TEXT} AS variant_prot FROM orders)),
s AS (SELECT *, 'NC_1.1:' || b || CASE k % 5 WHEN 0 THEN ':del:ins' WHEN 1 THEN ':dup:A' ELSE ':A:G' END AS spdi FROM t),
r AS (SELECT o_orderkey, k, variant_prot, spdi, 'NM_1.1:c.' || b || CASE k % 7 WHEN 0 THEN 'dup' WHEN 1 THEN 'delinsAG' WHEN 2 THEN 'del' WHEN 3 THEN 'insT' WHEN 4 THEN 'A[3]' WHEN 5 THEN 'A>G' ELSE '=' END AS variant_nuc,
  CASE k % 11 WHEN 0 THEN 'ERR:RefMismatch: x' WHEN 1 THEN 'ERR:Validate: y' WHEN 2 THEN 'ERR:Parse: z' WHEN 3 THEN replace(plain, 'Ter', 'del') WHEN 4 THEN replace(plain, 'fs', 'ins') WHEN 5 THEN 'p.(Met1Ter?)' WHEN 6 THEN 'ERR:Transcript NM_1 not found' ELSE plain END AS ours_p,
  CASE k % 4 WHEN 0 THEN 'ERR:other' WHEN 1 THEN replace(plain, '=', 'Ala') ELSE plain END AS theirs_p,
  CASE k % 9 WHEN 0 THEN 'ERR:Unsupported operation: no such edit' WHEN 1 THEN 'ERR:Other:foo' WHEN 2 THEN 'PANIC' WHEN 3 THEN 'bad:1' WHEN 4 THEN 'NC_2.1:' || b || ':A:G' WHEN 5 THEN 'NC_1.1:1' || b || ':A:G' WHEN 6 THEN 'NC_1.1:' || b || ':T:G' WHEN 7 THEN spdi || 'G' ELSE spdi END AS ours_spdi FROM s),
w AS (SELECT *, CASE k % 4 WHEN 0 THEN spdi WHEN 1 THEN ours_spdi WHEN 2 THEN 'ERR:z' ELSE 'NC_9.1:1:A:G' END AS theirs_spdi,
  replace(translate(plain_ours, '()', ''), 'Ter', '*') AS c_ours, replace(translate(string_split(theirs_p, ':')[-1], '()', ''), 'Ter', '*') AS c_theirs, replace(translate(string_split(variant_prot, ':')[-1], '()', ''), 'Ter', '*') AS c_truth FROM (SELECT *, string_split(ours_p, ':')[-1] AS plain_ours FROM r)),
v AS (SELECT *, ours_p NOT LIKE 'ERR%' AND c_ours = c_truth AS a, theirs_p NOT LIKE 'ERR%' AND c_theirs = c_truth AS b,
  ours_p LIKE 'ERR:%' OR NOT (c_ours = c_truth OR contains(ours_p, 'Ter') AND contains(variant_prot, 'Ter') OR contains(ours_p, 'fs') AND contains(variant_prot, 'fs') OR contains(ours_p, '=') AND contains(variant_prot, '=')) AS wrong_p, ours_spdi <> spdi AS wrong_s FROM w)"""


@query(f"""WITH {_VALIDATED} SELECT count(*) AS total, CAST(sum(a::int) AS BIGINT) AS ours_ok, CAST(sum(b::int) AS BIGINT) AS theirs_ok, round(100.0 * sum(a::int) / count(*), 2) AS ours_pct, round(100.0 * sum(b::int) / count(*), 2) AS theirs_pct, sum(a::int) >= sum(b::int) AS ours_leads FROM v""")
def q_accuracy(spark, sf_dir):
    return reports.accuracy(_validated(spark, sf_dir), "ours_p", "theirs_p", "variant_prot")


@query(f"WITH {_VALIDATED} SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'ours_only' WHEN b THEN 'theirs_only' ELSE 'neither' END AS outcome, count(*) AS n FROM v GROUP BY 1")
def q_contingency(spark, sf_dir):
    match = lambda c: text.exact_match(F.col(c), F.col("variant_prot"))
    return reports.contingency(_validated(spark, sf_dir), match("ours_p"), match("theirs_p"))


@query(f"WITH {_VALIDATED} SELECT CASE WHEN ours_spdi = spdi AND theirs_spdi = spdi THEN 'both' WHEN ours_spdi = spdi THEN 'ours_only' WHEN theirs_spdi = spdi THEN 'theirs_only' ELSE 'neither' END AS outcome, count(*) AS n FROM v GROUP BY 1")
def q_contingency_spdi(spark, sf_dir):
    return reports.contingency(_validated(spark, sf_dir), F.col("ours_spdi") == F.col("spdi"), F.col("theirs_spdi") == F.col("spdi"))


_CATEGORY_SQL = """CASE WHEN ours_p LIKE 'ERR:RefMismatch%' THEN 'RefSeq Data Mismatch' WHEN ours_p LIKE 'ERR:Validate%' THEN 'Coordinate Out of Bounds' WHEN ours_p LIKE 'ERR:Parse%' THEN 'Parsing Error'
  WHEN wrong_p AND wrong_s THEN CASE WHEN contains(variant_prot, 'Ter') AND NOT contains(ours_p, 'Ter') THEN 'Protein: Stop Codon Logic' WHEN contains(variant_prot, 'fs') AND NOT contains(ours_p, 'fs') THEN 'Protein: Frameshift Logic'
    WHEN contains(spdi, 'del') AND contains(spdi, 'ins') THEN 'Complex Indel' ELSE 'General Mapping Failure' END
  WHEN wrong_p THEN CASE WHEN contains(ours_p, 'Ter?') THEN 'Protein: Uncertain Stop' ELSE 'Protein: Translation/Formatting' END
  WHEN wrong_s THEN CASE WHEN contains(spdi, 'dup') OR contains(variant_nuc, 'dup') THEN 'Genomic: Duplication Shifting' ELSE 'Genomic: Normalization/Projection' END ELSE 'Unknown' END"""


@query(f"WITH {_VALIDATED}, c AS (SELECT {_CATEGORY_SQL} AS category FROM v) SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 2) AS share FROM c GROUP BY category")
def q_failure_categories(spark, sf_dir):
    rows = _validated(spark, sf_dir)
    return reports.categories(rows, reports.failure_category(rows))


@query(f"WITH {_VALIDATED} SELECT * FROM (SELECT o_orderkey, ours_p, {_CATEGORY_SQL} AS category FROM v) QUALIFY row_number() OVER (PARTITION BY category ORDER BY o_orderkey) <= 100")
def q_samples_per_category(spark, sf_dir):
    rows = _validated(spark, sf_dir)
    return reports.samples(rows, reports.failure_category(rows), ["o_orderkey"]).select("o_orderkey", "ours_p", "category")


@query(f"WITH {_VALIDATED} SELECT o_orderkey, ours_p, ours_spdi FROM v WHERE wrong_p OR wrong_s")
def q_disagreements(spark, sf_dir):
    return reports.disagreements(_validated(spark, sf_dir)).select("o_orderkey", "ours_p", "ours_spdi")


@query(f"""WITH {_VALIDATED}, m AS (SELECT *, string_split(ours_spdi, ':') AS x, string_split(spdi, ':') AS y FROM v WHERE wrong_s)
SELECT CASE WHEN ours_spdi LIKE 'ERR:%' THEN 'Error: ' || x[2] WHEN ours_spdi = 'PANIC' THEN 'Panic' WHEN len(x) <> 4 OR len(y) <> 4 THEN 'Malformed SPDI' WHEN x[1] <> y[1] THEN 'Accession Mismatch' WHEN x[2] <> y[2] THEN 'Position Mismatch'
  WHEN x[3] <> y[3] THEN 'Reference Seq Mismatch' WHEN x[4] <> y[4] THEN 'Alternate Seq Mismatch' ELSE 'Other' END AS category,
  CASE WHEN theirs_spdi = spdi THEN 'Matched ClinVar' WHEN theirs_spdi = ours_spdi THEN 'Shared Mismatch' WHEN theirs_spdi LIKE 'ERR:%' THEN 'Error' ELSE 'Unique Mismatch' END AS behaviour, count(*) AS n FROM m GROUP BY 1, 2""")
def q_spdi_mismatches(spark, sf_dir):
    return reports.spdi_mismatches(_validated(spark, sf_dir))


_KIND_SQL = "CASE WHEN contains(variant_nuc, 'dup') THEN 'dup' WHEN contains(variant_nuc, 'delins') THEN 'delins' WHEN contains(variant_nuc, 'del') THEN 'del' WHEN contains(variant_nuc, 'ins') THEN 'ins' WHEN contains(variant_nuc, '[') THEN 'repeat' WHEN contains(variant_nuc, '>') THEN 'subst' ELSE 'Unknown' END"


@query(f"""WITH {_VALIDATED}, m AS (SELECT * FROM v WHERE wrong_s) SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN ours_spdi LIKE 'ERR:Unsupported operation: %' THEN substring(ours_spdi, 28) WHEN ours_spdi LIKE 'ERR:%' THEN 'Other ERR: ' || string_split(ours_spdi, ':')[2] ELSE 'Real Mismatch' END AS reason FROM m
  UNION ALL SELECT 'Mismatch: ' || {_KIND_SQL} FROM m WHERE ours_spdi NOT LIKE 'ERR:%') GROUP BY reason""")
def q_spdi_reasons(spark, sf_dir):
    return reports.spdi_reasons(_validated(spark, sf_dir))


@query(f"""WITH {_VALIDATED} SELECT CASE WHEN theirs_spdi = spdi THEN 'Matched ClinVar' WHEN theirs_spdi LIKE 'ERR:%' THEN 'Error' ELSE 'Unique Mismatch' END AS behaviour, count(*) AS n FROM v WHERE ours_spdi LIKE 'ERR:Unsupported operation%' GROUP BY 1""")
def q_unsupported(spark, sf_dir):
    return reports.unsupported(_validated(spark, sf_dir))


_LEVELS = """l AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'Analogous' WHEN k % 13 = 1 THEN 'Identity' WHEN k % 13 = 2 THEN 'Different' END AS level_truth, CASE WHEN k % 17 = 0 THEN 'Identity' WHEN k % 17 = 1 THEN 'Different' END AS level_theirs, k % 2 = 0 AS consistent,
  regexp_replace(c_ours, '^p\\.[A-Z][a-z]{2}[0-9]+=$', 'p.=') AS s_ours, regexp_replace(c_theirs, '^p\\.[A-Z][a-z]{2}[0-9]+=$', 'p.=') AS s_theirs, regexp_replace(c_truth, '^p\\.[A-Z][a-z]{2}[0-9]+=$', 'p.=') AS s_truth FROM v)"""
_CLASS_SQL = """CASE WHEN s_ours = s_truth THEN 'ClinVar Match ' || sure WHEN level_truth IN ('Identity', 'Analogous') THEN 'Biological Equivalence (' || level_truth || ') ' || sure || ' - ClinVar'
  WHEN s_ours = s_theirs THEN 'Parity Match (Not Analogous to GT)' WHEN level_theirs IN ('Identity', 'Analogous') THEN 'Biological Equivalence (' || level_theirs || ') - Parity'
  WHEN ours_p LIKE 'ERR:%' AND contains(ours_p, 'Transcript') AND contains(ours_p, 'not found') THEN 'Provider Error (Missing Transcript)' WHEN ours_p LIKE 'ERR:%' AND contains(ours_p, 'TranscriptMismatch') THEN 'Error: Reference sequence mismatch'
  WHEN ours_p LIKE 'ERR:%' THEN 'Error: ' || ltrim(plain_ours) WHEN contains(ours_p, 'fs') OR contains(variant_prot, 'fs') THEN 'Frameshift Difference' WHEN contains(ours_p, 'delins') OR contains(variant_prot, 'delins') THEN 'AA Mismatch (delins)'
  WHEN contains(variant_nuc, '[') OR contains(variant_nuc, 'dup') THEN 'Repeat/Duplication Mismatch' WHEN contains(ours_p, '*') OR contains(variant_prot, '*') THEN 'Nonsense Notation Mismatch' ELSE 'Other Mismatch' END"""


@query(f"""WITH {_VALIDATED}, {_LEVELS}, c AS (SELECT {_CLASS_SQL} AS category FROM (SELECT *, CASE WHEN consistent THEN '(Consistent)' ELSE '(Inconsistent)' END AS sure FROM l)),
g AS (SELECT category, count(*) AS n, contains(category, 'ClinVar') AS success FROM c GROUP BY category)
SELECT category, n, success, round(100.0 * n / CASE WHEN success THEN sum(n) OVER () ELSE sum(n) OVER (PARTITION BY success) END, 2) AS share FROM g""")
def q_classification(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _validated(spark, sf_dir).withColumn("level_truth", F.when(k % 13 == 0, "Analogous").when(k % 13 == 1, "Identity").when(k % 13 == 2, "Different"))
    rows = rows.withColumn("level_theirs", F.when(k % 17 == 0, "Identity").when(k % 17 == 1, "Different")).withColumn("consistent", k % 2 == 0)
    return reports.class_counts(rows, reports.classification())


@query(f"""WITH {_VALIDATED}, {_LEVELS}, e AS (SELECT *, CASE WHEN ours_p LIKE 'ERR:%' THEN ours_p ELSE c_ours END AS x, CASE WHEN theirs_p LIKE 'ERR:%' THEN theirs_p ELSE c_theirs END AS y FROM l)
SELECT count(*) AS total, count(*) FILTER (x = c_truth) AS ours_identity, count(*) FILTER (x <> c_truth AND ours_p NOT LIKE 'ERR%' AND level_truth IN ('Identity', 'Analogous')) AS ours_analogous,
  count(*) FILTER (y = c_truth) AS theirs_identity, count(*) FILTER (y <> c_truth AND theirs_p NOT LIKE 'ERR%' AND level_theirs IN ('Identity', 'Analogous')) AS theirs_analogous FROM e""")
def q_identity_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _validated(spark, sf_dir).withColumn("ours_level", F.when(k % 13 == 0, "Analogous").when(k % 13 == 1, "Identity").when(k % 13 == 2, "Different"))
    return reports.identity_counts(rows.withColumn("theirs_level", F.when(k % 17 == 0, "Identity").when(k % 17 == 1, "Different")))


def _deletions(spark, sf_dir):
    """SPDI texts of a deletion and of the same one base further on."""
    at, n, near = F.col("pos0"), F.col("len"), F.col("near")
    told = lambda on: F.concat_ws(":", "ac", (at + on).cast("string"), near.substr(F.col("ahead") + on + 1, n), F.lit(""))
    return synth.variant_rows(spark, sf_dir).select(*KEY, told(0).alias("spdi"), told(1).alias("ours_spdi"))


@query(_with("SELECT count(*) AS mismatches, count(*) FILTER (substring(seq, 1, pos0) || substring(seq, pos0 + len + 1) = substring(seq, 1, pos0 + 1) || substring(seq, pos0 + len + 2)) AS equivalent, count(*) FILTER (substring(seq, 1, pos0) || substring(seq, pos0 + len + 1) <> substring(seq, 1, pos0 + 1) || substring(seq, pos0 + len + 2)) AS real FROM v"))
def q_spdi_differences(spark, sf_dir):
    """Deletions compared with those one base on, by carrying both out."""
    return normalize.spdi_differences(_deletions(spark, sf_dir), synth.reference(spark, sf_dir, of_transcripts=False))


@query(_with("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN kind NOT IN (1, 3) THEN 'Identity' WHEN substring(seq, pos0 + 1, 1) = substring(seq, pos0 + len + 1, 1) THEN 'Analogous' ELSE 'Different' END AS level FROM v"""))
def q_equiv_gg(spark, sf_dir):
    """Genomic deletions and duplications against the same one base on, other variants against themselves."""
    rows = synth.variant_texts(spark, sf_dir)
    span = F.concat((F.col("pos0") + 2).cast("string"), F.when(F.col("len") > 1, F.concat(F.lit("_"), (F.col("pos0") + F.col("len") + 1).cast("string"))).otherwise(""))
    other = F.when(F.col("kind") == 1, F.concat("ac", F.lit(":g."), span, F.lit("del"))).when(F.col("kind") == 3, F.concat("ac", F.lit(":g."), span, F.lit("dup"))).otherwise(F.col("hgvs"))
    rows = with_variant(with_variant(rows.select(*KEY, "hgvs", other.alias("other")), "hgvs", "a", kinds="g"), "other", "b", kinds="g")
    return equivalence.equivalence_level(rows.select(*KEY, "a", "b"), synth.reference(spark, sf_dir, of_transcripts=False)).select(*KEY, "level")


#: Published pairs of protein variants with their levels.
LEVELS = [("NP_1.1:p.Ala201_Val202insGlyProGlyAla", "NP_1.1:p.Gly198_Ala201dup", "Analogous"), ("MOCK:p.(Lys2=)", "MOCK:p.Lys2=", "Identity"), ("MOCK:p.Lys2Asn", "MOCK:p.Lys2Ter", "Different")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{y}', '{level}')" for x, y, level in [*[(k, f"MOCK:{v}", "Identity") for k, v in EXPECTED.items()], *LEVELS]) + ") t(a_text, b_text, level)")
def q_equiv_cp(spark, sf_dir):
    """Coding variants against their published consequences, and pairs of protein variants."""
    pairs = [*[(k, f"MOCK:{v}") for k, v in EXPECTED.items()], *[(x, y) for x, y, _ in LEVELS]]
    rows = with_variant(with_variant(spark.createDataFrame(pairs, "a_text string, b_text string"), "a_text", "a"), "b_text", "b")
    return equivalence.equivalence_level(rows, toy_reference(spark)).select("a_text", "b_text", "level")


def _coding_job(spark, sf_dir):
    """A coding substitution for each order, and a true protein text that few of them give."""
    r = synth.reference(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("_docs"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").crossJoin(F.broadcast(docs))  # one row
    tx = r.transcripts.join(r.spliced, ["ac", "reference"])
    rows = rows.join(tx, F.col("o_custkey") % F.col("_docs") == F.col("doc_id"))
    i = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % (F.col("cds_end") - F.col("cds_start") + 1)).cast("int")
    rows = rows.withColumn("_i", i)
    b = F.col("tx_seq").substr(F.col("cds_start") + F.col("_i") + 1, F.lit(1))
    nuc = F.concat("ac", F.lit(":c."), (F.col("_i") + 1).cast("string"), b, F.lit(">"), F.translate(b, "ACGT", "CGTA"))
    return rows.select("o_orderkey", nuc.alias("variant_nuc"), F.concat("protein", F.lit(":p.Lys"), (F.expr("_i div 3") + 1).cast("string"), F.lit("Asn")).alias("variant_prot"))


@query(_with(f"""SELECT o_orderkey, variant_nuc, told AS ours_p, ac || ':' || CAST(g AS VARCHAR) || ':' || CASE WHEN strand = 1 THEN b || ':' || x ELSE translate(b, 'ACGT', 'TGCA') || ':' || translate(x, 'ACGT', 'TGCA') END AS ours_spdi,
  CASE WHEN told = 'p.(Lys' || CAST(j + 1 AS VARCHAR) || 'Asn)' THEN 'Identity' ELSE 'Different' END AS equivalence_level FROM (
  SELECT *, 'p.(' || names[ra] || CAST(j + 1 AS VARCHAR) || CASE WHEN ra = aa THEN '=' WHEN aa = '*' THEN 'Ter' WHEN ra = '*' THEN names[aa] || 'extTer' || CASE WHEN instr(rest, '*') > 0 THEN CAST(instr(rest, '*') AS VARCHAR) ELSE '?' END ELSE names[aa] END || ')' AS told FROM (
    SELECT *, code[substring(tx_seq, cds_start + 3 * j + 1, 3)] AS ra, code[substring(altered, 3 * j + 1, 3)] AS aa, {_translate_sql('substring(altered, 3 * j + 4)')} AS rest FROM (
      SELECT *, i // 3 AS j, substring(tx_seq, cds_start + 1, i) || x || substring(tx_seq, cds_start + i + 2) AS altered, tx_ac || ':c.' || CAST(i + 1 AS VARCHAR) || b || '>' || x AS variant_nuc,
        CASE WHEN strand = 1 THEN 20 + (n // sz) * th + n % sz ELSE 20 + (2 - n // sz) * th + sz - 1 - n % sz END AS g, {_CODON_SQL} AS code, {_NAMES_SQL} AS names FROM (
        SELECT *, translate(b, 'ACGT', 'CGTA') AS x FROM (SELECT *, cds_start + i AS n, substring(tx_seq, cds_start + i + 1, 1) AS b FROM (
          SELECT o_orderkey, t.*, CAST((o_orderkey * 7 + o_custkey) % (cds_end - cds_start + 1) AS INTEGER) AS i FROM orders JOIN txs t ON t.doc_id = o_custkey % (SELECT count(*) FROM documents)))))))"""))
def q_validate(spark, sf_dir):
    """The batch job: consequence, SPDI and level of coding substitutions."""
    return validate.validate(_coding_job(spark, sf_dir), synth.reference(spark, sf_dir)).select("o_orderkey", "variant_nuc", "ours_p", "ours_spdi", "equivalence_level")


def _all() -> None:
    """The queries of the other modules add themselves."""
    from allelic.plans import consequence_queries, edit_queries, file_queries, pair_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
