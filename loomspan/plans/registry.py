"""Registered queries of the alignment engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import flags, sequence
from loomspan.operators import admission, annotation, inspect, intervals, mods, pairs, transform
from loomspan.operators import lift as lifting
from loomspan.plans import oracles as O
from loomspan.plans.context import Context, once
from loomspan.sources import bam, text

FLAGSHIP = "lift_core"
_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple = ()):
    """Registers f(Context); sql may use the views and the common table expressions."""

    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql:
            _ORACLES[name] = O.over(sql, *ctes)
        return f

    return add


def queries() -> dict:
    return _QUERIES


def oracles() -> dict[str, str]:
    return _ORACLES


# Annotation


@query("gtf_exon_merge", "SELECT gene_id, tx_id, chrom, strand, ex_start, ex_end FROM fx_exons")
def _(c):
    rows = c.fx.gtf_rows.select("gene_id", "tx_id", "chrom", "strand", F.col("row_start").alias("ex_start"), F.col("row_end").alias("ex_end"))
    return annotation.merge_exons(rows).select("gene_id", "tx_id", "chrom", "strand", "ex_start", "ex_end")


@query("tx_offsets", "SELECT tx_id, ex_start, tx_off, ROW_NUMBER() OVER (PARTITION BY tx_id ORDER BY tx_off) AS exon_rank, tx_len FROM o_tx", O.LIFT)
def _(c):
    return annotation.exon_offsets(c.exons).select("tx_id", "ex_start", "tx_off", F.col("exon_rank").cast("bigint").alias("exon_rank"), "tx_len")


@query("gene_bounds", "SELECT gene_id, gene_start, gene_end FROM o_gene", O.LIFT)
def _(c):
    return annotation.gene_bounds(c.exons)


@query("header_sq", "SELECT chrom, CAST(MAX(ex_end) + 1000000 AS BIGINT) AS ln FROM fx_exons GROUP BY chrom")
def _(c):
    return c.sq


@query("id_resolve_lookup", "SELECT DISTINCT rname, tx_id FROM o_reads WHERE tx_id IS NOT NULL", O.LIFT)
def _(c):
    return annotation.resolve_names(c.fx.reads, c.exons).select("rname", "tx_id")


@query("id_resolve_auto", "SELECT DISTINCT r.rname, e.tx_id FROM fx_reads r JOIN fx_exons e ON split_part(e.tx_id, '.', 1) = split_part(r.rname, '.', 1)")
def _(c):
    return annotation.resolve_names(c.fx.reads, c.exons, "auto").select("rname", "tx_id")


# Admission


@query(
    "admission_status_counts",
    "SELECT CASE WHEN (flag & 2304) <> 0 THEN 'secondary' WHEN (flag & 16) <> 0 THEN 'reverse' WHEN mapq < 10 THEN 'low_mapq' WHEN (flag & 4) <> 0 THEN 'unmapped' WHEN tx_id IS NULL THEN 'missing' ELSE 'admitted' END AS status, COUNT(*) AS n FROM o_reads GROUP BY 1",
    O.LIFT,
)
def _(c):
    return admission.status_counts(admission.with_status(c.reads, min_mapq=10, primary_only=True, drop_reverse_reads=True))


@query(
    "missing_tx_report",
    "SELECT COUNT(*) AS records, COUNT(DISTINCT rname) AS names, COUNT(*) FILTER ((flag & 16) = 0) AS forward, COUNT(*) FILTER ((flag & 16) <> 0) AS reverse, COUNT(*) FILTER ((flag & 2304) = 0) AS primary_records, COUNT(*) FILTER ((flag & 256) <> 0) AS secondary_records, COUNT(*) FILTER ((flag & 2048) <> 0) AS supplementary_records FROM o_reads WHERE tx_id IS NULL AND (flag & 4) = 0",
    O.LIFT,
)
def _(c):
    return admission.missing_report(admission.with_status(c.reads))


@query("missing_by_nh", "SELECT nh, COUNT(*) AS n FROM o_reads WHERE tx_id IS NULL AND (flag & 4) = 0 GROUP BY nh", O.LIFT)
def _(c):
    return admission.missing_by_nh(admission.with_status(c.reads))


@query("gene_list_filter", "SELECT aln_id, tx_id FROM o_reads WHERE tx_id IN (SELECT tx_id FROM fx_exons WHERE gene_id IN ('G1', 'G7', 'G11') OR split_part(tx_id, '.', 1) = 'TX9')", O.LIFT)
def _(c):
    one = lambda *x: c.spark.createDataFrame([(i,) for i in x], "id string")
    return admission.listed(c.reads, c.exons, one("G1", "G7", "G11"), one("TX9")).select("aln_id", "tx_id")


# Lift


@query("lift_core", "SELECT aln_id, chrom, g_start, g_end, xl, xp, xi, im FROM o_lift", O.LIFT)
def _(c):
    return c.lifted().select("aln_id", "chrom", "g_start", "g_end", "xl", "xp", F.col("xi").cast("bigint").alias("xi"), F.col("im").cast("bigint").alias("im"))


@query("lift_cigar", "SELECT aln_id, g_start, g_cigar FROM o_lift", O.LIFT)
def _(c):
    return c.lifted().select("aln_id", "g_start", "g_cigar")


@query(
    "lift_tags",
    """SELECT aln_id, tx_id, gene_id, CAST(CASE WHEN strand = '+' THEN g_start - gene_start ELSE gene_end - g_end END AS BIGINT) AS ds, CAST(CASE WHEN strand = '+' THEN gene_end - g_start ELSE g_end - gene_start END AS BIGINT) AS de,
       CAST(CASE WHEN strand = '+' THEN g_end - gene_start ELSE gene_end - g_start END AS BIGINT) AS es, CAST(CASE WHEN strand = '+' THEN gene_end - g_end ELSE g_start - gene_start END AS BIGINT) AS ee,
       CASE WHEN (g_flag & 16) = 0 THEN 1 ELSE -1 END AS ro FROM o_lift""",
    O.LIFT,
)
def _(c):
    return c.lifted().select("aln_id", "tx_id", "gene_id", *[F.col(x).cast("bigint").alias(x) for x in ("ds", "de", "es", "ee")], "ro")


@query(
    "lift_revcomp",
    "SELECT aln_id, g_flag, CASE WHEN strand = '+' THEN seq ELSE reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) END AS g_seq, CASE WHEN strand = '+' THEN qual ELSE reverse(qual) END AS g_qual FROM o_lift",
    O.LIFT,
)
def _(c):
    return c.lifted(sequences=True).select("aln_id", "g_flag", "g_seq", "g_qual")


@query(
    "lift_status_counts",
    "SELECT CASE WHEN l.aln_id IS NOT NULL THEN 'converted' WHEN f.aln_id IS NOT NULL THEN 'failed_intron' ELSE 'failed' END AS status, COUNT(*) AS n FROM o_in i LEFT JOIN o_fit f USING (aln_id) LEFT JOIN o_lift l USING (aln_id) GROUP BY 1",
    O.LIFT,
)
def _(c):
    admitted = admission.with_status(c.reads).where("status = 'admitted'").drop("status")
    return admission.status_counts(lifting.lift(admitted, c.tx))


@query(
    "intron_warnings_top",
    "SELECT warning, n FROM (SELECT 'large_intron_' || CAST(gap // 1000 AS VARCHAR) || 'kb' AS warning, COUNT(*) AS n FROM (SELECT r.aln_id, LAST(gap ORDER BY ex_end) AS gap FROM o_reg r JOIN o_lift USING (aln_id) WHERE gap > 1000 GROUP BY r.aln_id) x GROUP BY 1) y ORDER BY n DESC, warning LIMIT 10",
    O.LIFT,
)
def _(c):
    return c.lifted(warn_intron=1000).where("warning IS NOT NULL").groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning").limit(10)


# Pairs


@query("pairs_same_tx", "SELECT aln_id, pk, CASE WHEN pk = 1 THEN no END AS pair_no FROM o_pk", O.PAIRS)
def _(c):
    return c.restored(False).select("aln_id", "pk", "pair_no")


@query("pairs_cross_tx", "SELECT aln_id, pk2 AS pk, no2 AS pair_no FROM o_pk2", O.PAIRS)
def _(c):
    return c.restored(True).select("aln_id", "pk", "pair_no")


@query(
    "pair_summary",
    "SELECT qname, CASE WHEN t1 = t2 THEN t1 ELSE t1 || '/' || t2 END AS transcript_id, CASE WHEN pk2 = 1 THEN 'same' ELSE 'cross' END AS pair_type, c1 AS r1_chrom, s1 + 1 AS r1_pos, c2 AS r2_chrom, s2 + 1 AS r2_pos, CASE WHEN c1 <> c2 THEN 0 ELSE (e1 - s1 + e2 - s2 + GREATEST(0, GREATEST(s1, s2) - LEAST(e1, e2))) * CASE WHEN s1 <= s2 THEN 1 ELSE -1 END END AS tlen FROM o_mates",
    O.PAIRS,
)
def _(c):
    return pairs.mates(c.restored(True)).select("qname", "transcript_id", "pair_type", "r1_chrom", "r1_pos", "r2_chrom", "r2_pos", "tlen")


@query(
    "tlen_ref_vs_sam",
    "SELECT a1 AS r1_aln, a2 AS r2_aln, CASE WHEN c1 <> c2 THEN 0 ELSE (e1 - s1 + e2 - s2 + GREATEST(0, GREATEST(s1, s2) - LEAST(e1, e2))) * CASE WHEN s1 <= s2 THEN 1 ELSE -1 END END AS tlen, CASE WHEN c1 <> c2 THEN 0 ELSE (GREATEST(e1, e2) - LEAST(s1, s2)) * CASE WHEN s1 <= s2 THEN 1 ELSE -1 END END AS sam_tlen, c1 = c2 AND pk2 = 1 AS proper FROM o_mates",
    O.PAIRS,
)
def _(c):
    return pairs.mates(c.restored(True)).select("r1_aln", "r2_aln", "tlen", "sam_tlen", "proper")


@query(
    "pair_stats",
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (pk2 IS NULL) AS passthrough, COUNT(*) FILTER (pk2 = 1) // 2 AS same_pairs, COUNT(*) FILTER (pk2 = 2) // 2 AS cross_pairs, COUNT(*) FILTER (pk2 = 0) AS singletons, COUNT(*) FILTER (pk2 = -1) AS ambiguous FROM o_pk2",
    O.PAIRS,
)
def _(c):
    return pairs.pair_stats(c.restored(True))


_OF_PAIR = "pk2 IN (1, 2)"


@query(
    "pairs_records",
    f"""SELECT p.aln_id, CAST(CASE WHEN {_OF_PAIR} THEN (l.g_flag & ~42) | 1 | CASE WHEN pk2 = 1 AND x.chrom = l.chrom THEN 2 ELSE 0 END | CASE WHEN (x.g_flag & 4) <> 0 THEN 8 ELSE 0 END | CASE WHEN (x.g_flag & 16) <> 0 THEN 32 ELSE 0 END ELSE l.g_flag END AS INT) AS flag,
       pk2 AS pk, x.chrom AS rnext, x.g_start AS pnext,
       CAST(CASE WHEN {_OF_PAIR} AND x.chrom = l.chrom THEN (e1 - s1 + e2 - s2 + GREATEST(0, GREATEST(s1, s2) - LEAST(e1, e2))) * CASE WHEN is_first = (s1 <= s2) THEN 1 ELSE -1 END ELSE 0 END AS BIGINT) AS tlen
       FROM o_pk2 p JOIN o_lift l USING (aln_id) LEFT JOIN (SELECT a1 AS aln_id, a2 AS other, true AS is_first, s1, e1, s2, e2 FROM o_mates UNION ALL SELECT a2, a1, false, s1, e1, s2, e2 FROM o_mates) m USING (aln_id)
       LEFT JOIN o_lift x ON x.aln_id = m.other WHERE pk2 IS NULL OR pk2 <> -1""",
    O.PAIRS,
)
def _(c):
    return pairs.records(c.restored(True, "g_flag")).select("aln_id", "flag", "pk", "rnext", "pnext", "tlen")


@query("pairs_ambiguous", "SELECT aln_id, qname, tx_id FROM o_pk2 WHERE pk2 = -1", O.PAIRS)
def _(c):
    return pairs.ambiguous(c.restored(True)).select("aln_id", "qname", "tx_id")


@query("pairs_unpaired", "SELECT aln_id, qname, tx_id FROM o_pk2 WHERE pk2 = 0", O.PAIRS)
def _(c):
    return pairs.unpaired(c.restored(True)).select("aln_id", "qname", "tx_id")


@query(
    "bedcov_unnamed",
    "SELECT CASE WHEN bed_start % 2 = 0 THEN 'B' END AS name, b.chrom, bed_start, bed_end, CAST(COALESCE(SUM((LEAST(bed_end, run_end) - GREATEST(bed_start, run_start)) * depth), 0) AS BIGINT) AS depth_sum FROM fx_bed b LEFT JOIN o_runs r ON r.chrom = b.chrom AND run_start < bed_end AND run_end > bed_start GROUP BY ALL",
    O.DEPTH,
)
def _(c):
    # Names that are null or one for all must not mix regions.
    bed = c.fx.bed.withColumn("name", F.expr("CASE WHEN bed_start % 2 = 0 THEN 'B' END"))
    return intervals.region_depth(intervals.depth_runs(c.lifted()), bed).drop("deep")


@query(
    "inject_repeated",
    "SELECT r.aln_id, s.er FROM fx_reads r LEFT JOIN (SELECT read_id, MIN(end_reason) AS er FROM (SELECT read_id, end_reason FROM fx_summary UNION ALL SELECT read_id, 'zz' FROM fx_summary) t GROUP BY read_id) s ON s.read_id = r.qname",
)
def _(c):
    # Each read id stands twice in this summary; reads must not multiply.
    twice = c.fx.summary.unionByName(c.fx.summary.withColumn("end_reason", F.lit("zz")))
    return transform.inject_summary(c.fx.reads, twice, {"end_reason": "er"})[0].select("aln_id", "er")


@query("id_resolve_collisions", "SELECT DISTINCT 'TX' || CAST(i AS VARCHAR) AS rname, 'TX' || CAST(i AS VARCHAR) || '.10' AS tx_id FROM fx_exons")
def _(c):
    # Every transcript comes again as version 10, later: the last in order answers for the base, not the greatest text.
    tx = c.fx.exons.selectExpr("concat('TX', i, '.9') AS tx_id", "i AS line_no").union(c.fx.exons.selectExpr("concat('TX', i, '.10')", "i + 1000000000"))
    names = c.fx.exons.selectExpr("concat('TX', i) AS rname").distinct()
    return annotation.resolve_names(names, tx).select("rname", "tx_id")


# Inspection

_FLAGSTAT = " UNION ALL ".join(
    f"SELECT {i} AS line, '{n}' AS metric, COUNT(*) FILTER (({w.replace('rnext', 'CAST(NULL AS VARCHAR)')}) AND (flag & 512) = 0) AS passed, COUNT(*) FILTER (({w.replace('rnext', 'CAST(NULL AS VARCHAR)')}) AND (flag & 512) <> 0) AS failed FROM fx_reads"
    for i, (n, w) in enumerate(inspect.FLAGSTAT)
)


@query("flagstat", _FLAGSTAT)
def _(c):
    return inspect.flagstat(c.fx.reads)


@query(
    "idxstats",
    "SELECT s.chrom AS rname, ln, COALESCE(mapped, 0) AS mapped, COALESCE(unmapped, 0) AS unmapped FROM (SELECT chrom, CAST(MAX(ex_end) + 1000000 AS BIGINT) AS ln FROM fx_exons GROUP BY chrom UNION ALL SELECT '*', 0) s LEFT JOIN (SELECT chrom, COUNT(*) FILTER ((flag & 4) = 0) AS mapped, COUNT(*) FILTER ((flag & 4) <> 0) AS unmapped FROM o_lift GROUP BY chrom) USING (chrom)",
    O.LIFT,
)
def _(c):
    return inspect.idxstats(c.lifted().select(F.col("chrom").alias("rname"), "flag"), c.sq)


@query(
    "stats_hist",
    """SELECT metric, bucket, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT 'length' AS metric, CAST(length(seq) AS VARCHAR) AS bucket, 1 AS n FROM fx_reads UNION ALL SELECT 'mapq', CAST(mapq AS VARCHAR), 1 FROM fx_reads
       UNION ALL SELECT 'gc_percent', CAST((length(seq) - length(translate(seq, 'GCgc', ''))) * 100 // length(seq) AS VARCHAR), 1 FROM fx_reads
       UNION ALL SELECT 'soft_clip', CAST(COALESCE(list_sum([CAST(left(x, length(x) - 1) AS INT) FOR x IN regexp_extract_all(cigar, '[0-9]+S')]), 0) AS VARCHAR), 1 FROM fx_reads
       UNION ALL SELECT 'cigar_bases', right(t, 1), CAST(left(t, length(t) - 1) AS BIGINT) FROM (SELECT unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) AS t FROM fx_reads) y
       UNION ALL SELECT CASE right(t, 1) WHEN 'N' THEN 'intron' WHEN 'I' THEN 'insertion' ELSE 'deletion' END, left(t, length(t) - 1), 1 FROM (SELECT unnest(regexp_extract_all(cigar, '[0-9]+[NID]')) AS t FROM fx_reads) z
       UNION ALL SELECT 'n_percent', CAST(len(list_filter(string_split(seq, ''), lambda x: x = 'N')) * 100 // length(seq) AS VARCHAR), 1 FROM fx_reads
       UNION ALL SELECT 'splices', CAST(length(cigar) - length(replace(cigar, 'N', '')) AS VARCHAR), 1 FROM fx_reads
       UNION ALL SELECT 'tag', 'NH', 1 FROM fx_reads WHERE nh IS NOT NULL UNION ALL SELECT 'tag', 'HI', 1 FROM fx_reads WHERE hi IS NOT NULL UNION ALL SELECT 'tag', 'RG', 1 FROM fx_reads WHERE rg IS NOT NULL
       UNION ALL SELECT 'mate', CASE WHEN (flag & 64) <> 0 THEN 'first' ELSE 'second' END, 1 FROM fx_reads WHERE (flag & 1) <> 0) x GROUP BY metric, bucket""",
)
def _(c):
    return inspect.histograms(c.fx.reads)


@query(
    "tagcheck_rollup",
    "SELECT COALESCE(k, 'TOTAL') AS class, COUNT(*) AS records, COUNT(*) FILTER (seq IS NULL) AS no_seq, COUNT(*) FILTER (hi IS NULL) AS no_hi, COUNT(*) FILTER (rg IS NULL) AS no_rg FROM (SELECT *, CASE WHEN (flag & 256) <> 0 THEN 'secondary' WHEN (flag & 2048) <> 0 THEN 'supplementary' ELSE 'primary' END AS k FROM fx_reads) x GROUP BY ROLLUP (k)",
)
def _(c):
    return inspect.tagcheck(c.fx.reads)


@query("tagcheck_missing", "SELECT DISTINCT qname FROM fx_reads WHERE rg IS NULL")
def _(c):
    return inspect.missing_tags(c.fx.reads, "rg")


@query("samples", "SELECT DISTINCT sample FROM fx_reads")
def _(c):
    return inspect.samples(c.fx.reads)


@query("samples_rg", "SELECT DISTINCT sample AS sm FROM fx_reads WHERE rg IS NOT NULL")
def _(c):
    lines = c.fx.reads.selectExpr("CASE WHEN rg IS NULL THEN concat('@CO\\tSM:', qname) ELSE concat('@RG\\tID:', rg, '\\tSM:', sample, '\\tPL:x') END AS value")
    return inspect.read_groups(lines)


@query("index_windows", 'SELECT chrom, g_start // 16384 AS "window", COUNT(*) AS records, MIN(g_start) AS first_start, MAX(g_end) AS last_end FROM o_lift GROUP BY 1, 2', O.LIFT)
def _(c):
    return inspect.index_windows(c.lifted())


@query("head_records", "SELECT aln_id, qname, flag, rname, pos, cigar FROM fx_reads ORDER BY aln_id LIMIT 25")
def _(c):
    return inspect.head(c.fx.reads, 25).select("aln_id", "qname", "flag", "rname", "pos", "cigar")


@query("view_count", "SELECT COUNT(*) AS records FROM fx_reads WHERE (flag & 2308) = 0 AND mapq >= 20")
def _(c):
    return transform.filter_records(c.fx.reads, reject=2308, min_mapq=20).agg(F.count("*").alias("records"))


@query("checksum")
def _(c):
    return inspect.checksum(c.fx.reads)


@query("flags_decode", "SELECT DISTINCT flag, concat_ws(',', " + ", ".join(f"CASE WHEN (flag & {b}) <> 0 THEN '{n}' END" for b, n in flags.BITS) + ") AS names, flag AS encoded FROM fx_reads")
def _(c):
    return c.fx.reads.select("flag").distinct().select("flag", flags.decode(F.col("flag")).alias("names")).withColumn("encoded", flags.encode(F.col("names")))


@query("validate_report", "SELECT COUNT(*) AS records, COUNT(*) AS chrom_ok, COUNT(*) AS blocks_ok, COUNT(*) AS tags_ok FROM o_lift", O.LIFT)
def _(c):
    checked = inspect.validate(c.lifted(), c.tx)
    return checked.agg(F.count("*").alias("records"), *[F.count_if(x).alias(x) for x in ("chrom_ok", "blocks_ok", "tags_ok")])


# Intervals


@query("depth_runs", "SELECT chrom, run_start, run_end, depth FROM o_runs", O.DEPTH)
def _(c):
    return intervals.depth_runs(c.lifted())


@query("depth_bases", "SELECT chrom, unnest(range(run_start, run_end)) AS base, depth FROM o_runs", O.DEPTH)
def _(c):
    return intervals.depth_bases(intervals.depth_runs(c.lifted()))


@query(
    "coverage_table",
    "SELECT s.chrom, ln, COALESCE(records, 0) AS records, CAST(COALESCE(covered, 0) AS BIGINT) AS covered, CAST(COALESCE(depth_sum, 0) AS BIGINT) AS depth_sum FROM (SELECT chrom, CAST(MAX(ex_end) + 1000000 AS BIGINT) AS ln FROM fx_exons GROUP BY chrom) s LEFT JOIN (SELECT chrom, SUM(run_end - run_start) AS covered, SUM((run_end - run_start) * depth) AS depth_sum FROM o_runs GROUP BY chrom) USING (chrom) LEFT JOIN (SELECT chrom, COUNT(*) AS records FROM o_lift GROUP BY chrom) USING (chrom)",
    O.DEPTH,
)
def _(c):
    lifted = c.lifted()
    return intervals.coverage(intervals.depth_runs(lifted), lifted, c.sq)


@query(
    "coverage_means",
    """SELECT s.chrom, ln, COALESCE(records, 0) AS records, CAST(COALESCE(covered, 0) AS BIGINT) AS covered, CAST(COALESCE(depth_sum, 0) AS BIGINT) AS depth_sum, COALESCE(covered, 0) * 100 / ln AS percent, COALESCE(depth_sum, 0) / ln AS mean_depth, mq / records AS mean_mapq
       FROM (SELECT chrom, CAST(MAX(ex_end) + 1000000 AS BIGINT) AS ln FROM fx_exons GROUP BY chrom) s
       LEFT JOIN (SELECT chrom, COUNT(*) AS covered, SUM(LEAST(d, 3)) AS depth_sum FROM (SELECT chrom, base, COUNT(*) AS d FROM (SELECT chrom, unnest(range(b_start, b_end)) AS base FROM o_block WHERE (flag & 1796) = 0 AND (flag & 1) = 1 AND mapq >= 20) x GROUP BY ALL) y GROUP BY chrom) USING (chrom)
       LEFT JOIN (SELECT chrom, COUNT(*) AS records, SUM(mapq) AS mq FROM o_lift WHERE (flag & 1796) = 0 AND (flag & 1) = 1 AND mapq >= 20 GROUP BY chrom) USING (chrom)""",
    O.BLOCKS,
)
def _(c):
    return intervals.coverage_means(c.lifted(), c.sq, min_mapq=20, required=1, cap=3)


@query(
    "bedcov",
    "SELECT b.name, b.chrom, bed_start, bed_end, CAST(COALESCE(SUM((LEAST(bed_end, run_end) - GREATEST(bed_start, run_start)) * depth), 0) AS BIGINT) AS depth_sum, CAST(COALESCE(SUM(CASE WHEN depth >= 5 THEN LEAST(bed_end, run_end) - GREATEST(bed_start, run_start) END), 0) AS BIGINT) AS deep FROM fx_bed b LEFT JOIN o_runs r ON r.chrom = b.chrom AND run_start < bed_end AND run_end > bed_start GROUP BY ALL",
    O.DEPTH,
)
def _(c):
    return intervals.region_depth(intervals.depth_runs(c.lifted()), c.fx.bed, 5)


_COUNT = (
    *O.BLOCKS,
    ("o_hit", "SELECT b.aln_id, MIN(e.gene_id) AS lo, MAX(e.gene_id) AS hi2 FROM o_block b JOIN fx_exons e ON e.chrom = b.chrom AND e.ex_start < b.b_end AND e.ex_end > b.b_start GROUP BY b.aln_id"),
    ("o_asg", "SELECT l.aln_id, l.sample, CASE WHEN nh > 1 THEN 'Unassigned_MultiMapping' WHEN lo IS NULL THEN 'Unassigned_NoFeatures' WHEN lo <> hi2 THEN 'Unassigned_Ambiguity' ELSE 'Assigned' END AS status, lo FROM o_lift l LEFT JOIN o_hit USING (aln_id)"),
)


@query("count_genes", "SELECT lo AS gene_id, sample, COUNT(*) AS n FROM o_asg WHERE status = 'Assigned' GROUP BY ALL", _COUNT)
def _(c):
    return intervals.count_genes(intervals.assign_genes(c.lifted(), c.exons))


@query("count_summary", "SELECT status, COUNT(*) AS n FROM o_asg GROUP BY status", _COUNT)
def _(c):
    return admission.status_counts(intervals.assign_genes(c.lifted(), c.exons))


@query("count_pivot", "SELECT lo AS gene_id, COUNT(*) FILTER (sample = 'S0') AS S0, COUNT(*) FILTER (sample = 'S1') AS S1, COUNT(*) FILTER (sample = 'S2') AS S2 FROM o_asg WHERE status = 'Assigned' GROUP BY lo", _COUNT)
def _(c):
    counted = intervals.count_genes(intervals.assign_genes(c.lifted(), c.exons))
    return counted.groupBy("gene_id").pivot("sample", ["S0", "S1", "S2"]).agg(F.sum("n")).fillna(0)


#: Every aligned base, and every base of every gene.
_BASES = (
    *O.BLOCKS,
    ("o_gb", "SELECT DISTINCT chrom, gene_id, base FROM (SELECT chrom, gene_id, unnest(range(ex_start, ex_end)) AS base FROM fx_exons) x"),
    ("o_bb", "SELECT b.aln_id, b.chrom, unnest(range(b_start, b_end)) AS base FROM o_block b JOIN o_lift l USING (aln_id) WHERE l.nh = 1"),
    ("o_pg", "SELECT aln_id, gene_id, COUNT(*) AS n FROM o_bb JOIN o_gb USING (chrom, base) GROUP BY ALL"),
    ("o_nd", "SELECT aln_id, COUNT(*) AS total, COUNT(*) FILTER (g.base IS NOT NULL) AS inside FROM o_bb LEFT JOIN (SELECT DISTINCT chrom, base FROM o_gb) g USING (chrom, base) GROUP BY aln_id"),
)


def _htseq(mode: str, need: str) -> str:
    return f"SELECT '{mode}' AS mode, status, COUNT(*) AS n, COUNT(DISTINCT gene_id) AS genes FROM (SELECT l.aln_id, CASE WHEN l.nh > 1 THEN 'Unassigned_MultiMapping' WHEN k IS NULL THEN 'Unassigned_NoFeatures' WHEN k > 1 THEN 'Unassigned_Ambiguity' ELSE 'Assigned' END AS status, CASE WHEN l.nh = 1 AND k = 1 THEN lo END AS gene_id FROM o_lift l LEFT JOIN (SELECT aln_id, COUNT(*) AS k, MIN(gene_id) AS lo FROM o_pg JOIN o_nd USING (aln_id) WHERE n = {need} GROUP BY aln_id) g USING (aln_id)) x GROUP BY status"


@query("count_htseq", f"{_htseq('intersection-strict', 'total')} UNION ALL {_htseq('intersection-nonempty', 'inside')}", _BASES)
def _(c):
    lifted = c.lifted()
    one = lambda m: intervals.assign_genes(lifted, c.exons, mode=m).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("gene_id").alias("genes")).select(F.lit(m).alias("mode"), "status", "n", "genes")
    return one("intersection-strict").unionByName(one("intersection-nonempty"))


@query(
    "count_fragments",
    """SELECT lo AS tx_id, sample, COUNT(*) AS n FROM (SELECT f, sample, BOOL_OR(nh > 1) AS m, MIN(t) AS lo, MAX(t) AS hi2 FROM (
         SELECT CASE WHEN (l.flag & 1) <> 0 THEN 'p' || l.sample || ':' || l.qname || ':' || CAST(COALESCE(l.hi, 0) AS VARCHAR) ELSE CAST(l.aln_id AS VARCHAR) END AS f, l.sample, l.nh, CASE WHEN l.nh = 1 THEN e.tx_id END AS t
         FROM o_lift l LEFT JOIN o_block b USING (aln_id) LEFT JOIN fx_exons e ON e.chrom = b.chrom AND e.ex_start < b.b_end AND e.ex_end > b.b_start AND (e.strand = '-') = (((l.flag & 16) <> 0) <> ((l.flag & 129) = 129))) x GROUP BY ALL) y WHERE NOT m AND lo = hi2 GROUP BY ALL""",
    O.BLOCKS,
)
def _(c):
    assigned = intervals.assign_genes(c.lifted(), c.exons, stranded=1, by_pair=True, attribute="tx_id")
    return intervals.count_genes(assigned, "tx_id")


_JUNCTIONS = (
    *O.BLOCKS,
    ("o_j", "SELECT chrom, b_start + 1 AS j_start, b_end AS j_end, CASE WHEN (flag & 16) = 0 THEN '+' ELSE '-' END AS strand, COUNT(*) AS support FROM o_at WHERE op = 'N' AND (flag & 2304) = 0 GROUP BY ALL"),
    ("o_kn", "SELECT DISTINCT chrom, CAST(ex_end + 1 AS BIGINT) AS j_start, CAST(nx AS BIGINT) AS j_end FROM (SELECT *, LEAD(ex_start) OVER (PARTITION BY tx_id ORDER BY ex_start) AS nx FROM fx_exons) x WHERE nx IS NOT NULL"),
)


@query("junctions_support", "SELECT *, j_end - j_start + 1 AS intron_len FROM o_j", _JUNCTIONS)
def _(c):
    return intervals.junctions(c.lifted())


@query(
    "junctions_class",
    """SELECT j.chrom, j.j_start, j.j_end, j.strand, j.support, CASE WHEN EXISTS (FROM o_kn k WHERE k.chrom = j.chrom AND k.j_start = j.j_start AND k.j_end = j.j_end) THEN 'annotated'
       WHEN EXISTS (FROM o_kn k WHERE k.chrom = j.chrom AND k.j_start = j.j_start) AND EXISTS (FROM o_kn k WHERE k.chrom = j.chrom AND k.j_end = j.j_end) THEN 'novel combination'
       WHEN EXISTS (FROM o_kn k WHERE k.chrom = j.chrom AND k.j_start = j.j_start) THEN CASE WHEN j.strand = '+' THEN 'novel acceptor' ELSE 'novel donor' END
       WHEN EXISTS (FROM o_kn k WHERE k.chrom = j.chrom AND k.j_end = j.j_end) THEN CASE WHEN j.strand = '+' THEN 'novel donor' ELSE 'novel acceptor' END ELSE 'fully novel' END AS annotation
       FROM (SELECT chrom, j_start + CASE WHEN support % 5 = 0 THEN 1 ELSE 0 END AS j_start, j_end + CASE WHEN support % 3 = 0 THEN 2 ELSE 0 END AS j_end, strand, support FROM o_j) j""",
    _JUNCTIONS,
)
def _(c):
    # Some ends are moved, so that every class occurs.
    found = intervals.junctions(c.lifted()).withColumns({"j_start": F.expr("j_start + CASE WHEN support % 5 = 0 THEN 1 ELSE 0 END"), "j_end": F.expr("j_end + CASE WHEN support % 3 = 0 THEN 2 ELSE 0 END")})
    return intervals.classify(found, c.exons).select("chrom", "j_start", "j_end", "strand", "support", "annotation")


_BASE = "(SELECT substr(g.seq, CAST({0} % 64 AS INT) + 1, 1) FROM fx_genome g WHERE g.chrom = j.chrom AND g.bin = ({0}) // 64)"
_ENDS = ("o_m", "SELECT j.*, concat(" + _BASE.format("(j_start - 1)") + ", " + _BASE.format("(j_start)") + ", '-', " + _BASE.format("(j_end - 2)") + ", " + _BASE.format("(j_end - 1)") + ") AS m FROM o_j j")


@query(
    "junction_motif",
    "SELECT chrom, j_start, j_end, strand, CASE WHEN m IN ('GT-AG', 'CT-AC') THEN 'GT-AG' WHEN m IN ('GC-AG', 'CT-GC') THEN 'GC-AG' WHEN m IN ('AT-AC', 'GT-AT') THEN 'AT-AC' ELSE 'non-canonical' END AS motif, CASE WHEN m IN ('GT-AG', 'GC-AG', 'AT-AC') THEN '+' WHEN m IN ('CT-AC', 'CT-GC', 'GT-AT') THEN '-' END AS motif_strand FROM o_m",
    (*_JUNCTIONS, _ENDS),
)
def _(c):
    return intervals.motif(intervals.junctions(c.lifted()), c.genome).select("chrom", "j_start", "j_end", "strand", "motif", "motif_strand")


_SOURCES = (
    *_JUNCTIONS,
    _ENDS,
    ("o_jr", "SELECT a.chrom, a.b_start + 1 AS j_start, a.b_end AS j_end, CASE WHEN (g_flag & 16) = 0 THEN '+' ELSE '-' END AS fs, CASE WHEN nh > 1 THEN CASE WHEN (nh = 2) = ((g_flag & 16) = 0) THEN '+' ELSE '-' END END AS ts FROM o_at a JOIN o_lift l USING (aln_id) WHERE a.op = 'N' AND (g_flag & 2304) = 0"),
    ("o_mo", "SELECT DISTINCT chrom, j_start, j_end, CASE WHEN m IN ('GT-AG', 'CT-AC') THEN 'GT-AG' WHEN m IN ('GC-AG', 'CT-GC') THEN 'GC-AG' WHEN m IN ('AT-AC', 'GT-AT') THEN 'AT-AC' ELSE 'non-canonical' END AS motif, CASE WHEN m IN ('GT-AG', 'GC-AG', 'AT-AC') THEN '+' WHEN m IN ('CT-AC', 'CT-GC', 'GT-AT') THEN '-' END AS ms FROM o_m"),
)


@query("junctions_strand", "SELECT chrom, j_start, j_end, COALESCE(ms, ts, fs) AS strand, CASE WHEN ms IS NOT NULL THEN 'motif' WHEN ts IS NOT NULL THEN 'ts' ELSE 'flag' END AS strand_src, motif, COUNT(*) AS support, j_end - j_start + 1 AS intron_len FROM o_jr JOIN o_mo USING (chrom, j_start, j_end) GROUP BY ALL", _SOURCES)
def _(c):
    lifted = c.lifted().withColumns({"flag": F.col("g_flag"), "ts": F.expr("CASE nh WHEN 2 THEN '+' WHEN 3 THEN '-' END")})
    return intervals.stranded_junctions(lifted, c.genome)


# Manipulation


@query("filter_flags", "SELECT aln_id FROM fx_reads WHERE (flag & 1) = 1 AND (flag & 2304) = 0 AND (flag & 4) = 0 AND nh = 1 AND mapq >= 5 AND NOT (flag & 1024) <> 0")
def _(c):
    return transform.filter_records(c.fx.reads, require=1, reject=4, keep=("primary-unique",), drop=("dup",), min_mapq=5).select("aln_id")


@query("filter_region", "SELECT DISTINCT b.aln_id FROM o_block b JOIN fx_bed f ON f.chrom = b.chrom AND f.bed_start < b.b_end AND f.bed_end > b.b_start", O.BLOCKS)
def _(c):
    return transform.filter_regions(c.lifted(), c.fx.bed).select("aln_id")


@query("filter_gene", "SELECT DISTINCT b.aln_id FROM o_block b JOIN fx_exons e ON e.gene_id IN ('G3', 'G8') AND e.chrom = b.chrom AND e.ex_start < b.b_end AND e.ex_end > b.b_start", O.BLOCKS)
def _(c):
    genes = c.spark.createDataFrame([("G3",), ("G8",)], "id string")
    return transform.filter_regions(c.lifted(), transform.gene_regions(c.exons, genes)).select("aln_id")


@query("filter_mates_together", "SELECT aln_id FROM (SELECT aln_id, MAX(CASE WHEN mapq >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS m FROM fx_reads) x WHERE m = 1")
def _(c):
    return transform.mate_policy(c.fx.reads, F.col("mapq") >= 40, "together").select("aln_id")


@query(
    "dedup_mark",
    "SELECT aln_id, CASE WHEN rn > 1 THEN flag | 1024 ELSE flag END AS flag, rn > 1 AS duplicate FROM (SELECT aln_id, flag, CASE WHEN (flag & 2308) = 0 THEN ROW_NUMBER() OVER (PARTITION BY rname, pos, cigar, flag & 16, (flag & 2308) = 0 ORDER BY q DESC, aln_id) ELSE 0 END AS rn FROM (SELECT *, list_sum([GREATEST(ascii(x) - 33, 0) FOR x IN string_split(qual, '')]) AS q FROM fx_reads) y) x",
)
def _(c):
    return transform.mark_duplicates(c.fx.reads).select("aln_id", "flag", "duplicate")


@query(
    "dedup_stats",
    "SELECT COUNT(*) AS records, COUNT(*) FILTER (p) AS examined, COUNT(*) FILTER (p AND rn > 1) AS duplicates, COUNT(*) FILTER (p AND rn > 1) / COUNT(*) FILTER (p) AS rate FROM (SELECT (flag & 2308) = 0 AS p, ROW_NUMBER() OVER (PARTITION BY rname, pos, cigar, flag & 16, (flag & 2308) = 0 ORDER BY aln_id) AS rn FROM fx_reads) x",
)
def _(c):
    return transform.duplicate_stats(transform.mark_duplicates(c.fx.reads))


@query("subsample_rate", "SELECT aln_id FROM fx_reads WHERE CAST('0x' || substr(md5('7:' || qname), 1, 7) AS BIGINT) < CAST(0.3 * 268435456 AS BIGINT)")
def _(c):
    return transform.subsample(c.fx.reads, 0.3, 7).select("aln_id")


@query("reservoir_n", "SELECT aln_id FROM fx_reads ORDER BY md5('3:' || CAST(aln_id AS VARCHAR)), aln_id LIMIT 500")
def _(c):
    return transform.reservoir(c.fx.reads, 500, 3).select("aln_id")


@query("target_cov", "SELECT aln_id, chrom, bin, rk AS bin_rank FROM (SELECT aln_id, chrom, g_start // 1000 AS bin, ROW_NUMBER() OVER (PARTITION BY chrom, g_start // 1000 ORDER BY md5('0:' || CAST(aln_id AS VARCHAR)), aln_id) AS rk FROM o_lift) x WHERE rk <= 4", O.LIFT)
def _(c):
    return transform.cap_coverage(c.lifted(), 4).select("aln_id", "chrom", "bin", F.col("bin_rank").cast("bigint").alias("bin_rank"))


@query(
    "split_counts",
    "SELECT 'strand' AS split_by, CASE WHEN (flag & 16) = 0 THEN 'plus' ELSE 'minus' END AS part, COUNT(*) AS n FROM fx_reads GROUP BY 2 UNION ALL SELECT 'readgroup', COALESCE(rg, 'none'), COUNT(*) FROM fx_reads GROUP BY 2 UNION ALL SELECT 'round-robin', CAST(aln_id % 4 AS VARCHAR), COUNT(*) FROM fx_reads GROUP BY 2",
)
def _(c):
    one = lambda by: transform.split_key(c.fx.reads, by).groupBy("part").agg(F.count("*").alias("n")).select(F.lit(by).alias("split_by"), "part", "n")
    return one("strand").union(one("readgroup")).union(one("round-robin"))


@query("sort_coord", "SELECT aln_id, chrom, g_start, DENSE_RANK() OVER (ORDER BY chrom) AS sq_index FROM o_lift", O.LIFT)
def _(c):
    return transform.sort_coordinate(c.lifted(), c.sq).select("aln_id", "chrom", "g_start", F.col("sq_index").cast("bigint").alias("sq_index"))


@query("sort_name", "SELECT aln_id, qname, flag FROM fx_reads")
def _(c):
    return transform.sort_name(c.fx.reads).select("aln_id", "qname", "flag")


@query("collate", "SELECT aln_id, qname FROM fx_reads")
def _(c):
    return transform.collate(c.fx.reads).select("aln_id", "qname")


@query("merge_cat", "SELECT aln_id, sample FROM fx_reads WHERE sample IN ('S0', 'S2') UNION ALL SELECT aln_id, sample FROM fx_reads WHERE sample = 'S2'")
def _(c):
    r = c.fx.reads
    return transform.cat(transform.merge(r.where("sample = 'S0'"), r.where("sample = 'S2'")), r.where("sample = 'S2'"), headers=(c.sq, c.sq)).select("aln_id", "sample")


_MATE = (
    ("o_e", "SELECT *, pos + COALESCE(list_sum([CAST(left(x, length(x) - 1) AS BIGINT) FOR x IN regexp_extract_all(cigar, '[0-9]+[MD=X]')]), 0) AS e, COALESCE(list_sum([CASE WHEN ascii(x) - 33 >= 15 THEN ascii(x) - 33 ELSE 0 END FOR x IN string_split(qual, '')]), 0) AS s, (flag & 2304) = 0 AND (flag & 1) <> 0 AS p, (flag & 128) <> 0 AS sec FROM fx_reads"),
    ("o_side", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qname, sec ORDER BY aln_id) AS rn FROM o_e WHERE p) x WHERE rn = 1"),
)


@query(
    "fixmate",
    """SELECT a.aln_id, CASE WHEN m.aln_id IS NULL THEN a.flag ELSE (a.flag & ~40) + CASE WHEN (m.flag & 4) <> 0 THEN 8 ELSE 0 END + CASE WHEN (m.flag & 16) <> 0 THEN 32 ELSE 0 END END AS flag, m.rname AS rnext, m.pos AS pnext,
       CAST(CASE WHEN m.rname = a.rname THEN CASE WHEN a.pos < m.pos OR (a.pos = m.pos AND NOT a.sec) THEN 1 ELSE -1 END * (GREATEST(a.e, m.e) - LEAST(a.pos, m.pos)) ELSE 0 END AS BIGINT) AS tlen, CAST(m.s AS INT) AS ms
       FROM o_e a LEFT JOIN o_side m ON a.p AND m.qname = a.qname AND m.sec = (NOT a.sec)""",
    _MATE,
)
def _(c):
    return transform.fixmate(c.fx.reads).select("aln_id", "flag", "rnext", "pnext", "tlen", "ms")


@query("addreplacerg", "SELECT aln_id, COALESCE(rg, 'RGX') AS rg FROM fx_reads")
def _(c):
    return transform.add_read_group(c.fx.reads, "RGX", orphan_only=True).select("aln_id", "rg")


@query("reheader", "SELECT 'SQ' AS kind, CASE WHEN chrom = 'chrM' THEN 'MT' ELSE chrom END AS name, CAST(CAST(MAX(ex_end) + 1000000 AS BIGINT) AS VARCHAR) AS value FROM fx_exons GROUP BY chrom UNION ALL SELECT 'RG', 'new', NULL")
def _(c):
    header = c.sq.select(F.lit("SQ").alias("kind"), F.lit(0).alias("ord"), F.col("chrom").alias("name"), F.col("ln").cast("string").alias("value"))
    header = header.unionByName(c.spark.createDataFrame([("PG", 1, "aligner", "x"), ("CO", 2, None, "y")], "kind string, ord int, name string, value string"))
    return transform.reheader(header, {"chrM": "MT"}, "new", ("PG", "CO")).select("kind", "name", "value")


_INJECT = (("o_inj", "SELECT r.aln_id, r.qname, CASE WHEN r.nh = 2 THEN CAST(r.mapq AS VARCHAR) END AS ch, CAST(s.channel AS VARCHAR) AS new_ch, s.end_reason AS er FROM fx_reads r LEFT JOIN fx_summary s ON s.read_id = r.qname"),)


def _injected(c):
    reads = c.fx.reads.withColumn("ch", F.when(F.col("nh") == 2, F.col("mapq").cast("string")))
    return transform.inject_summary(reads, c.fx.summary, {"channel": "ch", "end_reason": "er"})


@query("inject_summary", "SELECT aln_id, COALESCE(ch, new_ch) AS ch, er FROM o_inj", _INJECT)
def _(c):
    return _injected(c)[0].select("aln_id", "ch", "er")


@query("inject_conflicts", "SELECT aln_id, qname, 'ch' AS tag, ch AS old, new_ch AS new, ch = new_ch AS equal FROM o_inj WHERE ch IS NOT NULL AND new_ch IS NOT NULL", _INJECT)
def _(c):
    return _injected(c)[1]


@query(
    "tag_recovery",
    """SELECT r.aln_id, p.seq IS NOT NULL AND (r.flag & 2304) <> 0 AS recovered, CASE WHEN (r.flag & 2304) = 0 THEN r.seq WHEN p.seq IS NULL THEN NULL WHEN (p.flag & 16) <> (r.flag & 16) THEN reverse(translate(p.seq, 'ACGTacgtNn', 'TGCAtgcaNn')) ELSE p.seq END AS seq,
       CASE WHEN (r.flag & 2304) <> 0 AND p.seq IS NOT NULL THEN translate(cigar, 'H', 'S') ELSE cigar END AS cigar
       FROM fx_reads r LEFT JOIN (SELECT * FROM (SELECT qname, flag & 192 AS mate, flag, seq, ROW_NUMBER() OVER (PARTITION BY qname, flag & 192 ORDER BY aln_id) AS rn FROM fx_reads WHERE (flag & 2304) = 0) x WHERE rn = 1) p ON p.qname = r.qname AND p.mate = (r.flag & 192)""",
)
def _(c):
    bare = c.fx.reads.withColumn("seq", F.expr("CASE WHEN (flag & 2304) = 0 THEN seq END"))
    return transform.recover_tags(bare).select("aln_id", "recovered", "seq", "cigar")


_MD = (
    *O.BLOCKS,
    ("o_al", "SELECT a.aln_id, b.k, b.op, b.off, b.len, CAST(COALESCE(SUM(CASE WHEN b.op IN ('M','I','S','=','X') THEN b.len ELSE 0 END) OVER (PARTITION BY a.aln_id ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS qo, a.chrom, a.g_start, a.seq FROM o_lift a JOIN o_bp b USING (aln_id)"),
    ("o_bs", "SELECT aln_id, k, op, j, qo, chrom, seq, g_start + off + j AS g FROM (SELECT *, unnest(range(len)) AS j FROM o_al WHERE op IN ('M','=','X','D')) x"),
    ("o_cmp", "SELECT b.aln_id, k, op, j, upper(substr(b.seq, CAST(qo + j AS INT) + 1, 1)) AS q, COALESCE(substr(n.seq, CAST(g % 64 AS INT) + 1, 1), 'N') AS r FROM o_bs b LEFT JOIN fx_genome n ON n.chrom = b.chrom AND n.bin = g // 64"),
)


@query("calmd_nm", "SELECT a.aln_id, CAST(x.n + COALESCE(i.n, 0) AS INT) AS nm FROM (SELECT aln_id, SUM(CASE WHEN op = 'D' OR q <> r THEN 1 ELSE 0 END) AS n FROM o_cmp GROUP BY aln_id) x JOIN o_lift a USING (aln_id) LEFT JOIN (SELECT aln_id, SUM(len) AS n FROM o_al WHERE op = 'I' GROUP BY aln_id) i USING (aln_id)", _MD)
def _(c):
    return transform.calmd(c.lifted(sequences=True), c.genome).select("aln_id", "nm")


# Tags. Every read gets two calls of m and h on C, and one of a on A.


def _called(c):
    reads = c.fx.reads.selectExpr("aln_id", "concat('C+mh?,', pos % 5, ',', mapq % 7, ';A+a,', nh, ';') AS mm", "concat('B:C,', mapq * 4, ',', pos, ',', mapq, ',', nh * 80, ',', pos * 7 % 256) AS tag")
    return mods.with_mods(reads.withColumn("ml", mods.likelihoods("tag")))


@query("mod_calls", "SELECT aln_id, 'm' AS code, CAST(mapq * 4 AS VARCHAR) || ',' || CAST(mapq AS VARCHAR) AS calls FROM fx_reads UNION ALL SELECT aln_id, 'h', CAST(pos AS VARCHAR) || ',' || CAST(nh * 80 AS VARCHAR) FROM fx_reads UNION ALL SELECT aln_id, 'a', CAST(pos * 7 % 256 AS VARCHAR) FROM fx_reads")
def _(c):
    return _called(c).select("aln_id", F.explode("mods").alias("code", "calls")).select("aln_id", "code", F.array_join("calls", ",").alias("calls"))


@query("filter_mods", "SELECT aln_id FROM fx_reads WHERE mapq * 4 >= 204.8 OR mapq >= 204.8")
def _(c):
    return transform.min_mod_fraction(_called(c), "m5C", 0.8).select("aln_id")


@query("tag_surgery", "SELECT aln_id, CASE WHEN rg IS NULL THEN '' ELSE 'RD=' || rg || ';' END || 'XS=' || sample AS tags FROM fx_reads")
def _(c):
    tags = F.map_filter(F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("RG"), F.col("rg"), F.lit("XS"), F.col("sample")), lambda _, v: v.isNotNull())
    edited = transform.edit_tags(c.fx.reads.withColumn("tags", tags), strip=("NH",), rename={"RG": "RD"})
    return edited.select("aln_id", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"))


# Formats


@query("gtf_text_parse", "SELECT gene_id, tx_id, chrom, strand, feature, CAST(row_start AS BIGINT) AS ex_start, CAST(row_end AS BIGINT) AS ex_end FROM fx_gtf_rows")
def _(c):
    return text.parse_gtf(text.format_gtf(c.fx.gtf_rows))


@query("sam_text_roundtrip", "SELECT qname, flag, rname, pos, mapq, cigar, seq, qual, nh, hi, rg FROM fx_reads")
def _(c):
    return text.parse_sam(text.format_sam(c.fx.reads)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "nh", "hi", "rg")


_ROUTE = (("o_fq", "SELECT aln_id, qname AS name, CASE WHEN (flag & 1) = 0 THEN 's' WHEN (flag & 192) = 64 THEN '1' WHEN (flag & 192) = 128 THEN '2' ELSE '0' END AS route, CASE WHEN (flag & 16) <> 0 THEN reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) ELSE seq END AS s, CASE WHEN (flag & 16) <> 0 THEN reverse(qual) ELSE qual END AS q FROM fx_reads WHERE (flag & 2304) = 0"),)


@query("fastq", "SELECT route, '@' || name || chr(10) || s || chr(10) || '+' || chr(10) || q AS value FROM o_fq", _ROUTE)
def _(c):
    return text.format_fastq(text.sequence_records(c.fx.reads))


@query("fasta", "SELECT route, '>' || name || chr(10) || s AS value FROM o_fq", _ROUTE)
def _(c):
    return text.format_fasta(text.sequence_records(c.fx.reads))


@query("faidx", "SELECT tx_id || ':' || CAST(k AS VARCHAR) AS name, string_agg(substr(seq, CAST(GREATEST(0, ex_start - bin * 64) AS INT) + 1, CAST(LEAST(64, ex_end - bin * 64) - GREATEST(0, ex_start - bin * 64) AS INT)), '' ORDER BY bin) AS seq FROM fx_exons e JOIN fx_genome g ON g.chrom = e.chrom AND g.bin BETWEEN ex_start // 64 AND (ex_end - 1) // 64 GROUP BY ALL")
def _(c):
    regions = c.fx.exons.selectExpr("concat(tx_id, ':', k) AS name", "chrom", "ex_start + 1 AS r_start", "ex_end AS r_end")
    return text.fetch(c.genome, regions)


@query("dict", "SELECT chrom || ':' || CAST(bin AS VARCHAR) AS chrom, 64::BIGINT AS ln, md5(upper(seq)) AS m5 FROM fx_genome")
def _(c):
    return text.sequence_dictionary(c.genome.selectExpr("concat(chrom, ':', bin) AS chrom", "seq"))


def _header(c):
    """A BAM header lists every transcript of the annotation, here with and without its version."""
    ids = F.array("tx_id", sequence.strip_version(F.col("tx_id")))
    return once(c, "bam_header", lambda: c.exons.select(F.explode(ids).alias("name")).distinct().withColumn("length", F.lit(1000)))


_KEPT = ("NH", "HI", "RG", "XA", "XB", "XF", "XI", "XZ")


@query(
    "bam_roundtrip",
    """SELECT qname, flag, CASE WHEN rname = 'TXMISSING' THEN NULL ELSE rname END AS rname, pos, mapq, cigar, CASE WHEN (flag & 1) <> 0 AND rname <> 'TXMISSING' THEN rname END AS rnext, CAST(CASE WHEN (flag & 1) <> 0 THEN pos + 7 ELSE -1 END AS INT) AS pnext, CAST(CASE WHEN (flag & 16) <> 0 THEN -mapq ELSE mapq END AS INT) AS tlen, seq, qual, sample,
       'i:' || CAST(nh AS VARCHAR) AS nh, 'i:' || CAST(hi AS VARCHAR) AS hi, 'Z:' || rg AS rg, 'A:x' AS xa, 'B:s,' || CAST(pos AS VARCHAR) || ',-' || CAST(mapq + 1 AS VARCHAR) AS xb, 'f:0.5' AS xf, 'i:4000000000' AS xi, 'Z:' || qname AS xz FROM fx_reads""",
)
def _(c):
    tags = "map('XA', 'A:x', 'XB', concat('B:s,', pos, ',-', mapq + 1), 'XF', 'f:0.5', 'XI', 'i:4000000000', 'XZ', concat('Z:', qname))"
    mates = {"rnext": "CASE WHEN (flag & 1) <> 0 THEN CASE WHEN (flag & 64) <> 0 THEN '=' ELSE rname END END", "pnext": "CASE WHEN (flag & 1) <> 0 THEN pos + 7 END", "tlen": "CASE WHEN (flag & 16) <> 0 THEN -mapq ELSE mapq END", "tags": tags}
    reads, header = c.fx.reads.withColumns({k: F.expr(v) for k, v in mates.items()}), _header(c)
    # A file for each sample, whose path names it.
    back = [bam.decode(bam.encode(reads.where(F.col("sample") == s), header).withColumn("path", F.lit(f"runs/{s}.genome.bam")).withColumn("_sample", bam.sample_of("path")), sample="_sample") for s in ("S0", "S1", "S2")]
    got = back[0].unionByName(back[1]).unionByName(back[2])
    return got.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "sample", *[F.try_element_at("tags", F.lit(t)).alias(t.lower()) for t in _KEPT])


@query("quickcheck", "SELECT * FROM (VALUES ('cut', false), ('headless', false), ('whole', true)) AS v(path, ok)")
def _(c):
    # Every file as it is, without its last byte, and without its first.
    kinds = F.array(*[F.struct(F.lit(p).alias("path"), x.alias("content")) for p, x in (("whole", F.col("content")), ("cut", F.expr("substring(content, 1, length(content) - 1)")), ("headless", F.expr("substring(content, 2)")))])
    files = bam.encode(c.fx.reads, _header(c)).select(F.inline(kinds))
    return bam.quickcheck(files).groupBy("path").agg(F.bool_and("ok").alias("ok"))
