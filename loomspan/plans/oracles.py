"""Common table expressions of the DuckDB oracles: the lift written relationally, base run by base run, apart from the engine."""

from loomspan.plans.fixtures import with_views

LIFT = (
    ("o_tx", """SELECT gene_id, tx_id, chrom, strand, ex_start, ex_end, ex_end - ex_start AS ex_len,
        CAST(SUM(ex_end - ex_start) OVER (PARTITION BY tx_id) AS BIGINT) AS tx_len,
        CAST(COALESCE(SUM(ex_end - ex_start) OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '+' THEN ex_start ELSE -ex_start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tx_off FROM fx_exons"""),
    ("o_gene", "SELECT gene_id, MIN(ex_start) AS gene_start, MAX(ex_end) AS gene_end FROM fx_exons GROUP BY gene_id"),
    ("o_one", "SELECT DISTINCT tx_id, gene_id, chrom, strand, tx_len FROM o_tx"),
    ("o_reads", "SELECT r.*, COALESCE(a.tx_id, b.tx_id) AS tx_id FROM fx_reads r LEFT JOIN (SELECT DISTINCT tx_id FROM fx_exons) a ON a.tx_id = r.rname LEFT JOIN (SELECT DISTINCT tx_id FROM fx_exons) b ON split_part(b.tx_id, '.', 1) = r.rname"),
    ("o_in", "SELECT r.*, t.gene_id, t.chrom, t.strand, t.tx_len, g.gene_start, g.gene_end FROM o_reads r JOIN o_one t USING (tx_id) JOIN o_gene g USING (gene_id) WHERE (flag & 4) = 0"),
    ("o_list", "SELECT aln_id, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS l FROM o_in"),
    ("o_text", "SELECT aln_id, generate_subscripts(l, 1) AS k, unnest(l) AS t FROM o_list"),
    ("o_ops", "SELECT aln_id, k, right(t, 1) AS op, CAST(left(t, length(t) - 1) AS BIGINT) AS len FROM o_text WHERE right(t, 1) <> 'N'"),
    ("o_spans", "SELECT *, op IN ('M','D','=','X') AS is_ref, COALESCE(SUM(CASE WHEN op IN ('M','D','=','X') THEN len ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rs FROM o_ops"),
    ("o_tot", "SELECT aln_id, SUM(CASE WHEN is_ref THEN len ELSE 0 END) AS span FROM o_spans GROUP BY aln_id"),
    ("o_fit", "SELECT i.*, CAST(span AS BIGINT) AS span FROM o_in i JOIN o_tot USING (aln_id) WHERE span > 0 AND pos >= 0 AND pos + span <= tx_len"),
    ("o_reg", "SELECT f.aln_id, e.ex_end, LEAD(e.ex_start) OVER (PARTITION BY f.aln_id ORDER BY e.ex_start) - e.ex_end AS gap FROM o_fit f JOIN o_tx e ON e.tx_id = f.tx_id AND e.tx_off < f.pos + f.span AND e.tx_off + e.ex_len > f.pos"),
    ("o_gap", "SELECT aln_id, MAX(gap) AS im, COUNT(*) AS regions FROM o_reg GROUP BY aln_id"),
    ("o_piece", """SELECT s.aln_id, s.k, s.op, f.strand, CASE WHEN f.strand = '+' THEN s.k ELSE -s.k END AS k2,
        LEAST(f.pos + s.rs + s.len, e.tx_off + e.ex_len) - GREATEST(f.pos + s.rs, e.tx_off) AS len,
        CASE WHEN f.strand = '+' THEN e.ex_start + GREATEST(f.pos + s.rs, e.tx_off) - e.tx_off ELSE e.ex_end - (LEAST(f.pos + s.rs + s.len, e.tx_off + e.ex_len) - e.tx_off) END AS g0
        FROM o_spans s JOIN o_fit f USING (aln_id) JOIN o_tx e ON e.tx_id = f.tx_id AND e.tx_off < f.pos + s.rs + s.len AND e.tx_off + e.ex_len > f.pos + s.rs WHERE s.is_ref"""),
    ("o_next", "SELECT *, LEAD(g0) OVER (PARTITION BY aln_id ORDER BY k2, g0) - g0 - len AS gap FROM o_piece"),
    ("o_rows", """SELECT aln_id, k2, g0, 0 AS sub, op, len FROM o_next UNION ALL SELECT aln_id, k2, g0, 1, 'N', gap FROM o_next WHERE gap > 0
        UNION ALL SELECT s.aln_id, CASE WHEN f.strand = '+' THEN s.k ELSE -s.k END, 0, 0, s.op, s.len FROM o_spans s JOIN o_fit f USING (aln_id) WHERE NOT s.is_ref"""),
    ("o_new", "SELECT *, CASE WHEN op = LAG(op) OVER w AND op NOT IN ('N', '=', 'X') THEN 0 ELSE 1 END AS fresh FROM o_rows WINDOW w AS (PARTITION BY aln_id ORDER BY k2, g0, sub)"),
    ("o_isl", "SELECT *, SUM(fresh) OVER (PARTITION BY aln_id ORDER BY k2, g0, sub) AS isl FROM o_new"),
    ("o_op2", "SELECT aln_id, isl, MIN(op) AS op, CAST(SUM(len) AS BIGINT) AS len FROM o_isl GROUP BY aln_id, isl"),
    ("o_cig", "SELECT aln_id, string_agg(CAST(len AS VARCHAR) || op, '' ORDER BY isl) AS g_cigar FROM o_op2 GROUP BY aln_id"),
    ("o_pos", "SELECT aln_id, CAST(MIN(g0) AS BIGINT) AS g_start, CAST(MAX(g0 + len) AS BIGINT) AS g_end FROM o_piece GROUP BY aln_id"),
    ("o_lift", """SELECT f.*, p.g_start, p.g_end, c.g_cigar, f.span AS xl, p.g_end - p.g_start AS xp, CASE WHEN g.regions > 1 THEN 1 ELSE 0 END AS xi, CAST(g.im AS BIGINT) AS im,
        CASE WHEN f.strand = '+' THEN f.flag ELSE xor(f.flag, 16) END AS g_flag FROM o_fit f JOIN o_pos p USING (aln_id) JOIN o_cig c USING (aln_id) JOIN o_gap g USING (aln_id) WHERE COALESCE(g.im, 0) <= 500000"""),
)

#: Reference blocks of lifted records, from their CIGAR text.
BLOCKS = (
    *LIFT,
    ("o_bt", "SELECT aln_id, generate_subscripts(l, 1) AS k, unnest(l) AS t FROM (SELECT aln_id, regexp_extract_all(g_cigar, '[0-9]+[MIDNSHP=X]') AS l FROM o_lift) x"),
    ("o_bo", "SELECT aln_id, k, right(t, 1) AS op, CAST(left(t, length(t) - 1) AS BIGINT) AS len FROM o_bt"),
    ("o_bp", "SELECT *, CAST(COALESCE(SUM(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM o_bo"),
    ("o_at", "SELECT b.aln_id, l.chrom, l.flag, l.mapq, l.sample, b.op, b.len, l.g_start + b.off AS b_start, l.g_start + b.off + b.len AS b_end FROM o_bp b JOIN o_lift l USING (aln_id)"),
    ("o_block", "SELECT * FROM o_at WHERE op IN ('M','=','X')"),
)

#: Depth by place: every event place and the depth after it.
DEPTH = (
    *BLOCKS,
    ("o_ev", "SELECT chrom, p, SUM(d) AS d FROM (SELECT chrom, b_start AS p, 1 AS d FROM o_block WHERE (flag & 1796) = 0 UNION ALL SELECT chrom, b_end, -1 FROM o_block WHERE (flag & 1796) = 0) x GROUP BY chrom, p HAVING SUM(d) <> 0"),
    ("o_sw", "SELECT chrom, p AS run_start, LEAD(p) OVER w AS run_end, CAST(SUM(d) OVER w AS BIGINT) AS depth FROM o_ev WINDOW w AS (PARTITION BY chrom ORDER BY p)"),
    ("o_runs", "SELECT * FROM o_sw WHERE depth > 0"),
)

#: Pair restoration.
PAIRS = (
    *LIFT,
    ("o_key", "SELECT aln_id, qname, tx_id, flag, chrom, g_start, g_end, COALESCE(hi, CASE WHEN COALESCE(nh, 1) = 1 THEN 0 ELSE (g_start * 31 + (flag & 16)) % 65536 END) AS hi_key FROM o_lift"),
    ("o_rn", "SELECT *, ROW_NUMBER() OVER (PARTITION BY qname, tx_id, hi_key, flag & 1 ORDER BY aln_id) AS rn, COUNT(*) OVER (PARTITION BY qname, tx_id, hi_key, flag & 1) AS n FROM o_key"),
    ("o_pk", "SELECT *, CASE WHEN (flag & 1) = 0 THEN NULL WHEN rn % 3 = 0 THEN -1 WHEN rn % 3 = 1 AND rn = n THEN 0 ELSE 1 END AS pk, (rn - 1) // 3 AS no FROM o_rn"),
    ("o_side", "SELECT *, ROW_NUMBER() OVER (PARTITION BY qname, hi_key, pk, (flag & 64) <> 0 ORDER BY aln_id) AS rk FROM o_pk"),
    ("o_cross", "SELECT a.aln_id AS a, b.aln_id AS b, a.rk FROM o_side a JOIN o_side b ON a.pk = 0 AND b.pk = 0 AND a.qname = b.qname AND a.hi_key = b.hi_key AND a.rk = b.rk AND (a.flag & 64) <> 0 AND (b.flag & 64) = 0"),
    ("o_pk2", "SELECT s.*, CASE WHEN c.rk IS NOT NULL THEN 2 ELSE s.pk END AS pk2, CASE WHEN c.rk IS NOT NULL THEN c.rk - 1 WHEN s.pk = 1 THEN s.no END AS no2 FROM o_side s LEFT JOIN (SELECT a AS aln_id, rk FROM o_cross UNION ALL SELECT b, rk FROM o_cross) c USING (aln_id)"),
    ("o_mates", """SELECT x.qname, x.pk2, x.tx_id AS t1, y.tx_id AS t2, x.aln_id AS a1, y.aln_id AS a2, x.chrom AS c1, y.chrom AS c2, x.g_start AS s1, x.g_end AS e1, y.g_start AS s2, y.g_end AS e2
        FROM o_pk2 x JOIN o_pk2 y ON x.pk2 IN (1, 2) AND y.pk2 = x.pk2 AND x.qname = y.qname AND x.hi_key = y.hi_key AND x.no2 = y.no2 AND (x.pk2 = 2 OR x.tx_id = y.tx_id) AND x.aln_id <> y.aln_id
        WHERE CASE WHEN (x.flag & 64) <> (y.flag & 64) THEN (x.flag & 64) <> 0 WHEN x.g_start <> y.g_start THEN x.g_start < y.g_start ELSE x.aln_id < y.aln_id END"""),
)


def over(query: str, *ctes: tuple[str, str]) -> str:
    return with_views(query, *ctes)
