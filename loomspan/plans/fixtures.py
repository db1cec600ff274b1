"""Alignment and annotation tables derived from the star schema, as one SQL text for Spark and for DuckDB.

Integer arithmetic over non-negative numbers only, so both engines give the same rows. aln_id orders records by order key and
line number, without a global sort: the lower 20 bits tell lines with the same number apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "part", "lineitem", "events")

#: name: SQL. {div} is integer division; a view may use those before it.
VIEWS = {
    "fx_exons": """
        SELECT gene_id, tx_id, chrom, strand, ex_start, ex_start + ex_length AS ex_end, i, k, ex_length FROM (
          SELECT concat('G', CAST(i {div} 4 AS STRING)) AS gene_id, concat('TX', CAST(i AS STRING), '.', CAST(1 + i % 3 AS STRING)) AS tx_id,
            CASE (i {div} 4) % 5 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' WHEN 2 THEN 'chr10' WHEN 3 THEN 'chrX' ELSE 'chrM' END AS chrom,
            CASE WHEN (i {div} 4) % 2 = 0 THEN '+' ELSE '-' END AS strand,
            1000 + ((i {div} 4) {div} 5) * 200000 + (i % 4) * 50 + k * (400 + (37 * i) % 1500) + CASE WHEN i % 50 = 0 AND k >= 1 THEN 600000 ELSE 0 END AS ex_start,
            CASE WHEN k = 1 AND i % 3 = 0 THEN 12 + (13 * i) % 20 ELSE 80 + (13 * i + 29 * k) % 120 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END AS ex_length, i, k
          FROM (SELECT CAST(p_partkey AS BIGINT) AS i, 1 + p_size % 6 AS n FROM part) p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS ks(k) WHERE k < n) x""",
    "fx_gtf_rows": """
        SELECT 100 * i + 10 * k + j AS line_no, chrom, feature, row_start, row_end, strand, gene_id, tx_id FROM (
          SELECT i, k, 0 AS j, chrom, 'exon' AS feature, ex_start AS row_start, ex_end - CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END AS row_end, strand, gene_id, tx_id FROM fx_exons
          UNION ALL SELECT i, k, 1, chrom, 'CDS', ex_start + 4, ex_end - CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END - 4, strand, gene_id, tx_id FROM fx_exons
          UNION ALL SELECT i, k, 2, chrom, 'UTR', ex_end - 15, ex_end, strand, gene_id, tx_id FROM fx_exons WHERE k % 3 = 0) x""",
    "fx_reads": """
        SELECT aln_id, concat('R', CAST(o AS STRING)) AS qname, concat('S', CAST(supp % 3 AS STRING)) AS sample,
          CASE WHEN ln = 6 AND supp % 7 = 0 THEN 'TXMISSING' WHEN ln = 7 THEN concat('TX', CAST(i AS STRING)) ELSE concat('TX', CAST(i AS STRING), '.', CAST(1 + i % 3 AS STRING)) END AS rname,
          CAST(CASE WHEN o % 2 = 0 THEN 1 + CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END ELSE 0 END + CASE WHEN rf = 'R' THEN 16 ELSE 0 END
            + CASE WHEN ln IN (3, 5) THEN 256 ELSE 0 END + CASE WHEN ln = 6 THEN 2048 ELSE 0 END + CASE WHEN ls = 'O' AND c % 97 = 0 THEN 4 ELSE 0 END AS INT) AS flag,
          CAST(c % 61 AS INT) AS mapq, CAST(c % 150 AS INT) AS pos, cigar,
          substr(repeat(translate(md5(CAST(aln_id AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 8), 1, CAST(ql AS INT)) AS seq,
          substr(repeat(translate(md5(concat('q', CAST(aln_id AS STRING))), '0123456789abcdef', '!#%+05:?@ABDEFGI'), 8), 1, CAST(ql AS INT)) AS qual,
          CASE WHEN o % 11 <> 0 THEN 0 END AS hi, CAST(1 + supp % 3 AS INT) AS nh, CASE WHEN supp % 10 <> 0 THEN concat('RG', CAST(supp % 4 AS STRING)) END AS rg
        FROM (SELECT *, CASE c % 8
            WHEN 0 THEN concat(a, 'M') WHEN 1 THEN concat('3S', a, 'M') WHEN 2 THEN concat(a, 'M2I', b, 'M') WHEN 3 THEN concat(a, 'M4D', b, 'M')
            WHEN 4 THEN concat(a, '=1X', b, '=') WHEN 5 THEN concat('5H2S', a, 'M1S') WHEN 6 THEN concat(a, 'M77N', b, 'M') ELSE concat(a, 'M2I', b - b + 3, 'D') END AS cigar,
            CASE c % 8 WHEN 0 THEN a WHEN 1 THEN a + 3 WHEN 2 THEN a + 2 + b WHEN 3 THEN a + b WHEN 4 THEN a + 1 + b WHEN 5 THEN a + 3 WHEN 6 THEN a + b ELSE a + 2 END AS ql
          FROM (SELECT l_orderkey AS o, l_linenumber AS ln, l_suppkey AS supp, l_returnflag AS rf, l_linestatus AS ls, CAST(ROUND(100 * l_extendedprice) AS BIGINT) AS c,
              CAST(l_quantity AS INT) AS a, CAST(20 + l_suppkey % 30 AS INT) AS b, (7 * l_orderkey + l_linenumber {div} 3) % (SELECT count(*) FROM part) AS i,
              (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 7919 + l_suppkey * 104729 + CAST(ROUND(100 * l_extendedprice) AS BIGINT)) % 1048576 AS aln_id
            FROM lineitem) x) y""",
    "fx_bed": """
        SELECT concat('B', CAST(n_nationkey AS STRING)) AS name, chrom, CAST(1000 + n_nationkey * 2000 + n_regionkey * 300 AS BIGINT) AS bed_start,
          CAST(1000 + n_nationkey * 2000 + n_regionkey * 300 + 500 + 40 * (n_nationkey % 7) AS BIGINT) AS bed_end
        FROM nation CROSS JOIN (VALUES ('chr1'), ('chr2'), ('chr10'), ('chrX'), ('chrM')) AS cs(chrom)""",
    "fx_summary": """
        SELECT concat('R', CAST(event_id AS STRING)) AS read_id, CAST(ROUND(100 * value) AS BIGINT) AS st, event_type AS end_reason, CAST(user_id % 512 AS INT) AS channel FROM events""",
    "fx_genome": """
        SELECT chrom, bin, translate(concat(md5(concat(chrom, ':', CAST(bin AS STRING), ':a')), md5(concat(chrom, ':', CAST(bin AS STRING), ':b'))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
        FROM (SELECT DISTINCT chrom, b.bin AS bin FROM (SELECT chrom, ex_start {div} 64 AS lo, ex_end {div} 64 AS hi FROM fx_exons) e {spread}) g""",
}
_SPREAD = {
    "spark": "LATERAL VIEW explode(sequence(greatest(lo - 3, 0), hi + 3)) b AS bin",
    "duckdb": ", LATERAL (SELECT unnest(range(greatest(lo - 3, 0), hi + 4)) AS bin) b",
}


def sql(name: str, engine: str) -> str:
    """A view's SQL for 'spark' or 'duckdb'."""
    return VIEWS[name].format(div="div" if engine == "spark" else "//", spread=_SPREAD[engine])


def with_views(query: str, *extra: tuple[str, str]) -> str:
    """DuckDB SQL of a query over the views and further (name, SQL) ones."""
    parts = [f"{n} AS ({sql(n, 'duckdb')})" for n in VIEWS] + [f"{n} AS ({q})" for n, q in extra]
    return "WITH " + ",\n".join(parts) + "\n" + query


class Fixtures:
    """The views of a directory as DataFrames, each built once, on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        """A table; one with fewer splits than cores is dealt over them, as record work is heavy beside its bytes. A part becomes some
        35 tiles of the genome, so a split holds a small number of bytes of parts."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name == "part":
            cores = max(cores, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >> 19)
        return df.repartition(cores) if name in ("lineitem", "part") and df._jdf.rdd().getNumPartitions() < cores else df

    def __getattr__(self, name: str) -> DataFrame:
        key = f"fx_{name}"
        if key not in VIEWS:
            raise AttributeError(name)
        if key not in self._made:
            text = sql(key, "spark").replace("{", "{{").replace("}", "}}")
            used = {t: self.table(t) for t in TABLES if f" {t}" in text} | {v: getattr(self, v[3:]) for v in VIEWS if v != key and v in text}
            for t in used:
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            self._made[key] = self.spark.sql(text, **used)
        return self._made[key]

    @property
    def sizes(self) -> DataFrame:
        """chrom and size (the last exon end and 1,000,000); chrM has none."""
        from pyspark.sql import functions as F

        return self.exons.where("chrom <> 'chrM'").groupBy("chrom").agg((F.max("ex_end") + 1_000_000).cast("bigint").alias("size"))
