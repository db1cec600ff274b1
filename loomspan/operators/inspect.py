"""Reports over records: each is one aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import cigar

_PRIMARY = "(flag & 2304) = 0"
#: Lines of the flag tally, in order; the conditions are SQL.
FLAGSTAT = (
    ("total", "true"),
    ("primary", _PRIMARY),
    ("secondary", "(flag & 256) <> 0"),
    ("supplementary", "(flag & 2048) <> 0 AND (flag & 256) = 0"),
    ("duplicates", "(flag & 1024) <> 0"),
    ("primary_duplicates", f"(flag & 1024) <> 0 AND {_PRIMARY}"),
    ("mapped", "(flag & 4) = 0"),
    ("primary_mapped", f"(flag & 4) = 0 AND {_PRIMARY}"),
    ("paired", f"(flag & 1) <> 0 AND {_PRIMARY}"),
    ("read1", f"(flag & 65) = 65 AND {_PRIMARY}"),
    ("read2", f"(flag & 129) = 129 AND {_PRIMARY}"),
    ("properly_paired", f"(flag & 3) = 3 AND (flag & 4) = 0 AND {_PRIMARY}"),
    ("both_mapped", f"(flag & 1) <> 0 AND (flag & 12) = 0 AND {_PRIMARY}"),
    ("singletons", f"(flag & 1) <> 0 AND (flag & 12) = 8 AND {_PRIMARY}"),
    ("mate_other_reference", f"(flag & 1) <> 0 AND (flag & 12) = 0 AND rnext IS NOT NULL AND rnext <> '=' AND rnext <> rname AND {_PRIMARY}"),
    ("mate_other_reference_mapq5", f"(flag & 1) <> 0 AND (flag & 12) = 0 AND rnext IS NOT NULL AND rnext <> '=' AND rnext <> rname AND mapq >= 5 AND {_PRIMARY}"),
)


def flagstat(reads: DataFrame) -> DataFrame:
    """line, metric, passed, failed: the 16 tallies by QC bit, from one pass."""
    if "rnext" not in reads.columns:
        reads = reads.withColumn("rnext", F.lit(None).cast("string"))
    one = reads.agg(*[F.struct(F.expr(f"count_if(({c}) AND (flag & 512) = 0)").alias("p"), F.expr(f"count_if(({c}) AND (flag & 512) <> 0)").alias("f")).alias(n) for n, c in FLAGSTAT])
    rows = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(n).alias("metric"), F.col(f"{n}.p").alias("passed"), F.col(f"{n}.f").alias("failed")) for i, (n, _) in enumerate(FLAGSTAT)])
    return one.select(F.inline(rows))


def idxstats(reads: DataFrame, sq: DataFrame) -> DataFrame:
    """rname, ln, mapped, unmapped for each header sequence, and '*' for records without one."""
    per = reads.groupBy(F.coalesce("rname", F.lit("*")).alias("rname")).agg(F.expr("count_if((flag & 4) = 0)").alias("mapped"), F.expr("count_if((flag & 4) <> 0)").alias("unmapped"))
    names = sq.select(F.col("chrom").alias("rname"), "ln").unionByName(reads.sparkSession.createDataFrame([("*", 0)], "rname string, ln bigint"))
    zero = F.lit(0).cast("bigint")
    return names.join(per, "rname", "left").select("rname", "ln", F.coalesce("mapped", zero).alias("mapped"), F.coalesce("unmapped", zero).alias("unmapped"))


def histograms(reads: DataFrame) -> DataFrame:
    """metric, bucket, n: read length, MAPQ, operations by kind (in bases), GC and N percent, clipped bases, splices a record,
    lengths of introns, insertions and deletions, tags present, mates of paired records, and the nanopore columns end_reason,
    channel and polya where the table has them. One scan, one shuffle."""
    ops = F.expr(
        "flatten(transform(_c, c -> array(named_struct('metric', 'cigar_bases', 'bucket', c.op, 'n', cast(c.len AS bigint)), named_struct('metric', "
        "CASE c.op WHEN 'N' THEN 'intron' WHEN 'I' THEN 'insertion' WHEN 'D' THEN 'deletion' END, 'bucket', cast(c.len AS string), 'n', 1L))))"
    )
    one = lambda m, b: F.struct(F.lit(m).alias("metric"), b.cast("string").alias("bucket"), F.lit(1).cast("bigint").alias("n"))
    share = lambda of: F.expr(f"(length(seq) - length(translate(seq, '{of}', ''))) * 100 div nullif(length(seq), 0)")
    clip = F.expr("aggregate(filter(_c, c -> c.op = 'S'), 0, (a, c) -> a + c.len)")
    fixed = [one("length", F.length("seq")), one("mapq", F.col("mapq")), one("gc_percent", share("GCgc")), one("n_percent", share("Nn")), one("soft_clip", clip)]
    fixed += [one("splices", F.expr("CASE WHEN _c IS NOT NULL THEN size(filter(_c, c -> c.op = 'N')) END"))]
    fixed += [one("tag", F.when(F.col(c).isNotNull(), c.upper())) for c in ("nh", "hi", "rg") if c in reads.columns]
    fixed += [one("mate", F.expr("CASE WHEN (flag & 1) = 0 THEN NULL WHEN (flag & 192) = 64 THEN 'first' WHEN (flag & 192) = 128 THEN 'second' ELSE 'other' END"))]
    fixed += [one(c, F.col(c)) for c in ("end_reason", "channel", "polya") if c in reads.columns]
    from loomspan.operators.lift import made_once

    used = [c for c in ("seq", "mapq", "cigar", "nh", "hi", "rg", "flag", "end_reason", "channel", "polya") if c in reads.columns]
    df = made_once(made_once(reads, [], used).withColumn("_c", cigar.parse("cigar")), used, ["_c"]).select(F.inline(F.concat(F.array(*fixed), F.coalesce(ops, F.array().cast("array<struct<metric:string,bucket:string,n:bigint>>")))))
    return df.where("metric IS NOT NULL AND bucket IS NOT NULL").groupBy("metric", "bucket").agg(F.sum("n").alias("n"))


def tagcheck(reads: DataFrame, tags: tuple[str, ...] = ("seq", "hi", "rg")) -> DataFrame:
    """class (primary, secondary, supplementary, TOTAL), records and the number that lack each column."""
    kind = F.expr("CASE WHEN (flag & 256) <> 0 THEN 'secondary' WHEN (flag & 2048) <> 0 THEN 'supplementary' ELSE 'primary' END")
    rolled = reads.withColumn("_class", kind).rollup("_class").agg(F.count("*").alias("records"), *[F.count_if(F.col(t).isNull() | (F.col(t).cast("string") == "*")).alias(f"no_{t}") for t in tags])
    return rolled.withColumnRenamed("_class", "class").withColumn("class", F.coalesce("class", F.lit("TOTAL")))


def samples(reads: DataFrame, column: str = "sample") -> DataFrame:
    """Distinct values of the sample column."""
    return reads.select(column).where(F.col(column).isNotNull()).distinct()


def read_groups(lines: DataFrame, tag: str = "SM") -> DataFrame:
    """Distinct values of a tag in the @RG lines (column value) of headers; the lines may hold other records too."""
    found = lines.where(F.col("value").startswith("@RG\t")).select(F.regexp_extract("value", f"\t{tag}:([^\t]*)", 1).alias(tag.lower()))
    return found.where(F.col(tag.lower()) != "").distinct()


def index_windows(lifted: DataFrame, width: int = 1 << 14) -> DataFrame:
    """chrom, window, records, first_start and last_end of the records that begin in each window: what a reader needs to tell
    which part of a table sorted by place to open."""
    return lifted.groupBy("chrom", F.expr(f"g_start div {width}").alias("window")).agg(F.count("*").alias("records"), F.min("g_start").alias("first_start"), F.max("g_end").alias("last_end"))


def checksum(reads: DataFrame, columns: tuple[str, ...] = ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")) -> DataFrame:
    """records and two digests that no order changes: the sum, wide enough not to overflow, and the exclusive or of row hashes."""
    h = F.xxhash64(*columns)
    return reads.agg(F.count("*").alias("records"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(h).alias("digest_xor"))


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n records of the input."""
    return reads.orderBy("aln_id").limit(n)


def missing_tags(reads: DataFrame, tag: str) -> DataFrame:
    """Names of records without the column."""
    return reads.where(F.col(tag).isNull()).select("qname").distinct()


def validate(lifted: DataFrame, tx: DataFrame) -> DataFrame:
    """aln_id and three verdicts: chromosome of the transcript, blocks inside its exons, tags in keeping with CIGAR and place."""
    from loomspan.operators.lift import join_transcripts

    df = join_transcripts(lifted.select("aln_id", "tx_id", F.col("chrom").alias("_chrom"), "g_start", "g_end", "g_cigar", "xl", "xp"), tx).withColumn("_c", cigar.parse("g_cigar"))
    df = df.withColumn("_r", F.expr("transform(_c, c -> CASE WHEN instr('MDN=X', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END)"))
    from loomspan.functions.arrays import with_running_sums

    df = with_running_sums(df, "_r", "_e")
    blocks = "forall(sequence(0, size(_c) - 1), k -> _c[k].op NOT IN ('M', '=', 'X', 'D') OR exists(exons, e -> e.start <= g_start + _e[k] - _r[k] AND e.end >= g_start + _e[k]))"
    return df.select(
        "aln_id",
        (F.col("_chrom") == F.col("chrom")).alias("chrom_ok"),
        F.expr(f"CASE WHEN size(_e) > 0 AND size(_c) > 0 THEN {blocks} ELSE false END").alias("blocks_ok"),
        ((F.expr("element_at(_e, -1)") == F.col("xp")) & (F.col("g_start") + F.col("xp") == F.col("g_end")) & (cigar.span("_c") == F.col("xl"))).alias("tags_ok"),
    )
