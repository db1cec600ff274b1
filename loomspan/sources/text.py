"""Text formats as DataFrames: GTF, SAM, FASTA, lists, sizes, BED and summaries, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.sequence import gtf_attribute, reverse_complement
from loomspan.operators.lift import made_once

# The feature kinds of GTF rows that build exons.
EXON_KINDS = ("exon", "CDS", "UTR", "five_prime_utr", "three_prime_utr")
_SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def parse_gtf(lines: DataFrame, exons_only: bool = False) -> DataFrame:
    """lines (value) to gene_id, tx_id, chrom, strand, feature, ex_start, ex_end, 0-based and half-open. Comments, short rows,
    rows of other kinds and rows without a transcript_id are skipped."""
    cols = F.split("value", "\t")
    kinds = ("exon",) if exons_only else EXON_KINDS
    df = made_once(made_once(lines, [], ["value"]).where(~F.col("value").startswith("#")).withColumn("_f", cols), [], ["_f"]).where("size(_f) >= 9").where(F.col("_f")[2].isin(*kinds))
    df = df.select(
        F.coalesce(gtf_attribute(F.col("_f")[8], "gene_id"), F.lit("unknown")).alias("gene_id"),
        gtf_attribute(F.col("_f")[8], "transcript_id").alias("tx_id"),
        F.col("_f")[0].alias("chrom"),
        F.col("_f")[6].alias("strand"),
        F.col("_f")[2].alias("feature"),
        (F.col("_f")[3].cast("bigint") - 1).alias("ex_start"),
        F.col("_f")[4].cast("bigint").alias("ex_end"),
    )
    df = made_once(df, [], df.columns)
    return df.where("tx_id IS NOT NULL")


def read_gtf(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_gtf(spark.read.text(path), **options)


def format_gtf(rows: DataFrame) -> DataFrame:
    """value: GTF lines of gene_id, tx_id, chrom, strand, feature, row_start, row_end."""
    return rows.select(F.concat_ws("\t", "chrom", F.lit("loomspan"), "feature", (F.col("row_start") + 1).cast("string"), F.col("row_end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "tx_id", F.lit('";'))).alias("value"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """lines (value) of SAM records to columns; '*' is null, places 0-based; tags a map from name to (type, text)."""
    # The line is split once; NH, HI and RG are looked up in its end, from the tab before the tags on, without the map.
    end = F.expr("substring(value, length(substring_index(value, '\t', 11)) + 1)")
    df = made_once(lines, [], ["value"]).where(~F.col("value").startswith("@")).withColumns({"_f": F.split("value", "\t"), "_x": end})
    df = made_once(df, [], ["_f", "_x"]).where("size(_f) >= 11")
    tag = lambda t: F.when(F.col("_x").contains(f"\t{t}:"), F.regexp_extract("_x", f"\t{t}:..([^\t]*)", 1))
    raw = {n: F.col("_f")[i] for i, n in enumerate(_SAM)}
    some = lambda c: F.when(c != "*", c)
    tags = F.expr("map_from_entries(transform(slice(_f, 12, greatest(size(_f) - 11, 0)), t -> struct(left(t, 2), named_struct('type', substr(t, 4, 1), 'text', substr(t, 6)))))")
    whole = {n: raw[n].cast("int") for n in ("flag", "mapq", "tlen")}
    return df.select(
        raw["qname"].alias("qname"), whole["flag"].alias("flag"), some(raw["rname"]).alias("rname"), (raw["pos"].cast("int") - 1).alias("pos"), whole["mapq"].alias("mapq"), some(raw["cigar"]).alias("cigar"),
        F.when(raw["rnext"] == "=", raw["rname"]).otherwise(some(raw["rnext"])).alias("rnext"), (raw["pnext"].cast("int") - 1).alias("pnext"), whole["tlen"].alias("tlen"), some(raw["seq"]).alias("seq"), some(raw["qual"]).alias("qual"), tags.alias("tags"),
        tag("NH").cast("int").alias("nh"), tag("HI").cast("int").alias("hi"), tag("RG").alias("rg"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def parse_sam_header(lines: DataFrame) -> DataFrame:
    """kind, ord, name (SN or ID), value (the rest) of header lines."""
    df = lines.where(F.col("value").rlike("^@[A-Z]{2}"))
    name = F.nullif(F.regexp_extract("value", "\t(?:SN|ID):([^\t]+)", 1), F.lit(""))
    return df.select(F.substring("value", 2, 2).alias("kind"), F.monotonically_increasing_id().alias("ord"), name.alias("name"), F.expr("substr(value, 5)").alias("value"))


def format_sam(reads: DataFrame) -> DataFrame:
    """value: SAM lines; nulls are '*' (0 for numbers), NH, HI and RG come back as tags."""
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    have = lambda c, d: F.col(c) if c in reads.columns else F.lit(d)
    tag = lambda c, t: F.when(F.col(c).isNotNull(), F.concat(F.lit(t), F.col(c).cast("string"))) if c in reads.columns else F.lit(None).cast("string")
    rnext = F.coalesce(F.when(have("rnext", None) == F.col("rname"), F.lit("=")).otherwise(have("rnext", None)), F.lit("*"))
    fields = [F.col("qname"), F.col("flag").cast("string"), star("rname"), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.col("mapq").cast("string"), star("cigar"), rnext, (F.coalesce(have("pnext", None).cast("int"), F.lit(-1)) + 1).cast("string"), F.coalesce(have("tlen", 0).cast("string"), F.lit("0")), star("seq"), star("qual")]
    return reads.select(F.concat_ws("\t", *fields, tag("nh", "NH:i:"), tag("hi", "HI:i:"), tag("rg", "RG:Z:")).alias("value"))


def sequence_records(reads: DataFrame, require: int = 0, reject: int = 0x900, suffix: bool = False) -> DataFrame:
    """name, route (1, 2, 0 or s) and the sequence and qualities as sequenced: reverse-strand records are turned back.
    Routes: first and second mates, reads that say neither or both, and single reads."""
    f = F.col("flag")
    df = reads.where((f.bitwiseAND(F.lit(require)) == require) & (f.bitwiseAND(F.lit(reject)) == 0) & F.col("seq").isNotNull())
    mate = f.bitwiseAND(F.lit(192))
    route = F.when(f.bitwiseAND(F.lit(1)) == 0, "s").when(mate == 64, "1").when(mate == 128, "2").otherwise("0")
    back = f.bitwiseAND(F.lit(16)) != 0
    name = F.when(F.lit(suffix) & route.isin("1", "2"), F.concat("qname", F.lit("/"), route)).otherwise(F.col("qname"))
    return df.select("aln_id", name.alias("name"), route.alias("route"), F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def format_fastq(records: DataFrame) -> DataFrame:
    return records.select("route", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.repeat(F.lit("B"), F.length("seq")))).alias("value"))


def format_fasta(records: DataFrame) -> DataFrame:
    return records.select("route", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def write_routes(text: DataFrame, path: str) -> None:
    """One folder of text a route."""
    text.write.partitionBy("route").text(path)


def parse_fasta(lines: DataFrame, width: int = 64) -> DataFrame:
    """lines (value, in file order under line_no) to chrom, bin, seq tiles of `width` bases. Each name's lines are placed by
    running sums of their lengths."""
    from pyspark.sql import Window

    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("_h", F.when(F.col("value").startswith(">"), F.regexp_extract("value", "^>(\\S+)", 1)))
    named = named.withColumn("chrom", F.last("_h", ignorenulls=True).over(w)).where("_h IS NULL AND value <> ''")
    per = Window.partitionBy("chrom").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("_at", F.coalesce(F.sum(F.length("value")).over(per), F.lit(0)))
    spread = placed.select("chrom", "_at", "value", F.explode(F.expr(f"sequence(_at div {width}, (_at + length(value) - 1) div {width})")).alias("bin"))
    part = spread.select("chrom", "bin", F.struct(F.greatest(F.lit(0), F.col("_at") - F.col("bin") * width).alias("at"), F.expr(f"substr(value, cast(greatest(0, bin * {width} - _at) AS int) + 1, cast(least(_at + length(value), (bin + 1) * {width}) - greatest(_at, bin * {width}) AS int))").alias("text")).alias("p"))
    return part.groupBy("chrom", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("seq"))


def fetch(genome: DataFrame, regions: DataFrame, width: int = 64) -> DataFrame:
    """name, seq of regions (name, chrom, r_start, r_end; 1-based, inclusive) from tiles; only the tiles under them are read."""
    wanted = regions.withColumn("bin", F.explode(F.expr(f"sequence((r_start - 1) div {width}, (r_end - 1) div {width})")))
    hit = wanted.join(genome, ["chrom", "bin"]).withColumn("_low", F.greatest(F.lit(0), F.col("r_start") - 1 - F.col("bin") * width)).withColumn("_high", F.least(F.lit(width), F.col("r_end") - F.col("bin") * width))
    piece = F.struct("bin", F.expr("substr(seq, cast(_low AS int) + 1, cast(_high - _low AS int))").alias("text"))
    return hit.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("seq"))


def sequence_dictionary(genome: DataFrame) -> DataFrame:
    """chrom, ln, m5 from whole sequences (chrom, seq)."""
    return genome.select("chrom", F.length("seq").cast("bigint").alias("ln"), F.md5(F.upper("seq").cast("binary")).alias("m5"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """id: one a line; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' AND NOT startswith(id, '#')").distinct()


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size; rows of fewer than two columns are skipped."""
    return spark.read.text(path).withColumn("_f", F.split("value", "\t")).where("size(_f) >= 2").select(F.col("_f")[0].alias("chrom"), F.col("_f")[1].cast("bigint").alias("size"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, bed_start, bed_end, name."""
    rows = spark.read.text(path).where("NOT value RLIKE '^(#|track|browser)'").withColumn("_f", F.split("value", "\t")).where("size(_f) >= 3")
    return rows.select(F.col("_f")[0].alias("chrom"), F.col("_f")[1].cast("bigint").alias("bed_start"), F.col("_f")[2].cast("bigint").alias("bed_end"), F.expr("try_element_at(_f, 4)").alias("name"))


def read_summary(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A sequencing summary with any order of columns; those that aren't asked for are ignored, absent ones are null."""
    raw = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.csv(path, sep="\t", header=True)
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(t) for c, t in columns.items()])
