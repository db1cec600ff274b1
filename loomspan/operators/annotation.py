"""Annotation model: exon merge, transcript offsets, gene bounds, identifier resolution and the sequence header."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.sequence import strip_version

#: A table of the annotation up to this many rows is replicated to the tasks; a larger one is joined by a shuffle, as the driver
#: would have to hold it whole.
BROADCAST_TRANSCRIPTS = 50_000
DEFAULT_TAIL = 1_000_000


def _seen(rows: DataFrame) -> str:
    """The column that tells which row came first."""
    return "line_no" if "line_no" in rows.columns else "ex_start"


def merge_exons(rows: DataFrame) -> DataFrame:
    """gene_id, tx_id, chrom, strand, ex_start, ex_end, and with line_no in rows also the transcript's first: overlapping or touching
    rows of a transcript become one exon; its first row (by line_no, else by place) tells gene, chromosome and strand."""
    first = F.min_by(F.struct("gene_id", "chrom", "strand"), F.struct(_seen(rows), "gene_id", "chrom", "strand")).over(Window.partitionBy("tx_id"))
    kept = ["line_no"] if "line_no" in rows.columns else []
    rows = rows.withColumn("_of", first).withColumns({c: F.col(f"_of.{c}") for c in ("gene_id", "chrom", "strand")}).drop("_of")
    rows = rows.withColumns({c: F.min(c).over(Window.partitionBy("tx_id")) for c in kept})
    w = Window.partitionBy("tx_id").orderBy("ex_start", "ex_end")
    reach = F.max("ex_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("_new", F.when(F.col("ex_start") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy("gene_id", "tx_id", "chrom", "strand", *kept, "_island").agg(F.min("ex_start").alias("ex_start"), F.max("ex_end").alias("ex_end")).drop("_island")


def exon_offsets(exons: DataFrame) -> DataFrame:
    """Adds rank and tx_off (bases before the exon, in transcript direction) and g_off (in genome direction)."""
    length = F.col("ex_end") - F.col("ex_start")
    genome = Window.partitionBy("tx_id").orderBy("ex_start").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(length).over(Window.partitionBy("tx_id"))
    g_off = F.coalesce(F.sum(length).over(genome), F.lit(0)).cast("bigint")
    with_off = exons.withColumn("ex_len", length).withColumn("g_off", g_off).withColumn("tx_len", total.cast("bigint"))
    with_off = with_off.withColumn("tx_off", F.when(F.col("strand") == "+", F.col("g_off")).otherwise(F.col("tx_len") - F.col("g_off") - F.col("ex_len")))
    rank = F.row_number().over(Window.partitionBy("tx_id").orderBy("tx_off"))
    return with_off.withColumn("exon_rank", rank)


def gene_bounds(exons: DataFrame) -> DataFrame:
    """gene_id, gene_start, gene_end over all its transcripts."""
    return exons.groupBy("gene_id").agg(F.min("ex_start").alias("gene_start"), F.max("ex_end").alias("gene_end"))


def build_transcripts(exons: DataFrame) -> DataFrame:
    """One row a transcript: tx_id, gene_id, chrom, strand, tx_len, gene_start, gene_end and exons in genome order. The first-seen
    exon (by line_no, else by place) tells gene, chromosome and strand, all three together."""
    offsets = exon_offsets(exons)
    first = F.min_by(F.struct("gene_id", "chrom", "strand"), F.struct(_seen(exons), "gene_id", "chrom", "strand"))
    one = offsets.groupBy("tx_id").agg(
        first.alias("_of"),
        F.max("tx_len").alias("tx_len"),
        F.array_sort(F.collect_list(F.struct("g_off", F.col("ex_start").alias("start"), F.col("ex_end").alias("end"), F.col("ex_len").alias("len")))).alias("exons"),
    )
    one = one.withColumns({c: F.col(f"_of.{c}") for c in ("gene_id", "chrom", "strand")})
    return one.join(gene_bounds(exons), "gene_id").select("tx_id", "gene_id", "chrom", "strand", "tx_len", "gene_start", "gene_end", "exons")


def resolver(tx: DataFrame, mode: str = "lookup") -> DataFrame:
    """key, tx_id, prio, ord: the names that stand for a transcript. Lower prio wins, then the transcript that comes last (by line_no
    in tx, else by id).

    strict: its own id. strip: the id up to the first dot. permissive: also with and without a chr prefix.
    lookup: its id, else the id's base."""
    ids = tx.groupBy("tx_id").agg((F.min("line_no") if "line_no" in tx.columns else F.lit(0)).cast("bigint").alias("ord"))
    own = ids.select(F.col("tx_id").alias("key"), "tx_id", F.lit(0).alias("prio"), "ord")
    base = ids.select(strip_version(F.col("tx_id")).alias("key"), "tx_id", F.lit(1).alias("prio"), "ord")
    if mode == "strict":
        return own
    if mode == "strip":
        return base
    found = own.unionByName(base)
    if mode == "permissive":
        bare = F.regexp_replace("key", "^(?i:chr)", "")
        found = found.unionByName(found.select(bare.alias("key"), "tx_id", (F.col("prio") + 2).alias("prio"), "ord")).unionByName(
            found.select(F.concat(F.lit("chr"), bare).alias("key"), "tx_id", (F.col("prio") + 2).alias("prio"), "ord")
        )
    return found


def resolve_names(names: DataFrame, tx: DataFrame, mode: str = "lookup") -> DataFrame:
    """rname, tx_id for each distinct rname that a transcript answers to; base collisions go to the last transcript.

    Only distinct names are resolved, so the reads themselves are joined once, by the equality of rname."""
    keys = resolver(tx, "strip" if mode == "strip" else "lookup" if mode == "auto" else mode)
    wanted = names.select("rname").where(F.col("rname").isNotNull()).distinct()
    if mode == "auto":
        strict = wanted.join(resolver(tx, "strict"), wanted["rname"] == F.col("key"), "left_anti").limit(1).count() == 0
        keys = resolver(tx, "strict" if strict else "strip")
    asked = wanted.select("rname", F.col("rname").alias("key"), F.lit(0).alias("q"))
    if mode != "strict":
        asked = asked.unionByName(wanted.select("rname", strip_version(F.col("rname")).alias("key"), F.lit(1).alias("q")))
    best = F.min_by("tx_id", F.struct("q", "prio", F.lit(0)))
    hits = asked.join(keys, "key").groupBy("rname", "q", "prio").agg(F.max_by("tx_id", F.struct("ord", "tx_id")).alias("tx_id"))
    return hits.groupBy("rname").agg(best.alias("tx_id"))


def base_collisions(tx: DataFrame) -> DataFrame:
    """base, n: bases that several transcript ids share."""
    return tx.select("tx_id").distinct().groupBy(strip_version(F.col("tx_id")).alias("base")).agg(F.count("*").alias("n")).where("n > 1")


def header_sq(exons: DataFrame, sizes: DataFrame | None = None, tail: int = DEFAULT_TAIL) -> DataFrame:
    """chrom, ln in name order: the size given, else the last exon end and a tail."""
    ends = exons.groupBy("chrom").agg(F.max("ex_end").alias("_end"))
    if sizes is None:
        return ends.select("chrom", (F.col("_end") + tail).cast("bigint").alias("ln")).orderBy("chrom")
    return ends.join(sizes, "chrom", "left").select("chrom", F.coalesce("size", F.col("_end") + tail).cast("bigint").alias("ln")).orderBy("chrom")


def small(tx: DataFrame, bound: int = BROADCAST_TRANSCRIPTS) -> bool:
    """True if the annotation may be replicated."""
    return tx.limit(bound + 1).count() <= bound


def replicated(table: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """table for the smaller side of a join: replicated if it (or the table `of`, which it follows) is small. Else it is to be
    shuffled, whatever the optimiser takes for its size: it reads that off the files, which explode to many times their bytes."""
    return F.broadcast(table) if small(table if of is None else of) else table.hint("merge")
