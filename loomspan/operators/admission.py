"""Admission: which records are converted, and what becomes of the others. The first rule that hits names the status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.annotation import replicated


def resolved(reads: DataFrame, names: DataFrame) -> DataFrame:
    """reads with tx_id of their rname; names is the resolver's table, replicated while it is small."""
    return reads.join(replicated(names), "rname", "left")


def with_status(reads: DataFrame, min_mapq: int = 0, primary_only: bool = False, drop_reverse_reads: bool = False, drop_minus_transcripts: bool = False, legacy: bool = False) -> DataFrame:
    """reads (with tx_id, and strand if minus transcripts are dropped) with status: secondary, reverse, low_mapq, unmapped,
    missing or admitted, tested in this order. primary_only drops secondary and supplementary records (legacy: secondary)."""
    flag = F.col("flag")
    status = F.when(F.lit(primary_only) & (flag.bitwiseAND(F.lit(256 if legacy else 2304)) != 0), "secondary")
    direct = F.lit(drop_reverse_reads) & (flag.bitwiseAND(F.lit(16)) != 0)
    if drop_minus_transcripts:
        direct = direct | (F.col("strand") == "-")
    status = status.when(direct, "reverse").when(F.col("mapq") < min_mapq, "low_mapq").when(flag.bitwiseAND(F.lit(4)) != 0, "unmapped")
    return reads.withColumn("status", status.when(F.col("tx_id").isNull(), "missing").otherwise("admitted"))


def status_counts(reads: DataFrame) -> DataFrame:
    """status, n."""
    return reads.groupBy("status").agg(F.count("*").alias("n"))


def listed(reads: DataFrame, tx: DataFrame, genes: DataFrame | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Reads whose transcript is in the union of the lists (one column id; versioned or bare)."""
    ids = tx.select("tx_id", "gene_id").distinct()
    wanted = None
    for table, column in ((genes, "gene_id"), (transcripts, "tx_id")):
        if table is not None:
            asked = table.select("id").distinct()
            for name in (F.col(column), F.substring_index(column, ".", 1)):  # two equality joins, as an OR would be a nested loop
                near = ids.withColumn("id", name).join(asked, "id", "left_semi").select("tx_id")
                wanted = near if wanted is None else wanted.union(near)
    return reads if wanted is None else reads.join(wanted.distinct(), "tx_id", "left_semi")


def missing_report(reads: DataFrame) -> DataFrame:
    """One row over records without a transcript: counts by strand and class, and distinct names."""
    f = F.col("flag")
    return reads.where("status = 'missing'").agg(
        F.count("*").alias("records"),
        F.count_distinct("rname").alias("names"),
        F.count_if(f.bitwiseAND(F.lit(16)) == 0).alias("forward"),
        F.count_if(f.bitwiseAND(F.lit(16)) != 0).alias("reverse"),
        F.count_if(f.bitwiseAND(F.lit(2304)) == 0).alias("primary_records"),
        F.count_if(f.bitwiseAND(F.lit(256)) != 0).alias("secondary_records"),
        F.count_if(f.bitwiseAND(F.lit(2048)) != 0).alias("supplementary_records"),
    )


def missing_by_nh(reads: DataFrame) -> DataFrame:
    """nh, n over records without a transcript."""
    return reads.where("status = 'missing'").groupBy("nh").agg(F.count("*").alias("n"))
