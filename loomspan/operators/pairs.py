"""Pair restoration over lifted records. A key's records meet in one partition by the hash of their name, as mates must."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hi_or_default():
    """HI, else 0 for a single hit, else a hash of place and strand in 16 bits."""
    place = F.pmod(F.col("g_start") * 31 + F.col("flag").bitwiseAND(F.lit(16)), F.lit(65536)).cast("int")
    return F.coalesce("hi", F.when(F.coalesce("nh", F.lit(1)) == 1, F.lit(0)).otherwise(place))


def restore(reads: DataFrame, cross_transcript: bool = False) -> DataFrame:
    """reads (aln_id, qname, tx_id, hi_key, flag, chrom, g_start, g_end) with pk: 1 same transcript, 2 across transcripts,
    0 singleton, -1 ambiguous, null passed through (unpaired), and pair_key and pair_no shared by mates.

    On one (qname, tx_id, hi) key, in input order, every third record is ambiguous and the two before it are mates.
    Across transcripts the n-th first read of a (qname, hi) meets the n-th second read among what is left."""
    paired = F.col("flag").bitwiseAND(F.lit(1)) != 0
    w = Window.partitionBy("qname", "tx_id", "hi_key", paired).orderBy("aln_id")
    df = reads.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = (F.col("_rn") % 3 == 1) & (F.col("_rn") == F.col("_n"))
    kind = F.when(~paired, F.lit(None).cast("int")).when(F.col("_rn") % 3 == 0, -1).when(last, 0).otherwise(1)
    df = df.withColumn("pk", kind).withColumn("pair_no", F.when(F.col("pk") == 1, F.expr("(_rn - 1) div 3"))).withColumn("pair_key", F.when(F.col("pk") == 1, F.col("tx_id")))
    if cross_transcript:
        first = F.col("flag").bitwiseAND(F.lit(64)) != 0
        alone = F.col("pk") == 0
        side = Window.partitionBy("qname", "hi_key", "pk", first).orderBy("aln_id")
        both = Window.partitionBy("qname", "hi_key", "pk", "_rank")
        df = df.withColumn("_rank", F.row_number().over(side)).withColumn("_met", F.count("*").over(both))
        met = alone & (F.col("_met") == 2)
        df = df.withColumn("pair_no", F.when(met, F.col("_rank") - 1).otherwise(F.col("pair_no"))).withColumn("pk", F.when(met, 2).otherwise(F.col("pk")))
        df = df.withColumn("pair_key", F.when(F.col("pk") == 2, F.lit("*")).otherwise(F.col("pair_key"))).drop("_rank", "_met")
    return df.withColumn("pair_no", F.col("pair_no").cast("bigint")).drop("_rn", "_n")


def mates(restored: DataFrame) -> DataFrame:
    """One row a pair: both records, r1 by bit 0x40 and else by place, with tlen, sam_tlen and proper."""
    side = F.struct(
        F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, 0).otherwise(1).alias("second"), "g_start", "aln_id", "flag", "chrom", "g_end", "tx_id"
    )
    two = restored.where("pk IN (1, 2)").groupBy("qname", "hi_key", "pk", "pair_key", "pair_no").agg(F.min(side).alias("r1"), F.max(side).alias("r2"))
    same = F.col("r1.chrom") == F.col("r2.chrom")
    span = F.col("r1.g_end") - F.col("r1.g_start") + F.col("r2.g_end") - F.col("r2.g_start")
    gap = F.greatest(F.lit(0), F.greatest("r1.g_start", "r2.g_start") - F.least("r1.g_end", "r2.g_end"))
    sign = F.when(F.col("r1.g_start") <= F.col("r2.g_start"), 1).otherwise(-1)
    outer = F.greatest("r1.g_end", "r2.g_end") - F.least("r1.g_start", "r2.g_start")
    return two.select(
        "qname",
        F.when(F.col("r1.tx_id") == F.col("r2.tx_id"), F.col("r1.tx_id")).otherwise(F.concat_ws("/", "r1.tx_id", "r2.tx_id")).alias("transcript_id"),
        F.when(F.col("pk") == 1, "same").otherwise("cross").alias("pair_type"),
        F.col("r1.aln_id").alias("r1_aln"),
        F.col("r2.aln_id").alias("r2_aln"),
        F.col("r1.chrom").alias("r1_chrom"),
        (F.col("r1.g_start") + 1).alias("r1_pos"),
        F.col("r2.chrom").alias("r2_chrom"),
        (F.col("r2.g_start") + 1).alias("r2_pos"),
        F.when(same, sign * (span + gap)).otherwise(F.lit(0)).cast("bigint").alias("tlen"),
        F.when(same, sign * outer).otherwise(F.lit(0)).cast("bigint").alias("sam_tlen"),
        (same & (F.col("pk") == 1)).alias("proper"),
    )


def records(restored: DataFrame) -> DataFrame:
    """The main output: restored without ambiguous records; mates (pk 1 or 2) get bit 0x1, 0x2 on one transcript and chromosome, 0x8
    and 0x20 of the other, and rnext, pnext and tlen (spans and gap, the first record of the pair by mates() with the sign)."""
    side = F.struct(F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, 0).otherwise(1).alias("second"), "g_start", "aln_id", "flag", "chrom", "g_end")
    w = Window.partitionBy("qname", "hi_key", "pk", "pair_key", "pair_no")
    paired = F.col("pk").isin(1, 2)
    df = restored.where("pk IS NULL OR pk <> -1").withColumn("_r1", F.min(side).over(w)).withColumn("_r2", F.max(side).over(w))
    own_first = F.col("_r1.aln_id") == F.col("aln_id")
    df = df.withColumn("_m", F.when(paired, F.when(own_first, F.col("_r2")).otherwise(F.col("_r1"))))
    same = F.col("_m.chrom") == F.col("chrom")
    span = F.col("_r1.g_end") - F.col("_r1.g_start") + F.col("_r2.g_end") - F.col("_r2.g_start")
    gap = F.greatest(F.lit(0), F.greatest("_r1.g_start", "_r2.g_start") - F.least("_r1.g_end", "_r2.g_end"))
    plus = own_first == (F.col("_r1.g_start") <= F.col("_r2.g_start"))
    bits = F.lit(1).bitwiseOR(F.when(same & (F.col("pk") == 1), 2).otherwise(0))
    bits = bits.bitwiseOR(F.when(F.col("_m.flag").bitwiseAND(F.lit(4)) != 0, 8).otherwise(0)).bitwiseOR(F.when(F.col("_m.flag").bitwiseAND(F.lit(16)) != 0, 32).otherwise(0))
    return df.withColumns(
        {
            "flag": F.when(paired, F.col("flag").bitwiseAND(F.lit(~42)).bitwiseOR(bits)).otherwise(F.col("flag")),
            "rnext": F.col("_m.chrom"),
            "pnext": F.col("_m.g_start"),
            "tlen": F.when(paired & same, F.when(plus, span + gap).otherwise(-(span + gap))).otherwise(F.lit(0)).cast("bigint"),
        }
    ).drop("_r1", "_r2", "_m")


def ambiguous(restored: DataFrame) -> DataFrame:
    """The records that leave the main output."""
    return restored.where("pk = -1")


def unpaired(restored: DataFrame) -> DataFrame:
    """Paired records that found no mate."""
    return restored.where("pk = 0")


def pair_stats(restored: DataFrame) -> DataFrame:
    """Total, passed through, same, cross (in pairs), singletons and ambiguous."""
    k = F.col("pk")
    return restored.agg(
        F.count("*").alias("total"),
        F.count_if(k.isNull()).alias("passthrough"),
        F.expr("count_if(pk = 1) div 2").alias("same_pairs"),
        F.expr("count_if(pk = 2) div 2").alias("cross_pairs"),
        F.count_if(k == 0).alias("singletons"),
        F.count_if(k == -1).alias("ambiguous"),
    )
