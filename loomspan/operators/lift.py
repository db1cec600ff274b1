"""Lift: alignments on transcripts become alignments on the genome, their CIGAR split at exon ends.

All of it is narrow: after one lookup of the transcript (replicated while its size allows), the exon walk, the split and the
merge are array expressions over the record's own CIGAR, so reads are never shuffled however many fall on one transcript.
On '-' the whole CIGAR is reversed and places are counted from the other end, after which both strands are lifted alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.functions.arrays import with_running_sums
from loomspan.functions.sequence import reverse_complement
from loomspan.operators.annotation import replicated

# Intron caps of the species presets, in bases, as documented and as the older implementation has them.
SPECIES = {"human": 500_000, "mouse": 240_000, "drosophila": 100_000, "yeast": 2_000}
SPECIES_LEGACY = {"human": 500_000, "mouse": 500_000, "zebrafish": 500_000, "fly": 100_000, "worm": 50_000, "yeast": 5_000, "plant": 750_000}
MAX_INTRON = 500_000


def made_once(df: DataFrame, kept: list[str], made: list[str]) -> DataFrame:
    """df with the columns kept and made. The latter pass through a generator of one row, which the optimiser doesn't look
    behind: a filter on them would else be pushed down and repeat, at every level, the expressions that they stand on."""
    return df.select(*kept, F.inline(F.array(F.struct(*made))))


def join_transcripts(reads: DataFrame, tx: DataFrame, how: str = "inner") -> DataFrame:
    """Reads with the columns of their transcript; reads carry tx_id."""
    return reads.join(replicated(tx), "tx_id", how)


def lift(reads: DataFrame, tx: DataFrame, max_intron: int = MAX_INTRON, warn_intron: int | None = None, preserve: bool = True, legacy: bool = False, how: str = "inner") -> DataFrame:
    """reads (aln_id, tx_id, flag, pos, cigar, and seq and qual if any) with the lifted record: status ('converted', 'failed' or
    'failed_intron'), g_start, g_end, g_cigar, g_flag, g_seq, g_qual and the tags xl xp xi im ds de es ee ro, and warning.

    A record without reference bases, outside its transcript, or over an intron longer than max_intron fails.
    preserve keeps = and X runs as they are; without it they become M (legacy: they merge with their own kind)."""
    df = join_transcripts(reads, tx, how).withColumn("_raw", cigar.parse("cigar"))
    df = df.withColumn("_in", F.expr("filter(_raw, c -> c.op <> 'N')")).withColumn("_span", F.coalesce(cigar.span("_in"), F.lit(0)))
    plus = F.col("strand") == "+"
    df = df.withColumn("_ops", F.when(plus, F.col("_in")).otherwise(F.reverse("_in")))
    df = df.withColumn("_u0", F.when(plus, F.col("pos").cast("bigint")).otherwise(F.col("tx_len") - F.col("pos") - F.col("_span")))
    df = df.withColumn("_u1", F.col("_u0") + F.col("_span"))
    inside = (F.col("_span") > 0) & (F.col("pos") >= 0) & (F.col("pos") + F.col("_span") <= F.col("tx_len"))
    df = df.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    # Exons under the record, and the gaps between them.
    df = df.withColumn("_ex", F.expr("CASE WHEN _inside THEN filter(exons, e -> e.g_off < _u1 AND e.g_off + e.len > _u0) END"))
    df = df.withColumn("_gaps", F.expr("CASE WHEN size(_ex) > 0 THEN transform(_ex, (e, i) -> CASE WHEN i + 1 < size(_ex) THEN element_at(_ex, i + 2).start - e.end ELSE 0 END) END"))
    # Places of the operations, in genome direction.
    df = df.withColumn("_rl", F.expr(f"CASE WHEN _inside THEN transform(_ops, c -> CASE WHEN instr('{cigar.REF_OPS}', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END) END"))
    df = with_running_sums(df, "_rl", "_re")
    # Each reference operation in parts, one for each exon; a gap follows at once where a part ends with its exon.
    cut = (
        "CASE WHEN size(_re) > 0 AND size(_gaps) > 0 THEN flatten(transform(_ops, (c, k) -> CASE "
        "WHEN _rl[k] = 0 THEN array(named_struct('op', c.op, 'len', cast(c.len AS bigint))) "
        "ELSE flatten(filter(transform(_ex, (e, i) -> CASE "
        "WHEN e.g_off >= _u0 + _re[k] OR e.g_off + e.len <= _u0 + _re[k] - _rl[k] THEN NULL "
        "WHEN _gaps[i] > 0 AND e.g_off + e.len <= _u0 + _re[k] THEN array("
        "named_struct('op', c.op, 'len', e.g_off + e.len - greatest(e.g_off, _u0 + _re[k] - _rl[k])), named_struct('op', 'N', 'len', cast(_gaps[i] AS bigint))) "
        "ELSE array(named_struct('op', c.op, 'len', least(e.g_off + e.len, _u0 + _re[k]) - greatest(e.g_off, _u0 + _re[k] - _rl[k]))) END), p -> p IS NOT NULL)) END)) END"
    )
    df = df.withColumn("_cut", F.expr(cut))
    if not preserve and not legacy:
        df = df.withColumn("_cut", F.expr("transform(_cut, c -> named_struct('op', CASE WHEN c.op IN ('=', 'X') THEN 'M' ELSE c.op END, 'len', c.len))"))
    df = merge_ops(df, "_cut", "_out", "'N', '=', 'X'" if preserve else "'N'")
    longest = F.expr("array_max(_gaps)")
    ok = F.col("_inside") & (F.size("_ex") > 0)
    df = df.withColumn("im", F.when(longest > 0, longest))
    df = df.withColumn("status", F.when(~ok, "failed").when(F.col("im") > max_intron, "failed_intron").otherwise("converted"))
    good = F.col("status") == "converted"
    when = lambda x: F.when(good, x)
    df = df.withColumn("g_start", when(F.expr("_ex[0].start + _u0 - _ex[0].g_off"))).withColumn("g_end", when(F.expr("element_at(_ex, -1).start + _u1 - element_at(_ex, -1).g_off")))
    low_start, high_start = F.col("g_start") - F.col("gene_start"), F.col("gene_end") - F.col("g_start")
    low_end, high_end = F.col("g_end") - F.col("gene_start"), F.col("gene_end") - F.col("g_end")
    warning = F.lit(None).cast("string")
    if warn_intron is not None:
        df = df.withColumn("_last", F.expr(f"try_element_at(filter(_gaps, g -> g > {warn_intron}), -1)"))
        warning = F.when(F.col("_last").isNotNull(), F.concat(F.lit("large_intron_"), F.expr("_last div 1000"), F.lit("kb")))
    df = df.withColumns(
        {
            "g_cigar": when(cigar.render("_out")),
            "g_flag": when(F.when(plus, F.col("flag")).otherwise(F.col("flag").bitwiseXOR(F.lit(16)))),
            "xl": when(F.col("_span")),
            "xp": F.col("g_end") - F.col("g_start"),
            "xi": when((F.size("_ex") > 1).cast("int")),
            "im": when(F.col("im")),
            "ds": F.when(plus, low_start).otherwise(high_end),
            "de": F.when(plus, high_start).otherwise(low_end),
            "es": F.when(plus, low_end).otherwise(high_start),
            "ee": F.when(plus, high_end).otherwise(low_start),
            "warning": F.when(F.col("status") == "failed_intron", F.lit(f"intron_>{max_intron}bp")).otherwise(when(warning)),
        }
    )
    shown = F.col("flag") if legacy else F.col("g_flag")
    df = df.withColumn("ro", when(F.when(shown.bitwiseAND(F.lit(16)) == 0, 1).otherwise(-1)))
    if "seq" in reads.columns:
        df = df.withColumn("g_seq", when(F.when(plus, F.col("seq")).otherwise(reverse_complement(F.col("seq")))))
    if "qual" in reads.columns:
        df = df.withColumn("g_qual", when(F.when(plus, F.col("qual")).otherwise(F.reverse("qual"))))
    made = [c for c in df.columns if c not in reads.columns and not c.startswith("_") and c != "exons"]
    return made_once(df, list(reads.columns), made)


def merge_ops(df: DataFrame, ops: str, out: str, kept_apart: str) -> DataFrame:
    """Adds out: ops with equal neighbours summed, but for the kinds kept apart. Runs are told by where they begin, and their
    lengths by differences of running sums."""
    df = df.withColumn("_ln", F.expr(f"transform({ops}, c -> c.len)"))
    df = with_running_sums(df, "_ln", "_sm")
    begins = f"CASE WHEN size({ops}) > 0 THEN filter(sequence(0, size({ops}) - 1), k -> k = 0 OR {ops}[k].op IN ({kept_apart}) OR {ops}[k].op <> {ops}[k - 1].op) END"
    df = df.withColumn("_bg", F.expr(begins))
    ends = f"CASE WHEN j + 1 < size(_bg) THEN _bg[j + 1] ELSE size({ops}) END - 1"
    return df.withColumn(out, F.expr(f"CASE WHEN size(_bg) > 0 AND size(_sm) > 0 THEN transform(_bg, (k, j) -> named_struct('op', {ops}[k].op, 'len', _sm[{ends}] - CASE WHEN k = 0 THEN 0L ELSE _sm[k - 1] END)) END"))
