"""Interval work: overlap joins by bins, depth by events, coverage, region depth, feature counts and junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.functions.arrays import with_running_sums
from loomspan.operators.annotation import replicated

BIN = 4096
#: Depth runs are swept in tiles of so many bases, so no task holds a chromosome.
TILE = 1 << 16


def overlap_join(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, width: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of both sides on one chrom whose half-open intervals overlap. Each side is dealt to its bins; a pair is kept in the
    first bin that both have, so it appears once. An equality join on (chrom, bin); a side is replicated only if the caller says so."""
    a = left.withColumn("_lb", F.explode(F.expr(f"sequence({l_start} div {width}, ({l_end} - 1) div {width})")))
    b = right.withColumnRenamed("chrom", "_chrom").withColumn("_rb", F.explode(F.expr(f"sequence({r_start} div {width}, ({r_end} - 1) div {width})")))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_lb") == F.col("_rb")) & (F.col(l_start) < F.col(r_end)) & (F.col(l_end) > F.col(r_start))
    once = F.col("_lb") == F.greatest(F.expr(f"{l_start} div {width}"), F.expr(f"{r_start} div {width}"))
    return a.join(b, on & once, how).drop("_lb", "_rb", "_chrom")


def blocks(lifted: DataFrame, deletions: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """aln_id, chrom, b_start, b_end and flag, mapq, kept of the reference blocks; N never counts, D only if asked for."""
    kinds = "M=XD" if deletions else "M=X"
    df = lifted.select("aln_id", "chrom", "g_start", "flag", "mapq", *kept, cigar.parse("g_cigar").alias("_c")).where("_c IS NOT NULL")
    df = df.withColumn("_r", F.expr("transform(_c, c -> CASE WHEN instr('MDN=X', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END)"))
    df = with_running_sums(df, "_r", "_e")
    made = f"CASE WHEN size(_e) > 0 THEN filter(transform(_c, (c, k) -> named_struct('op', c.op, 'b_start', g_start + _e[k] - _r[k], 'b_end', g_start + _e[k])), b -> instr('{kinds}', b.op) > 0) END"
    return df.select("aln_id", "chrom", "flag", "mapq", *kept, F.expr(f"inline({made})")).drop("op")


def depth_runs(lifted: DataFrame, deletions: bool = False, min_mapq: int = 0, excluded: int = 1796) -> DataFrame:
    """chrom, run_start, run_end, depth (over 0). Starts and ends of blocks are summed by place first, with partial sums before
    the shuffle; then tiles are swept on their own, each begun with the depth that the tiles before it leave over."""
    b = blocks(lifted.where((F.col("flag").bitwiseAND(F.lit(excluded)) == 0) & (F.col("mapq") >= min_mapq)), deletions)
    ends = F.array(F.struct(F.col("b_start").alias("place"), F.lit(1).alias("d")), F.struct(F.col("b_end").alias("place"), F.lit(-1).alias("d")))
    events = b.select("chrom", F.inline(ends)).groupBy("chrom", "place").agg(F.sum("d").alias("d")).where("d <> 0")
    # Several branches read the events; kept in memory or on disk they are made once, and again only where an executor is lost.
    events = events.withColumn("tile", F.expr(f"place div {TILE}")).persist()
    tiles = events.groupBy("chrom", "tile").agg(F.sum("d").alias("d"))
    before = Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.withColumn("base", F.coalesce(F.sum("d").over(before), F.lit(0)))
    following = Window.partitionBy("chrom").orderBy("tile")
    carried = carried.withColumn("next_tile", F.lead("tile").over(following)).select("chrom", "tile", "base", "next_tile")
    w = Window.partitionBy("chrom", "tile").orderBy("place")
    swept = events.join(carried, ["chrom", "tile"]).withColumn("depth", F.col("base") + F.sum("d").over(w)).withColumn("run_end", F.lead("place").over(w))
    # The last run of a tile ends with the first event of the next tile that has one.
    first = events.groupBy("chrom", "tile").agg(F.min("place").alias("first_place")).withColumnRenamed("tile", "next_tile")
    open_ = swept.where("run_end IS NULL AND depth > 0").join(first, ["chrom", "next_tile"]).select("chrom", F.col("place").alias("run_start"), F.col("first_place").alias("run_end"), "depth")
    closed = swept.where("run_end IS NOT NULL AND depth > 0").select("chrom", F.col("place").alias("run_start"), "run_end", "depth")
    return closed.unionByName(open_)


def depth_bases(runs: DataFrame, sq: DataFrame | None = None) -> DataFrame:
    """chrom, base (0-based), depth of covered bases; with a header also those of depth 0."""
    out = runs.select("chrom", F.explode(F.expr("sequence(run_start, run_end - 1)")).alias("base"), "depth")
    if sq is None:
        return out
    whole = sq.select("chrom", "ln", F.explode(F.expr("sequence(0, (ln - 1) div 65536)")).alias("t")).select("chrom", F.explode(F.expr("sequence(t * 65536, least(ln, (t + 1) * 65536) - 1)")).alias("base"))
    return whole.join(out, ["chrom", "base"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def coverage(runs: DataFrame, reads: DataFrame, sq: DataFrame) -> DataFrame:
    """chrom, ln, records, covered bases and summed depth of each header sequence."""
    zero = F.lit(0).cast("bigint")
    cov = runs.groupBy("chrom").agg(F.sum(F.col("run_end") - F.col("run_start")).alias("covered"), F.sum((F.col("run_end") - F.col("run_start")) * F.col("depth")).alias("depth_sum"))
    n = reads.groupBy("chrom").agg(F.count("*").alias("records"))
    joined = sq.join(cov, "chrom", "left").join(n, "chrom", "left")
    return joined.select("chrom", "ln", *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("records", "covered", "depth_sum")])


def coverage_means(lifted: DataFrame, sq: DataFrame, min_mapq: int = 0, excluded: int = 1796, required: int = 0, cap: int | None = None) -> DataFrame:
    """coverage of the records with all required and no excluded flag bits and at least min_mapq, depths counted up to cap, with
    percent covered, mean_depth and mean_mapq (null without records)."""
    flag = F.col("flag")
    used = lifted.where((flag.bitwiseAND(F.lit(excluded)) == 0) & (flag.bitwiseAND(F.lit(required)) == required) & (F.col("mapq") >= min_mapq))
    runs = depth_runs(used, excluded=0)
    if cap is not None:
        runs = runs.withColumn("depth", F.least("depth", F.lit(cap).cast("bigint")))
    quality = used.groupBy("chrom").agg((F.sum("mapq") / F.count("*")).alias("mean_mapq"))
    means = {"percent": F.col("covered") * 100 / F.col("ln"), "mean_depth": F.col("depth_sum") / F.col("ln")}
    return coverage(runs, used, sq).withColumns(means).join(quality, "chrom", "left")


def region_depth(runs: DataFrame, bed: DataFrame, threshold: int = 0) -> DataFrame:
    """name, chrom, bed_start, bed_end, depth_sum and bases at a depth of at least threshold, for every region."""
    places = bed.select("chrom", "bed_start", "bed_end").distinct()  # names may be null or repeat, and places too
    hit = overlap_join(replicated(places), runs, "bed_start", "bed_end", "run_start", "run_end")
    size = F.least("bed_end", "run_end") - F.greatest("bed_start", "run_start")
    per = hit.groupBy("chrom", "bed_start", "bed_end").agg(F.sum(size * F.col("depth")).alias("depth_sum"), F.sum(F.when(F.col("depth") >= threshold, size).otherwise(0)).alias("deep"))
    zero = F.lit(0).cast("bigint")
    return bed.join(per, ["chrom", "bed_start", "bed_end"], "left").select("name", "chrom", "bed_start", "bed_end", F.coalesce("depth_sum", zero).alias("depth_sum"), F.coalesce("deep", zero).alias("deep"))


def merged(exons: DataFrame, *keys: str) -> DataFrame:
    """The union of the exons of each key (chrom among them) as ex_start, ex_end without overlaps. A key is sorted in one task:
    by chrom that is a chromosome's exons, which follow the annotation and not the reads."""
    w = Window.partitionBy(*keys).orderBy("ex_start", "ex_end")
    df = exons.withColumn("_reach", F.max("ex_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_run", F.sum(F.when(F.col("ex_start") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_run").agg(F.min("ex_start").alias("ex_start"), F.max("ex_end").alias("ex_end")).drop("_run")


def assign_genes(lifted: DataFrame, exons: DataFrame, stranded: int = 0, multi: bool = False, mode: str = "union", by_pair: bool = False, attribute: str = "gene_id") -> DataFrame:
    """unit (aln_id, or a fragment's key by_pair), sample, status and the attribute: a unit is assigned if exactly one feature fits.

    mode: which features fit. union: those that any block overlaps. intersection-strict: those that cover every aligned base.
    intersection-nonempty: those that cover every aligned base that any feature covers. stranded: 0 either strand, 1 the same,
    2 the opposite. multi: records with several hits count too. by_pair: the records of a name, sample and hit index are one unit,
    second reads count as if turned, and a unit has several hits if one of its records has."""
    if mode not in ("union", "intersection-strict", "intersection-nonempty"):
        raise ValueError(f"unknown mode {mode}")
    unit = "aln_id"
    usable = lifted.withColumn("_multi", F.coalesce("nh", F.lit(1)) > 1).withColumn("_unmapped", F.col("flag").bitwiseAND(F.lit(4)) != 0)
    if by_pair:
        unit = "fragment"
        usable = usable.withColumn(unit, F.expr("CASE WHEN (flag & 1) <> 0 THEN concat_ws(':', 'p', sample, qname, coalesce(hi, 0)) ELSE concat('r:', aln_id) END"))
    usable = usable.withColumn("_c", cigar.parse("g_cigar")).withColumn("_total", F.coalesce(cigar.span("_c", "M=X"), F.lit(0))).drop("_c")
    asked = usable.where(~F.col("_unmapped") & (F.lit(multi) | ~F.col("_multi")))
    b = blocks(asked, kept=(unit,) if by_pair else ())
    ex = exons.select(F.col(attribute).alias("_feature"), "chrom", "strand", "ex_start", "ex_end").distinct()
    side = ["chrom", "strand"] if stranded else ["chrom"]
    if mode != "union":
        per = merged(ex, "_feature", *side)
        # The null feature is what any feature covers.
        ex = per.unionByName(merged(ex, *side).withColumn("_feature", F.lit(None).cast("string"))) if mode == "intersection-nonempty" else per
    hit = overlap_join(b, replicated(ex, exons), "b_start", "b_end", "ex_start", "ex_end")
    if stranded:
        turned = F.col("flag").bitwiseAND(F.lit(16)) != 0
        if by_pair:
            turned = turned != (F.col("flag").bitwiseAND(F.lit(129)) == 129)
        same = turned == (F.col("strand") == "-")
        hit = hit.where(same if stranded == 1 else ~same)
    if mode == "union":
        genes = hit.groupBy(unit).agg(F.min("_feature").alias("_low"), F.max("_feature").alias("_high"))
    else:
        size = F.least("b_end", "ex_end") - F.greatest("b_start", "ex_start")
        per = hit.groupBy(unit, "_feature").agg(F.sum(size).alias("_n"))
        genes = per.groupBy(unit).agg(F.max(F.when(F.col("_feature").isNull(), F.col("_n"))).alias("_any"), F.collect_list(F.when(F.col("_feature").isNotNull(), F.struct("_feature", "_n"))).alias("_per"))
    units = usable.groupBy(unit, "sample").agg(F.bool_or("_multi").alias("_multi"), F.bool_and("_unmapped").alias("_unmapped"), F.sum("_total").alias("_total")) if by_pair else usable
    df = units.join(genes, unit, "left")
    if mode != "union":
        need = "_total" if mode == "intersection-strict" else "_any"
        df = df.withColumn("_fit", F.expr(f"transform(filter(_per, x -> x._n = {need}), x -> x._feature)")).withColumn("_low", F.array_min("_fit")).withColumn("_high", F.array_max("_fit"))
    status = F.when(F.col("_unmapped"), "Unassigned_Unmapped").when(F.col("_multi") & ~F.lit(multi), "Unassigned_MultiMapping")
    status = status.when(F.col("_low").isNull(), "Unassigned_NoFeatures").when(F.col("_low") != F.col("_high"), "Unassigned_Ambiguity").otherwise("Assigned")
    df = df.withColumn("status", status)
    return df.select(unit, "sample", "status", F.when(F.col("status") == "Assigned", F.col("_low")).alias(attribute))


def count_genes(assigned: DataFrame, attribute: str = "gene_id") -> DataFrame:
    """The attribute, sample, n."""
    return assigned.where(F.col(attribute).isNotNull()).groupBy(attribute, "sample").agg(F.count("*").alias("n"))


def introns(lifted: DataFrame, *kept: str, min_mapq: int = 0, all_alignments: bool = False) -> DataFrame:
    """The kept columns, chrom, j_start and j_end (1-based, inclusive) of every N operation; of primary records, unless all are
    asked for."""
    df = lifted.where((F.col("mapq") >= min_mapq) & (F.lit(all_alignments) | (F.col("flag").bitwiseAND(F.lit(2304)) == 0)))
    df = df.where("instr(g_cigar, 'N') > 0").select("chrom", "g_start", *kept, cigar.parse("g_cigar").alias("_c"))
    df = df.withColumn("_r", F.expr("transform(_c, c -> CASE WHEN instr('MDN=X', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END)"))
    df = with_running_sums(df, "_r", "_e")
    made = "CASE WHEN size(_e) > 0 THEN filter(transform(_c, (c, k) -> named_struct('op', c.op, 'j_start', g_start + _e[k] - _r[k] + 1, 'j_end', g_start + _e[k])), j -> j.op = 'N') END"
    return df.select("chrom", *kept, F.expr(f"inline({made})")).drop("op")


def junctions(lifted: DataFrame, min_support: int = 1, min_mapq: int = 0, all_alignments: bool = False) -> DataFrame:
    """chrom, j_start, j_end, strand (of the record's flag), support, intron_len."""
    found = introns(lifted, "flag", min_mapq=min_mapq, all_alignments=all_alignments).withColumn("strand", F.expr("CASE WHEN (flag & 16) = 0 THEN '+' ELSE '-' END"))
    out = found.groupBy("chrom", "j_start", "j_end", "strand").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    return out.withColumn("intron_len", F.col("j_end") - F.col("j_start") + 1)


def stranded_junctions(lifted: DataFrame, genome: DataFrame | None = None, min_support: int = 1, min_mapq: int = 0, all_alignments: bool = False) -> DataFrame:
    """chrom, j_start, j_end, strand, strand_src, support, intron_len, motif. The strand comes from the splice motif (with a
    genome), else the column ts ('+' or '-' as the read lies, so turned for reverse records), else the flag; strand_src says from
    which. Records are counted by place, ts and flag before motifs are looked up."""
    if "ts" not in lifted.columns:
        lifted = lifted.withColumn("ts", F.lit(None).cast("string"))
    found = introns(lifted, "flag", "ts", min_mapq=min_mapq, all_alignments=all_alignments)
    found = found.withColumn("_flag", F.expr("CASE WHEN (flag & 16) = 0 THEN '+' ELSE '-' END"))
    found = found.withColumn("_ts", F.expr("CASE WHEN ts IN ('+', '-') THEN CASE WHEN ts = _flag THEN '+' ELSE '-' END END"))
    found = found.groupBy("chrom", "j_start", "j_end", "_ts", "_flag").agg(F.count("*").alias("_n"))
    found = motif(found, genome) if genome is not None else found.withColumns({"motif": F.lit(None).cast("string"), "motif_strand": F.lit(None).cast("string")})
    source = F.when(F.col("motif_strand").isNotNull(), "motif").when(F.col("_ts").isNotNull(), "ts").otherwise("flag")
    found = found.withColumns({"strand": F.coalesce("motif_strand", "_ts", "_flag"), "strand_src": source})
    out = found.groupBy("chrom", "j_start", "j_end", "strand", "strand_src", "motif").agg(F.sum("_n").alias("support")).where(F.col("support") >= min_support)
    return out.withColumn("intron_len", F.col("j_end") - F.col("j_start") + 1)


def annotated_introns(exons: DataFrame) -> DataFrame:
    """chrom, j_start, j_end of the introns between a transcript's exons."""
    w = Window.partitionBy("tx_id").orderBy("ex_start")
    gaps = exons.withColumn("_next", F.lead("ex_start").over(w)).where("_next IS NOT NULL")
    return gaps.select("chrom", (F.col("ex_end") + 1).cast("bigint").alias("j_start"), F.col("_next").cast("bigint").alias("j_end")).distinct()


def classify(found: DataFrame, exons: DataFrame) -> DataFrame:
    """found with annotation: annotated, novel combination, novel donor, novel acceptor or fully novel. Ends are told on the
    genome: the lower end is a donor on '+', an acceptor on '-'."""
    known = annotated_introns(exons)
    lows, highs = known.select("chrom", "j_start").distinct().withColumn("_low", F.lit(True)), known.select("chrom", "j_end").distinct().withColumn("_high", F.lit(True))
    df = found.join(known.withColumn("_known", F.lit(True)), ["chrom", "j_start", "j_end"], "left").join(lows, ["chrom", "j_start"], "left").join(highs, ["chrom", "j_end"], "left")
    low, high = F.col("_low").isNotNull(), F.col("_high").isNotNull()
    plus = F.col("strand") == "+"
    kind = F.when(F.col("_known").isNotNull(), "annotated").when(low & high, "novel combination").when(low, F.when(plus, "novel acceptor").otherwise("novel donor"))
    kind = kind.when(high, F.when(plus, "novel donor").otherwise("novel acceptor")).otherwise("fully novel")
    return df.withColumn("annotation", kind).drop("_known", "_low", "_high")


def motif(found: DataFrame, genome: DataFrame, width: int = 64) -> DataFrame:
    """found with motif: GT-AG, GC-AG, AT-AC in either orientation (motif_strand tells which), else non-canonical. genome is
    (chrom, bin, seq) in tiles of `width` bases; an end that spans two tiles looks at both."""
    def two(df: DataFrame, at: str, out: str) -> DataFrame:
        a = genome.select(F.col("chrom"), F.col("bin").alias("_b0"), F.col("seq").alias("_s0"))
        b = genome.select(F.col("chrom"), F.col("bin").alias("_b1"), F.col("seq").alias("_s1"))
        df = df.withColumn("_b0", F.expr(f"({at}) div {width}")).withColumn("_b1", F.expr(f"({at} + 1) div {width}"))
        df = df.join(a, ["chrom", "_b0"], "left").join(b, ["chrom", "_b1"], "left")
        text = F.concat(F.expr(f"substr(_s0, cast(({at}) % {width} AS int) + 1, 1)"), F.expr(f"substr(_s1, cast(({at} + 1) % {width} AS int) + 1, 1)"))
        return df.withColumn(out, text).drop("_b0", "_b1", "_s0", "_s1")

    df = two(two(found, "j_start - 1", "_left"), "j_end - 2", "_right").withColumn("_m", F.concat_ws("-", "_left", "_right"))
    forward, reverse = {"GT-AG": "GT-AG", "GC-AG": "GC-AG", "AT-AC": "AT-AC"}, {"CT-AC": "GT-AG", "CT-GC": "GC-AG", "GT-AT": "AT-AC"}
    table = F.create_map(*[F.lit(x) for k, v in (forward | reverse).items() for x in (k, v)])
    strand = F.when(F.col("_m").isin(*forward), "+").when(F.col("_m").isin(*reverse), "-")
    return df.withColumn("motif", F.coalesce(F.try_element_at(table, F.col("_m")), F.lit("non-canonical"))).withColumn("motif_strand", strand).drop("_left", "_right", "_m")
