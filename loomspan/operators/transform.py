"""Record manipulation: filters, tag surgery, duplicates, sampling, splitting, sorting, merging, mates and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.functions.flags import PRESETS
from loomspan.functions.sequence import reverse_complement
from loomspan.operators.annotation import replicated
from loomspan.operators.intervals import blocks, overlap_join
from loomspan.operators.lift import made_once
from loomspan.operators.mods import NAMES

_QUAL = "aggregate(transform(split(qual, ''), q -> ascii(q) - 33), 0, (a, q) -> a + greatest(q, 0))"


def filter_records(reads: DataFrame, require: int = 0, reject: int = 0, keep: tuple[str, ...] = (), drop: tuple[str, ...] = (), min_mapq: int = 0, where: Column | None = None) -> DataFrame:
    """Records that pass every test: all flag bits required, none rejected, presets, MAPQ, and any further condition."""
    tests = [F.col("mapq") >= min_mapq]
    if require:
        tests.append(F.col("flag").bitwiseAND(F.lit(require)) == require)
    if reject:
        tests.append(F.col("flag").bitwiseAND(F.lit(reject)) == 0)
    tests += [F.expr(PRESETS[p]) for p in keep] + [~F.expr(PRESETS[p]) for p in drop]
    if where is not None:
        tests.append(where)
    return reads.where(reduce(Column.__and__, tests))


def filter_regions(lifted: DataFrame, regions: DataFrame) -> DataFrame:
    """Records with a block in a region (chrom, bed_start, bed_end)."""
    hit = overlap_join(blocks(lifted), replicated(regions.select("chrom", "bed_start", "bed_end")), "b_start", "b_end", "bed_start", "bed_end")
    return lifted.join(hit.select("aln_id").distinct(), "aln_id", "left_semi")


def gene_regions(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Exon intervals of the listed genes (column id), of all their transcripts."""
    return exons.join(genes.select(F.col("id").alias("gene_id")).distinct(), "gene_id", "left_semi").selectExpr("chrom", "cast(ex_start AS bigint) AS bed_start", "cast(ex_end AS bigint) AS bed_end").distinct()


def mate_policy(reads: DataFrame, kept: Column, policy: str = "independent") -> DataFrame:
    """independent: each record by itself. together: a template stays if one of its records does. both: only if all do."""
    if policy == "independent":
        return reads.where(kept)
    w = Window.partitionBy("qname")
    agg = F.max if policy == "together" else F.min
    return reads.withColumn("_kept", agg(kept.cast("int")).over(w)).where("_kept = 1").drop("_kept")


def edit_tags(reads: DataFrame, strip: tuple[str, ...] = (), keep_only: tuple[str, ...] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """The map column tags without some keys, with only some, or with other names."""
    names = F.create_map(*[F.lit(x) for kv in (rename or {"": ""}).items() for x in kv])
    tags = F.map_filter("tags", lambda k, _: ~k.isin(*strip)) if strip else F.col("tags")
    if keep_only is not None:
        tags = F.map_filter(tags, lambda k, _: k.isin(*keep_only))
    return reads.withColumn("tags", F.transform_keys(tags, lambda k, _: F.coalesce(F.try_element_at(names, k), k)) if rename else tags)


def min_mod_fraction(reads: DataFrame, code: str, fraction: float) -> DataFrame:
    """Records with a call of the modification, by code or name (map mods: code to array of 0-255 likelihoods), at this probability
    or more."""
    calls = F.coalesce(F.try_element_at("mods", F.lit(code)), F.try_element_at("mods", F.lit(NAMES.get(code, code))))
    return reads.where(F.exists(calls, lambda x: x >= F.lit(256 * fraction)))


def mark_duplicates(reads: DataFrame, umi: str | None = None, remove: bool = False) -> DataFrame:
    """Primary mapped records with the place, strand and CIGAR of a better one get bit 0x400, or go. Best: the highest sum of
    base qualities, then the lowest aln_id. A place with a very large pile is not sorted in one task: the best is found by an
    aggregation with partial results, and the others are told by comparing with it."""
    key = ["rname", "pos", "cigar", F.col("flag").bitwiseAND(F.lit(16)).alias("_strand")] + ([umi] if umi else [])
    names = ["rname", "pos", "cigar", "_strand"] + ([umi] if umi else [])
    asked = (F.col("flag").bitwiseAND(F.lit(2308)) == 0) & F.col("rname").isNotNull()
    rated = reads.where(asked).select("aln_id", *key, F.expr(f"coalesce({_QUAL}, 0)").alias("_q"))
    best = rated.groupBy(*names).agg(F.min_by("aln_id", F.struct(-F.col("_q"), "aln_id")).alias("_best"))
    df = reads.withColumn("_strand", F.when(asked, F.col("flag").bitwiseAND(F.lit(16))))
    df = df.join(best, names, "left").withColumn("duplicate", F.coalesce(asked & (F.col("aln_id") != F.col("_best")), F.lit(False))).drop("_strand", "_best")
    if remove:
        return df.where("NOT duplicate")
    return df.withColumn("flag", F.when(F.col("duplicate"), F.col("flag").bitwiseOR(F.lit(1024))).otherwise(F.col("flag")))


def duplicate_stats(marked: DataFrame) -> DataFrame:
    """One row: records, examined (primary, mapped), duplicates among them and their share of the examined (null without any)."""
    one = marked.agg(F.count("*").alias("records"), F.expr("count_if((flag & 2308) = 0 AND rname IS NOT NULL)").alias("examined"), F.count_if("duplicate").alias("duplicates"))
    return one.withColumn("rate", F.try_divide("duplicates", "examined"))


def _name_share(seed: int) -> Column:
    """A number below 2^28 from the name's md5; mates agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("qname"))), 1, 7), 16, 10).cast("bigint")


def subsample(reads: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Templates whose name falls under the rate."""
    return reads.where(_name_share(seed) < int(rate * (1 << 28)))


def reservoir(reads: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n records (or all), by the order of a seeded hash; a top-n, not a sort."""
    return reads.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("aln_id").cast("string"))), "aln_id").limit(n)


def cap_coverage(lifted: DataFrame, cap: int, width: int = 1000, seed: int = 0) -> DataFrame:
    """At most cap records that begin in a bin of the genome, by seeded order; the plan (bin and rank) stays as columns."""
    w = Window.partitionBy("chrom", "bin").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("aln_id").cast("string"))), "aln_id")
    return lifted.withColumn("bin", F.expr(f"g_start div {width}")).withColumn("bin_rank", F.row_number().over(w)).where(F.col("bin_rank") <= cap)


def split_key(reads: DataFrame, by: str, ways: int = 4) -> DataFrame:
    """reads with part: the reference, read group, strand or turn that a split goes by."""
    part = {
        "reference": F.coalesce("rname", F.lit("*")),
        "readgroup": F.coalesce("rg", F.lit("none")),
        "strand": F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, "plus").otherwise("minus"),
        "round-robin": F.pmod(F.col("aln_id"), F.lit(ways)).cast("string"),
    }[by]
    return reads.withColumn("part", part)


def write_split(reads: DataFrame, by: str, path: str, ways: int = 4) -> None:
    """One folder a part."""
    split_key(reads, by, ways).write.partitionBy("part").parquet(path)


def sort_coordinate(lifted: DataFrame, sq: DataFrame) -> DataFrame:
    """By header order, place and input order; records without a place last. A range-partitioned sort."""
    order = sq.select("chrom", F.row_number().over(Window.orderBy("chrom")).alias("sq_index"))
    return lifted.join(F.broadcast(order), "chrom", "left").orderBy(F.col("sq_index").asc_nulls_last(), F.col("g_start").asc_nulls_last(), "aln_id")


def natural_key(name: str) -> Column:
    """An array that orders names with their runs of digits as numbers: of any length, as their own length leads them."""
    number = "concat(lpad(length(ltrim('0', x)), 6, '0'), ltrim('0', x))"
    return F.expr(f"transform(regexp_extract_all({name}, '[0-9]+|[^0-9]', 0), x -> CASE WHEN x RLIKE '^[0-9]' THEN {number} ELSE x END)")


def sort_name(reads: DataFrame, natural: bool = False) -> DataFrame:
    """By name, then first before second reads, then input order. natural: numbers within names go by value."""
    return reads.orderBy(*[natural_key("qname")] if natural else [], "qname", F.col("flag").bitwiseAND(F.lit(192)), "aln_id")


def collate(reads: DataFrame) -> DataFrame:
    """Records of a name stand together; names in no order. One hash shuffle, no global sort."""
    return reads.repartition("qname").sortWithinPartitions("qname", "aln_id")


def cat(*parts: DataFrame, headers: tuple[DataFrame, ...] = ()) -> DataFrame:
    """All records; headers must name the same sequences."""
    for other in headers[1:]:
        if headers[0].exceptAll(other).union(other.exceptAll(headers[0])).limit(1).count():
            raise ValueError("the headers differ")
    return reduce(DataFrame.unionByName, parts)


def merge(*parts: DataFrame, by: tuple[str, ...] = ("rname", "pos", "aln_id")) -> DataFrame:
    """All records, sorted."""
    return reduce(DataFrame.unionByName, parts).orderBy(*by)


def fixmate(reads: DataFrame, remove: bool = False) -> DataFrame:
    """Primary mates of a name get each other's place: rnext, pnext, bits 0x8 and 0x20, tlen, and ms (the mate's sum of base
    qualities of 15 or more). remove: unmapped and secondary records go."""
    primary = (F.col("flag").bitwiseAND(F.lit(2304)) == 0) & (F.col("flag").bitwiseAND(F.lit(1)) != 0)
    second = F.col("flag").bitwiseAND(F.lit(128)) != 0
    df = reads.withColumn("_end", F.col("pos") + F.coalesce(cigar.span("_c"), F.lit(0))) if "_c" in reads.columns else reads.withColumn("_c", cigar.parse("cigar")).withColumn("_end", F.col("pos") + F.coalesce(cigar.span("_c"), F.lit(0)))
    df = df.withColumn("_ms", F.expr("coalesce(aggregate(transform(split(qual, ''), q -> ascii(q) - 33), 0, (a, q) -> a + CASE WHEN q >= 15 THEN q ELSE 0 END), 0)"))
    mate = F.struct("aln_id", "rname", "pos", "flag", "_end", "_ms")
    side = df.where(primary).groupBy("qname", second.alias("_second")).agg(F.min(mate).alias("mate"))
    side = side.select("qname", (~F.col("_second")).alias("_second"), "mate")
    out = df.withColumn("_second", F.when(primary, second)).join(side, ["qname", "_second"], "left")
    found = F.col("mate").isNotNull()
    same = found & (F.col("mate.rname") == F.col("rname"))
    base = F.col("flag").bitwiseAND(F.lit(~(8 | 32)))
    bits = F.when(F.col("mate.flag").bitwiseAND(F.lit(4)) != 0, 8).otherwise(0) + F.when(F.col("mate.flag").bitwiseAND(F.lit(16)) != 0, 32).otherwise(0)
    low, high = F.least("pos", "mate.pos"), F.greatest("_end", "mate._end")
    first = (F.col("pos") < F.col("mate.pos")) | ((F.col("pos") == F.col("mate.pos")) & ~second)
    out = out.withColumns(
        {
            "flag": F.when(found, base + bits).otherwise(F.col("flag")),
            "rnext": F.col("mate.rname"),
            "pnext": F.col("mate.pos"),
            "tlen": F.when(same, F.when(first, high - low).otherwise(low - high)).otherwise(F.lit(0)).cast("bigint"),
            "ms": F.col("mate._ms").cast("int"),
        }
    ).drop("_second", "_end", "_ms", "_c", "mate")
    return out.where("(flag & 4) = 0 AND (flag & 256) = 0") if remove else out


def add_read_group(reads: DataFrame, rg: str, orphan_only: bool = False) -> DataFrame:
    """rg for all records, or only for those without one."""
    return reads.withColumn("rg", F.coalesce("rg", F.lit(rg)) if orphan_only else F.lit(rg))


def reheader(header: DataFrame, rename_sq: dict[str, str] | None = None, add_rg: str | None = None, strip: tuple[str, ...] = ()) -> DataFrame:
    """header (kind, ord, name, value) with sequences renamed, a read group added, and kinds such as PG or CO dropped."""
    names = F.create_map(*[F.lit(x) for kv in (rename_sq or {"": ""}).items() for x in kv])
    df = header.where(~F.col("kind").isin(*strip)) if strip else header
    df = df.withColumn("name", F.when(F.col("kind") == "SQ", F.coalesce(F.try_element_at(names, F.col("name")), F.col("name"))).otherwise(F.col("name")))
    if add_rg is None:
        return df
    last = df.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("ord"))
    return df.unionByName(last.select(F.lit("RG").alias("kind"), F.col("ord").cast("int").alias("ord"), F.lit(add_rg).alias("name"), F.lit(None).cast("string").alias("value")))


def rename_references(reads: DataFrame, names: dict[str, str]) -> DataFrame:
    """Records under the new sequence names."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return reads.withColumn("rname", F.coalesce(F.try_element_at(table, F.col("rname")), F.col("rname")))


def inject_summary(reads: DataFrame, summary: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """reads with the summary's values (by read id) under tag columns, never over a value that is there; and the conflicts:
    qname, tag, old, new, equal, one row where both have a value. Of rows that repeat a read id the least counts."""
    fresh = summary.select(F.col("read_id").alias("qname"), F.struct(*[F.col(c).cast("string").alias(f"_{t}") for c, t in columns.items()]).alias("_s"))
    fresh = fresh.groupBy("qname").agg(F.min("_s").alias("_s")).select("qname", "_s.*")
    joined = reads.join(fresh, "qname", "left")
    for t in columns.values():
        if t not in reads.columns:
            joined = joined.withColumn(t, F.lit(None).cast("string"))
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("old"), F.col(f"_{t}").alias("new")) for t in columns.values()])
    conflicts = joined.select("aln_id", "qname", F.inline(rows)).where("old IS NOT NULL AND new IS NOT NULL").withColumn("equal", F.col("old") == F.col("new"))
    out = joined.withColumns({t: F.coalesce(F.col(t).cast("string"), F.col(f"_{t}")) for t in columns.values()}).drop(*[f"_{t}" for t in columns.values()])
    return out, conflicts


def recover_tags(reads: DataFrame) -> DataFrame:
    """Secondary and supplementary records without a sequence get that of the primary record of their name and mate number,
    turned if the strands differ, and their hard clips become soft. recovered tells which."""
    reads = made_once(reads, [], reads.columns)  # a filter on seq would else carry what makes it below, and make it twice
    mate = F.col("flag").bitwiseAND(F.lit(192)).alias("_mate")
    primary = reads.where("(flag & 2304) = 0 AND seq IS NOT NULL AND seq <> '*'").groupBy("qname", mate).agg(
        F.min_by(F.struct("seq", "qual", F.col("flag").bitwiseAND(F.lit(16)).alias("strand")), "aln_id").alias("_p")
    )
    lacks = (F.col("flag").bitwiseAND(F.lit(2304)) != 0) & (F.col("seq").isNull() | (F.col("seq") == "*"))
    df = reads.withColumn("_mate", F.col("flag").bitwiseAND(F.lit(192))).join(primary, ["qname", "_mate"], "left").withColumn("recovered", lacks & F.col("_p").isNotNull())
    turned = F.col("_p.strand") != F.col("flag").bitwiseAND(F.lit(16))
    return df.withColumns(
        {
            "seq": F.when(F.col("recovered"), F.when(turned, reverse_complement(F.col("_p.seq"))).otherwise(F.col("_p.seq"))).otherwise(F.col("seq")),
            "qual": F.when(F.col("recovered"), F.when(turned, F.reverse("_p.qual")).otherwise(F.col("_p.qual"))).otherwise(F.col("qual")),
            "cigar": F.when(F.col("recovered"), F.translate("cigar", "H", "S")).otherwise(F.col("cigar")),
        }
    ).drop("_mate", "_p")


def calmd(lifted: DataFrame, genome: DataFrame, width: int = 64) -> DataFrame:
    """aln_id, md, nm against genome (chrom, bin, seq), which is joined by the tiles under each record's blocks (not its introns); a
    record's tiles meet by its id. Bases are compared inside the record, run lengths told by where mismatches and deletions lie."""
    df = lifted.where("g_cigar IS NOT NULL AND seq IS NOT NULL").withColumn("_c", cigar.parse("g_cigar"))
    from loomspan.functions.arrays import with_running_sums

    df = df.withColumn("_r", F.expr("transform(_c, c -> CASE WHEN instr('MDN=X', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END)"))
    df = df.withColumn("_q", F.expr("transform(_c, c -> CASE WHEN instr('MIS=X', c.op) > 0 THEN cast(c.len AS bigint) ELSE 0L END)"))
    df = with_running_sums(with_running_sums(df, "_r", "_re"), "_q", "_qe")
    under = f"transform(_c, (c, k) -> CASE WHEN c.op <> 'N' AND _r[k] > 0 THEN sequence((g_start + _re[k] - _r[k]) div {width}, (g_start + _re[k] - 1) div {width}) ELSE array() END)"
    tiles = df.select("aln_id", "chrom", F.explode(F.expr(f"CASE WHEN size(_re) > 0 THEN array_distinct(flatten({under})) END")).alias("bin"))
    text = tiles.join(genome, ["chrom", "bin"], "left").groupBy("aln_id").agg(F.map_from_entries(F.collect_set(F.struct(F.struct("chrom", "bin").alias("at"), F.coalesce("seq", F.repeat(F.lit("N"), F.lit(width)))))).alias("_g"))
    df = df.join(text, "aln_id")  # records that share an id find their tiles among those of all of them
    base = f"substr(_g[named_struct('chrom', chrom, 'bin', (g_start + _re[k] - _r[k] + j) div {width})], cast((g_start + _re[k] - _r[k] + j) % {width} AS int) + 1, 1)"
    made = (
        "flatten(transform(_c, (c, k) -> CASE WHEN c.op IN ('M', '=', 'X') THEN transform(sequence(0, c.len - 1), j -> "
        f"CASE WHEN upper(substr(seq, cast(_qe[k] - _q[k] AS int) + j + 1, 1)) = upper({base}) THEN '=' ELSE upper({base}) END) "
        f"WHEN c.op = 'D' THEN array(concat('^', array_join(transform(sequence(0, c.len - 1), j -> upper({base})), ''))) ELSE array() END))"
    )
    df = df.withColumn("_m", F.expr(f"CASE WHEN size(_re) > 0 AND size(_qe) > 0 THEN {made} END"))
    # '=' runs become their lengths; a number stands before, between and after mismatches and deletions.
    marks = "filter(transform(_m, (m, k) -> CASE WHEN m <> '=' THEN named_struct('k', k, 'm', m) END), x -> x IS NOT NULL)"
    df = df.withColumn("_x", F.expr(f"CASE WHEN size(_m) >= 0 THEN {marks} END"))
    text_ = (
        "concat(array_join(transform(_x, (x, i) -> concat(x.k - CASE WHEN i = 0 THEN 0 ELSE _x[i - 1].k + 1 END, x.m)), ''), "
        "size(_m) - CASE WHEN size(_x) = 0 THEN 0 ELSE element_at(_x, -1).k + 1 END)"
    )
    inserted = "aggregate(filter(_c, c -> c.op = 'I'), 0, (a, c) -> a + c.len)"
    return df.select("aln_id", F.expr(text_).alias("md"), F.expr(f"aggregate(_x, 0, (a, x) -> a + length(replace(x.m, '^', ''))) + {inserted}").alias("nm"))
