"""Hand-worked cases of the lift, exon merge, resolver, admission, pairing and text formats."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import cigar, flags
from loomspan.functions.sequence import gtf_attribute, reverse_complement
from loomspan.operators import admission, annotation, inspect, intervals, lift, mods, pairs, transform
from loomspan.sources import bam, text

EXONS = [("G", t, "chr1", s, a, b) for t, s in (("P", "+"), ("M", "-")) for a, b in ((100, 110), (200, 220), (300, 305))]
EXON_SCHEMA = "gene_id string, tx_id string, chrom string, strand string, ex_start int, ex_end int"
GOLD = [
    ("G1", "P", 5, "10M", 105, "5M90N5M", 205, 10, 100, 1, 90, 5, 200, 105, 100),
    ("G2", "P", 12, "8M", 202, "8M", 210, 8, 8, 0, None, 102, 103, 110, 95),
    ("G3", "P", 0, "10M2I10M", 100, "10M90N2I10M", 210, 20, 110, 1, 90, 0, 205, 110, 95),
    ("G4", "P", 5, "3M4D3M", 105, "3M2D90N2D3M", 205, 10, 100, 1, 90, 5, 200, 105, 100),
    ("G5", "M", 2, "3S6M1S", 217, "1S3M80N3M3S", 303, 6, 86, 1, 80, 2, 203, 88, 117),
    ("G6", "M", 3, "2M1I3M", 217, "3M80N1I2M", 302, 5, 85, 1, 80, 3, 202, 88, 117),
    ("G8", "P", 8, "24M", 108, "2M90N20M80N2M", 302, 24, 194, 1, 90, 8, 197, 202, 3),
    ("G9", "P", 5, "5M77N5M", 105, "5M90N5M", 205, 10, 100, 1, 90, 5, 200, 105, 100),
    ("G10", "P", 12, "4=77N4=", 202, "4=4=", 210, 8, 8, 0, None, 102, 103, 110, 95),
    ("G12", "M", 0, "2H3S35M1S", 100, "1S10M90N20M80N5M3S2H", 305, 35, 205, 1, 90, 0, 205, 205, 0),
    ("G13", "P", 9, "1=1X2=", 109, "1=90N1X2=", 203, 4, 94, 1, 90, 9, 196, 103, 102),
]


@pytest.fixture(scope="module")
def tx(spark):
    return annotation.build_transcripts(spark.createDataFrame(EXONS, EXON_SCHEMA)).cache()


def reads(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "aln_id long, tx_id string, flag int, pos int, cigar string, seq string, qual string")


def test_lift_goldens(spark, tx):
    df = reads(spark, [(g[1], 0, g[2], g[3], None, None) for g in GOLD])
    got = lift.lift(df, tx).orderBy("aln_id").select("status", "g_start", "g_cigar", "g_end", "xl", "xp", "xi", "im", "ds", "de", "es", "ee").collect()
    assert [tuple(r) for r in got] == [("converted", *g[4:]) for g in GOLD]


def test_lift_failures_and_caps(spark, tx):
    df = reads(spark, [("P", 0, 30, "6M", None, None), ("P", 0, 0, "5S", None, None), ("P", 0, 0, "*", None, None), ("P", 0, 0, None, None, None), ("P", 0, -1, "5M", None, None)])
    assert {r["status"] for r in lift.lift(df, tx).collect()} == {"failed"}
    one = reads(spark, [("P", 0, 5, "10M", None, None)])
    at = lambda **o: lift.lift(one, tx, **o).first()
    assert at(max_intron=89)["status"] == "failed_intron" and at(max_intron=89)["warning"] == "intron_>89bp"
    assert at(max_intron=90)["status"] == "converted"
    assert at(warn_intron=89)["warning"] == "large_intron_0kb" and at(warn_intron=90)["warning"] is None


def test_lift_strand_and_modes(spark, tx):
    r = lift.lift(reads(spark, [("M", 0, 2, "7M", "AACGTNR", "ABCDEFG")]), tx).first()
    assert (r["g_flag"], r["ro"], r["g_seq"], r["g_qual"]) == (16, -1, "RNACGTT", "GFEDCBA")
    one = reads(spark, [("P", 0, 12, "4=77N4=", None, None)])
    assert lift.lift(one, tx, preserve=False).first()["g_cigar"] == "8M"
    assert lift.lift(one, tx, preserve=False, legacy=True).first()["g_cigar"] == "8="
    assert lift.lift(reads(spark, [("M", 0, 2, "7M", None, None)]), tx, legacy=True).first()["ro"] == 1


def test_lift_of_a_long_cigar(spark):
    exons = spark.createDataFrame([("G", "T", "c", "+", 1000 * k, 1000 * k + 500) for k in range(8)], EXON_SCHEMA)
    df = reads(spark, [("T", 0, 0, "1M1I1M1D" * 900, None, None)])
    r = lift.lift(df, annotation.build_transcripts(exons)).select("xl", "xp", "g_start", "g_end", cigar.parse("g_cigar").alias("c")).first()
    ops = [(c["op"], c["len"]) for c in r["c"]]
    assert r["xl"] == sum(n for o, n in ops if o in "MD=X") == 2700 and r["xp"] == sum(n for o, n in ops if o in "MDN=X") == r["g_end"] - r["g_start"]


@pytest.mark.parametrize("rows, merged", [([(0, 10), (10, 20), (25, 30)], [(0, 20), (25, 30)]), ([(0, 10), (5, 8), (9, 12)], [(0, 12)])])
def test_exon_merge(spark, rows, merged):
    got = annotation.merge_exons(spark.createDataFrame([("G", "T", "c", "+", a, b) for a, b in rows], EXON_SCHEMA)).orderBy("ex_start").collect()
    assert [(r["ex_start"], r["ex_end"]) for r in got] == merged


def test_first_seen_row_tells_the_transcript(spark):
    rows = [("G2", "T", "c2", "-", 50, 60, 1), ("G1", "T", "c1", "+", 10, 20, 2), ("G1", "T", "c1", "+", 55, 70, 3)]
    df = spark.createDataFrame(rows, "gene_id string, tx_id string, chrom string, strand string, ex_start int, ex_end int, line_no int")
    merged = annotation.merge_exons(df)
    assert sorted(tuple(r)[:6] for r in merged.select("gene_id", "tx_id", "chrom", "strand", "ex_start", "ex_end").collect()) == [("G2", "T", "c2", "-", 10, 20), ("G2", "T", "c2", "-", 50, 70)]
    one = annotation.build_transcripts(df).first()
    assert (one["gene_id"], one["chrom"], one["strand"]) == ("G2", "c2", "-")


def test_resolver(spark):
    tx = spark.createDataFrame([("T.1",), ("T.2",), ("U",)], "tx_id string")
    names = spark.createDataFrame([("T.9",), ("T.1",), ("U.3",), ("V",), (None,)], "rname string")
    ask = lambda mode: {r["rname"]: r["tx_id"] for r in annotation.resolve_names(names, tx, mode).collect()}
    assert ask("lookup") == {"T.9": "T.2", "T.1": "T.1", "U.3": "U"}
    assert ask("strict") == {"T.1": "T.1"}
    assert [(r["base"], r["n"]) for r in annotation.base_collisions(tx).collect()] == [("T", 2)]


def test_admission_order(spark):
    df = spark.createDataFrame([(4, 0, None), (256, 0, "T"), (16, 60, "T"), (0, 60, None), (0, 60, "T")], "flag int, mapq int, tx_id string")
    got = [r["status"] for r in admission.with_status(df, min_mapq=1, primary_only=True, drop_reverse_reads=True).collect()]
    assert got == ["low_mapq", "secondary", "reverse", "missing", "admitted"]


@pytest.mark.parametrize("n, want", [(1, (0, 0, 1)), (2, (1, 0, 0)), (3, (1, 1, 0)), (4, (1, 1, 1)), (5, (2, 1, 0)), (6, (2, 2, 0))])
def test_pairing_counts(spark, n, want):
    df = spark.createDataFrame([(k, "q", "T", 0, 1, "c", 10 * k, 10 * k + 5) for k in range(n)], "aln_id long, qname string, tx_id string, hi_key int, flag int, chrom string, g_start long, g_end long")
    r = pairs.pair_stats(pairs.restore(df)).first()
    assert (r["same_pairs"], r["ambiguous"], r["singletons"]) == want


@pytest.mark.parametrize("a, b, tlen, sam", [((100, 150), (120, 170), 100, 70), ((100, 150), (200, 250), 150, 150)])
def test_cross_pairs_and_tlen(spark, a, b, tlen, sam):
    df = spark.createDataFrame([(0, "q", "A", 0, 65, "c", *a), (1, "q", "B", 0, 129, "c", *b)], "aln_id long, qname string, tx_id string, hi_key int, flag int, chrom string, g_start long, g_end long")
    r = pairs.mates(pairs.restore(df, True)).first()
    assert (r["pair_type"], r["tlen"], r["sam_tlen"], r["proper"], r["transcript_id"]) == ("cross", tlen, sam, False, "A/B")
    assert pairs.pair_stats(pairs.restore(df, False)).first()["singletons"] == 2


def test_header_sizes(spark):
    exons = spark.createDataFrame(EXONS, EXON_SCHEMA)
    assert annotation.header_sq(exons).first()["ln"] == 1_000_305
    assert annotation.header_sq(exons, spark.createDataFrame([("chr2", 5)], "chrom string, size long")).first()["ln"] == 1_000_305


def test_scalars(spark):
    df = spark.createDataFrame([('gene_id "g"; tag "a"; tag "b"; transcript_id "";', "AACGTNR", 83)], "a string, s string, f int")
    r = df.select(gtf_attribute(F.col("a"), "tag").alias("t"), gtf_attribute(F.col("a"), "transcript_id").alias("x"), reverse_complement(F.col("s")).alias("r"), flags.decode(F.col("f")).alias("d")).first()
    assert tuple(r) == ("b", None, "RNACGTT", "PAIRED,PROPER_PAIR,REVERSE,READ1")


def test_gtf_text(spark):
    lines = ["#x", 'c\t.\texon\t101\t110\t.\t+\t.\tgene_id "g"; transcript_id "t";', 'c\t.\tgene\t1\t9\t.\t+\t.\tgene_id "g";', 'c\t.\texon\t1\t9\t.\t+\t.\ttranscript_id "";', "short"]
    got = text.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["gene_id"], r["tx_id"], r["ex_start"], r["ex_end"]) for r in got] == [("g", "t", 100, 110)]


def test_checksum_ignores_order(spark):
    df = spark.range(100).selectExpr("cast(id AS string) AS qname", "cast(id AS int) AS flag")
    assert inspect.checksum(df, ("qname", "flag")).first() == inspect.checksum(df.repartition(7).orderBy(F.desc("flag")), ("qname", "flag")).first()


def test_bam_round_trip(spark):
    rows = [("r1", 0, "c1", 5, 60, "3S4M", "ACGTNAC", "ABCDEFG", 1, 0, "RG1"), ("r2", 4, None, None, 0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, nh int, hi int, rg string").coalesce(1)
    files = bam.encode(df, ["c1"], [100])
    got = {r["qname"]: r for r in bam.decode(files).collect()}
    assert tuple(got["r1"])[:6] == ("r1", 0, "c1", 5, 60, "3S4M") and got["r1"]["seq"] == "ACGTNAC" and got["r1"]["tags"] == {"NH": "i:1", "HI": "i:0", "RG": "Z:RG1"}
    assert got["r2"]["rname"] is None and got["r2"]["cigar"] is None and got["r2"]["seq"] is None
    assert bam.quickcheck(files.selectExpr("'p' AS path", "content")).first()["ok"]


def test_tag_surgery_and_mods(spark):
    df = spark.sql("SELECT map('NM', '1', 'MD', '5', 'XX', 'y') AS tags, map('m5C', array(10, 210)) AS mods")
    assert transform.edit_tags(df, strip=("NM",), rename={"XX": "YY"}).first()["tags"] == {"MD": "5", "YY": "y"}
    assert transform.edit_tags(df, keep_only=("MD",)).first()["tags"] == {"MD": "5"}
    assert transform.min_mod_fraction(df, "m5C", 0.8).count() == 1 and transform.min_mod_fraction(df, "m5C", 0.9).count() == 0


def test_streaming_conversion(spark, tx, tmp_path):
    from loomspan.streaming.convert import convert_stream, write_stream

    reads(spark, [("P", 0, 5, "10M", None, None)]).withColumnRenamed("tx_id", "rname").write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([("P", "P")], "rname string, tx_id string")
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    write_stream(convert_stream(source, tx, names).select("aln_id", "g_cigar"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["g_cigar"] == "5M90N5M"


def test_mod_calls(spark):
    rows = [("C+mh,5,2;A+a.,1;", "B:C,1,2,3,4,9"), ("C+m,0;G-m?,0,1;N+17802,3;", "7,8,9,200"), (None, "1"), ("", ""), ("C+m,0,0;", "5"), ("C+m,0;", None)]
    df = spark.createDataFrame(rows, "mm string, tag string").withColumn("ml", mods.likelihoods("tag"))
    got = [r["mods"] for r in mods.with_mods(df).collect()]
    assert got == [{"m": [1, 3], "h": [2, 4], "a": [9]}, {"m": [7, 8, 9], "17802": [200]}, None, {}, {"m": [5]}, None]
    assert transform.min_mod_fraction(mods.with_mods(df), "pseU", 0.7).count() == 1


def test_natural_name_order(spark):
    names = ["r10", "r9", "r010x", "a100b2", "a100b10", "r", "a#1", "r123456789012345678901234567890", ""]
    df = spark.createDataFrame([(n, 0, k) for k, n in enumerate(names)], "qname string, flag int, aln_id long")
    got = [r["qname"] for r in transform.sort_name(df, natural=True).collect()]
    assert got == ["", "a#1", "a100b2", "a100b10", "r", "r9", "r10", "r010x", "r123456789012345678901234567890"]


def test_corrupt_tags_are_read_as_far_as_they_go():
    assert bam._tags(b"NHC\x02" + b"XBBi\xff\xff\xff\xff" + b"XAAx") == [("NH", "i:2")]
    assert bam._tags(b"NHC\x02" + b"XZZno end") == [("NH", "i:2")]
    with pytest.raises(ValueError):
        bam._tag_bytes("XX", "q:1")


def test_batch_of_files(spark, tmp_path):
    rows = [("r1", 99, "c1", 5, 60, "4M", "=", 20, 19, "ACGT", None, {"ts": "A:+"}), ("r2", 0, "c1", 5, 60, "4M", None, None, None, "ACGT", None, None)]
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
    for k, name in enumerate(("s1.genome.bam", "s2.bam", "s3.txt")):
        raw = bam.encode(spark.createDataFrame(rows[: k + 1], schema).coalesce(1), ["c1"], [100]).first()["content"]
        (tmp_path / name).write_bytes(bytes(raw))
    got = sorted(bam.read_batch(spark, str(tmp_path)).collect(), key=lambda r: (r["sample"], r["qname"]))
    assert [(r["sample"], r["qname"], r["rnext"], r["pnext"], r["tlen"], dict(r["tags"])) for r in got] == [("s1", "r1", "c1", 20, 19, {"ts": "A:+"}), ("s2", "r1", "c1", 20, 19, {"ts": "A:+"}), ("s2", "r2", None, -1, 0, {})]


def test_counting_modes_and_fragments(spark):
    exons = spark.createDataFrame([("A", "c", "+", 0, 100), ("A", "c", "+", 50, 120), ("B", "c", "-", 110, 200), ("C", "c", "+", 300, 400)], "gene_id string, chrom string, strand string, ex_start long, ex_end long")
    schema = "aln_id long, qname string, sample string, chrom string, flag int, mapq int, nh int, hi int, g_start long, g_cigar string"
    lifted = spark.createDataFrame(
        [(0, "a", "s", "c", 0, 9, 1, 0, 90, "15M"), (1, "b", "s", "c", 0, 9, 1, 0, 100, "30M"), (2, "c", "s", "c", 0, 9, 1, 0, 390, "20M"), (3, "d", "s", "c", 99, 9, 1, 0, 10, "20M"), (4, "d", "s", "c", 147, 9, 1, 0, 60, "20M"), (5, "e", "s", "c", 0, 9, 2, 0, 10, "20M"), (6, "f", "s", "c", 0, 9, 1, 0, 250, "9M")],
        schema,
    )
    at = lambda **o: {r[0]: (r["status"], r["gene_id"]) for r in intervals.assign_genes(lifted, exons, **o).collect()}
    none, both = ("Unassigned_NoFeatures", None), ("Unassigned_Ambiguity", None)
    union, strict, nonempty = at(), at(mode="intersection-strict"), at(mode="intersection-nonempty")
    assert (union[0], union[1], union[2], union[6]) == (("Assigned", "A"), both, ("Assigned", "C"), none)
    assert (strict[0], strict[1], strict[2], strict[6]) == (("Assigned", "A"), none, none, none)
    assert (nonempty[0], nonempty[1], nonempty[2], nonempty[6]) == (("Assigned", "A"), none, ("Assigned", "C"), none)
    assert strict[5][0] == "Unassigned_MultiMapping" and at(multi=True)[5] == ("Assigned", "A")
    fragments = at(by_pair=True, stranded=1)
    assert fragments["p:s:d:0"] == ("Assigned", "A") and len(fragments) == 6  # the second read lies the other way
    assert at(stranded=1)[4] == none
    with pytest.raises(ValueError):
        intervals.assign_genes(lifted, exons, mode="other")


def test_junction_strand_without_a_genome(spark):
    df = spark.createDataFrame([("c", 0, 9, 10, "5M10N5M", "+"), ("c", 16, 9, 10, "5M10N5M", "+"), ("c", 16, 9, 10, "5M10N5M", None)], "chrom string, flag int, mapq int, g_start long, g_cigar string, ts string")
    got = intervals.stranded_junctions(df).orderBy("strand", "strand_src").collect()
    assert [(r["j_start"], r["j_end"], r["strand"], r["strand_src"], r["support"], r["motif"]) for r in got] == [(16, 25, "+", "ts", 1, None), (16, 25, "-", "flag", 1, None), (16, 25, "-", "ts", 1, None)]
    assert {r["strand_src"] for r in intervals.stranded_junctions(df.drop("ts")).collect()} == {"flag"}


def test_histograms_of_sparse_and_nanopore_records(spark):
    df = spark.createDataFrame([(0, 5, None, "", "a"), (0, 5, "3M2N1I4M", "ACGNNACG", None)], "flag int, mapq int, cigar string, seq string, channel string")
    got = {(r["metric"], r["bucket"]): r["n"] for r in inspect.histograms(df).collect()}
    assert got[("channel", "a")] == 1 and got[("n_percent", "25")] == 1 and got[("intron", "2")] == 1 and got[("splices", "1")] == 1 and got[("cigar_bases", "M")] == 7
    assert not any(m in ("mate", "tag") for m, _ in got)


def test_calmd_of_records_that_share_an_id(spark):
    """Two records with one id over the same tile, and over tiles of one number on two chromosomes, keep their own bases."""
    genome = spark.createDataFrame([("c1", 0, "A" * 64), ("c2", 0, "C" * 64)], "chrom string, bin long, seq string")
    rows = [(1, "c1", 5, "4M", "AAAA"), (1, "c1", 7, "4M", "AACA"), (1, "c2", 5, "4M", "CCGG")]
    lifted = spark.createDataFrame(rows, "aln_id long, chrom string, g_start long, g_cigar string, seq string")
    assert sorted((r["md"], r["nm"]) for r in transform.calmd(lifted, genome).collect()) == [("2A1", 1), ("2C0C0", 2), ("4", 0)]


def test_a_large_annotation_is_not_replicated(spark):
    """Whatever the optimiser takes for its size, a table beyond the bound is no broadcast, as the driver would hold it whole."""
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    lifted = spark.createDataFrame([(1, "c1", 12, "4M", 0, 60, 1, "S0")], "aln_id long, chrom string, g_start long, g_cigar string, flag int, mapq int, nh int, sample string")
    exons = lambda n: spark.range(n).selectExpr("concat('G', id) AS gene_id", "concat('T', id) AS tx_id", "'c1' AS chrom", "'+' AS strand", "id * 10 AS ex_start", "id * 10 + 5 AS ex_end")
    regions = lambda n: exons(n).selectExpr("chrom", "ex_start AS bed_start", "ex_end AS bed_end")
    for made, at in ((lambda n: intervals.assign_genes(lifted, exons(n)), "_feature"), (lambda n: transform.filter_regions(lifted, regions(n)), "bed_start")):
        big = shown(made(60_000))
        assert "strategy=merge" in big, at
        assert "strategy=broadcast" in shown(made(100)), at
    assert made(60_000).count() == 1 and intervals.count_genes(intervals.assign_genes(lifted, exons(60_000))).count() == 1


def test_bam_header_from_a_table(spark):
    """A header in a table is not collected: a file lists the sequences that its records and mates lie on, and no others."""
    schema = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"
    rows = [("a", 1, "c7", 3, 9, "3M", "c9", 5, 0, "ACn", "!I~"), ("b", 1, "c7", 4, 9, "2M", "=", 6, 0, "GT", None), ("c", 0, "absent", 4, 9, None, None, None, None, None, None), ("d", 1, None, -1, 0, None, "absent", 1, 0, "A", "5")]
    header = spark.range(100_000).selectExpr("concat('c', id) AS name", "int(id + 1) AS length")
    files = bam.encode(spark.createDataFrame(rows, schema).coalesce(1), header)
    held = [b"".join(bam.inflate(bytes(r["content"]))) for r in files.collect()]
    assert all(len(raw) < 1000 for raw in held) and any(b"@SQ\tSN:c9\tLN:10\n" in raw for raw in held)
    got = {r["qname"]: tuple(r)[2:11] for r in bam.decode(files).drop("tags").collect()}
    assert got == {"a": ("c7", 3, 9, "3M", "c9", 5, 0, "ACN", "!I~"), "b": ("c7", 4, 9, "2M", "c7", 6, 0, "GT", None), "c": (None, 4, 9, None, None, -1, 0, None, None), "d": (None, -1, 0, None, None, 1, 0, "A", "5")}
    assert bam.quickcheck(files.selectExpr("'p' AS path", "content")).where("NOT ok").count() == 0


def test_text_is_split_once(spark):
    """Neither format evaluates its split, its patterns or its tags again for each column; tags are told from fields that look alike."""
    line = "\t".join(["q", "0", "NH:i:9", "4", "9", "3M", "*", "0", "0", "ACG", "*", "RG:Z:", "NH:i:3", "XX:Z:HI:i:4"])
    got = text.parse_sam(spark.createDataFrame([(line,), (line.rsplit("\t", 3)[0],)], "value string"))
    assert [(r["rname"], r["nh"], r["hi"], r["rg"], len(r["tags"])) for r in got.collect()] == [("NH:i:9", 3, None, "", 3), ("NH:i:9", None, None, None, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    gtf = text.parse_gtf(spark.createDataFrame([('c\tx\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";',)], "value string"))
    plan = gtf._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all") == 2


def test_made_columns_are_not_made_again(spark):
    """What makes a column stands once in the plan for each scan of it, however often an operator uses the column."""
    reads = spark.range(5).selectExpr("id AS aln_id", "'q' AS qname", "cast(id * 64 AS int) AS flag", "9 AS mapq", "'3M' AS cigar", "md5(cast(id AS string)) AS seq", "'III' AS qual")
    tagged = reads.selectExpr("aln_id", "concat('C+m,', md5(cast(aln_id AS string)), ';') AS mm", "array(1, 2) AS ml")
    for df, scans in ((transform.recover_tags(reads), 2), (inspect.histograms(reads), 1), (mods.with_mods(tagged), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == scans
