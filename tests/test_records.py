from pyspark.sql import functions as F

from fusionframe.operators import reads as G
from fusionframe.operators import records as R

READ = "qname string, chrom string, st long, en long, mate_st long, flag int, cigar string, seq string, qual string"


def test_align_ok_counts_bases_of_good_quality_only(spark):
    cases = [("ACGTACGT", "ACGTACGT", "IIIIIIII", True), ("ACGT", "TGCT", "IIII", False), ("ACGT", "TGCT", "+++I", True),
             ("AC-GT", "ACTGA", "IIIII", True), ("ACTGT", "AC-GA", "II+I", True), ("A" * 30, "A" * 24 + "C" * 6, "I" * 30, True),
             ("A" * 30, "A" * 23 + "C" * 7, "I" * 30, False), ("", "", "", True)]
    rows = spark.createDataFrame(cases, "r string, q string, l string, want boolean")
    got = rows.select("want", G.align_ok(F.col("r"), F.col("q"), F.col("l")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_junction_reads_stop_at_the_first_gap_that_does_not_fit(spark):
    def read(name, cigar, flag=1, st=100):
        return (name, "chr1", st, 900, 500, flag, cigar, "ACGT", "IIII")

    reads = spark.createDataFrame([
        read("fits", "50M200N50M"), read("second", "20M2N3M28N30M200N50M"), read("stopped", "20M90N20M200N50M"), read("short", "50M200N9M"), read("duplicate", "50M200N50M", 1025),
        read("size", "50M211N50M"), read("far", "30M200N50M"), read("unmapped", "50M200N50M", 5), read("null", None), read("nopos", "50M200N50M", 1, None)], READ)
    sites = spark.createDataFrame([("s", "chr1", 150, 1, 201)], "key string, chrom string, pos long, clip int, gap int")
    got = [r.qname for r in G.junction_reads(reads, sites, "key").collect()]
    assert got == ["fits"]
    left = spark.createDataFrame([("s", "chr1", 350, -1, 201)], sites.schema)
    assert [r.qname for r in G.junction_reads(reads, left, "key").collect()] == ["fits"]
    assert G.junction_reads(reads.limit(0), sites, "key").count() == 0


def test_mates_and_pairs_of_empty_and_null_rows(spark):
    reads = spark.createDataFrame([("q", "chr1", 110, 150, 400, 65, "40M", "ACGT", "IIII"), ("q", "chr1", 410, 450, 100, 129, "40M", "ACGT", "IIII"),
                                   ("n", None, None, None, None, None, None, None, None)], READ)
    a = spark.createDataFrame([("w", "chr1", 100, 200)], "key string, chrom string, st long, en long")
    b = spark.createDataFrame([("w", "chr1", 400, 460)], a.schema)
    assert sorted((r.qname, r.side) for r in G.pair_reads(reads, a, b, "key").collect()) == [("q", "a"), ("q", "b")]
    given = reads.where("flag = 65").select(F.lit("w").alias("key"), "qname", "flag")
    assert [r.flag for r in G.mates_of(given, reads, b, "key").collect()] == [129]
    assert G.pair_reads(reads, a.limit(0), b, "key").count() == 0


def test_sample_names(spark):
    names = ["SJTALL001_D-TB-01-0284", "SJAML040538_D2", "SJAML040538_D02", "SJALL001_Q", "other", None, "x/SJE2A012_D.bam", "BinG12_x"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = rows.select("i", *R.parse_sample(F.col("name")), R.tumor_normal(F.col("name")).alias("tn")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("SJTALL001", "TALL", "D", 1, "T"), ("SJ040538", "AML", "D", 2, "T"), (None, None, None, None, "T"), (None, None, None, None, None),
        (None, None, None, None, None), (None, None, None, None, None), (None, None, None, None, "T"), (None, None, None, None, "N")]
    files = spark.createDataFrame([("a/SJAML040538_D2_123456789M.bam",), ("b.bam",)], "f string")
    assert [r[0] for r in files.select(R.sample_of_file(F.col("f"))).collect()] == ["SJAML040538_D2", "b"]


def test_status_and_anchor(spark):
    cases = [("MKV", "MKV", 1, 1), ("MKVLA", "KVL", 1, 2), (None, "MKV", 1, -1), ("A" * 50, "A" * 49 + "C", 1, -2), ("A" * 25, "A" * 24 + "C", 1, -3), ("MKV", "WW", 1, -4), ("MKV", "WW", 2, -5)]
    rows = spark.createDataFrame(cases, "p string, t string, n int, want int")
    got = rows.select("want", R.aa_status(F.col("p"), F.col("t"), F.col("n")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    text = spark.createDataFrame([("X" * 7 + "ACDEFGHIKLMNPQRSTVWYACDEF", "ACDEFGHIKLMNPQRSTVWYACDEW", 8), ("ACDEF", "ACDEF", 0), ("AC", "ACDEFGHIKLM", 0)], "t string, p string, want int")
    assert all(r.want == r.got for r in text.select("want", R.approx_anchor(F.col("t"), F.col("p")).alias("got")).collect())


def test_internal_events_with_a_gold_list(spark):
    rows = spark.createDataFrame([(1, "A", 10, 20, "Internal_dup", 5, 1), (2, "B", 10, 20, "Internal_dup", 50, 1), (3, "B,C", 10, 20, "Internal_inv", 50, 1), (4, "A", 10, 20, "CTX", 1, 1)],
                                 "ord long, genea string, posa long, posb long, type string, reads int, cutoff int")
    windows = spark.createDataFrame([("A", 1, 30)], "gene string, st long, en long")
    assert sorted(r.ord for r in R.internal_events(rows, windows).collect()) == [1, 4]
    gold = spark.createDataFrame([("B",)], "name string")
    assert sorted(r.ord for r in R.internal_events(rows, windows, gold).collect()) == [2, 4]
