"""Literal loops, known results and files."""
import random

import pytest
from pyspark.sql import functions as F

from fusionframe.fixtures import view
from fusionframe.functions import columns as C
from fusionframe.operators import evidence, intervals, proximity, scoring, transcripts
from fusionframe.sources import text as files

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first().v


def loop(rows, mode):
    kept = []
    for r in rows:
        for k in kept:
            same = k["chra"] == r["chra"] and k["chrb"] == r["chrb"] and abs(k["posa"] - r["posa"]) < 10 and abs(k["posb"] - r["posb"]) < 10
            reads = (k["readsa"] + k["readsb"], r["readsa"] + r["readsb"])
            if mode == "raw" and same or mode == "rank" and same and reads[0] > reads[1]:
                break
            if mode == "annotated" and same and (reads[0] >= reads[1] or k["matcha"] + k["matchb"] >= r["matcha"] + r["matchb"]):
                break
            if mode == "raw" and k["chra"] == r["chrb"] and k["chrb"] == r["chra"] and abs(k["posa"] - r["posb"]) < 10 and abs(k["posb"] - r["posa"]) < 10:
                k["chrb"], k["posb"] = r["chra"], r["posa"]
                break
        else:
            kept.append(dict(r))
    return kept


@pytest.mark.parametrize("mode", ["raw", "annotated", "rank"])
def test_folds_equal_a_loop(spark, mode):
    rng = random.Random(1)
    rows = [dict(ord=i, chra=f"c{rng.randint(1, 2)}", posa=rng.randint(1, 150), chrb=f"c{rng.randint(1, 2)}", posb=rng.randint(1, 150), readsa=rng.randint(0, 5),
                 readsb=rng.randint(0, 5), matcha=rng.randint(0, 9), matchb=rng.randint(0, 9)) for i in range(600)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "ord long, chra string, posa long, chrb string, posb long, readsa long, readsb long, matcha long, matchb long")
    got = sorted(tuple(r) for r in proximity.dedupe_pairs(frame, mode).collect())
    assert got == sorted(tuple(r.values()) for r in loop(rows, mode))


def test_chunks():
    assert proximity.chunk_by_sum([5, 3, 4, 9, 1, 1], 6) == [1, 1, 1, 2, 2, 2]
    assert proximity.chunk_by_sum([5, 7, 4, 9, 1], 6) == [1, 1, 2, 2, 3]


def test_known_score(spark):
    row = dict(areaa=1145, areab=1756, mafa=0.38, mafb=0.77, matcha=90, matchb=90, repa=0.0, repb=0.0, sv_ort=">", frame="1", type="CTX", chra="a", chrb="b",
               posa=1, posb=2, qsa=1, qsb=1, has_itd=False)
    assert one(spark, scoring.score(), **row) == pytest.approx(5802)
    assert one(spark, scoring.score(), **row | {"type": "read_through"}) == pytest.approx(580.2)


def test_known_fractions_and_totals(spark):
    def maf(*v):
        return one(spark, scoring.allele_fraction(*[F.col(c) for c in "abcde"]), **dict(zip("abcde", v)))
    assert maf(67, 20, 175, 224, 0.0) == pytest.approx(0.383, abs=1e-3)
    assert maf(141, 27, 183, 44, 0.0) == pytest.approx(0.770, abs=1e-3)
    assert maf(5, 5, 0, 0, 0.25) == 0.25
    assert one(spark, scoring.total_reads(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=175, b=224, c=1, d=2) == 399
    assert one(spark, scoring.total_reads(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=0, b=224, c=7, d=9) == 9


def test_known_expression_ratio(spark):
    reads, length = 33.8541666, 1000.0
    genes = spark.createDataFrame([(1, "g", "c", 1, 1000, length, reads, 0.0274)], "gene_id long, name string, chrom string, st long, en long, mrna_length double, n_reads double, cutoff double")
    sites = spark.createDataFrame([("c", 5, "-", 168, 4804, 141, 27, 183, 44), ("c", 5000, "+", 5, 9, 1, 1, 1, 1), ("c", 5001, "+", 4, 9, 1, 1, 1, 1)],
                                  "chrom string, pos long, side string, reads long, bases long, plus_clip long, minus_clip long, plus_depth long, minus_depth long")
    got = {r.pos: r for r in evidence.expressed_sites(sites, genes, 101, spark.createDataFrame([("x",)], "name string")).collect()}
    assert got[5].expression_ratio == pytest.approx(34.6908, abs=1e-2)
    assert set(got) == {5, 5000} and got[5000].cutoff == -1
    assert set(r.pos for r in evidence.expressed_sites(sites, genes, 101, spark.createDataFrame([("g",)], "name string")).collect()) == {5000}


@pytest.mark.parametrize("up,down,want", [
    ("XXXXXXXXXXM1234567890", "*YYYYYYYYYYYYYYYYYYYY", True), ("YYYYYYYYYY", "M1234567890*", True), ("YYYYYYM123456789", "0*YYYYYYYYYY", True),
    ("XXXXXXXXXX", "YYYYYYYYYYM12345678901", True), ("M1234567890*", "YYYYYYYYYYYYYYYYYYYY", False), ("M12345*XXXXXXXXX", "YYYM12345678901", True),
    ("M123456789*", "YYYYYYYYYYYYYYYYYYYY", False)])
def test_coding_frames(spark, up, down, want):
    assert one(spark, transcripts.coding_frame(F.col("u"), F.col("d")), u=up, d=down) is want


def test_masks(spark):
    assert one(spark, C.mask_tandem(F.col("s"), F.lit(4)), s="GGATATATATCC") == "GGNNNNNNNNCC"
    assert one(spark, C.low_complexity_junction(F.col("s")), s="ACGT" + "A" * 30 + "CCGT") is True
    assert one(spark, C.low_complexity_junction(F.col("s")), s="ACGTTGCATGCCAGTACGATCGATTACGGCATTACGGA") is False


def test_text_columns(spark):
    trims = {"0.38": ".38", "2.078000": "2.078", "0.0": "0", "-0.50": "-.5", "12": "12", "x": "x"}
    assert {k: one(spark, C.float_trim(F.col("s")), s=k) for k in trims} == trims
    assert one(spark, C.clean_text(F.col("s")), s="  'ab c' ") == "ab c"
    assert one(spark, C.format_duration(F.col("s")), s=90061) == "1d 1h 1m 1s"
    assert one(spark, C.collapse_genes(F.split(F.col("s"), ",")), s="C11orf52,HSPB2-C11ORF52,TRIM61,LOC12") == ["TRIM61"]
    assert one(spark, C.same_gene(F.col("a"), F.col("b")), a="NA,x", b="NA,x") is False
    assert one(spark, C.same_gene(F.col("a"), F.col("b")), a="x|y", b="z,y") is True
    assert C.smallest_cover(0, 0.5, 0.05) == 5


def test_intervals_of_any_width_and_edges(spark):
    rng = random.Random(3)
    def make(n, seed):
        return [(i, rng.choice(["a", "b", None]), s, s + rng.choice([0, 10, 5_000, 400_000, -5])) for i in range(n) for s in [rng.randint(1, 900_000)]]
    l, r = make(120, 1), make(120, 2)
    schema = "id long, chrom string, st long, en long"
    got = sorted((x.id, x.r_id) for x in intervals.interval_join(spark.createDataFrame(l, schema), spark.createDataFrame(r, schema)).collect())
    assert got == sorted((a[0], b[0]) for a in l for b in r if a[1] and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and a[3] >= b[2])
    empty = spark.createDataFrame([], schema)
    assert intervals.interval_join(empty, spark.createDataFrame(r, schema)).count() == 0


def test_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)
    sam = files.read_sam_text(spark, put("a.sam", "@HD\tx\nr1\t16\tchr1\t5\t60\t3S4M\t=\t9\t0\tACGTACG\tIIIIIII\n")).first()
    assert (sam.flag, sam.st, sam.mate_chrom, sam.cigar) == (16, 5, "chr1", "3S4M")
    line = "\t".join(["G-locA", "NM_1", "chr1", "+", "10", "100", "20", "90", "2", "10,60,", "40,100,"])
    ref = files.read_refflat(spark, put("r.txt", f"#c\n{line}\n{line.replace('NM_', 'NR_')}\n{line.replace('10,60,', '10,')}\n")).collect()
    assert len(ref) == 1 and (ref[0].gene, ref[0].st, [tuple(e) for e in ref[0].exons]) == ("G", 11, [(11, 40), (61, 100)])
    j = files.read_junctions(spark, put("j.tab", "junction\tcount\ttype\tqc_plus\nchr1:164748842:+,chr1:164792494:+\t11\tnovel\t7\n")).first()
    assert (j.posa, j.posb, j["count"]) == (164748842, 164792494, 11)
    assert files.read_lookup(spark, "complex_regions", put("c.txt", "name\tchrom\tStart\tEnd\nIGH\tchr14\t5\t9\n")).collect() == [("IGH", "chr14", 5, 9)]
    assert files.detect_layout(spark, put("d.csv", "a,b,c\n1,2,3\n4,5,6\n")) == (",", 3)
    assert files.read_delimited(spark, str(tmp_path / "d.csv")).count() == 2
    fa = files.read_fasta(spark, put("f.fa", ">c1 x\nACGT\nAC\n>c2\nTTTT\n"))
    assert sorted(map(tuple, fa.collect())) == [("c1", "ACGTAC"), ("c2", "TTTT")]
    asked = spark.createDataFrame([(1, "c1", 2, 5), (2, "c2", 4, 4)], "k long, chrom string, st long, en long")
    assert sorted(map(tuple, files.base_range(files.chunked(fa, 3), asked, "k", 3).collect())) == [(1, "CGTA"), (2, "T")]
    psl = "\t".join(["10", *["0"] * 7, "+", "q", "20", "0", "10", "t", "99", "4", "30", "2", "4,6,", "0,4,", "4,24,"])
    hit = files.read_psl(spark, put("p.psl", f"psLayout\n{psl}\n")).first()
    assert (hit.matches, hit.tst, [tuple(b) for b in hit.blocks]) == (10, 5, [(1, 5, 4), (5, 25, 6)])
    a, b = put("u1", "x\ty\n1\t2\n"), put("u2", "x\ty\n1\t2\n3\t4\n")
    assert files.union_files(spark, [a, b]).count() == 3 and files.union_files(spark, [a, b], True).count() == 2
    with pytest.raises(ValueError):
        files.union_files(spark, [a, put("u3", "x\tz\n1\t2\n")])
    assert files.check_widths(spark, b).collect() == [(2, 3)]
    files.write_tsv(spark.createDataFrame([("a", 0.3833)], "n string, v double"), str(tmp_path / "out"), [("v", "%.2f"), ("n", None)])
    assert spark.read.text(str(tmp_path / "out")).collect()[0].value in ("v\tn", "0.38\ta")
    shaped = files.reshape(spark.createDataFrame([(1, 2, 3)], "a int, b int, tmp_c int"), {"a": "x"}, {"s": "q"}, {"z": 0}, ["b"], "^tmp_")
    assert shaped.columns == ["s", "x", "z"]
    assert proximity.drop_header_rows(spark.createDataFrame([("readsA",), ("5",)], "readsA string"), "readsA").collect() == [("5",)]
    with pytest.raises(ValueError):
        files.check_unique(["a", "a"])


def test_samples_keep_small_sites(spark):
    rows = spark.range(5000).selectExpr("if(id < 4900, 'big', 'small') site", "concat('r', id) name")
    got = {r.site: r.n for r in proximity.sample_fragments(rows, ["site"], ["name"], 500).groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert got["small"] == 100 and 350 < got["big"] < 650


def test_clusters_keep_long_clips_only(spark):
    sites = spark.createDataFrame([("c", 10, "+", 3, 40, 3, 0, 0), ("c", 13, "+", 2, 50, 1, 1, 30), ("c", 30, "+", 4, 60, 4, 0, 10)],
                                  "chrom string, pos long, side string, reads long, bases long, plus_clip long, minus_clip long, long_bases long")
    assert [tuple(r) for r in evidence.cluster_positions(sites).collect()] == [("c", "+", 13, 5, 90, 4, 1)]


def test_views_are_used(spark):
    assert view(spark, SF, "fx_svs").count() == 1500
