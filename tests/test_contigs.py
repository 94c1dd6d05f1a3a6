"""Contig resolution, folds and sweeps against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fusionframe.operators import contigs as C
from fusionframe.operators import evidence as E
from fusionframe.operators import graph, intervals, proximity, scoring, sweep, transcripts

HIT = "contig string, id string, tname string, tstart long, tend long, qstart long, qend long, qstrand int, qlen long, matches long, mismatches long, blocks array<struct<t:long,q:long,len:long>>"
SITE = "contig string, sc_chrom string, sc_site long, clip int"


def hit(contig, tname, tstart, qstart, length, qlen=200, strand=1, id=None, blocks=None, matches=None, mismatches=0):
    blocks = blocks or [(tstart, qstart if strand > 0 else qstart + length - 1, length)]
    tend = blocks[-1][0] + blocks[-1][2] - 1
    return (contig, id or f"{contig}{tname}{tstart}", tname, tstart, tend, qstart, qstart + length - 1, strand, qlen, length if matches is None else matches, mismatches, blocks)


def sites(spark, *rows):
    return spark.createDataFrame(rows, SITE)


def hits(spark, *rows):
    return C.sort_hits(spark.createDataFrame(rows, HIT))


def test_triage(spark):
    h = hits(spark, hit("short", "chr1", 100, 1, 90, qlen=90), hit("whole", "chr2", 5000, 1, 200), hit("beside", "chr1", 90_000, 2, 198, matches=190),
             hit("left", "chr1", 30_000, 1, 100), hit("left", "chr1", 60_000, 101, 100), hit("far", "chr1", 30_000, 1, 100), hit("far", "chr1", 90_000, 101, 100),
             hit("over", "chr1", 900, 1, 200, blocks=[(900, 1, 100), (1300, 101, 100)]), hit("good", "chr1", 901, 1, 100), hit("good", "chr9", 1, 101, 100))
    s = sites(spark, *[(c, "chr1", 1000, 1) for c in ("short", "whole", "beside", "left", "far", "over", "good")])
    got = {r.contig: (r.bad, r.site_mapped, r.best) for r in C.triage_contigs(h, s, 100).collect()}
    assert got == {"short": (True, False, 90), "whole": (True, False, 200), "beside": (True, False, 190), "left": (True, False, 100), "far": (False, False, 100),
                   "over": (False, True, 200), "good": (False, False, 100)}


def test_block_events(spark):
    h = hits(spark, hit("del", "chr1", 901, 1, 200, blocks=[(901, 1, 100), (1501, 101, 100)]), hit("dup", "chr1", 901, 1, 200, blocks=[(901, 1, 100), (1001, 131, 70)]),
             hit("one", "chr1", 901, 1, 150), hit("off", "chr1", 901, 1, 200, blocks=[(901, 1, 40), (960, 41, 160)]))
    s = sites(spark, *[(c, "chr1", 1001, 1) for c in ("del", "dup", "one", "off")])
    got = {r.contig: r for r in C.block_events(h, s, s).collect()}
    assert sorted(got) == ["del", "dup", "one"]
    assert (got["del"].kind, got["del"].tposa, got["del"].tposb, got["del"].qposa, got["del"].qposb) == ("gap", 1001, 1501, 101, 101)
    assert (got["dup"].kind, got["dup"].itd, got["dup"].tposa, got["dup"].tposb) == ("dup", True, 1001, 971)
    assert (got["one"].kind, got["one"].qposa, got["one"].matchesa, got["one"].matchesb) == ("one_block", 101, 101, 50)


def test_known_case_gives_one_pair(spark):
    h = hits(spark, hit("c1", "chr1", 901, 1, 100), hit("c1", "chr19", 5000, 101, 100))
    s, seq = sites(spark, ("c1", "chr1", 1000, 1)), spark.createDataFrame([("c1", "ACGT" * 50)], "contig string, seq string")
    triage = C.triage_contigs(h, s, 100)
    pm = C.partial_hits(h, s, triage, seq).collect()
    assert [(r.tpos, r.qstart, r.qend, r.ort, len(r.overhang), len(r.junction)) for r in pm] == [(1000, 1, 101, 1, 100, 25)]
    got = C.detect_pairs(h, s, seq, h.limit(0), 100).collect()
    assert [(r.contig, r.step, r.tnamea, r.tposa, r.tnameb, r.tposb) for r in got] == [("c1", 2, "chr1", 1000, "chr19", 5000)]


def test_empty_contigs(spark):
    h, s, seq = hits(spark), sites(spark), spark.createDataFrame([], "contig string, seq string")
    assert C.detect_pairs(h, s, seq, h, 100).count() == 0


def row(contig, step, n, a, b, matches, place, **more):
    return {"contig": contig, "id": str(n), "n": n, "step": step, "itd": False, "qlen": 200, "tnamea": a[0], "tposa": a[1], "tnameb": b[0], "tposb": b[1], "matchesa": matches[0], "matchesb": matches[1],
            "enda": a[1], "endb": b[1], "second": False, "best": 0, "site_mapped": False, "place": place, "n_contigs": 5, "n_bad": 1, "n_mapped": 0} | more


def choose(rows, most=3):
    return [(r["contig"], r["n"]) for r in C.choose_pairs(rows, most, 100, 25, 10_000)]


def test_choose_pairs():
    far = row("a", 2, 1, ("1", 100), ("2", 500), (80, 80), (0, "a"))
    assert choose([far]) == [("a", 1)]
    better = row("b", 2, 1, ("2", 520), ("1", 90), (90, 90), (1, "b"))
    assert choose([far, better]) == [("b", 1)]  # swapped ends, greater product: takes the place
    worse = better | {"matchesa": 50}
    assert choose([far, worse]) == [("a", 1)]
    assert choose([far, row("b", 2, 1, ("3", 1), ("1", 90), (90, 90), (1, "b"), second=True)]) == [("a", 1)]
    near = row("a", 1, 2, ("1", 100), ("1", 900), (90, 90), (0, "a"))
    assert choose([near, far]) == [("a", 2)]  # explains the contig: nothing on other targets is looked for
    event = row("c", 0, 1, ("1", 100), ("1", 700), (100, 90), (0, "c"))
    assert choose([event | {"n_contigs": 2, "n_mapped": 1}, far]) == [("c", 1)]
    many = [row("a", 2, i, ("1", 100), ("2", 1000 * i), (60 + i, 60), (0, "a")) for i in range(1, 6)]
    assert choose(many) == [("a", 3), ("a", 4), ("a", 5)]
    assert choose([m | {"qlen": 104} for m in many]) == []
    assert choose([m | {"best": 125} for m in many]) == [("a", 5)]


def test_merge_replaces_in_order(spark):
    rows = [(1, "1", 100, "2", 100, 3, 1), (2, "1", 140, "2", 140, 2, 1), (3, "1", 180, "2", 180, 1, 1)]
    schema = "ord long, chra string, posa long, chrb string, posb long, matcha long, matchb long"
    assert sorted(r.ord for r in proximity.merge_candidates(spark.createDataFrame(rows, schema)).collect()) == [1, 3]
    rng = random.Random(4)
    rows = [(i, f"c{rng.randint(1, 2)}", rng.randint(0, 900), f"c{rng.randint(1, 2)}", rng.randint(0, 900), rng.randint(1, 9), rng.randint(1, 9)) for i in range(1500)]

    kept = []
    for r in rows:
        for i, k in enumerate(kept):
            if (r[1], r[3]) == (k[1], k[3]) and abs(r[2] - k[2]) < 50 and abs(r[4] - k[4]) < 50 or (r[1], r[3]) == (k[3], k[1]) and abs(r[2] - k[4]) < 50 and abs(r[4] - k[2]) < 50:
                if r[5] * r[6] > k[5] * k[6]:
                    kept[i] = r
                break
        else:
            kept.append(r)
    assert sorted(r.ord for r in proximity.merge_candidates(spark.createDataFrame(rows, schema)).collect()) == sorted(k[0] for k in kept)


def test_top_hits_rule(spark):
    rows = [("few", i, 50 + i, 90, 52) for i in range(4)] + [("short", i, 50, 104, 0) for i in range(5)] + [("many", i, 50 + i // 2, 120, 0) for i in range(9)]
    got = proximity.top_hits(spark.createDataFrame(rows, "contig string, ord long, matches long, qlen long, best long"), 5, 100).collect()
    assert sorted((r.contig, r.ord) for r in got) == [("few", 2), ("few", 3), ("many", 4), ("many", 5), ("many", 6), ("many", 7), ("many", 8)]


def test_support_counts_rows_and_reads_apart(spark):
    maps = [("k", "r1", 60, 0, 60, 20, 130), ("k", "r1", 60, 0, 60, 10, 140), ("k", "r2", 60, 0, 60, 30, 130), ("k", "r3", 60, 0, 60, 30, 130), ("k", "low", 60, 0, 70, 20, 150), ("k", "edge", 60, 0, 60, 20, 105), ("k", "few", 25, 0, 25, 10, 160)]
    frame = spark.createDataFrame(maps, "contig string, read string, matches long, qstart long, qend long, tstart long, tend long")
    points = spark.createDataFrame([(1, "k", 100, 1), (2, "k", 100, -1), (3, "none", 5, 1)], "key long, contig string, pos long, ort int")
    assert {r.key: (r.reads, r.support) for r in E.junction_support(frame, points, "key").collect()} == {1: (3, 30 + 30 + 40), 2: (3, 80 + 90 + 70 + 70), 3: (0, 0)}


def test_genes_between_by_strand(spark):
    pairs = spark.createDataFrame([(1, "1", 0, "1", 100_000)], "ord long, chra string, posa long, chrb string, posb long")
    genes = spark.createDataFrame([("out", "1", "-", 20_000, 40_000, 900), ("in", "1", "+", 25_000, 30_000, 900), ("nest", "1", "-", 26_000, 27_000, 900)], "gene string, chrom string, strand string, st long, en long, cds_length long")
    got = [transcripts.genes_between(pairs, genes, strand=s).collect()[0].genes for s in (None, "+", "-")]
    assert got == [2, 1, 1]


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_running_max_over_borders(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), rng.randint(0, 60), i, rng.randint(0, 99) if rng.random() < 0.8 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, at long, i long, v long")
    got = {r.i: (r.before, r.upto) for r in sweep.running_max(sweep.running_max(frame, ["k"], "at", ["i"], {"before": F.col("v")}, block), ["k"], "at", ["i"], {"upto": F.col("v")}, block, before=False).collect()}
    for k, at, i, v in rows:
        earlier = [w for l, b, j, w in rows if l == k and (b, j) < (at, i) and w is not None]
        upto = earlier + ([v] if v is not None else [])
        assert got[i] == (max(earlier, default=None), max(upto, default=None))


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_merge_and_edges_with_blocks_of_any_width(spark, block, monkeypatch):
    monkeypatch.setattr(sweep.running_max, "__defaults__", (block, True))
    rng = random.Random(block)
    rows = [(rng.choice("xy"), s := rng.randint(0, 120), s + rng.choice([0, 0, 2, 9, 30])) for _ in range(60)] + [("x", 5, 5)] * 3
    got = sorted(map(tuple, intervals.merge_intervals(spark.createDataFrame(rows, "chrom string, st long, en long")).collect()))
    want = []
    for c in "xy":
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if want and want[-1][0] == c and s <= want[-1][2]:
                want[-1] = (c, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((c, s, e))
    assert got == want
    points = [(i, rng.choice("xyz"), rng.randint(0, 150)) for i in range(80)]
    edges = [(c, rng.choice("+-"), p, i) for i, (c, a, b) in enumerate(rows) for p in (a, b)]
    near = sweep.nearest_edges(spark.createDataFrame(points, "i long, chrom string, pos long"), spark.createDataFrame(edges, "chrom string, strand string, edge long, what long").withColumn("what", F.struct("what")), "i")
    for r in near.collect():
        _, c, pos = points[r.i]
        for s in "+-":
            down = max(((p, -w) for cc, t, p, w in edges if cc == c and t == s and p <= pos), default=None)
            up = min(((p, w) for cc, t, p, w in edges if cc == c and t == s and p >= pos), default=None)
            assert (r[f"down_{s}"] and (r[f"down_{s}"].edge, -r[f"down_{s}"].what[0])) == down
            assert (r[f"up_{s}"] and (r[f"up_{s}"].edge, r[f"up_{s}"].what[0])) == up


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(chain + star + [(200, 200), (300, 299), (299, 300)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 299: 299, 300: 299}
    assert graph.components(edges.limit(0)).count() == 0


def test_build_genes_keeps_gene_in_gene_apart(spark):
    rows = [(1, "G", "1", "+", 1, 100, [(1, 10), (90, 100)]), (2, "G", "1", "+", 95, 200, [(95, 99), (150, 200)]), (3, "H", "1", "+", 20, 60, [(20, 60)]), (4, "I", "1", "-", 5, 9, [(5, 9)]), (5, "J", "1", "+", 200, 300, [(200, 300)])]
    frame = spark.createDataFrame(rows, "tx long, gene string, chrom string, strand string, st long, en long, exons array<struct<st:long,en:long>>")
    got = {r.gene_no: (r.st, r.en, r.names, r.transcripts) for r in transcripts.build_genes(frame).collect()}
    assert got == {1: (1, 300, "G,J", 3), 3: (20, 60, "H", 1), 4: (5, 9, "I", 1)}


def test_long_and_short_intervals_meet_once(spark):
    rng = random.Random(2)
    make = lambda n: [(i, "1", s := rng.randint(0, 5000), s + rng.choice([0, 3, 40, 900, 4000])) for i in range(n)]
    left, right = make(120), make(120)
    schema = "i long, chrom string, st long, en long"
    for pad in (0, 25):
        got = sorted((r.i, r.r_i) for r in intervals.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), width=10, pad=pad).collect())
        assert got == sorted((a[0], b[0]) for a in left for b in right if a[2] - pad <= b[3] and a[3] + pad >= b[2])


def test_consensus_ties_and_n(spark):
    rows = [("+", "ACG"), ("+", "ATN"), ("+", "AT"), ("-", "GCA"), ("-", "TTA"), ("-", "A"), ("+", None)]
    frame = spark.createDataFrame([("1", 5, s, q) for s, q in rows], "chrom string, pos long, side string, seq string")
    got = {r.side: (r.consensus, r.support, r.reads) for r in E.clip_consensus(frame, ["chrom", "pos", "side"]).collect()}
    assert got == {"+": ("ATG", 1, 3), "-": ("GCA", 1, 3)}


def test_known_pairs_follow_order(spark):
    rows = [(1, "IGH", "A"), (2, "A", "B"), (3, "C", "D"), (4, "IGH", "IGK"), (5, "IGH", "E"), (6, "E", "F"), (7, "TRA", "C"), (8, "C", "Z")]
    got = {(r.x, r.y) for r in scoring.known_pairs(spark.createDataFrame(rows, "ord long, genea string, geneb string")).collect()}
    want = [("IGH", "A"), ("C", "D"), ("IGH", "IGK"), ("E", "F"), ("TRA", "C")]
    assert got == {p for x, y in want for p in ((x, y), (y, x))}
