"""Findings of round 3: dense data, against plain loops and without pairs of all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fusionframe.operators import contigs, evidence, intervals, proximity, records, scoring, transcripts
from fusionframe.plans import catalog

MANY = 100_000  # as many pairs as its square, in one bin


def test_counts_where_all_rows_overlap(spark):
    reads = spark.range(MANY).selectExpr("'c' chrom", "1000 + id % 10 st", "1100 + id % 7 en", "0 flag", "if(id % 4 = 0, '+', '-') strand")
    ivals = spark.range(MANY).selectExpr("id key", "'c' chrom", "1050 + id % 5 st", "1060 + id % 5 en")
    start = time.time()
    got = intervals.count_overlaps(ivals, reads, "key").groupBy("n_reads").count().collect()
    assert [(r.n_reads, r["count"]) for r in got] == [(MANY, MANY)]
    assert [tuple(r) for r in evidence.depth_at(reads, ivals.selectExpr("chrom", "1050 pos")).collect()] == [("c", 1050, MANY, MANY // 4, MANY * 3 // 4)]
    assert time.time() - start < 90


def test_counts_equal_a_loop(spark):
    rng = random.Random(3)
    def span(n): return [(rng.choice("ab"), s, s + rng.choice([-1, 0, 3, 200, 70_000])) for s in (rng.randrange(-300, 140_000) for _ in range(n))]
    reads, ivals = span(400) + [(None, 5, 9), ("a", None, 9)], span(80) + [("a", None, 5), ("z", 1, 2)]
    r = spark.createDataFrame([(*x, 0, "+-"[i % 2]) for i, x in enumerate(reads)], "chrom string, st long, en long, flag int, strand string")
    i = spark.createDataFrame([(k, *x) for k, x in enumerate(ivals)], "key long, chrom string, st long, en long")
    ok = [x for x in reads if None not in x and x[1] <= x[2]]
    want = {k: sum(x[0] == c and s <= e and x[1] <= e and x[2] >= s for x in ok) if s is not None else 0 for k, (c, s, e) in enumerate(ivals)}
    assert {x.key: x.n_reads for x in intervals.count_overlaps(i, r, "key").collect()} == want
    places = [(c, s) for c, s, _ in ivals]
    depth = {(x.chrom, x.pos): (x.depth, x.plus_depth + x.minus_depth) for x in evidence.depth_at(r, spark.createDataFrame(places, "chrom string, pos long")).collect()}
    assert depth == {(c, s): (sum(x[0] == c and x[1] <= s <= x[2] for x in ok),) * 2 if s is not None else (0, 0) for c, s in places}


def test_places_are_looked_up_once(spark):
    n = 20_000
    points = spark.range(n).selectExpr("id ord", "'c' chrom", "1000L st", "1000L en", "1000L pos", "1 qs", "1 ort", "'g' gene")
    tx = spark.range(n).selectExpr("id tx", "concat('g', id % 3) gene", "'c' chrom", "if(id % 2 = 0, '+', '-') strand", "900 + id % 50 st", "1100 + id % 60 en", "950L cds_st", "1050L cds_en",
                                   "array(named_struct('st', 900 + id % 50, 'en', 1100 + id % 60)) exons")
    start = time.time()
    assert transcripts.gene_features(points, tx, "ord").groupBy("gene", "feature").count().count() == 3
    assert {r.feature for r in transcripts.annotate_site(points, tx, "ord").select("feature").distinct().collect()} == {"coding"}
    assert records.intergenic_sites(points.selectExpr("*", "9 reads"), tx, "ord").count() == 0
    near = records.salvage_nearest(points.withColumn("gene", F.concat(F.lit("g"), F.col("ord") % 3)).where("ord < 60"), tx, "ord")
    assert near.select("ord").distinct().count() == 60
    assert time.time() - start < 90


def test_nearest_transcripts_equal_a_loop(spark):
    rng = random.Random(5)
    tx = [(k, rng.choice("xy"), rng.choice("ab"), s, s + rng.choice([0, 5, 300, 70_000]), 1, 2) for k, s in enumerate(rng.randrange(-50, 90_000) // 7 * 7 for _ in range(300))]
    points = [(k, rng.choice("xyz"), rng.choice("ab"), p) for k, p in enumerate([t[3] for t in tx[:40]] + [t[4] for t in tx[40:80]] + [rng.randrange(-90, 99_000) for _ in range(80)])]
    want = set()
    for k, g, c, p in points:
        far = [(t[3] - p if p < t[3] else p - t[4], t[0]) for t in tx if t[1] == g and t[2] == c]
        want |= {(k, t) for d, t in far if d == min(far)[0]}
    got = records.salvage_nearest(spark.createDataFrame(points, "ord long, gene string, chrom string, pos long"), spark.createDataFrame(tx, "tx long, gene string, chrom string, st long, en long, cds_st long, cds_en long"), "ord")
    assert {tuple(r) for r in got.collect()} == want


def test_nested_ranges_equal_a_loop(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice("ab"), s, s + rng.choice([0, 1, 2, 500, 70_000])) for k, s in enumerate(rng.randrange(-5, 30) * rng.choice([1, 4000]) for _ in range(200))]
    def nested(x): return any(y[0] != x[0] and y[1] == x[1] and y[2] <= x[2] and y[3] >= x[3] and (y[2:] != x[2:] or y[0] < x[0]) for y in rows)
    got = proximity.prune_nested(spark.createDataFrame(rows, "k long, g string, st long, en long"), "k", "g")
    assert {r.k for r in got.collect()} == {x[0] for x in rows if not nested(x)}


def test_names_of_many_rows(spark):
    names = {r.id: r.unique_name for r in evidence.uniquify(spark.range(6000).withColumn("name", F.lit("g")), "name", "id").collect()}
    assert names[0] == "g-locA" and names[26] == "g-locAA" and names[5999] == "g-loc" + chr(64 + 5999 // 26) + chr(65 + 5999 % 26) and len(set(names.values())) == 6000


def test_pair_bands_equal_a_loop(spark):
    rng = random.Random(11)
    pairs = [(k, rng.choice("ab"), rng.randrange(-20, 60), rng.choice("ab"), rng.randrange(-20, 60)) for k in range(300)]
    def near(a, b): return a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 10 and abs(a[3] - b[3]) < 10
    want = {(x[0], y[0]) for x in pairs for y in pairs if near(x[1:], y[1:]) or near(x[1:], (*y[3:], *y[1:3]))}
    df = spark.createDataFrame(pairs, "ord long, chra string, posa long, chrb string, posb long")
    got = [tuple(r) for r in intervals.pair_band_join(df, df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_folds_equal_an_ordered_loop(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice("ab"), rng.randrange(60), rng.choice("ab"), rng.randrange(60), rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.randrange(9)) for k in range(400)]
    schema = "ord long, chra string, posa long, chrb string, posb long, readsa long, readsb long, matcha long, matchb long"

    def near(k, c1, p1, c2, p2): return (k[1], k[3]) == (c1, c2) and abs(k[2] - p1) < 10 and abs(k[4] - p2) < 10

    def loop(mode):
        kept = []
        for r in rows:
            for i, k in enumerate(kept):
                direct = near(k, *r[1:5])
                if mode == "annotated":
                    direct = direct and (k[5] + k[6] >= r[5] + r[6] or k[7] + k[8] >= r[7] + r[8])
                if mode == "rank":
                    direct = direct and k[5] + k[6] > r[5] + r[6]
                if direct:
                    break
                if mode == "raw" and near(k, r[3], r[4], r[1], r[2]):
                    kept[i] = (*k[:3], r[1], r[2], *k[5:])
                    break
            else:
                kept.append(r)
        return sorted(kept)

    for mode in ("raw", "annotated", "rank"):
        assert sorted(tuple(r) for r in proximity.dedupe_pairs(spark.createDataFrame(rows, schema), mode).collect()) == loop(mode)


def test_folds_hold_what_they_keep():
    # 20,000 rows of one place pair: a fold that holds rows, or looks along one end only, holds or scans them all
    for fold, most in ((proximity.FoldRaw(10), 1), (proximity.FoldBest(10, True), 1), (proximity.FoldBest(10, False), 1)):
        for k in range(20_000):
            fold.add((k, "a", 5, "b", 5, 1, 1, 1, 1))
        assert sum(map(len, fold.places.cells.values())) <= most
    blank = proximity.FoldBest(10, True)
    assert blank.add((1, "a", 5, "b", 5, None, 1, 1, 1)) and blank.add((2, "a", 5, "b", 5, 0, 0, 1, 1))


def test_genes_between_equal_a_loop(spark):
    rng = random.Random(17)
    genes = [(f"g{rng.randrange(50)}", rng.choice("xy"), rng.choice(["+", "-", ".", None]), s, s + rng.choice([3, 40, 400, 2000]), rng.choice([100, 301])) for s in (rng.randrange(6000) for _ in range(90))]
    pairs = [(k, rng.choice("xy"), rng.randrange(7000), "x", rng.randrange(7000)) for k in range(120)]
    want = {}
    for k, ca, a, cb, b in pairs:
        if ca != cb:
            continue
        s, e = min(a, b), max(a, b)
        met = [g for g in genes if g[1] == ca and g[3] <= e and g[4] >= s]
        free = [x for x in met if x[3] > s and x[4] < e and x[5] > 300 and not any(y[0] != x[0] and y[2] and y[2] == x[2] and y[3] < x[3] and y[4] > x[4] for y in met)]
        want[k] = 0 if any(g[3] <= s + 50 and g[4] >= e - 50 for g in met) else len(free)
    got = transcripts.genes_between(spark.createDataFrame(pairs, "ord long, chra string, posa long, chrb string, posb long"),
                                    spark.createDataFrame(genes, "gene string, chrom string, strand string, st long, en long, cds_length long"), 50)
    assert {r.ord: r.genes for r in got.collect()} == want


def test_one_locus_equals_a_loop(spark):
    rng = random.Random(19)
    genes = [(k, rng.choice("xy"), s, s + rng.choice([50, 500, 9000])) for k, s in enumerate(rng.randrange(80_000) for _ in range(25))]
    pairs = [(k, rng.choice("xy"), a, a - 20, a + 60, 1, rng.choice("xy"), b, b - 20, b + 60, 1) for k in range(150) for a, b in [(rng.randrange(80_000), rng.randrange(80_000))]]

    def ends(c, st, en):
        gaps = [(0 if d <= 0 else 1 if d <= 5000 else 2, g) for g in genes if g[1] == c for d in [max(0, g[2] - en, st - g[3])] if d <= 10_000]
        return [g for t, g in gaps if t == min(t for t, _ in gaps)], not gaps or min(t for t, _ in gaps) > 0

    def within(x, y): return x[2] - 1000 < y[2] and x[3] + 1000 > y[3]
    want = {}
    for k, ca, a, sa, ea, _, cb, b, sb, eb, _ in pairs:
        (ga, na), (gb, nb) = ends(ca, sa, ea), ends(cb, sb, eb)
        near = min(abs(a - sb), abs(a - eb), abs(b - sa), abs(b - ea))
        want[k] = ca == cb and (any(within(x, y) or within(y, x) for x in ga for y in gb) or ((na or nb) and near < 1000) or (na and nb and (near < 5000 or abs(a - b) < 1000)))
    got = scoring.same_locus(spark.createDataFrame(pairs, "ord long, chra string, posa long, sta long, ena long, qsa int, chrb string, posb long, stb long, enb long, qsb int"),
                             spark.createDataFrame(genes, "gene_id long, chrom string, st long, en long"))
    assert {r.ord: r.same for r in got.collect()} == want


def test_clips_of_tight_and_loose_reads_at_a_site(spark):
    # q1 also reaches the site by a moved clip of another read of its name; x and y are alike, and z lies alone
    reads = [("q1", "c", 100, "30S6M101N60M", 0, 5), ("q1", "c", 100, "30S3M104N60M", 0, 5), ("x", "c", 100, "30S60M", 0, 7), ("y", "c", 100, "30S60M", 32, 7), ("z", "c", 102, "25S60M", 32, 7)]
    df = spark.createDataFrame(reads, "qname string, chrom string, st long, cigar string, flag int, mate_st long")
    sites = spark.createDataFrame([(1, "c", 100, "-"), (2, "c", 100, "-"), (3, "c", 2, "-"), (4, None, 5, "-")], "key long, chrom string, pos long, side string")
    got = {r.key: tuple(r)[1:] for r in evidence.clip_reads_at(df, sites, "key").collect()}
    assert got == {1: (3, 100, "+", 5, 7, 30), 2: (3, 100, "+", 5, 7, 30)}


def test_consensus_equals_a_loop_in_any_batches(spark, monkeypatch):
    rng = random.Random(12)
    places = [("a", 5, "+"), ("a", 5, "-"), ("a", 6, "+"), ("b", 5, "-"), (None, 5, "+"), ("b", None, "-")]
    rows = [(*rng.choice(places), "".join(rng.choice("ACGTNacgtR") for _ in range(rng.choice([0, 1, 3, 9])))) for _ in range(300)] + [("z", 1, "+", "ACG"), ("a", 5, "+", None)]
    want = {}
    for place in set(r[:3] for r in rows):
        read = [(r[3] if place[2] == "+" else r[3][::-1]).upper() for r in rows if r[:3] == place and r[3]]
        won = []
        for i in range(max(map(len, read), default=0)):
            column = [t[i] for t in read if len(t) > i]
            if len(column) >= 2:
                won.append(min((b == "N", -column.count(b), b, len(column)) for b in set(column)))
        if won:
            text = "".join(w[2] for w in won)
            want[place] = (text if place[2] == "+" else text[::-1], min(-w[1] for w in won), won[0][3])
    frame = spark.createDataFrame(rows, "chrom string, pos long, side string, seq string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, deep in ((7, 1 << 17), (10_000, 1 << 17), (7, 50)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            monkeypatch.setattr(evidence, "DEEP", deep)
            got = {(r.chrom, r.pos, r.side): (r.consensus, r.support, r.reads) for r in evidence.clip_consensus(frame, ["chrom", "pos", "side"]).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_consensus_moves_clips_and_not_letters(spark):
    clips = spark.range(1000).selectExpr("'c' chrom", "id % 300 pos", "'+' side", "'ACGTACGT' seq")
    plan = evidence.clip_consensus(clips, ["chrom", "pos", "side"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("name", ["M02_block_events", "M04_overhang_local", "M06_overhang_second"])
def test_hits_are_moved_to_their_contig_once(spark, name):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Join" in plan and "Exchange" not in plan


def test_pairs_of_a_site_grow_without_their_square():
    rng = random.Random(7)
    rows = [dict(contig=i // 3, n=i, step=2, itd=False, qlen=200, matchesa=rng.randrange(60, 120), matchesb=rng.randrange(60, 120), tnamea="x", tnameb="y", enda=rng.randrange(10**8), endb=rng.randrange(10**8),
                 tposa=0, tposb=0, second=False, best=0, site_mapped=False, n_contigs=9, n_bad=0, n_mapped=0, place=(-200, i // 3)) for i in range(20_000)]
    start = time.time()
    kept = contigs.choose_pairs(rows, 3, 100, 25, 10_000)
    assert len(kept) > 19_000 and time.time() - start < 10


def test_dense_ranges_equal_a_loop(spark, monkeypatch):
    rng = random.Random(9)

    def ranges(n):
        out = [(i % 5, "cd"[rng.randrange(2)], p := rng.randrange(400), p + rng.choice([0, 3, 12, 40, 900])) for i in range(n)]
        return out + [(0, "c", -30, 30), (1, "c", None, 5), (2, "d", 9, 3), (3, None, 1, 9), (4, "d", -2000, 3000)]
    left, right = ranges(300) * 3, ranges(200)
    want = sorted(l + r for l in left for r in right if None not in l + r and l[1] == r[1] and l[2] <= l[3] and r[2] <= r[3] and l[2] <= r[3] and l[3] >= r[2])
    schema = "i int, chrom string, st long, en long"
    for piece, copies in ((4, 2), (256, 1000)):
        monkeypatch.setattr(intervals, "PIECE", piece)
        monkeypatch.setattr(intervals, "COPIES", copies)
        met = intervals.dense_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), width=10)
        assert met.columns == ["i", "chrom", "st", "en", "r_i", "r_chrom", "r_st", "r_en"]
        assert sorted(map(tuple, met.collect())) == want


def test_pairs_of_ranges_come_out_packed(spark, tmp_path):
    pairs = catalog.QUERIES["J01_interval_join"](spark, "/root/testdata/sf0.1")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    pairs.write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 7_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 3 * n


def test_pairs_of_transcripts_equal_a_loop(spark, monkeypatch):
    rng = random.Random(3)
    svs = [(i % 90, rng.choice(["c", "d", "e", None]), rng.choice([None, *range(20)]), rng.choice(["c", "d"]), rng.randrange(30)) for i in range(300)]
    svs += [(i, "c", 7, "d", 8) for i in range(100, 125)]  # many rows of one pair of places
    tx = [(i, rng.choice("cd"), p := rng.randrange(25), p + rng.randrange(9), 0, 5 if i % 6 else 0) for i in range(60)]

    def over(chrom, pos):
        return [t[0] for t in tx if t[4] < t[5] and pos is not None and t[1] == chrom and t[2] <= pos <= t[3]] or [None]
    blank = lambda row: tuple(-1 if x is None else x for x in row)
    want = sorted(blank((s[0], a, b)) for s in svs for a in over(*s[1:3]) for b in over(*s[3:]))
    pairs = spark.createDataFrame(svs, "ord long, chra string, posa long, chrb string, posb long")
    frame = spark.createDataFrame(tx, "tx long, chrom string, st long, en long, cds_st long, cds_en long")
    for most, rows in ((2, 4), (512, 100_000)):
        monkeypatch.setattr(records, "LIST", most)
        monkeypatch.setattr(records, "ROWS", rows)
        assert sorted(map(blank, records.pair_transcripts(pairs, frame, "ord").collect())) == want


def test_pairs_of_transcripts_move_rows_and_lists_only(spark):
    plan = catalog.QUERIES["J17_pair_transcripts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord#" not in plan and "LeftOuter" not in plan[:plan.index("Scan parquet")]  # no (ord, tx) is moved to its ord
