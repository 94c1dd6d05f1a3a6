"""Faults of the fourth review, each with a case that failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_balls_are_not_broadcast(spark, tmp_path):
    """34 rows a fingerprint were broadcast, as Spark sized them before the explode."""
    from fusionframe.llm.simhash import fingerprint_links
    base = np.random.default_rng(4).integers(-2 ** 62, 2 ** 62, 50).tolist()
    spark.createDataFrame([(v,) for x in base for v in (x, x ^ 1, x ^ (5 << 33))], "fp long").write.parquet(str(tmp_path / "fps"))
    prints = spark.read.parquet(str(tmp_path / "fps"))
    links = fingerprint_links(prints)
    assert "Broadcast" not in _plan(links)
    want = {tuple(sorted(p)) for x in base for p in ((x, x ^ 1), (x, x ^ (5 << 33)))}
    assert {(r.a, r.b) for r in links.collect()} == want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J13_junction_reads", "J16_transcripts_at", "J18_seek_base", "J19_nearest_cds", "J20_exon_of", "C05_numbered_feature"])
def test_pairs_come_out_over_all_tasks(spark, name):
    """F3, F4, F7-F10: few bytes were read by one or a few tasks, which made all pairs; and spread rows were broadcast."""
    from fusionframe.plans.catalog import QUERIES
    df = QUERIES[name](spark, SF)
    df.collect()
    assert df.rdd.getNumPartitions() == 8
    assert "Inner, Build" not in _plan(df)


def test_listed_join_equals_join(spark, monkeypatch):
    """F8-F10: keys of many rows, lists of several pieces, keys of one side only, null keys and repeated rows."""
    from fusionframe.operators import intervals as I
    monkeypatch.setattr(I, "LIST", 3)
    monkeypatch.setattr(I, "ROWS", 4)
    rows = spark.createDataFrame([(i, "k" if i < 20 else "m" if i < 23 else None) for i in range(25)] + [(1, "k"), (30, "alone")], "ord long, place string")
    found = spark.createDataFrame([("k", t, "a") for t in range(8)] + [("k", 2, "a"), ("m", 1, "b"), ("other", 5, "c"), (None, 6, "d")], "place string, tx long, gene string")
    got, want = I.listed_join(rows, found, ["place"]), rows.join(found, "place").select("ord", "place", "tx", "gene")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_cds_by_parts(spark):
    """parts are made once for a transcript; ties take the lower position, and transcripts without coding bases give nothing."""
    from fusionframe.operators import transcripts as T
    exons = "array(named_struct('st', 10L, 'en', 19L), named_struct('st', 30L, 'en', 39L))"
    hits = spark.sql(f"select * from values (1, 24L, '+'), (2, 24L, '-'), (3, 5L, '+'), (4, 90L, '-') h(key, pos, strand)").selectExpr(
        "key", "pos", "strand", "key tx", "15L cds_st", "35L cds_en", f"{exons} exons")
    none = hits.selectExpr("9 key", "pos", "strand", "tx", "50L cds_st", "60L cds_en", "exons").where("strand = '+'")
    want = [(1, 1, 5, 15), (2, 2, 7, 16), (3, 3, 1, 15), (4, 4, 1, 16)]
    assert sorted(map(tuple, T.nearest_cds(hits.unionByName(none), "key").collect())) == want
    assert sorted(map(tuple, T.nearest_cds(T.with_coding_parts(hits), "key").collect())) == want


def test_sites_alike_are_met_once(spark):
    """1200 equal sites are lists that a read unpacks, each site with each read that fits."""
    from fusionframe.operators import reads as G
    reads = spark.createDataFrame([("fits", "c", 100, 350, 1, "40M200N50M"), ("fits", "c", 100, 350, 1, "40M200N50M"), ("far", "c", 400, 650, 1, "40M200N50M")],
                                  "qname string, chrom string, st long, en long, flag int, cigar string")
    sites = spark.range(1200).selectExpr("id key", "'c' chrom", "140L pos", "1 clip", "200 gap")
    met = G.junction_reads(reads, sites, "key")
    assert [(r.qname, r.n) for r in met.groupBy("qname").agg(F.count("*").alias("n")).collect()] == [("fits", 2400)]
    joined = [line for line in _plan(met).splitlines() if "Join" in line]
    assert len(joined) == 1 and met.select("key").distinct().count() == 1200


def test_written_tables_are_small(spark, tmp_path):
    """tables that a query writes on its way took too much of the disk."""
    from fusionframe.operators.graph import written
    files = written(spark.range(10).toDF("a"), "small").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
