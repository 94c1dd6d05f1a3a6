"""Frames, proteins and annotation records on known cases and against plain loops."""

import random

from pyspark.sql import functions as F

from fusionframe.operators import frames as R
from fusionframe.sources import annotation as A


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).collect()[0].x


def fragment(spark, at, forward, length=4, first=4, last=12):
    return one(spark, R.aa_fragment(F.col("aa"), F.col("f"), F.col("l"), F.col("at"), length, forward), aa="abcDEFGHIJKLmnop", f=first, l=last, at=at)


def test_fragment_walk(spark):
    assert tuple(fragment(spark, 5, True)) == ("EFGH", 0, False)
    assert tuple(fragment(spark, 2, True)) == ("DEFG", 2, False)  # two codons of 5' UTR are passed over
    assert tuple(fragment(spark, 13, True)) == ("p", 4, True)  # three of 3' UTR, then the end
    assert tuple(fragment(spark, 6, False)) == ("CDEF".replace("C", "c"), 1, False)
    assert tuple(fragment(spark, 15, False)) == ("IJKL", 3, False)
    assert fragment(spark, 17, True) is None and fragment(spark, 0, False) is None


def test_match_upstream(spark):
    aa = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKV"
    match = lambda up, protein=aa: tuple(one(spark, R.match_upstream(F.col("up"), F.col("aa")), up=up, aa=protein))
    assert match(aa[5:30]) == (31, "perfect", 25, False)
    assert match(aa[5:30] + "WW") == (31, "tuple", 25, False)
    assert match("W" * 12) == (None, "", None, False)
    assert match("ABCDE") == (None, "", None, False)
    assert match(aa[5:15] + "W", aa + aa) == (None, "", None, True)
    wrong = "".join("W" if i % 26 == 25 else c for i, c in enumerate(aa[:52]))
    assert match(wrong)[1] == "tuple"


def test_frame_call(spark):
    call = lambda a, after, frag, utr, start, coding: one(spark, R.frame_call(*[F.col(c) for c in "abcdef"]), a=a, b=after, c=frag, d=utr, e=start, f=coding)
    assert call(True, "AB", "C*", 0, False, False) == 1
    assert call(True, "A*", "C", 0, True, True) == 0
    assert call(True, "AB", "C*", 1, True, True) == 0
    assert call(False, "", "", 0, True, True) == 2
    assert call(False, "", "", 0, False, True) == 3
    assert call(False, "", "", 0, False, False) == 0


def test_junction_contigs_cross_chunks(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(400))
    chunks = spark.createDataFrame([("1", i, seq[i * 64:(i + 1) * 64]) for i in range(7)], "name string, chunk long, seq string")
    tx = spark.createDataFrame([("1", 95, 101, "+"), ("1", 295, 305, "-"), ("1", 30, 31, "-")], "chrom string, st long, en long, strand string")
    rows = spark.createDataFrame([(1, "1", 100, "1", 200), (2, "1", 300, "1", 201), (3, "1", 100, "1", 300), (4, "1", 150, "1", 250), (5, "1", 30, "1", 350)], "ord long, chra string, posa long, chrb string, posb long")
    got = {r.ord: r for r in R.junction_contigs(rows, chunks, tx, 64).collect()}
    turn = str.maketrans("ACGT", "TGCA")
    assert got[1].contig == seq[40:100] + seq[199:259] and (got[1].posa, got[1].posb, got[1].strand) == (100, 200, "+")
    assert got[2].contig == (seq[240:300] + seq[200:260])[::-1].translate(turn) and (got[2].posa, got[2].posb) == (201, 300)
    assert got[3].contig == got[4].contig == "error" and "multiple" in got[3].sv_ort and "no strand" in got[4].sv_ort
    assert got[5].contig == (seq[:30] + seq[349:409])[::-1].translate(turn)
    given = R.junction_contigs(rows.where("ord = 4").withColumn("strand", F.lit("+")), chunks, tx, 64).collect()[0]
    assert given.contig == seq[90:150] + seq[249:309]


def test_collapse_equals_brute_force(spark):
    rng = random.Random(8)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 90))) for _ in range(60)]
    rows = [(rng.choice("xy"), i, s) for i, s in enumerate(base)]
    for _ in range(440):
        g, _, s = rng.choice(rows[:60])
        s = s[rng.randint(0, 9):len(s) - rng.randint(0, 9)]
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice([rng.choice(letters), "", rng.choice(letters) * 2]) + s[at + 1:]
        rows.append((g, len(rows), s))
    rows += [("x", 900, "AC"), ("x", 901, "ACDC"), ("x", 902, ""), ("x", 903, None), ("y", 904, "AC"), ("x", 905, base[0]), ("x", 906, base[0])]
    got = {(r.grp, r.id): (r.edits, r.into) for r in R.collapse_proteins(spark.createDataFrame(rows, "grp string, id long, seq string")).collect()}
    want = {}
    for g, i, s in rows:
        if s is None:
            continue
        most = int(len(s) * 0.05)
        found = [(e, j) for h, j, t in rows if h == g and j != i and t is not None and (len(t), j) > (len(s), i) and (e := R.edits_within(s, t, most)) <= most]
        if found:
            want[g, i] = min(found)
    assert got == want and len(want) > 100


def test_edits_within():
    assert [R.edits_within(*x) for x in [("abc", "xxabcxx", 1), ("abc", "xxabxx", 1), ("abc", "zzz", 1), ("", "a", 0), ("abcd", "xabdx", 2)]] == [0, 1, 2, 0, 1]


RECORD = '''LOCUS       NM_000001               60 bp    mRNA    linear   PRI 01-JAN-2020
DEFINITION  Homo sapiens thing one (THG1), transcript
            variant C, mRNA.
ACCESSION   NM_000001 XX_1
VERSION     NM_000001.4
FEATURES             Location/Qualifiers
     source          1..60
                     /map="7q11"
     gene            1..60
                     /gene="THG1"
                     /gene_synonym="OLD"
     CDS             join(4..9,
                     complement(13..21),30)
                     /gene="THG1"
                     /db_xref="GeneID:5"
                     /db_xref="GI:777"
                     /translation="MAK
                     LV"
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 ttttttttta
//
LOCUS       NR_000002               9 bp
DEFINITION  Other.
ACCESSION   NR_000002
VERSION     NR_000002.1
FEATURES             Location/Qualifiers
     gene            1..9
                     /gene="NC"
ORIGIN
        1 ggg
//
LOCUS       XM_000003               9 bp
DEFINITION  Predicted.
ACCESSION   XM_000003
VERSION     XM_000003.1
//
'''


def test_annotation_records(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD)
    records = A.read_records(spark, str(tmp_path / "a.gb"))
    assert records.count() == 3
    got = {r.accession: r for r in A.protein_table(records).collect()}
    assert sorted(got) == ["NM_000001", "NR_000002"]
    a = got["NM_000001"]
    assert (a.version, a.gi, a.gene, a.protein, a.variant, a.variant_numeric, a.accession_versioned, a.cds_count) == (4, "777", "THG1", "MAKLV", "C", 3, "NM_000001.4", 1)
    assert (got["NR_000002"].protein, got["NR_000002"].variant_numeric, got["NR_000002"].cds_count) == ("", 9999, 0)
    seqs = {r.accession: r for r in A.transcript_sequences(records).collect()}
    assert seqs["NM_000001.4"].title == "NM_000001.4 Homo sapiens thing one (THG1), transcript variant C, mRNA /gene=THG1 /map=7q11"
    assert seqs["NM_000001.4"].seq == "ACGTACGTACGTACGTACGTTTTTTTTTTA" and seqs["NR_000002.1"].title == "NR_000002.1 Other /gene=NC"
    assert {r.accession: r.seq for r in A.transcript_sequences(records, cds_only=True).collect()} == {"NM_000001.4": "TACGTACGTACGTACGTTTTTTTTTTA", "NR_000002.1": ""}


def test_locations(spark):
    def at(text):
        r = one(spark, A.location(F.col("t")), t=text)
        return r.st, r.en, r.complement, [tuple(p) for p in r.parts]
    assert at("12..40") == (12, 40, False, [(12, 40)])
    assert at("complement(join(<3..5,\n     8,10..>12))\n     /gene=\"X9..10\"") == (3, 12, True, [(3, 5), (8, 8), (10, 12)])
