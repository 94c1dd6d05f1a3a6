"""Gene models: features at positions, lengths, intervals, bases and reading frames.

Transcripts have gene, tx (id), chrom, strand, st, en, cds_st, cds_en and exons, an array of (st, en).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join, listed_join, place_join
from .graph import components, written
from .sweep import counts_at, nearest_edges, running_max

#: The standard genetic code, codons in order of TCAG.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
SCORES = {"coding": 1.0, "5utr": 0.8, "3utr": 0.8, "intron": 0.5, "intergenic": 0.1}


def exon_length(exons: Column) -> Column:
    """Bases of all exons, both ends counted."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda acc, e: acc + e["en"] - e["st"] + 1)


def cds_length(exons: Column, st: Column, en: Column) -> Column:
    """Bases of the exons within the coding range."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda acc, e: acc + F.greatest(F.lit(0), F.least(e["en"], en) - F.greatest(e["st"], st) + 1))


def feature_at(pos: Column, strand: Column, st: Column, en: Column, cds_st: Column, cds_en: Column, exons: Column) -> Column:
    """intergenic, 5utr, 3utr, coding or intron; exon bounds are open."""
    exonic = F.exists(exons, lambda e: (pos > e["st"]) & (pos < e["en"]))
    forward = strand == "+"
    return (F.when((pos < st) | (pos > en), "intergenic").when(~exonic, "intron")
            .when(pos <= cds_st, F.when(forward, "5utr").otherwise("3utr")).when(pos > cds_en, F.when(forward, "3utr").otherwise("5utr")).otherwise("coding"))


def numbered_feature(pos: Column, strand: Column, st: Column, en: Column, cds_st: Column, cds_en: Column, exons: Column, synthesize: Column | bool = False) -> Column:
    """(feature, number) with closed bounds; exons and introns are numbered from 1 along the strand, 0 outside the transcript.

    Where `synthesize` holds, the whole of a transcript without a coding range counts as coding.
    """
    ordered = F.array_sort(exons)
    none = (F.lit(synthesize) if isinstance(synthesize, bool) else synthesize) & (cds_st >= cds_en)
    first, last = F.when(none, st).otherwise(cds_st), F.when(none, en).otherwise(cds_en)
    at = F.size(F.filter(ordered, lambda e: e["st"] <= pos))
    exonic, forward = F.exists(ordered, lambda e: (e["st"] <= pos) & (pos <= e["en"])), strand == "+"
    outside = (pos < st) | (pos > en)
    utr = F.when((pos < first) == forward, "5utr").otherwise("3utr")
    feature = F.when(outside, "intergenic").when(~exonic, "intron").when((pos >= first) & (pos <= last), "coding").otherwise(utr)
    number = F.when(outside, 0).when(forward, at).when(exonic, F.size(exons) + 1 - at).otherwise(F.size(exons) - at)
    return F.struct(feature.alias("feature"), number.alias("number"))


def feature_annot(points: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, text): `feature=tx,tx;feature=tx` of the transcripts at each point, `intergenic=no_transcripts_found` without any; a place is looked up once."""
    place = ["chrom", "st", "en"]
    hits = interval_join(points.select(*place).distinct(), transcripts)
    what = numbered_feature(F.col("st"), F.col("r_strand"), F.col("r_st"), F.col("r_en"), F.col("r_cds_st"), F.col("r_cds_en"), F.col("r_exons"))["feature"]
    lists = hits.groupBy(*place, what.alias("f")).agg(F.array_join(F.array_sort(F.collect_set(F.col("r_tx").cast("string"))), ",").alias("l"))
    texts = lists.groupBy(*place).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "f", "l"))), ";").alias("text"))
    return points.select(key, *place).join(texts, place, "left").select(key, F.coalesce("text", F.lit("intergenic=no_transcripts_found")).alias("text"))


def with_coding_parts(transcripts: DataFrame) -> DataFrame:
    """Add `parts`: (st, en, upto) of the exons from the first coding base on, in the direction of the strand, `upto` the bases of those before."""
    forward = F.col("strand") == "+"
    parts = F.transform(F.array_sort("exons"), lambda e: F.struct(F.when(forward, F.greatest(e["st"], F.col("cds_st"))).otherwise(e["st"]).alias("st"),
                                                                  F.when(forward, e["en"]).otherwise(F.least(e["en"], F.col("cds_en"))).alias("en")))
    parts = F.filter(parts, lambda e: e["st"] <= e["en"])
    rows = transcripts.withColumn("_parts", F.when(forward, parts).otherwise(F.reverse(parts)))
    return rows.withColumn("parts", F.transform("_parts", lambda e, i: F.struct(e["st"].alias("st"), e["en"].alias("en"), exon_length(F.slice("_parts", 1, i)).alias("upto")))).drop("_parts")


def nearest_cds(hits: DataFrame, key: str) -> DataFrame:
    """(key, tx, coding_base, last_base): the coding base nearest to a point in its transcript, the lower position on ties, and the last one.

    Hits are rows of key, pos and a transcript (tx, strand, cds_st, cds_en, exons that do not overlap), or of its `parts` (`with_coding_parts`), which are then
    made once for a transcript. Coding bases count from 1 as in `codon_map`, by arithmetic on the parts, so that a hit stays one row.
    """
    hits = hits if "parts" in hits.columns else with_coding_parts(hits)
    forward, pos = F.col("strand") == "+", F.col("pos")

    def near(e):
        at = F.least(F.greatest(pos, e["st"]), e["en"])
        return F.struct(F.abs(at - pos).alias("far"), at.alias("at"), (e["upto"] + 1 + F.when(forward, at - e["st"]).otherwise(e["en"] - at)).alias("base"))

    last = F.element_at("parts", -1)
    return hits.where(F.size("parts") > 0).select(key, "tx", F.array_min(F.transform("parts", near))["base"].alias("coding_base"),
                                                  (last["upto"] + last["en"] - last["st"] + 1).alias("last_base"))


def feature_score(feature: Column) -> Column:
    return F.coalesce(*[F.when(feature == k, v) for k, v in SCORES.items()])


def gene_features(points: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, gene, feature): the best feature of each gene's transcripts at the points inside them; `key` is unique, a place is looked up once."""
    place = ["chrom", "st", "en"]
    hits = interval_join(points.select(*place).distinct(), transcripts)
    feature = feature_at(F.col("st"), F.col("r_strand"), F.col("r_st"), F.col("r_en"), F.col("r_cds_st"), F.col("r_cds_en"), F.col("r_exons"))
    best = hits.select(*place, F.col("r_gene").alias("gene"), feature.alias("feature")).groupBy(*place, "gene").agg(
        F.max_by("feature", F.struct(feature_score(F.col("feature")), "feature")).alias("feature"))
    return points.select(key, *place).join(best, place).select(key, "gene", "feature")


def annotate_site(points: DataFrame, genes: DataFrame, key: str, windows=(10, 5000, 10_000, 40_000)) -> DataFrame:
    """(key, gene, feature, score) of each point (pos, qs, ort): the nearest gene by priority, else NA.

    Coding comes before utr, intron and intergenic; among equals the same strand, then the first gene. Of
    genes beside the point the one with the nearest edge counts, under 40 kb. The feature is taken 10 bases inside, and the
    score is negative on the other strand. `key` is unique.

    The place looked at lies within the narrowest window of the point, so all features but intergenic come from genes in that window; points
    without one get the nearest edge of each strand and side by a sweep, whatever the number of genes around.
    """
    inside, most = min(windows), max(windows)
    strand = F.when(F.col("qs") > 0, "+").otherwise("-")
    back = F.when(F.col("ort") > 0, "+").otherwise("-") == strand
    # points alike in all that counts are looked up once, under a key of their own
    place, asked = ["chrom", "pos", "own", "back"], key
    points = points.select(asked, "chrom", "pos", strand.alias("own"), back.alias("back"))
    key = "_place"
    at = points.select(*place).distinct().withColumns({key: F.struct(*place), "st": F.col("pos"), "en": F.col("pos")})
    check = F.when(F.col("back"), F.col("st") - inside).otherwise(F.col("st") + inside)
    hits = interval_join(at, genes, width=10_000, pad=inside)
    feature = feature_at(check, F.col("r_strand"), F.col("r_st"), F.col("r_en"), F.col("r_cds_st"), F.col("r_cds_en"), F.col("r_exons"))
    sign = F.when(F.col("r_strand") == F.col("own"), 1).otherwise(-1)
    rows = hits.select(key, F.col("r_gene").alias("gene"), feature.alias("feature"), sign.alias("sign"), F.col("r_tx").alias("tx")).where("feature <> 'intergenic'")
    score = feature_score(F.col("feature"))
    best = F.min_by(F.struct("gene", "feature", (score * F.col("sign")).alias("score")), F.struct(-score, -F.col("sign"), "tx"))
    found = written(rows.groupBy(key).agg(best.alias("b")), "sites")
    left = written(at.join(found, key, "left_anti").select(key, "chrom", "pos", "own"), "points")  # the sweep reads them more than once
    what = F.struct(F.col("tx").alias("tx"), F.col("gene").alias("gene"))
    edges = genes.select("chrom", "strand", what.alias("what"), F.explode(F.array("st", "en")).alias("edge"))
    near = left.select(key, "pos", "own").join(nearest_edges(left, edges, key), key)

    def candidate(side: str, strand: str) -> Column:
        c = F.col(f"{side}_{strand}")
        far = F.abs(c["edge"] - F.col("pos"))
        return F.when(far < most, F.struct(far.alias("far"), (F.col("own") != strand).cast("int").alias("other"), c["what"]["tx"].alias("tx"), c["what"]["gene"].alias("gene")))

    best = F.array_min(F.array(*[candidate(side, s) for side in ("down", "up") for s in "+-"]))
    beside = near.withColumn("e", best).where("e is not null").select(key, F.struct(
        F.col("e.gene").alias("gene"), F.lit("intergenic").alias("feature"), F.when(F.col("e.other") == 0, SCORES["intergenic"]).otherwise(-SCORES["intergenic"]).alias("score")).alias("b"))
    named = found.unionByName(beside)
    return points.select(asked, F.struct(*place).alias(key)).join(named, key, "left").select(
        asked, F.coalesce("b.gene", F.lit("NA")).alias("gene"), F.coalesce("b.feature", F.lit("intergenic")).alias("feature"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def gene_lengths(transcripts: DataFrame) -> DataFrame:
    """(gene, mrna_length, cds_length): the longest transcript and the longest coding sequence."""
    return transcripts.groupBy("gene").agg(F.max(exon_length(F.col("exons"))).alias("mrna_length"),
                                           F.max(cds_length(F.col("exons"), F.col("cds_st"), F.col("cds_en"))).alias("cds_length"))


def gene_interval(transcripts: DataFrame, buffer: int = 0, upstream: int = 0) -> DataFrame:
    """(gene, chrom, strand, st, en) over a gene's transcripts, widened by `buffer`, and by `upstream` more before its start by strand."""
    st = F.min("st") - buffer - F.when(F.col("strand") == "+", upstream).otherwise(0)
    en = F.max("en") + buffer + F.when(F.col("strand") == "-", upstream).otherwise(0)
    return transcripts.groupBy("gene", "chrom", "strand").agg(F.greatest(F.lit(1), st).alias("st"), en.alias("en"))


def exon_rows(transcripts: DataFrame) -> DataFrame:
    """(tx, chrom, strand, number, st, en): exons numbered from 1 in the direction of the strand."""
    rows = transcripts.select("tx", "chrom", "strand", F.size("exons").alias("n"), F.posexplode(F.array_sort("exons")).alias("i", "e"))
    number = F.when(F.col("strand") == "+", F.col("i") + 1).otherwise(F.col("n") - F.col("i"))
    return rows.select("tx", "chrom", "strand", number.alias("number"), "e.st", "e.en")


def intron_rows(transcripts: DataFrame) -> DataFrame:
    """(tx, chrom, strand, number, st, en): the gaps between exons, numbered like the exon before them."""
    by = Window.partitionBy("tx").orderBy("st")
    nxt = exon_rows(transcripts).withColumns({"next_st": F.lead("st").over(by), "next_no": F.lead("number").over(by)})
    gaps = nxt.where(F.col("next_st") > F.col("en") + 1)
    return gaps.select("tx", "chrom", "strand", F.least("number", "next_no").alias("number"), (F.col("en") + 1).alias("st"), (F.col("next_st") - 1).alias("en"))


def base_features(transcripts: DataFrame) -> DataFrame:
    """(tx, pos, feature, number): every base with exon or intron number and coding, 5utr, 3utr or intron."""
    cds = transcripts.select("tx", "cds_st", "cds_en")
    exons = exon_rows(transcripts).join(cds, "tx").select("tx", "strand", "number", "cds_st", "cds_en", F.explode(F.sequence("st", "en")).alias("pos"))
    forward = F.col("strand") == "+"
    utr = F.when(F.col("pos") < F.col("cds_st"), F.when(forward, "5utr").otherwise("3utr")).when(
        F.col("pos") > F.col("cds_en"), F.when(forward, "3utr").otherwise("5utr")).otherwise("coding")
    introns = intron_rows(transcripts).select("tx", F.explode(F.sequence("st", "en")).alias("pos"), F.lit("intron").alias("feature"), "number")
    return exons.select("tx", "pos", utr.alias("feature"), "number").unionByName(introns)


def feature_summary(transcripts: DataFrame) -> DataFrame:
    """(tx, feature, number, st, en): the first and last base of each numbered feature."""
    return base_features(transcripts).groupBy("tx", "feature", "number").agg(F.min("pos").alias("st"), F.max("pos").alias("en"))


def codon_map(transcripts: DataFrame) -> DataFrame:
    """(tx, pos, exon, coding_base, codon, codon_base) of every exonic base, in the direction of the strand.

    coding_base counts from 1 at the start of the coding sequence, and from -1 back before it; codon and codon_base (1 to 3) follow from
    it, codons before the start being negative. Bases after the coding sequence go on counting.
    """
    cds = transcripts.select("tx", "cds_st", "cds_en")
    bases = exon_rows(transcripts).join(cds, "tx").select("tx", "strand", F.col("number").alias("exon"), "cds_st", "cds_en", F.explode(F.sequence("st", "en")).alias("pos"))
    along = F.when(F.col("strand") == "+", F.col("pos")).otherwise(-F.col("pos"))
    start = F.when(F.col("strand") == "+", F.col("cds_st")).otherwise(-F.col("cds_en"))
    by = Window.partitionBy("tx").orderBy("along")
    rows = bases.withColumns({"along": along, "before": (along < start).cast("int")}).withColumn("n", F.row_number().over(by))
    rows = rows.withColumn("utr", F.sum("before").over(Window.partitionBy("tx")))
    k = F.col("n") - F.col("utr")
    rows = rows.withColumn("coding_base", F.when(k > 0, k).otherwise(k - 1).cast("long"))
    codon = F.when(k > 0, F.floor((k - 1) / 3) + 1).otherwise(F.floor((k - 1) / 3))
    return rows.select("tx", "pos", "exon", "coding_base", codon.cast("long").alias("codon"), (F.pmod(k - 1, F.lit(3)) + 1).cast("long").alias("codon_base"))


def transcripts_at(points: DataFrame, transcripts: DataFrame, key: str, coding: bool = True, strand: bool = False) -> DataFrame:
    """(key, tx, gene) of the transcripts over each point, with `coding` only those with a coding range."""
    used = transcripts.where("cds_st < cds_en") if coding else transcripts
    place = ["chrom", "st", "en"] + (["strand"] if strand else [])
    hits = interval_join(points.select(*place).distinct(), used.drop("exons"), width=500, strand=strand, dealt=True)
    return listed_join(points.select(key, *place), hits.select(*place, F.col("r_tx").alias("tx"), F.col("r_gene").alias("gene")), place).select(key, "tx", "gene")


def seek_base(hits: DataFrame, key: str, downstream: bool, most: int = 1000) -> DataFrame:
    """(key, tx, pos, distance): the nearest exonic base of the point's transcript, forward or back along the strand, at most `most` away.

    Hits are rows of key, pos and a transcript (tx, strand, exons); each gives one row or none.
    """
    up = (F.col("strand") == "+") == F.lit(downstream)
    at = F.transform("exons", lambda e: F.when(up & (e["en"] >= F.col("pos")), F.greatest(e["st"], F.col("pos"))).when(~up & (e["st"] <= F.col("pos")), F.least(e["en"], F.col("pos"))))
    near = F.array_min(F.transform(F.filter(at, lambda p: p.isNotNull()), lambda p: F.struct(F.abs(p - F.col("pos")).alias("distance"), p.alias("pos"))))
    return hits.select(key, "tx", near.alias("n")).where(F.col("n.distance") <= most).select(key, "tx", "n.pos", F.col("n.distance").cast("long").alias("distance"))


def nearest_exon(hits: DataFrame, key: str) -> DataFrame:
    """(key, tx, exon, exons, distance): the exon nearest to the point in its transcript, the lower start on ties; hits as in `seek_base`."""
    ordered, n, forward = F.array_sort("exons"), F.size("exons"), F.col("strand") == "+"
    away = F.transform(ordered, lambda e, i: F.struct(F.greatest(F.lit(0), e["st"] - F.col("pos"), F.col("pos") - e["en"]).cast("long").alias("distance"), e["st"].alias("st"),
                                                      F.when(forward, i + 1).otherwise(n - i).cast("long").alias("number")))
    return hits.select(key, "tx", F.array_min(away).alias("n"), n.cast("long").alias("exons")).where("exons > 0").select(key, "tx", F.col("n.number").alias("exon"), "exons", "n.distance")


def neighbor_exons(points: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, tx, intron, to_previous, to_next): distances of an intronic point to the exons before and after it along the strand."""
    hits = place_join(points, intron_rows(transcripts))
    left, right = F.col("st") - F.col("r_st") + 1, F.col("r_en") - F.col("st") + 1
    forward = F.col("r_strand") == "+"
    return hits.select(key, F.col("r_tx").alias("tx"), F.col("r_number").cast("long").alias("intron"), F.when(forward, left).otherwise(right).alias("to_previous"),
                       F.when(forward, right).otherwise(left).alias("to_next"))


def symbol_of(rows: DataFrame, transcripts: DataFrame, accession: str) -> DataFrame:
    """Add `symbol`, the gene of the accession if it has exactly one."""
    known = transcripts.groupBy(F.col("tx").alias(accession)).agg(F.collect_set("gene").alias("genes")).where(F.size("genes") == 1)
    return rows.join(known.select(accession, F.col("genes")[0].alias("symbol")), accession, "left")


def genes_between(pairs: DataFrame, genes: DataFrame, margin: int = 10_000, strand: str | None = None) -> DataFrame:
    """(ord, genes): genes with over 300 coding bases that lie wholly between the ends of a pair and inside no other gene of their strand.

    0 if one gene spans both ends, give or take `margin`. Genes have gene, chrom, strand, st, en and cds_length; with `strand` (+ or -)
    only that strand's genes are looked at.
    """
    genes = genes.where(F.col("strand") == strand) if strand else genes
    spans = pairs.where("chra = chrb").select("ord", F.col("chra").alias("chrom"), F.least("posa", "posb").alias("st"), F.greatest("posa", "posb").alias("en"))
    genes = genes.select("gene", "chrom", "strand", "st", "en", "cds_length").where("st <= en")
    spans = spans.where("st <= en")
    # free: inside no other gene of the strand. The farthest end of the genes with lower starts tells, but where that is the gene's own it must be looked up.
    by = ["chrom", "strand"]
    tops = genes.groupBy(*by, "st").agg(F.max(F.struct("en", "gene")).alias("top"))
    low = running_max(tops.where("strand is not null"), by, "st", [], {"reach": F.col("top")}).select(*by, "st", "reach")
    rows = genes.where("cds_length > 300").join(low, [*by, "st"], "left")
    inner = F.coalesce(F.col("reach.en") > F.col("en"), F.lit(False))
    unsure = rows.where(inner & (F.col("reach.gene") == F.col("gene"))).drop("reach")
    outer = genes.select("chrom", "st", "en", F.col("strand").alias("d"), F.col("gene").alias("g"))
    nested = interval_join(unsure, outer).where("strand = r_d and gene <> r_g and r_st < st and r_en > en").select("gene", *by, "st", "en").distinct()
    rest = unsure.join(nested, ["gene", *by, "st", "en"], "left_anti")
    free = written(rows.where(~inner).select("chrom", F.coalesce("strand", F.lit("")).alias("strand"), "gene", "st", "en"), "free")
    # Of free genes of a strand no one lies inside another, so ends rise with starts, and those between are: all that end before the last base, less
    # all that start up to the first. Genes that lie only in one of their own name (`rest`) and those of other strands are counted one by one.
    simple, other = free.where("strand in ('+', '-')"), free.where("strand not in ('+', '-')")
    ends = spans.select("ord", "chrom", "st", "en")
    sums = counts_at(ends.select("chrom", F.explode(F.array("st", "en")).alias("at")), simple, {f"n_{d}": (F.col("strand") == d).cast("int") for d in "+-"})
    first = sums.select("chrom", F.col("at").alias("st"), *[F.col(f"started_n_{d}").alias(f"s{d}") for d in "+-"])
    last = sums.select("chrom", F.col("at").alias("en"), *[F.col(f"ended_n_{d}").alias(f"e{d}") for d in "+-"])
    wide = genes.select("chrom", "st", "en")
    # a gene that starts up to the first base and margin, and ends at the last less margin or later, and meets the span
    asked = ends.withColumns({"upto": F.least(F.col("en"), F.col("st") + margin), "least": F.greatest(F.col("st"), F.col("en") - margin)})
    marks = wide.select("chrom", F.col("st").alias("at"), F.lit(0).alias("late"), F.col("en").alias("reach")).unionByName(
        asked.select("chrom", F.col("upto").alias("at"), F.lit(1).alias("late"), F.lit(None).cast("long").alias("reach")).distinct())
    far = running_max(marks, ["chrom"], "at", ["late"], {"far": F.col("reach")}).where("late = 1").select("chrom", F.col("at").alias("upto"), "far").distinct()
    counted = asked.join(first, ["chrom", "st"], "left").join(last, ["chrom", "en"], "left").join(far, ["chrom", "upto"], "left")
    between = sum(F.greatest(F.lit(0), F.coalesce(F.col(f"`e{d}`"), F.lit(0)) - F.coalesce(F.col(f"`s{d}`"), F.lit(0))) for d in "+-")
    more = interval_join(ends, rest.select("chrom", "st", "en").unionByName(other.select("chrom", "st", "en"))).where("r_st > st and r_en < en").groupBy("ord").agg(F.count("*").alias("more"))
    counts = counted.join(more, "ord", "left").select("ord", F.when(F.coalesce(F.col("far") >= F.col("least"), F.lit(False)), 0).otherwise(between + F.coalesce("more", F.lit(0))).cast("long").alias("genes"))
    return pairs.where("chra = chrb").select("ord").join(counts, "ord", "left").select("ord", F.coalesce("genes", F.lit(0)).cast("long").alias("genes"))


def translate(seq: Column) -> Column:
    """Amino acids of the whole codons of a sequence; X for a codon with other letters."""
    digits = F.translate(seq, "TCAG", "0123")

    def amino(i: Column) -> Column:
        codon = F.substring(digits, i, F.lit(3))
        at = codon.substr(1, 1).cast("int") * 16 + codon.substr(2, 1).cast("int") * 4 + codon.substr(3, 1).cast("int")
        return F.when(codon.rlike("^[0-3]{3}$"), F.substring(F.lit(AMINO), at + 1, F.lit(1))).otherwise("X")

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq) - 2, F.lit(1)), F.lit(3)), lambda i: i + 2 <= F.length(seq))
    return F.array_join(F.transform(starts, amino), "")


def three_frames(seq: Column) -> list[Column]:
    return [translate(F.substring(seq, k + 1, 1 << 30)).alias(f"frame{k}") for k in range(3)]


def unique_anchor(text: Column, whole: Column, least: int) -> Column:
    """The place (from 1) of the shortest start of `whole`, of at least `least` letters, that `text` holds once; 0 if none is."""
    lengths = F.sequence(F.lit(least), F.greatest(F.length(whole), F.lit(least)))

    def once(n: Column) -> Column:
        part = F.substring(whole, F.lit(1), n)
        at = F.position(part, text)
        return F.when((F.length(whole) >= n) & (at > 0) & (F.position(part, text, at + 1) == 0), at)

    return F.coalesce(F.get(F.filter(F.transform(lengths, once), lambda v: v.isNotNull()), F.lit(0)), F.lit(0))


def coding_frame(upstream: Column, downstream: Column, least: int = 10) -> Column:
    """Whether an M and at least `least` further letters before a stop end in the downstream part (or right before it)."""
    frame = F.concat(upstream, downstream)
    found = F.regexp_extract_all(frame, F.lit("(M[^*]{%d,})" % least), F.lit(1))
    ends = F.transform(found, lambda m: F.position(m, frame) + F.length(m) - 1)
    return F.exists(ends, lambda e: e >= F.length(upstream))


def prune_pairs(rows: DataFrame, key: str, frame: str) -> DataFrame:
    """Rows with a frame over 0, and the others of keys that have no such row."""
    best = F.max(F.col(frame)).over(Window.partitionBy(key))
    return rows.withColumn("_best", best).where((F.col(frame) > 0) | (F.col("_best") <= 0)).drop("_best")


def frame_summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, in_frame, frames, genes): whether any row is in frame, the frames in order, and the one gene in frame if it is one."""
    framed = F.col("frame") > 0
    names = F.collect_set(F.when(framed, F.col("gene")))
    return rows.groupBy(key).agg(F.max(framed.cast("int")).cast("long").alias("in_frame"),
                                 F.array_join(F.array_sort(F.collect_set(F.col("frame").cast("string"))), ",").alias("frames"),
                                 F.when(F.size(names) == 1, names[0]).alias("gene"))


def mask_frame(frame: Column, length: Column) -> Column:
    """The frame with its first `length` letters as X."""
    n = F.least(length, F.length(frame))
    return F.concat(F.repeat(F.lit("X"), n), F.substring(frame, n + 1, F.length(frame)))


def build_genes(transcripts: DataFrame) -> DataFrame:
    """(gene_no, chrom, strand, st, en, names, transcripts): genes as transcripts of one strand that exon overlaps connect.

    gene_no is the least tx. Bounds are closed; a transcript whose exons miss another's, though it lies within it, is a gene of its own.
    A sweep links each exon that starts before the farthest end so far only to the transcript with that end, which connects the same transcripts as
    all overlapping pairs would. tx is unique; rows without exons are genes of one transcript.
    """
    exons = transcripts.select("chrom", "strand", "tx", F.explode("exons").alias("e")).select("chrom", "strand", "tx", "e.st", "e.en")
    swept = running_max(exons, ["chrom", "strand"], "st", ["en", "tx"], {"reach": F.struct("en", "tx")})
    edges = swept.where((F.col("st") <= F.col("reach.en")) & (F.col("tx") != F.col("reach.tx"))).select(F.col("tx").alias("a"), F.col("reach.tx").alias("b")).distinct()
    roots = components(edges).withColumnRenamed("node", "tx")
    rows = transcripts.join(roots, "tx", "left").withColumn("gene_no", F.coalesce("root", "tx"))
    return rows.groupBy("gene_no", "chrom", "strand").agg(
        F.min("st").alias("st"), F.max("en").alias("en"), F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("names"), F.count("*").alias("transcripts"))
