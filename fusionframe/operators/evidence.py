"""Support counts, clustering and candidate sites.

Reads have chrom, st, en, clip, side (of the clip), strand and flag. Rows with a null chrom or position join nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fusionframe.functions.columns import canonical_seq, clip_len, cigar_ops, flag_is, pair_key, ref_span, split_names

from .graph import written
from .intervals import overlap_nodes
from .sweep import BLOCK, counts_at, runs_by_gap

DUPLICATE, UNMAPPED = 1024, 4
#: Clips of a site beyond which its bases are counted before they meet.
DEEP = 1 << 17


def eligible_clips(reads: DataFrame, paired: bool = True) -> DataFrame:
    """Reads with a soft clip, a start, no duplicate flag and, if paired, a mate position."""
    ok = F.col("cigar").contains("S") & ~flag_is(F.col("flag"), DUPLICATE) & F.col("st").isNotNull()
    return reads.where(ok & F.coalesce(F.col("mate_st") > 0, F.lit(False)) if paired else ok)


def explode_clips(reads: DataFrame, min_len: int = 10) -> DataFrame:
    """One row (qname, chrom, side, pos, clip, strand) for each clipped end of at least `min_len` bases.

    A clip next to at most 5 matched bases and a gap is also put past the gap, with those bases in the clip.
    """
    reads = reads.withColumns({"_ops": cigar_ops(F.col("cigar")), "_en": F.col("st") + ref_span(F.col("cigar")) - 1,
                               "_left": clip_len(F.col("cigar"), "-"), "_right": clip_len(F.col("cigar"), "+")})  # each is parsed once
    ops, n, en, left, right = F.col("_ops"), F.size("_ops"), F.col("_en"), F.col("_left"), F.col("_right")

    def at(i: Column) -> Column:
        return F.get(ops, i)

    def short(length, m, gap):
        return (n >= 4) & (length >= min_len - 3) & (m["op"] == "M") & (m["len"] <= 5) & (gap["op"] == "N")

    l1, l2, r1, r2 = at(F.lit(1)), at(F.lit(2)), at(n - 2), at(n - 3)
    sites = F.array(
        F.when(left > 0, F.struct(F.lit("-").alias("side"), F.col("st").alias("pos"), left.alias("clip"))),
        F.when((left > 0) & short(left, l1, l2), F.struct(F.lit("-").alias("side"), (F.col("st") + l1["len"] + l2["len"]).alias("pos"), (left + l1["len"]).alias("clip"))),
        F.when(right > 0, F.struct(F.lit("+").alias("side"), en.alias("pos"), right.alias("clip"))),
        F.when((right > 0) & short(right, r1, r2), F.struct(F.lit("+").alias("side"), (en - r1["len"] - r2["len"]).alias("pos"), (right + r1["len"]).alias("clip"))))
    return reads.select("qname", "chrom", "strand", F.explode(sites).alias("s")).where("s is not null").select(
        "qname", "chrom", "s.side", "s.pos", "s.clip", "strand").where(F.col("clip") >= min_len)


def clip_evidence(reads: DataFrame, long_clip: int = 20) -> DataFrame:
    """Reads, clipped bases and strands of each (chrom, pos, side), without duplicates; a clip on side + is at the read's end."""
    ok = reads.where(~flag_is(F.col("flag"), DUPLICATE))
    pos = F.when(F.col("side") == "+", F.col("en")).otherwise(F.col("st"))
    return ok.groupBy("chrom", pos.alias("pos"), "side").agg(
        F.count("*").alias("reads"), F.sum("clip").alias("bases"),
        F.count_if(F.col("strand") == "+").alias("plus_clip"), F.count_if(F.col("strand") == "-").alias("minus_clip"),
        F.coalesce(F.sum(F.when(F.col("clip") >= long_clip, F.col("clip"))), F.lit(0)).cast("long").alias("long_bases"))


def cluster_positions(sites: DataFrame, spread: int = 5, min_reads: int = 2, min_long: int = 20) -> DataFrame:
    """Greedy clusters from left to right on each side: (chrom, side, pos, reads, bases, plus_clip, minus_clip).

    A position within `spread` of a kept cluster is passed over. Else, if the clipped bases from it to `spread` on
    reach `min_reads`, the position of most clipped bases there (the first of equal ones) is the centre, which is kept if
    the sites within `spread` on both sides have `min_reads` reads and `min_long` bases of long clips.
    Sums look `2 * spread` far at most, so they are taken within blocks of positions that overlap by that much. Choices do not reach over
    gaps of more than `2 * spread`, so runs between such gaps are folded alone.
    """
    block, halo = F.floor(F.col("pos") / BLOCK), 2 * spread
    near = F.sequence(F.floor((F.col("pos") - halo) / BLOCK), F.floor((F.col("pos") + halo) / BLOCK))
    sites = sites.withColumn("_near", F.explode(near))
    by = Window.partitionBy("chrom", "side", "_near").orderBy("pos")
    ahead, around = by.rangeBetween(0, spread), by.rangeBetween(-spread, spread)
    sums = ("reads", "bases", "plus_clip", "minus_clip", "long_bases")
    s = (sites.withColumns({f"t_{c}": F.sum(c).over(around) for c in sums}).withColumn("cover", F.sum("bases").over(ahead))
         .withColumn("centre", -F.max(F.struct("bases", (-F.col("pos")).alias("back"))).over(ahead)["back"]))
    total = F.struct(*[F.col(f"t_{c}").alias(c) for c in sums])
    s = s.withColumn("totals", F.max_by(total, F.struct("bases", -F.col("pos"))).over(ahead)).where(F.col("_near") == block)
    s = written(s.select("chrom", "side", "pos", "centre", "cover", "totals"), "positions")  # the sweep reads them more than once
    s = runs_by_gap(s, ["chrom", "side"], "pos", 2 * spread + 1, "block")
    s = s.where(F.col("cover") >= min_reads).where((F.col("totals.reads") >= min_reads) & (F.col("totals.long_bases") >= min_long))
    folded = s.groupBy("chrom", "side", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "centre", "totals"))).alias("rows"))
    step = F.aggregate(
        "rows", F.struct(F.lit(None).cast("long").alias("last"), F.slice("rows", 1, 0).alias("kept")),
        lambda acc, x: F.when(x["pos"] <= acc["last"] + spread, acc).otherwise(
            F.struct(x["centre"].alias("last"), F.array_append(acc["kept"], x).alias("kept"))))
    return folded.select("chrom", "side", F.explode(step["kept"]).alias("r")).select(
        "chrom", "side", F.col("r.centre").alias("pos"), *[F.col(f"r.totals.{c}").alias(c) for c in sums[:4]])


def depth_at(reads: DataFrame, sites: DataFrame, max_span: int | None = None) -> DataFrame:
    """(chrom, pos, depth, plus_depth, minus_depth) of each site (chrom, pos): mapped reads over it, 0 where none; `max_span` leaves out longer ones."""
    used = reads.where(~flag_is(F.col("flag"), UNMAPPED))
    if max_span:
        used = used.where(F.col("en") - F.col("st") + 1 <= max_span)
    sites = sites.select("chrom", "pos").distinct()
    kinds = {"depth": F.lit(1), "plus_depth": (F.col("strand") == "+").cast("int"), "minus_depth": (F.col("strand") == "-").cast("int")}
    sums = counts_at(sites.select("chrom", F.col("pos").alias("at")), used, {k: F.coalesce(w, F.lit(0)) for k, w in kinds.items()})
    over = sums.select("chrom", F.col("at").alias("pos"), *[(F.col(f"started_{k}") - F.col(f"ended_{k}")).alias(k) for k in kinds])
    return sites.join(over, ["chrom", "pos"], "left").na.fill(0, list(kinds))


def gene_cutoff(counts: DataFrame, read_length: int) -> DataFrame:
    """Add `cutoff` (support to ask of a gene) and `per_kb` to rows of (n_reads, mrna_length)."""
    return counts.withColumn("cutoff", (F.lit(read_length - 20) * F.col("n_reads")) / (100 * F.col("mrna_length"))) \
        .withColumn("per_kb", 1000 * F.col("n_reads") / F.col("mrna_length"))


def min_support(sites: DataFrame, least: int, known: DataFrame) -> DataFrame:
    """Sites with `least` reads, and those at a known position (chrom, pos)."""
    marked = sites.join(known.select("chrom", "pos", F.lit(True).alias("_known")).distinct(), ["chrom", "pos"], "left")
    return marked.where((F.col("reads") >= least) | F.col("_known")).drop("_known")


def expressed_sites(sites: DataFrame, genes: DataFrame, read_length: int, excluded: DataFrame, min_ratio: float = 0.01) -> DataFrame:
    """Candidate sites: (chrom, pos, side, reads, cutoff, bases, expression_ratio).

    Genes (gene_id, name, chrom, st, en, mrna_length, n_reads, cutoff) with reads are tried in order of gene_id. A gene with
    a cutoff under 0.01 or an excluded name ends the search; else the first whose expression ratio is over `min_ratio`, or any if a
    strand's clipped share is over 0.05, takes the site. Sites in no such gene stay with 5 reads, cutoff -1 and ratio 0.
    Sites have chrom, pos, side, reads, bases, plus_clip, minus_clip, plus_depth and minus_depth.
    """
    named = genes.where("n_reads > 0").select("gene_id", F.explode(split_names(F.col("name"))).alias(excluded.columns[0]))
    bad = named.join(excluded.distinct(), excluded.columns[0], "left_semi").select("gene_id").distinct().withColumn("bad", F.lit(True))
    used = genes.where("n_reads > 0").join(bad, "gene_id", "left").select("gene_id", "chrom", "st", "en", "mrna_length", "n_reads", "cutoff", F.coalesce("bad", F.lit(False)).alias("bad"))
    used, sites = written(used, "genes"), written(sites, "sites")  # both are read more than once
    share = F.greatest(F.col("plus_clip") / (F.col("plus_depth") + 0.01), F.col("minus_clip") / (F.col("minus_depth") + 0.01))
    points = sites.select("chrom", F.col("pos").alias("st"), F.col("pos").alias("en"), "side", "reads", "bases", share.alias("share"))
    divisor = F.col("r_n_reads") * read_length / (2 * F.col("r_mrna_length"))
    ratio = (F.col("bases") / (read_length - 20)) / divisor
    ends = F.col("r_bad") | (F.col("r_cutoff") < 0.01)
    # Of the genes of one node, one that does not end the search can only take a site if no earlier one has as low a divisor, and none after one that ends it.
    def fronts(rows: DataFrame, keys: list[str]) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy("r_gene_id").rowsBetween(Window.unboundedPreceding, -1)
        kept = rows.withColumns({"_least": F.min(divisor).over(over), "_ended": F.max(ends).over(over)})
        return kept.where(~F.coalesce("_ended", F.lit(False)) & (F.col("_least").isNull() | ends | (divisor < F.col("_least")))).drop("_least", "_ended")

    met = overlap_nodes(points, used.select("chrom", "st", "en", *[F.col(c).alias(f"r_{c}") for c in ("gene_id", "mrna_length", "n_reads", "cutoff", "bad")]), fronts)
    hits = points.join(met, ["chrom", "st", "en"]).withColumn("ratio", ratio)
    takes = (F.col("ratio") > min_ratio) | (F.col("share") > 0.05)
    first = hits.groupBy("chrom", F.col("st").alias("pos"), "side", "reads", "bases").agg(F.min(F.when(ends | takes, F.col("r_gene_id"))).alias("r_gene_id"))
    taken = first.join(used.select(*[F.col(c).alias(f"r_{c}") for c in ("gene_id", "mrna_length", "n_reads", "cutoff", "bad")]), "r_gene_id").where(~ends)
    inside = taken.select("chrom", "pos", "side", "reads", F.col("r_cutoff").alias("cutoff"), "bases", ratio.alias("expression_ratio"))
    outside = sites.where("reads >= 5").join(first.select("chrom", "pos", "side"), ["chrom", "pos", "side"], "left_anti").select(
        "chrom", "pos", "side", "reads", F.lit(-1.0).alias("cutoff"), "bases", F.lit(0.0).alias("expression_ratio"))
    return inside.unionByName(outside)


def depth_gate(sites: DataFrame) -> DataFrame:
    """Sites with depth whose reads are over a 200th of it (under 2000) or over a 20th."""
    return sites.where((F.col("depth") > 0) & (((F.col("depth") < 2000) & (F.col("reads") > F.col("depth") / 200)) | (F.col("reads") > F.col("depth") / 20)))


def junction_support(maps: DataFrame, points: DataFrame, key: str, cutoff: int = 5, least: int = 25, identity: float = 0.95) -> DataFrame:
    """(key, reads, support): the different reads that map over a point of a contig, and the sum of the lengths by which they reach past it.

    Points have the unique `key`, contig, pos and ort; a mapping row (contig, read, matches, qstart, qend, tstart, tend; starts from 0) counts with
    over `least` matches, more than `identity` of its range and over `cutoff` bases on both sides of the point. It reaches up to
    its end where ort is positive, else down to its start; of the rows of one length two count. Points without a row have zeros.
    """
    used = maps.where((F.col("matches") > least) & (F.try_divide("matches", F.col("qend") - F.col("qstart")) > identity))
    hits = points.select(key, "contig", "pos", "ort").join(used.select("contig", "read", "tstart", "tend"), "contig").where(
        (F.col("tend") > F.col("pos") + cutoff) & (F.col("tstart") < F.col("pos") - cutoff))
    length = F.when(F.col("ort") > 0, F.col("tend") - F.col("pos")).otherwise(F.col("pos") - F.col("tstart"))
    sized = hits.select(key, "read", length.alias("length"))
    support = sized.groupBy(key, "length").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum(F.col("length") * F.least("n", F.lit(2))).cast("long").alias("support"))
    reads = sized.select(key, "read").distinct().groupBy(key).agg(F.count("*").alias("reads"))
    return points.select(key).join(reads, key, "left").join(support, key, "left").na.fill(0, ["reads", "support"])


def partner_recurrence(pairs: DataFrame, least: int, exempt: DataFrame) -> DataFrame:
    """(gene, partners): genes of either end with at least `least` different partners, by the names of both lists, without exempt ones."""
    named = pairs.select(F.explode(split_names(F.col("genea"))).alias("x"), "geneb").select("x", F.explode(split_names(F.col("geneb"))).alias("y"))
    both = named.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    each = both.select(F.col("x").alias("gene")).unionAll(both.select("y"))
    counts = each.groupBy("gene").agg(F.count("*").alias("partners")).where(F.col("partners") >= least)
    return counts.join(exempt.select(F.col(exempt.columns[0]).alias("gene")), "gene", "left_anti")


def contig_recurrence(contigs: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, rows) of contigs, a sequence and its reverse complement being one."""
    return contigs.groupBy(canonical_seq(F.col(seq)).alias(seq)).agg(F.count("*").alias("rows"))


def modal_position(reads: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, pos, n): the most frequent position (the smallest of equal ones) and its rows."""
    counts = reads.groupBy(*keys, pos).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(pos, "n"), F.struct(-F.col("n"), F.col(pos))).alias("m")).select(*keys, "m.*")


def majority_strand(reads: DataFrame, keys: list[str], strand: str) -> DataFrame:
    """(keys, strand): + or - by more rows, = for equal numbers."""
    vote = F.sum(F.when(F.col(strand) == "+", 1).when(F.col(strand) == "-", -1).otherwise(0))
    return reads.groupBy(*keys).agg(F.when(vote > 0, "+").when(vote < 0, "-").otherwise("=").alias(strand))


def clip_ratio(rows: DataFrame, dna: bool) -> Column:
    """Clipped share: of the greater strand for DNA; for RNA against the gene's reads over four lengths."""
    plus, minus = (F.col(f"{s}_clip") / (F.col(f"{s}_depth") + 0.01) for s in ("plus", "minus"))
    return F.greatest(plus, minus) if dna else F.col("reads") * F.col("mrna_length") / (4.0 * F.col("n_reads"))


def uniquify(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get -locA, -locB and so on in order (after Z: -locAA)."""
    by = Window.partitionBy(name)
    n, i = F.count("*").over(by), F.row_number().over(by.orderBy(order)) - 1
    # F.char knows 256 characters only, and a name with 4992 rows passes them
    front = F.decode(F.unhex(F.lpad(F.hex(F.lit(64) + F.floor(i / 26)), 8, "0")), "UTF-32")
    letter = F.concat(F.when(i >= 26, front).otherwise(""), F.char(F.lit(65) + i % 26))
    return rows.select(order, F.when(n > 1, F.concat(F.col(name), F.lit("-loc"), letter)).otherwise(F.col(name)).alias("unique_name"))


def drop_genes(pairs: DataFrame, denied: DataFrame, unless: DataFrame | None = None) -> DataFrame:
    """Pairs none of whose names is denied; with `unless` (genea, geneb), pairs of it stay in any case."""
    name = denied.columns[0]
    named = pairs.select("ord", F.explode(F.concat(split_names(F.col("genea")), split_names(F.col("geneb")))).alias(name))
    bad = named.join(denied.distinct(), name, "left_semi").select("ord").distinct()
    if unless is not None:
        known = unless.select(pair_key(F.col("genea"), F.col("geneb")).alias("pair")).distinct()
        pair = pairs.select("ord", F.explode(split_names(F.col("genea"))).alias("x"), "geneb").select("ord", "x", F.explode(split_names(F.col("geneb"))).alias("y"))
        saved = pair.select("ord", pair_key(F.col("x"), F.col("y")).alias("pair")).join(known, "pair", "left_semi").select("ord")
        bad = bad.join(saved, "ord", "left_anti")
    return pairs.join(bad, "ord", "left_anti")


def drop_chroms(pairs: DataFrame, patterns: list[str], columns: tuple = ("chra", "chrb")) -> DataFrame:
    """Rows with no chrom that matches any pattern, case ignored."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    for c in columns:
        pairs = pairs.where(~F.col(c).rlike(pattern))
    return pairs


def del_reads(reads: DataFrame, pos: Column, length: int) -> DataFrame:
    """Reads over a position whose CIGAR has a gap of `length`."""
    return reads.where((F.col("st") <= pos) & (F.col("en") >= pos) & F.col("cigar").rlike(f"(^|\\D){length}N"))


#: Validators by name; each is a column function of the reads, and all of a set must hold.
VALIDATORS = {
    "quality": lambda: F.length(F.regexp_replace("qual", "[!-4]", "")) * 100 > (F.length("qual") - 1) * 80,
    "strand": lambda: F.when(flag_is(F.col("flag"), 2), F.col("mate_chrom") == F.col("chrom")).otherwise(True),
    "length": lambda: F.col("clip") >= 10,
}


def validated(reads: DataFrame, names: list[str], validators: dict | None = None) -> DataFrame:
    """Reads that pass all named validators; a null result fails."""
    rules = validators or VALIDATORS
    for name in names:
        reads = reads.where(F.coalesce(rules[name](), F.lit(False)))
    return reads


def novel_junctions(junctions: DataFrame, min_gap: int = 10_000) -> DataFrame:
    """Novel junctions of two perfect and five flanking reads, five perfect and clean ones together, and `min_gap` between the ends."""
    ok = (F.col("type") == "novel") & (F.col("perfect") >= 2) & (F.col("flanking") >= 5) & (F.col("perfect") + F.col("clean") >= 5)
    return junctions.where(ok & (F.abs(F.col("posa") - F.col("posb")) >= min_gap))


def clip_reads_at(reads: DataFrame, sites: DataFrame, key: str, shift: int = 3, min_len: int = 20, rescue: bool = True) -> DataFrame:
    """(key, reads, pos, mate_strand, mate_from, mate_to, longest): the clipped reads gathered at each site (key, chrom, pos, side).

    A read counts if its clip of 3 bases or more on the site's side ends within `shift` of the site; with `rescue` also if it
    overlaps that window and its clip, put past at most 6 matched bases and a gap of over 100, does. Of reads alike in start, end, mate start and
    clip one counts. pos is the place of most reads (the lowest of equals), mate_strand + where more mates are forward, else -.
    Sites whose longest clip is under `min_len` are left out. Reads have qname, chrom, st, cigar, flag and mate_st.
    """
    ok = F.col("cigar").contains("S") & ~flag_is(F.col("flag"), DUPLICATE) & F.col("st").isNotNull()
    used = reads.where(ok).withColumns({"ops": cigar_ops(F.col("cigar")), "en": F.col("st") + ref_span(F.col("cigar")) - 1})
    n = F.size("ops")

    def op(i):
        return F.get("ops", i if isinstance(i, Column) else F.lit(i))

    def ends(side: str):
        """The clip at its own place and, if it has one, past the short match: (side, pos, clip, moved)."""
        first, match, gap = (op(0), op(1), op(2)) if side == "-" else (op(n - 1), op(n - 2), op(n - 3))
        clipped = (first["op"] == "S") & (first["len"] >= 3)
        place = F.col("st") if side == "-" else F.col("en")
        moved = F.col("st") + match["len"] - gap["len"] if side == "-" else F.col("en") - match["len"] - gap["len"]
        short = clipped & (n >= 4) & (match["op"] == "M") & (match["len"] <= 6) & (gap["op"] == "N") & (gap["len"] > 100)
        made = [F.when(clipped, F.struct(F.lit(side).alias("side"), place.alias("at"), first["len"].alias("clip"), F.lit(0).alias("moved")))]
        if rescue:
            made.append(F.when(short, F.struct(F.lit(side).alias("side"), moved.alias("at"), (first["len"] + match["len"]).alias("clip"), F.lit(1).alias("moved"))))
        return made

    clips = used.select("qname", "chrom", "st", "en", "mate_st", "flag", F.explode(F.array(*ends("-"), *ends("+"))).alias("c")).where("c is not null").select(
        "qname", "chrom", "st", "en", "mate_st", "flag", "c.*")
    # different sites are looked up once
    asked = sites.select("chrom", "side", F.col("pos").alias("site")).dropna().distinct()
    spot, window = ["chrom", "side", "site"], F.explode(F.sequence(F.col("site") - shift, F.col("site") + shift))
    asked = asked.select(*spot, window.alias("at"))
    in_reach = (F.col("moved") == 0) | ((F.col("en") >= F.col("site") - shift) & (F.col("st") <= F.col("site") + shift))
    sums = [F.count("*").alias("n"), F.count_if(flag_is(F.col("flag"), 32)).alias("minus"), F.min("mate_st").alias("low"), F.max("mate_st").alias("high"), F.max("clip").alias("clip")]
    # A read is at a site once, by its own place if that is near, else by the moved one. Reads alike in start, end and mate (a kind) whose places lie too far
    # apart to meet at one site are told apart at each place, and come to the sites as sums; only the other kinds meet each site row by row.
    kind = ["chrom", "side", "st", "en", "mate_st"]
    own = F.when(F.col("side") == "-", F.col("st")).otherwise(F.col("en"))
    moved = clips.where("moved = 1").select(*kind, "at").distinct().withColumn("_last", F.lag("at").over(Window.partitionBy(*kind).orderBy("at")))
    tight = moved.where((F.abs(F.col("at") - own) <= 2 * shift) | (F.col("at") - F.col("_last") <= 2 * shift)).select(*kind).distinct()
    alike = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in kind]
    tight = tight.select(*[F.col(c).alias(f"_k_{c}") for c in kind])
    once = clips.groupBy(*kind, "at", "moved", "qname", "flag").agg(F.min("clip").alias("clip")).groupBy(*kind, "at", "moved", "clip").agg(F.min(F.struct("qname", "flag")).alias("r"))
    loose = once.join(tight, alike, "left_anti").withColumn("flag", F.col("r.flag"))
    near = F.when(F.col("moved") == 1, F.struct("st", "en"))  # a moved place counts only where its read is at the site
    cells = loose.groupBy("chrom", "side", "at", "moved", near.alias("near")).agg(*sums).select("*", "near.st", "near.en")
    some = asked.join(cells, ["chrom", "side", "at"]).where(in_reach).select(*spot, "at", "n", "minus", "low", "high", "clip")
    met = clips.join(tight, alike, "left_semi").join(asked, ["chrom", "side", "at"]).where(in_reach)
    met = met.groupBy(*spot, "qname", "st", "en", "mate_st", "flag").agg(F.min(F.struct("moved", "at", "clip")).alias("c"))
    one = met.groupBy(*spot, "st", "en", "mate_st", F.col("c.clip").alias("clip")).agg(F.min(F.struct("qname", "flag", F.col("c.at").alias("at"))).alias("r"))
    few = one.select(*spot, F.col("r.at").alias("at"), F.col("r.flag").alias("flag"), "mate_st", "clip").groupBy(*spot, "at").agg(*sums)
    places = some.unionByName(few).groupBy(*spot, "at").agg(F.sum("n").alias("n"), F.sum("minus").alias("minus"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("clip").alias("clip"))
    found = places.groupBy(*spot).agg(
        F.sum("n").alias("reads"), F.min_by("at", F.struct(-F.col("n"), "at")).alias("pos"), F.sum("minus").alias("minus"), F.min("low").alias("mate_from"), F.max("high").alias("mate_to"), F.max("clip").alias("longest"))
    found = found.where(F.col("longest") >= min_len).withColumnRenamed("pos", "_pos")
    return sites.select(key, "chrom", "side", F.col("pos").alias("site")).join(found, spot).withColumnRenamed("_pos", "pos").select(
        key, "reads", "pos", F.when(F.col("reads") - F.col("minus") > F.col("minus"), "+").otherwise("-").alias("mate_strand"), "mate_from", "mate_to", F.col("longest").cast("long").alias("longest"))


def clip_consensus(clips: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, consensus, support, reads): the majority base at each offset of the clipped bases of a site, as long as `least` reads reach it.

    clips have the keys, `side` and `seq`, the clipped bases in the direction of the reference; offset 1 is next to the site. Among equals
    the first of ACGT wins, N only where nothing else is. support is the least count of a winning base, reads those of the first offset.
    The clips of a site meet as they are and are counted as a sorted stream, of which a task holds one site's counts. Of a site with over `DEEP` clips
    the bases are counted before they meet, so that it moves four rows or so for each offset and task. The clips are written to the folder
    of spark.checkpoint.dir.
    """
    bases = F.when(F.col("side") == "+", F.col("seq")).otherwise(F.reverse("seq"))
    rows = written(clips.select(*keys, F.upper(bases).alias("_bases")).where("_bases <> ''"), "clips")
    deep = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > DEEP).select(*keys)  # at most a row for each DEEP clips
    deep = written(deep, "deep")
    if deep.isEmpty():
        return _count_stream(rows, keys, least)
    return _count_stream(rows.join(F.broadcast(deep), keys, "left_anti"), keys, least).unionByName(_count_letters(rows.join(F.broadcast(deep), keys, "left_semi"), keys, least))


def _count_letters(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """`clip_consensus` of few, deep sites, of rows (keys, _bases from the site on)."""
    letters = rows.select(*keys, F.posexplode(F.filter(F.split("_bases", ""), lambda b: b != "")).alias("offset", "base"))
    counts = letters.groupBy(*keys, "offset", "base").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys, "offset").agg(F.min(F.struct(F.col("base") == "N", -F.col("n"), "base")).alias("b"), F.sum("n").alias("depth")).where(F.col("depth") >= least)
    listed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("offset", F.col("b.base").alias("base"), (-F.col("b.col2")).alias("n"), "depth"))).alias("l"))
    return listed.select(*keys, _in_reference(F.array_join(F.col("l.base"), ""), keys).alias("consensus"), F.array_min(F.col("l.n")).alias("support"), F.get("l", F.lit(0))["depth"].alias("reads"))


def _in_reference(text: Column, keys: list[str]) -> Column:
    return F.when(F.col("side") == "+", text).otherwise(F.reverse(text)) if "side" in keys else text


def _count_stream(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """`clip_consensus` of rows (keys, _bases from the site on), sorted by site within each task."""
    per_site, per_offset = np.int64(1) << 45, np.int64(1) << 21  # code points have 21 bits, offsets 24

    def settle(heads, codes, n):
        """The rows of sites whose letters (site, offset, base) are all counted; codes are sorted."""
        place, base = codes // per_offset, codes % per_offset
        order = np.lexsort((base, -n, base == ord("N"), place))  # the winner of a place comes first
        first = np.flatnonzero(np.diff(place, prepend=-1))
        win, depth = order[first], np.add.reduceat(n, first)
        win, depth = win[depth >= least], depth[depth >= least]
        if not len(win):
            return None
        site = codes[win] // per_site
        at = np.flatnonzero(np.diff(site, prepend=-1))
        text = base[win].astype("<u4").tobytes().decode("utf-32-le", "replace")
        texts = [text[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(win)])]
        made = [pa.array(texts, pa.string()), pa.array(np.minimum.reduceat(n[win], at)), pa.array(depth[at])]
        return pa.RecordBatch.from_arrays([*[h.take(pa.array(site[at])) for h in heads], *made], [*keys, "consensus", "support", "reads"])

    def count(batches):
        head = codes = n = None  # of the last site, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            named, texts = [batch.column(k) for k in keys], batch.column("_bases").to_pylist()
            new = np.zeros(len(texts), bool)
            new[0] = True
            for column in named:
                a, b = column.slice(0, len(texts) - 1), column.slice(1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            heads, site = [c.take(pa.array(np.flatnonzero(new))) for c in named], np.cumsum(new) - 1
            sizes = np.array([len(t) for t in texts])
            letters = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            offset = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found, counted = np.unique(np.repeat(site, sizes) * per_site + offset * per_offset + letters, return_counts=True)
            if head is not None:
                if not all(h.equals(x.slice(0, 1)) for h, x in zip(head, heads)):
                    heads, found = [pa.concat_arrays([h, x]) for h, x in zip(head, heads)], found + per_site
                found, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
                counted = np.bincount(where, np.concatenate([n, counted])).astype(np.int64)
            end = len(heads[0]) - 1
            last = np.searchsorted(found, end * per_site)
            if last:
                done = settle(heads, found[:last], counted[:last])
                if done is not None:
                    yield done
            head, codes, n = [x.slice(end) for x in heads], found[last:] - end * per_site, counted[last:]
        if head is not None:
            done = settle(head, codes, n)
            if done is not None:
                yield done

    schema = StructType([*[rows.schema[k] for k in keys], StructField("consensus", StringType()), StructField("support", LongType()), StructField("reads", LongType())])
    sites = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, schema)
    return sites.withColumn("consensus", _in_reference(F.col("consensus"), keys))
