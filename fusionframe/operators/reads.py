"""Reads gathered at sites and windows.

Reads have qname, chrom, st, en, mate_st, flag, cigar, seq and qual. Rows with null positions or flags are in no window; repeated
rows come once each. Windows and sites have a key of their own, and each result row carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusionframe.functions.columns import cigar_ops, flag_is, is_garbage, is_high_quality, quality_count

from .intervals import LIST, interval_join

PAIRED, UNMAPPED, MATE_UNMAPPED, MATE_REVERSE, FIRST, DUPLICATE = 1, 4, 8, 32, 64, 1024


def _lacks(bits: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bits)) == 0


def _in_windows(reads: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Reads that overlap a window, with the window's key, st and en as r_<key>, r_st and r_en."""
    return interval_join(reads, windows.select(key, "chrom", "st", "en")).drop("r_chrom")


def pair_reads(reads: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Reads wholly inside one of a key's two windows whose name also occurs inside the other; `side` is a or b.

    Only paired reads with both ends mapped that are no duplicates count. A read inside both windows comes once for each.
    """
    used = reads.where(flag_is(F.col("flag"), PAIRED) & _lacks(UNMAPPED | MATE_UNMAPPED | DUPLICATE))

    def inside(windows: DataFrame, side: str) -> DataFrame:
        rows = _in_windows(used, windows, key).where("st >= r_st and en <= r_en").drop("r_st", "r_en")
        return rows.withColumnRenamed(f"r_{key}", key).withColumn("side", F.lit(side))

    rows = inside(first, "a").unionByName(inside(second, "b"))
    both = rows.groupBy(key, "qname").agg(F.count_distinct("side").alias("n")).where("n = 2")
    return rows.join(both.drop("n"), [key, "qname"], "left_semi")


def mates_of(given: DataFrame, reads: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """The other ends, in the key's window, of given reads (key, qname, flag).

    Windows of at most 100 bases are widened by 100 on both sides. Unpaired, unmapped and mostly unknown sequences are left
    out. Where both ends of a name are given, the mates of its second end are looked up.
    """
    end = F.when(flag_is(F.col("flag"), FIRST), 1).otherwise(2)
    narrow = F.when(F.col("en") - F.col("st") <= 100, 100).otherwise(0)
    wide = windows.select(key, "chrom", (F.col("st") - narrow).alias("st"), (F.col("en") + narrow).alias("en"))
    used = reads.where(flag_is(F.col("flag"), PAIRED) & _lacks(UNMAPPED) & ~is_garbage(F.col("seq")))
    near = _in_windows(used, wide, key).drop("r_st", "r_en").withColumnRenamed(f"r_{key}", key)
    ends = given.groupBy(key, "qname").agg(F.max(end).alias("_end"))
    return near.join(ends, [key, "qname"]).where(end != F.col("_end")).drop("_end")


def unmapped_mates(reads: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Unmapped reads of good sequence whose mate starts in a key's window on the window's strand (1 or -1).

    An unmapped read lies at its mate's start. Windows of at most 100 bases are widened by 100 on both sides; of windows over
    800 wide only the first and the last 400 bases are searched.
    """
    narrow = F.when(F.col("en") - F.col("st") <= 100, 100).otherwise(0)
    wide = windows.select(key, "chrom", "strand", (F.col("st") - narrow).alias("st"), (F.col("en") + narrow).alias("en"))
    edges = F.when(F.col("en") - F.col("st") > 800, F.array(F.struct("st", (F.col("st") + 400).alias("en")), F.struct((F.col("en") - 400).alias("st"), "en"))
                   ).otherwise(F.array(F.struct("st", "en")))
    parts = wide.select(key, "chrom", "strand", F.explode(edges).alias("w")).select(key, "chrom", "strand", "w.st", "w.en")
    mine = F.when(flag_is(F.col("flag"), MATE_REVERSE), -1).otherwise(1)
    used = reads.where(flag_is(F.col("flag"), PAIRED) & flag_is(F.col("flag"), UNMAPPED) & _lacks(MATE_UNMAPPED | DUPLICATE)
                       & is_high_quality(F.col("qual")) & ~is_garbage(F.col("seq")))
    at = used.select("qname", "chrom", F.col("mate_st").alias("st"), F.col("mate_st").alias("en"), "flag", "seq", "qual", mine.alias("mate_strand"))
    hits = interval_join(at, parts).where("mate_strand = r_strand")
    return hits.select(F.col(f"r_{key}").alias(key), "qname", "chrom", F.col("st").alias("mate_st"), "flag", "seq", "qual")


def junction_reads(reads: DataFrame, sites: DataFrame, key: str, extend: int = 15) -> DataFrame:
    """Reads with a gap like the one expected at a site (key, chrom, pos, clip, gap).

    Gaps are N operations with over 3 bases on both sides. Up to the one that counts, each must lie between matches of over 10
    bases and differ from the expected size by less than 10. For a right clip (clip > 0) the gap's start, else its end, must be
    less than `extend` from the site. Paired reads with both ends mapped that are no duplicates are used.
    """
    ops = F.col("_ops")  # parsed once a read, not once an operation

    def gap_at(op, i):
        before, after = F.get(ops, i - 1), F.get(ops, i + 1)
        start = F.col("st") + F.aggregate(F.slice(ops, 1, i), F.lit(0), lambda acc, o: acc + o["len"])
        good = (before["op"] == "M") & (before["len"] > 10) & (after["op"] == "M") & (after["len"] > 10)
        counts = (op["op"] == "N") & (F.coalesce(before["len"], F.lit(99)) > 3) & (F.coalesce(after["len"], F.lit(0)) > 3)
        return F.when(counts, F.struct(start.alias("at"), op["len"].alias("len"), F.coalesce(good, F.lit(False)).alias("good")))

    used = reads.where(flag_is(F.col("flag"), PAIRED) & _lacks(UNMAPPED | MATE_UNMAPPED | DUPLICATE) & F.col("cigar").contains("N")).withColumn("_ops", cigar_ops(F.col("cigar")))
    gaps = used.withColumn("_gaps", F.filter(F.transform(ops, gap_at), lambda g: g.isNotNull()))
    # One row per gap and kind of edge, with the gaps up to it: few rows lie near a site, while many reads overlap it.
    each = gaps.select(*[F.col(c).alias(f"_{c}") for c in reads.columns], "_gaps", F.posexplode("_gaps").alias("_i", "_g"))
    each = each.withColumn("_upto", F.slice("_gaps", 1, F.col("_i") + 1)).where(F.forall("_upto", lambda g: g["good"])).drop("_gaps", "_i")
    each = each.withColumn("right", F.explode(F.array(F.lit(True), F.lit(False))))
    edge = lambda g: g["at"] + F.when(F.col("right"), 0).otherwise(g["len"])
    # both the place and the size of the gap make the bins; a site goes into those its gaps can be in
    def bins(value: Column, reach: int) -> Column:
        return F.explode(F.sequence(F.floor((value - reach) / (2 * reach)), F.floor((value + reach) / (2 * reach))))

    points = each.withColumn("_at", edge(F.col("_g"))).withColumns({"_b": F.floor(F.col("_at") / (2 * extend)), "_s": F.floor(F.col("_g.len") / 20)})
    # a fixed number: the rows of a task do not show in the bytes it reads
    points = points.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_chrom", "right", "_b", "_s")
    # sites alike are met as one, with arrays of their keys that a read unpacks once it fits
    at = sites.where("clip <> 0").select(F.col(key).alias("key"), F.col("chrom").alias("r_chrom"), F.col("pos").alias("r_st"), (F.col("clip") > 0).alias("r_right"), F.col("gap").alias("r_gap"))
    alike = ["r_chrom", "r_st", "r_right", "r_gap"]
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("key"))
    at = at.withColumn("_piece", F.floor((nth - 1) / LIST)).groupBy(*alike, "_piece").agg(F.collect_list(F.struct("key")).alias("_keys"))
    at = at.withColumn("r_b", bins(F.col("r_st"), extend)).withColumn("r_s", bins(F.col("r_gap"), 10))
    hits = points.join(at.hint("merge"), (F.col("_chrom") == F.col("r_chrom")) & (F.col("right") == F.col("r_right")) & (F.col("_b") == F.col("r_b")) & (F.col("_s") == F.col("r_s"))
                       & (F.abs(F.col("_at") - F.col("r_st")) < extend) & (F.abs(F.col("_g.len") - F.col("r_gap")) < 10)
                       & (F.col("_st") <= F.col("r_st") + extend) & (F.col("_en") >= F.col("r_st") - extend))
    fits = F.forall("_upto", lambda g: F.abs(g["len"] - F.col("r_gap")) < 10)
    earlier = F.exists(F.slice("_upto", 1, F.size("_upto") - 1), lambda g: F.abs(edge(g) - F.col("r_st")) < extend)
    found = hits.where(fits & ~earlier)
    return found.select(F.inline("_keys").alias(key), *[F.col(f"_{c}").alias(c) for c in reads.columns])


def clip_quality_ok(qual: Column, clip: Column, side: str) -> Column:
    """Over 80 % of the clipped bases but one at the start (side -) or the end (side +) have a quality of 20 or more."""
    part = F.left(qual, clip) if side == "-" else F.right(qual, clip)
    return quality_count(part) * 100 > (clip - 1) * 80


def align_ok(ref: Column, query: Column, qual: Column, least: int = 20) -> Column:
    """Whether an alignment padded with - agrees: under 20 aligned bases at most one mismatch, else at least 80 % equal.

    Only places with a base on both sides and a query quality of `least` or more count. Qualities have no padding.
    """
    letters = F.arrays_zip(F.split(F.upper(ref), "").alias("r"), F.split(F.upper(query), "").alias("q"))
    zero = F.struct(F.lit(1).alias("j"), F.lit(0).alias("n"), F.lit(0).alias("same"))

    def step(acc, x):
        base = x["q"] != "-"
        counts = base & (x["r"] != "-") & (F.ascii(F.substring(qual, acc["j"], F.lit(1))) >= 33 + least)
        return F.struct((acc["j"] + base.cast("int")).alias("j"), (acc["n"] + counts.cast("int")).alias("n"), (acc["same"] + (counts & (x["r"] == x["q"])).cast("int")).alias("same"))

    got = F.aggregate(letters, zero, step)
    return F.when(got["n"] < 20, got["n"] - got["same"] <= 1).otherwise(got["same"] * 100 >= got["n"] * 80)
