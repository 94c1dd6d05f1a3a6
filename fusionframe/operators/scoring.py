"""Types, medals, scores, ratings and effects of breakpoint pairs.

Rows have the ends a and b: gene, chr, pos, qs (strand), ort, feature, reads, match, rep (repeat),
area and maf, each with a or b at its end, and sv_ort, type and frame. `ord` is a unique key. Nulls in a
rule's columns make its result null, as in any SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusionframe.functions.columns import pair_key, revcomp, same_gene, split_names

MIN_READS, MAX_REPEAT, MIN_RATIO = 2, 0.7, 0.01


def sv_type(internal: Column | None = None) -> Column:
    """CTX between chroms; else by strands, by the side of the clip with 10 bases of margin, and by shared genes."""
    internal = same_gene(F.col("genea"), F.col("geneb")) if internal is None else internal
    crossed = F.col("qsa") * F.col("qsb") < 0
    ahead = F.col("qsa") * F.col("orta") * (F.col("posa") - F.col("posb") - 10) < 0
    near = F.abs(F.col("posa") - F.col("posb")) < 100_000
    return (F.when(F.col("chra") != F.col("chrb"), "CTX")
            .when(internal & crossed, "Internal_inv").when(internal & ahead, "Internal_splicing").when(internal, "Internal_dup")
            .when(crossed, "ITX").when(ahead & near, "read_through").when(ahead, "DEL").otherwise("INS"))


def _in_frame() -> Column:
    return F.coalesce(F.col("frame").rlike("1|2"), F.lit(False))


def with_name(rows: DataFrame, column: str, names: DataFrame, flag: str) -> DataFrame:
    """Add `flag`: whether any name of a list column is in `names` (one column, any size)."""
    name = names.columns[0]
    hit = rows.select("ord", F.explode(split_names(F.col(column))).alias(name)).join(names.distinct(), name, "left_semi").select("ord").distinct()
    return rows.join(hit.withColumn(flag, F.lit(True)), "ord", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_pair(rows: DataFrame, known: DataFrame, flag: str) -> DataFrame:
    """Add `flag`: whether any pair of names of both ends is a pair of `known` (genea, geneb), either way round."""
    pairs = rows.select("ord", F.explode(split_names(F.col("genea"))).alias("x"), "geneb") \
        .select("ord", "x", F.explode(split_names(F.col("geneb"))).alias("y")).select("ord", pair_key(F.col("x"), F.col("y")).alias("pair"))
    hit = pairs.join(known.select(pair_key(F.col("genea"), F.col("geneb")).alias("pair")).distinct(), "pair", "left_semi").select("ord").distinct()
    return rows.join(hit.withColumn(flag, F.lit(True)), "ord", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_itd(rows: DataFrame, windows: DataFrame, strict: bool = True) -> DataFrame:
    """Add `has_itd` (a gene of end a has a window) and `in_itd` (both ends lie inside the window of one of its genes)."""
    named = rows.select("ord", "posa", "posb", F.explode(split_names(F.col("genea"))).alias("gene")).join(windows.select("gene", "st", "en"), "gene")
    inside = (F.least("posa", "posb") > F.col("st")) & (F.greatest("posa", "posb") < F.col("en")) if strict else \
        (F.least("posa", "posb") >= F.col("st")) & (F.greatest("posa", "posb") <= F.col("en"))
    hit = named.groupBy("ord").agg(F.lit(True).alias("has_itd"), F.bool_or(inside).alias("in_itd"))
    return rows.join(hit, "ord", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_itd", "in_itd")})


def medal(rows: DataFrame, known: DataFrame, windows: DataFrame) -> DataFrame:
    """Add has_itd, in_itd and `medal`, 0 to 4: by known partners of a, of b, of both, by known pairs and known duplications."""
    partners = known.select(F.col("genea").alias("partner")).union(known.select("geneb")).distinct()
    rows = with_itd(with_pair(with_name(with_name(rows, "genea", partners, "_ka"), "geneb", partners, "_kb"), known, "_kp"), windows, strict=False)
    value = (F.when(F.col("in_itd") & (F.col("type") == "Internal_dup"), 4).when(F.col("_kp"), 4)
             .when(F.col("_ka") & F.col("_kb") & ~F.col("type").contains("Internal"), 3)
             .when(F.col("_kb") & (F.col("sv_ort") == ">"), 2).when(F.col("_kb") & (F.col("sv_ort") == "?"), 1).when(F.col("_ka"), 1).otherwise(0))
    return rows.withColumn("medal", value).drop("_ka", "_kb", "_kp")


def score(read_length: int = 100) -> Column:
    """Half the sum of both ends' areas by their weights, doubled for a sure orientation and for a frame, with penalties of 0.1.

    A fraction below 0.01 weighs exp(0.01 / fraction), which is over 1; a fraction of 0 weighs 0.
    A read_through has its penalty in any frame. Needs `has_itd`.
    """
    least = read_length * 0.5

    def ratio(c):
        return F.when((F.col(c) > 0) & (F.col(c) < MIN_RATIO), F.exp(MIN_RATIO / F.col(c))).when(F.col(c) > 0, 1.0).otherwise(F.col(c))

    def match(c):
        return F.when(F.col(c) < least, F.exp(0.5 * (F.col(c) - least))).otherwise(1.0)

    ends = (F.col("areaa") * ratio("mafa") * match("matchb") * (1 - F.col("repb"))
            + F.col("areab") * ratio("mafb") * match("matcha") * (1 - F.col("repa")))
    framed, dup = _in_frame(), F.col("type") == "Internal_dup"
    value = 0.5 * ends * F.when(F.col("sv_ort") == ">", 2).otherwise(1) * F.when(framed, 2).otherwise(1)
    turned = (F.col("chra") == F.col("chrb")) & (F.col("qsa") != F.col("qsb"))
    gap = F.abs(F.col("posa") - F.col("posb"))
    for bad in (~framed & (F.col("type") == "DEL") | (F.col("type") == "read_through"), ~framed & dup, ~F.col("has_itd") & dup,
                turned & (gap < 40_000), turned & (gap < 10_000)):
        value = value * F.when(bad, 0.1).otherwise(1.0)
    return value


def rating() -> Column:
    """HQ for medal 4; bad for few reads, repeats or low fractions at both ends or a score under 1; RT for read_through; else LQ."""
    few = F.col("readsa") + F.col("readsb") <= MIN_READS
    repeats = (F.col("repa") > MAX_REPEAT) & (F.col("repb") > MAX_REPEAT)
    thin = (F.col("mafa") < MIN_RATIO) & (F.col("mafb") < MIN_RATIO)
    return (F.when(F.col("medal") == 4, "HQ").when(few | repeats | thin | (F.col("score") < 1), "bad")
            .when(F.col("type") == "read_through", "RT").otherwise("LQ"))


def effect() -> Column:
    """ITD, Fusion or upTSS by type and frame, else by which ends are coding."""
    a, b = F.col("featurea") == "coding", F.col("featureb") == "coding"
    return (F.when(F.col("type").contains("Internal_dup"), "ITD").when(F.col("frame").rlike("1"), "Fusion").when(F.col("frame").rlike("2"), "upTSS")
            .when(a & b, "Fusion").when(a, "CLoss").when(b, "NLoss").otherwise("other"))


def rate(rows: DataFrame, known: DataFrame, windows: DataFrame, read_length: int = 100) -> DataFrame:
    """Add medal, score, rating and effect."""
    return medal(rows, known, windows).withColumn("score", score(read_length)).withColumn("rating", rating()).withColumn("effect", effect())


def quota_rating(rows: DataFrame, quota: int = 10) -> DataFrame:
    """Rows that stay, with `final_rating`: the first 11 by rating, score and ord rise to HQ if both ends have over 2 reads.

    Only the first quota + 1 rows matter for the quota, so they alone are ordered and broadcast. Later LQ rows rise
    by their frame if an end has few reads, or by a medal over 1 and a frame. Bad rows go.
    """
    kept = rows.where(F.col("rating") != "bad")
    first = kept.where(F.col("rating").isin("HQ", "LQ")).orderBy("rating", F.desc("score"), "ord").limit(quota + 1)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("rating", (-F.col("score")).alias("down"), "ord"))).alias("top"))
    place = listed.select(F.posexplode("top").alias("k", "t")).select(F.col("t.ord").alias("ord"), "k")
    both = (F.col("readsa") > MIN_READS) & (F.col("readsb") > MIN_READS)
    up = F.when(F.col("k").isNotNull() & both, True).otherwise((F.coalesce(F.col("k") < quota, F.lit(False)) | ~both) & _in_frame())
    up = up | ((F.col("medal") > 1) & _in_frame())
    return kept.join(F.broadcast(place), "ord", "left").withColumn(
        "final_rating", F.when((F.col("rating") == "LQ") & up, "HQ").otherwise(F.col("rating"))).drop("k")


def orient(rows: DataFrame) -> DataFrame:
    """Turn pairs by the sum of both ends' annotation scores (scorea, scoreb): negative flips the contig and both strands.

    Then the end with negative orientation goes second. sv_ort is `?` where the sum is 0. Columns seq, qposa, qposb, orta,
    ortb, qsa, qsb, posa, posb, chra, chrb, genea, geneb.
    """
    total = F.col("scorea") + F.col("scoreb")
    flip = F.when(total < 0, -1).otherwise(1)
    turned = rows.withColumns(
        {"seq": F.when(total < 0, revcomp(F.col("seq"))).otherwise(F.col("seq")),
         **{c: F.col(c) * flip for c in ("qsa", "qsb", "orta", "ortb")},
         **{c: F.when(total < 0, F.length("seq") - F.col(c) + 1).otherwise(F.col(c)) for c in ("qposa", "qposb")}})
    names = ("gene", "chr", "pos", "qs", "ort", "qpos")
    swap = F.col("orta") < 0
    swapped = {f"{n}{x}": F.when(swap, F.col(f"{n}{y}")).otherwise(F.col(f"{n}{x}")) for n in names for x, y in (("a", "b"), ("b", "a"))}
    return turned.withColumns(swapped).withColumn("sv_ort", F.when(total == 0, "?").otherwise(">"))


def evidence_flags(window_is_poor: Column) -> Column:
    """Points against a pair: gap over 5, under 50 matches, repeat over 0.9, identity under 0.95, and 2 for a poor junction."""
    tests = [F.col("gap") > 5, F.col("matcha") < 50, F.col("repa") > 0.9, F.col("percent") < 0.95]
    return sum((F.when(t, 1).otherwise(0) for t in tests), F.when(window_is_poor, 2).otherwise(0))


def partner_counts(known: DataFrame) -> DataFrame:
    """(gene, partners): how many different known pairs hold a gene; a pair with itself counts twice."""
    pairs = known.select(F.least("genea", "geneb").alias("x"), F.greatest("genea", "geneb").alias("y")).distinct()
    return pairs.select(F.col("x").alias("gene")).unionAll(pairs.select("y")).groupBy("gene").agg(F.count("*").alias("partners"))


def allele_fraction(plus_clip: Column, minus_clip: Column, plus_depth: Column, minus_depth: Column, fallback: Column) -> Column:
    """The greater strand's clipped share, at most 1; `fallback` (also at most 1) where no strand has depth."""
    plus = F.when(plus_depth > 0, plus_clip / plus_depth).otherwise(0.0)
    minus = F.when(minus_depth > 0, minus_clip / minus_depth).otherwise(0.0)
    known = (F.coalesce(plus_depth, F.lit(0)) > 0) | (F.coalesce(minus_depth, F.lit(0)) > 0)
    return F.least(F.lit(1.0), F.when(known, F.greatest(plus, minus)).otherwise(fallback))


def total_reads(plus_depth: Column, minus_depth: Column, depth: Column, reads: Column) -> Column:
    """Depth of both strands if both are known, else `depth`; at least the supporting reads."""
    known = (F.coalesce(plus_depth, F.lit(0)) > 0) & (F.coalesce(minus_depth, F.lit(0)) > 0)
    return F.greatest(F.when(known, plus_depth + minus_depth).otherwise(depth), reads)


def adaptive_cutoff(sites: DataFrame, least: int = 2, strict: int = 5, limit: int = 200_000) -> int:
    """The support to ask for: `strict` where there are over `limit` sites."""
    return strict if sites.count() > limit else least


def same_locus(pairs: DataFrame, genes: DataFrame, min_distance: int = 10_000) -> DataFrame:
    """(ord, same): whether both ends of a pair lie in one locus.

    Pairs have ord, and for ends a and b chr, pos, st, en and qs. The genes (key gene_id) of an end are those that overlap it, else those
    within 5 kb, else within 10 kb. One gene at both ends, or a gene within another, give or take 1 kb, make it one locus; so do ends of one
    chrom within 1 kb of each other's range if an end overlaps no gene, or within 5 kb (or a tenth of `min_distance` on one strand) if neither does.
    """
    from .graph import written
    from .intervals import interval_join

    place = ["chrom", "st", "en"]
    ends = [pairs.select(F.col(f"chr{x}").alias("chrom"), F.col(f"st{x}").alias("st"), F.col(f"en{x}").alias("en")) for x in "ab"]
    left, tiers = written(ends[0].unionByName(ends[1]).dropna().distinct(), "ends"), []

    def stair(rows, outer: bool):
        """The ranges in none of the others (outer), or with none of the others in them: with no other two is a nesting lost."""
        key = F.transform(rows, lambda g: F.struct((g["st"] if outer else -g["st"]).alias("k"), (-g["en"] if outer else g["en"]).alias("e")))
        first = F.struct(F.lit(None).cast("long").alias("last"), F.slice(F.array_sort(key), 1, 0).alias("kept"))
        kept = F.aggregate(F.array_sort(key), first, lambda acc, g: F.when(acc["last"].isNull() | (g["e"] < acc["last"]), F.struct(g["e"].alias("last"), F.array_append(acc["kept"], g).alias("kept"))).otherwise(acc))["kept"]
        return F.transform(kept, lambda g: F.struct((g["k"] if outer else -g["k"]).alias("st"), (-g["e"] if outer else g["e"]).alias("en")))

    # different ends are looked up once, and in a wider tier only those without a gene in the narrower ones
    for tier, reach in enumerate((0, 5000, 10_000)):
        hits = interval_join(left, genes.select("chrom", "st", "en"), pad=reach, width=2000 + reach).groupBy(*place).agg(F.collect_set(F.struct(F.col("r_st").alias("st"), F.col("r_en").alias("en"))).alias("g"))
        tiers.append(written(hits.select(*place, F.lit(tier).alias("tier"), stair(F.col("g"), True).alias("outer"), stair(F.col("g"), False).alias("inner")), "tier"))
        left = left.join(tiers[-1], place, "left_anti")
    best = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    rows = pairs
    for x in "ab":
        rows = rows.join(best.select(*[F.col(c).alias(n) for c, n in zip(place, (f"chr{x}", f"st{x}", f"en{x}"))], F.struct("tier", "outer", "inner").alias(f"t{x}")), [f"chr{x}", f"st{x}", f"en{x}"], "left")
    none = {x: F.coalesce(F.col(f"t{x}.tier") > 0, F.lit(True)) for x in "ab"}
    one_chrom = F.col("chra") == F.col("chrb")

    def near(most):
        return F.least(*[F.abs(F.col(f"pos{x}") - F.col(f"{e}{y}")) for x, y in ("ab", "ba") for e in ("st", "en")]) < most

    close = one_chrom & (((none["a"] | none["b"]) & near(1000)) | (none["a"] & none["b"] & (near(5000) | ((F.abs(F.col("posa") - F.col("posb")) < min_distance / 10) & (F.col("qsa") == F.col("qsb"))))))

    def within(x, y):
        return (x["st"] - 1000 < y["st"]) & (x["en"] + 1000 > y["en"])

    def holds(x: str, y: str):
        """Whether a gene of end x has one of end y in it; one gene at both ends has itself."""
        return F.exists(f"t{x}.outer", lambda o: F.exists(f"t{y}.inner", lambda i: within(o, i)))

    shared = one_chrom & (F.coalesce(holds("a", "b"), F.lit(False)) | F.coalesce(holds("b", "a"), F.lit(False)))
    return rows.select("ord", F.coalesce(close | F.coalesce(shared, F.lit(False)), F.lit(False)).alias("same"))


def known_pairs(pairs: DataFrame, pattern: str = "^(IG|TR).$") -> DataFrame:
    """(x, y): the known pairs both ways, read in order of the unique `ord`, without those of a gene that is enhancer-activated by then.

    A pair with a gene of `pattern` activates its other gene, and is itself read if neither gene was active before. Only pairs of two
    such genes can make one of them active, so these few (one for each pair of names of the pattern) are read one by one; every other gene
    becomes active with its first pair that is read.
    """
    rows = pairs.select("ord", F.col("genea").alias("a"), F.col("geneb").alias("b"))
    is_a, is_b = F.col("a").rlike(pattern), F.col("b").rlike(pattern)
    first = rows.where(is_a & is_b).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("ord").alias("ord"))
    state = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<bigint>").alias("ords"))

    def read(acc, p):
        new = ~F.array_contains(acc["names"], p["a"]) & ~F.array_contains(acc["names"], p["b"])
        return F.when(new, F.struct(F.concat(acc["names"], F.array(p["a"], p["b"])).alias("names"), F.concat(acc["ords"], F.array(p["ord"], p["ord"])).alias("ords"))).otherwise(acc)

    folded = first.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "a", "b"))).alias("l")).select(F.aggregate("l", state, read).alias("s"))
    special = folded.select(F.explode(F.arrays_zip("s.names", "s.ords")).alias("z")).select(F.col("z.names").alias("g"), F.col("z.ords").alias("since"))
    mixed = rows.where(is_a != is_b).select("ord", F.when(is_a, F.col("a")).otherwise(F.col("b")).alias("g"), F.when(is_a, F.col("b")).otherwise(F.col("a")).alias("other"))
    open_ = mixed.join(special, "g", "left").where(F.col("since").isNull() | (F.col("ord") <= F.col("since")))
    active = open_.groupBy(F.col("other").alias("g")).agg(F.min("ord").alias("since")).unionByName(special)
    kept = rows
    for c in "ab":
        kept = kept.join(active.select(F.col("g").alias(c), F.col("since").alias(f"since_{c}")), c, "left").where(F.col(f"since_{c}").isNull() | (F.col("ord") <= F.col(f"since_{c}")))
    return kept.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(kept.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
