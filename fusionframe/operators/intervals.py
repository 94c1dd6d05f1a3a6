"""Joins and set operations on closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .sweep import counts_at, running_max

#: Levels of nodes of 4**level positions; the highest holds any longer range as several nodes.
LEVELS = 16


#: Right rows of a bin that a left row meets at once, and copies of a left row that are looked up as one, in `dense_join`.
PIECE, COPIES = 256, 1000

#: Found rows of a key that a row meets at once, and rows of a key in one task, in `listed_join`.
LIST, ROWS = 512, 100_000


def _binned(left: DataFrame, right: DataFrame, width: int, pad: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides spread over bins (`_b`, `_rb`), the right columns with `r_`, and the first position of the left row's bin.

    Ranges wider than 64 bins are spread over bins 64 times as wide and meet all others there, so that one long range makes few rows: each range
    gets the bins of the kinds of pairs it can be in (short with short, long with any, short with long). Two ranges share a bin first
    where the later start lies in it.
    """
    wide = width * 64
    l = left.withColumns({"_ls": F.col("st") - pad, "_le": F.col("en") + pad}).where("_ls <= _le")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_st <= r_en")

    def bins(start: Column, end: Column, short: tuple, long: tuple) -> Column:
        """(kind, bin) of a range for the kinds of pairs that a short or a long one can be in."""
        def of(kind):
            size = width if kind == 0 else wide
            return F.transform(F.sequence(F.floor(start / size), F.floor(end / size)), lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bin")))
        return F.explode(F.when(end - start > wide, F.concat(*map(of, long))).otherwise(F.concat(*map(of, short))))

    # kinds: 0 short with short, 1 long with any, 2 short with long
    l = l.withColumn("_b", bins(F.col("_ls"), F.col("_le"), (0, 2), (1,)))
    r = r.withColumn("_rb", bins(F.col("r_st"), F.col("r_en"), (0, 1), (1, 2)))
    return l, r, F.col("_b.bin") * F.when(F.col("_b.kind") == 0, width).otherwise(wide)


def interval_join(left: DataFrame, right: DataFrame, width: int = 2000, pad: int = 0, strand: bool = False, dealt: bool = False) -> DataFrame:
    """Pairs of rows on one chrom (with `strand`, on one strand too) whose [st, en] overlap once the left is widened by `pad`.

    Both sides are spread over bins, and one join meets them all; a pair is kept only in the first bin that both share, so it comes once. A bin with very many rows is
    left to Spark's skew join. Right columns get the prefix `r_`. Rows with null positions or st > en join nothing; ties and repeated rows give one pair each.
    With `dealt`, for few left rows that meet very many, bins go over a fixed number of tasks, and none of the spread rows are broadcast, which Spark sizes too low.
    """
    l, r, low = _binned(left, right, width, pad)
    l = l.withColumns({"_kind": F.col("_b.kind"), "_bin": F.col("_b.bin")})
    if dealt:
        l, r = l.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "_kind", "_bin"), r.hint("merge")
    on = ((F.col("chrom") == F.col("r_chrom")) & (F.col("_kind") == F.col("_rb.kind")) & (F.col("_bin") == F.col("_rb.bin"))
          & (F.col("r_st") <= F.col("_le")) & (F.col("r_en") >= F.col("_ls")) & (F.greatest("_ls", "r_st") >= low))
    if strand:
        on = on & (F.col("strand") == F.col("r_strand"))
    return l.join(r, on).drop("_b", "_rb", "_ls", "_le", "_kind", "_bin")


def dense_join(left: DataFrame, right: DataFrame, width: int = 2000) -> DataFrame:
    """The pairs of `interval_join` for two large sides whose pairs far outnumber their rows.

    Equal left rows are looked up once and their pairs repeated. The right rows of a bin are sorted by start and cut into arrays of `PIECE`, of which
    a left row meets only those that reach it, and unpacks them itself. So rows of a side and not pairs are moved,
    and pairs come out by bin, which packs them well where they are written. A bin is one task.
    """
    deal = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the pairs of a task do not show in the bytes it reads
    n = F.count("*")
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / COPIES)), lambda i: F.least(F.lit(COPIES), n - i * COPIES).cast("int"))
    once = left.dropna(subset=["chrom", "st", "en"]).groupBy(*left.columns).agg(runs.alias("_runs")).withColumn("_n", F.explode("_runs")).drop("_runs")
    l, r, low = _binned(once, right, width, 0)
    bin_ = ["_kind", "_bin"]
    l = l.withColumns({"_low": low, "_kind": F.col("_b.kind"), "_bin": F.col("_b.bin")}).drop("_b", "_ls", "_le")
    l = l.repartition(deal, "chrom", *bin_)
    names = [c for c in right.columns if c != "chrom"]
    r = r.select("r_chrom", *[f"r_{c}" for c in names], F.col("_rb.kind").alias("_kind"), F.col("_rb.bin").alias("_bin"))
    at = F.row_number().over(Window.partitionBy("r_chrom", *bin_).orderBy("r_st"))
    r = r.withColumn("_piece", F.floor((at - 1) / PIECE)).groupBy("r_chrom", *bin_, "_piece").agg(
        F.collect_list(F.struct(*[f"r_{c}" for c in names])).alias("_rows"), F.min("r_st").alias("_first"), F.max("r_en").alias("_last"))
    r = r.withColumnsRenamed({c: f"_r{c}" for c in bin_})
    on = F.col("chrom") == F.col("r_chrom")
    for c in bin_:
        on = on & (F.col(c) == F.col(f"_r{c}"))
    met = l.join(r.hint("merge"), on & (F.col("_first") <= F.col("en")) & (F.col("_last") >= F.col("st")))
    pairs = met.select(*left.columns, "_n", "_low", "r_chrom", F.inline("_rows")).where("r_st <= en and r_en >= st and greatest(st, r_st) >= _low")
    return pairs.select(*left.columns, *[f"r_{c}" for c in right.columns], F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy")).drop("_copy")


def place_join(left: DataFrame, right: DataFrame, strand: bool = False, **how) -> DataFrame:
    """`interval_join` that looks each different range of the left up once, and then hands what it met to the left rows of that range."""
    place = ["chrom", "st", "en"] + (["strand"] if strand else [])
    return listed_join(left, interval_join(left.select(*place).distinct(), right, strand=strand, **how), place)


def listed_join(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """The inner join by the columns `on`, for keys with many rows on both sides.

    What is found for a key is sorted and cut into arrays of `LIST`, which each row meets and unpacks itself. So rows of a side and not pairs are moved, what is
    costly to find is found once for a key, and the same list comes out for each row of a key, which packs well where it is written.
    A key with over `ROWS` rows is dealt over several tasks.
    """
    deal = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the pairs of a task do not show in the bytes it reads
    names, own = [c for c in found.columns if c not in on], [c for c in rows.columns if c not in on]
    many = rows.groupBy(*on).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_deals")).where("_deals > 1")
    deals = F.coalesce("_deals", F.lit(1))
    dealt = rows.join(F.broadcast(many), on, "left").withColumn("_deal", F.pmod(F.xxhash64(*own), deals).cast("int")).drop("_deals")
    found = found.join(F.broadcast(many), on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    key = [*on, "_deal"]
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*names))
    lists = found.withColumn("_piece", F.floor((at - 1) / LIST)).groupBy(*key, "_piece").agg(F.collect_list(F.struct(*names)).alias("_rows"))
    # the rows of a key repeat one array after the other: parts of `LIST` values, a multiple of 8, stay aligned in a file and pack
    return lists.hint("merge").join(dealt.repartition(deal, *key), key).select(*rows.columns, F.inline("_rows"))


def _nodes(st: Column, en: Column, top: int) -> Column:
    """The nodes (level, node) of 4**level positions, up to level `top`, that make up [st, en]; few however long it is."""
    def at(k: Column) -> Column:
        size = F.pow(F.lit(4.0), k).cast("long")
        first, last = F.ceil(st / size), F.floor((en + 1) / size) - 1
        up_first, up_last = F.ceil(st / (size * 4)), F.floor((en + 1) / (size * 4)) - 1
        def some(a, b):
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        parted = (k < top) & (up_first <= up_last)  # the next level holds the middle
        nodes = F.when(parted, F.concat(some(first, up_first * 4 - 1), some((up_last + 1) * 4, last))).otherwise(some(first, last))
        return F.transform(nodes, lambda n: F.struct(k.alias("level"), n.alias("node")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))


def _above(at: Column, top: int) -> Column:
    """The nodes (level, node) over a position, up to level `top`."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.alias("level"), F.floor(at / F.pow(F.lit(4.0), k)).alias("node")))


def _top(rows: DataFrame) -> int:
    """The level of the largest node in the widest range."""
    wide = rows.agg(F.max(F.col("en") - F.col("st") + 1)).first()[0] or 1
    return next((k for k in range(LEVELS) if 4 ** (k + 1) > wide), LEVELS)


def overlap_nodes(asked: DataFrame, ranges: DataFrame, condense) -> DataFrame:
    """(chrom, st, en, ...): for each different asked range, condensed rows of all ranges (chrom, st, en, ...) that overlap it.

    A range overlaps if it covers the asked start or starts within the rest. So ranges are split into nodes that meet the nodes over asked starts, and asked
    rests into nodes that meet the nodes over starts: a number of rows that grows with the input, however many ranges overlap. `condense(rows, keys)`
    reduces the rows of each node (the columns `keys`) to those that can matter, as a minimum or the different values do; the caller reduces
    what comes back for a range once more by the same rule. Ranges with null positions or st > en meet nothing.
    """
    keys = ["chrom", "_part", "_n"]
    asked = asked.select("chrom", "st", "en").where("st <= en").distinct()
    ranges = ranges.where("st <= en")
    st, en, rest = F.col("st"), F.col("en"), [c for c in ranges.columns if c not in ("chrom", "st", "en")]

    def split(rows: DataFrame, part: int, nodes: Column, columns: list) -> DataFrame:
        return rows.select("chrom", *columns, F.lit(part).alias("_part"), F.explode(nodes).alias("_n"))

    top = _top(ranges)
    held, sought = split(ranges, 0, _nodes(st, en, top), rest), split(asked, 0, _above(st, top), ["st", "en"])
    longer = asked.where("st < en")
    if not longer.isEmpty():
        top = _top(longer)
        held = held.unionByName(split(ranges, 1, _above(st, top), rest))
        sought = sought.unionByName(split(longer, 1, _nodes(st + 1, en, top), ["st", "en"]))
    return sought.join(condense(held, keys), keys).drop("_part", "_n")


def count_overlaps(ivals: DataFrame, reads: DataFrame, key: str, skip_flags: int = 1024 + 4, excluded: DataFrame | None = None) -> DataFrame:
    """Reads without the flags of `skip_flags` that overlap each interval; 0 where none does, and for excluded keys."""
    used = ivals.select(key, "chrom", "st", "en")
    if excluded is not None:
        used = used.join(excluded.select(key).distinct(), key, "left_anti")
    used = used.where("st <= en")
    kept = reads.where(F.col("flag").bitwiseAND(F.lit(skip_flags)) == 0)
    sums = counts_at(used.select("chrom", F.explode(F.array("st", "en")).alias("at")), kept, {"n": F.lit(1)})
    # a read overlaps if it starts at or before the end and does not end before the start
    ends = used.select(key, "chrom", F.explode(F.array(F.struct(F.col("en").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("st").alias("at"), F.lit(-1).alias("sign")))).alias("e")).select(key, "chrom", "e.*")
    counts = ends.join(sums, ["chrom", "at"]).groupBy(key).agg(F.sum(F.when(F.col("sign") > 0, F.col("started_n")).otherwise(-F.col("ended_n"))).alias("n_reads"))
    return ivals.select(key).join(counts, key, "left").select(key, F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))


def region_of(points: DataFrame, regions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name): the first region by `order` with a point strictly inside."""
    hits = interval_join(points, regions).where((F.col("st") > F.col("r_st")) & (F.col("st") < F.col("r_en")))
    return hits.groupBy(key).agg(F.min_by("r_name", f"r_{order}").alias("name"))


def query_intervals(rows: DataFrame, ivals: DataFrame, key: str, wiggle: int = 0) -> DataFrame:
    """Different rows that overlap any of the intervals widened by `wiggle`; equal intervals are asked once."""
    asked = ivals.select("chrom", "st", "en").distinct().withColumns({"st": F.col("st") - wiggle, "en": F.col("en") + wiggle})
    return interval_join(rows, asked).select(*rows.columns).dropDuplicates([key])


def first_interval(points: DataFrame, ivals: DataFrame, key: str, order: str) -> DataFrame:
    """For each point row `key`, the overlapping interval that comes first by `order`."""
    least = F.min(order).alias(order)
    met = overlap_nodes(points, ivals.select("chrom", "st", "en", order), lambda rows, keys: rows.groupBy(*keys).agg(least))
    return points.join(met.groupBy("chrom", "st", "en").agg(least), ["chrom", "st", "en"]).groupBy(key).agg(least)


def tiered_overlap(points: DataFrame, ivals: DataFrame, key: str, name: str, tiers=(0, 5000, 10000)) -> DataFrame:
    """Names of the intervals within the narrowest tier that has any; `key` is unique.

    Different places are asked once, and in a wider tier only those without any name in the narrower ones.
    """
    place = ["chrom", "st", "en"]
    named, left, found = ivals.select(*place, name), written(points.select(*place).where("st <= en").distinct(), "places"), None
    for t in sorted(tiers):
        wide = left.select("chrom", (F.col("st") - t).alias("st"), (F.col("en") + t).alias("en"))
        met = overlap_nodes(wide, named, lambda rows, keys: rows.select(*keys, name).distinct())
        listed = met.groupBy(*place).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"))
        here = written(listed.select("chrom", (F.col("st") + t).alias("st"), (F.col("en") - t).alias("en"), F.lit(t).cast("long").alias("tier"), "names"), "tier")
        found = here if found is None else found.unionByName(here)
        left = left.join(here, place, "left_anti")
    return points.select(key, *place).join(found, place).select(key, "tier", "names")


def pair_band_join(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs (l_ord, r_ord) whose both ends are nearer than `distance`, direct or swapped; `ord` is unique on each side.

    Both ends make the bins, four distances wide, and a right row is put into the bins that its neighbours can be in. A left row is in one bin, and a swapped
    right row does not meet what it meets directly, so a pair comes once.
    """
    size = 4 * distance

    def bins(pos: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(pos) - distance + 1) / size), F.floor((F.col(pos) + distance - 1) / size)))

    ends = right.select(F.col("ord").alias("r_ord"), "chra", "posa", "chrb", "posb")
    turned = ends.select("r_ord", F.col("chrb").alias("ra"), F.col("posb").alias("pa"), F.col("chra").alias("rb"), F.col("posa").alias("pb"), F.lit(True).alias("turned"))
    r = ends.toDF("r_ord", "ra", "pa", "rb", "pb").withColumn("turned", F.lit(False)).unionByName(turned)
    r = r.withColumn("bina", bins("pa")).withColumn("binb", bins("pb"))
    l = left.select("ord", "chra", "posa", "chrb", "posb", F.floor(F.col("posa") / size).alias("lbina"), F.floor(F.col("posb") / size).alias("lbinb"))

    def near(ra: str, pa: str, rb: str, pb: str) -> Column:
        return (F.col("chra") == F.col(ra)) & (F.col("chrb") == F.col(rb)) & (F.abs(F.col("posa") - F.col(pa)) < distance) & (F.abs(F.col("posb") - F.col(pb)) < distance)

    on = (F.col("lbina") == F.col("bina")) & (F.col("lbinb") == F.col("binb")) & near("ra", "pa", "rb", "pb")
    return l.join(r, on & ~(F.col("turned") & near("rb", "pb", "ra", "pa"))).select(F.col("ord").alias("l_ord"), "r_ord")


def merge_intervals(ivals: DataFrame) -> DataFrame:
    """Union of overlapping intervals on each chrom; a sweep by blocks, see `sweep.running_max`. Rows with null ends go."""
    rows = ivals.select("chrom", "st", "en").dropna(subset=["st", "en"])
    reach = running_max(rows, ["chrom"], "st", ["en"], {"reach": F.col("en")})
    opens = F.when(F.col("reach").isNull() | (F.col("st") > F.col("reach")), F.col("st"))
    # of rows that start at one place only the first can open a union, and it has the least reach before it
    marked = running_max(reach, ["chrom"], "st", ["en", "reach"], {"first": opens}, before=False)
    return marked.groupBy("chrom", "first").agg(F.max("en").alias("en")).select("chrom", F.col("first").alias("st"), "en")


def subtract_intervals(lengths: DataFrame, excluded: DataFrame) -> DataFrame:
    """The parts of 1..length of each chrom that no excluded interval covers; empty parts are skipped."""
    merged = merge_intervals(excluded)
    ends = merged.select("chrom", "st", "en", F.lit(0).alias("tail")).unionByName(lengths.select("chrom", (F.col("len") + 1).alias("st"), F.lit(None).cast("long").alias("en"), F.lit(1).alias("tail")))
    before = running_max(ends, ["chrom"], "st", ["tail"], {"last": F.col("en")})
    known = before.join(lengths.select("chrom").distinct(), "chrom", "left_semi")
    return known.select("chrom", (F.coalesce("last", F.lit(0)) + 1).alias("st"), (F.col("st") - 1).alias("en")).where("en >= st")
