"""Sweeps along sorted positions without one task for each chrom.

Rows are dealt into blocks of a fixed width of positions. A window runs within each block, and what earlier blocks hand on (a
running maximum) comes from one row for each block. Only those rows, as many as a chrom has blocks, meet in a window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block. A block's rows are one task's window, which Spark spills where they are many.
BLOCK = 1 << 16


def running_max(rows: DataFrame, key: list[str], at: str, order: list[str], values: dict[str, Column], block: int = BLOCK, before: bool = True) -> DataFrame:
    """Add the columns of `values`: the maximum of each over the rows of one key that come before by (`at`, *order), or with before=False up to the row itself.

    Null where there is none; nulls do not count. `at` is a whole number; rows equal in `at` and `order` come in any order.
    """
    names = list(values)
    blocked = rows.withColumns({"_block": F.floor(F.col(at) / block), **{f"_v_{n}": v for n, v in values.items()}})
    handed = blocked.groupBy(*key, "_block").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in names])
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = handed.select(*key, "_block", *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    within = Window.partitionBy(*key, "_block").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    swept = blocked.withColumns({n: F.max(f"_v_{n}").over(within) for n in names}).join(carry, [*key, "_block"])
    return swept.withColumns({n: F.greatest(n, f"_c_{n}") for n in names}).drop("_block", *[f"_{x}_{n}" for n in names for x in "vc"])


def counts_at(asked: DataFrame, ranges: DataFrame, weights: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """(chrom, at, started_*, ended_*): for each different place (chrom, at) the sums of each weight over the ranges that start at or before it, and over those that end before it.

    Ranges (chrom, st, en) with null positions or st > en do not count. Rows are summed to one for each place first, so dense data move few, and the
    sums run by blocks as in `running_max`. What covers a place is started - ended there; what overlaps [s, e] is started at e - ended at s.
    """
    names = list(weights)
    rows = ranges.where("st <= en").select("chrom", "st", "en", *[w.cast("long").alias(n) for n, w in weights.items()])
    zero, no = [F.lit(0).cast("long")] * len(names), F.lit(False)
    sums = [f"started_{n}" for n in names] + [f"ended_{n}" for n in names]

    def events(df: DataFrame, at: Column, asked: Column, started: list, ended: list) -> DataFrame:
        return df.select("chrom", at.cast("long").alias("at"), asked.alias("_asked"), *[v.alias(n) for n, v in zip(sums, started + ended)])

    values = [F.col(n) for n in names]
    every = events(rows, F.col("st"), no, values, zero).unionByName(events(rows, F.col("en") + 1, no, zero, values)).unionByName(
        events(asked, F.col("at"), F.lit(True), zero, zero))
    places = every.groupBy("chrom", "at").agg(F.bool_or("_asked").alias("_asked"), *[F.sum(n).alias(n) for n in sums]).withColumn("_block", F.floor(F.col("at") / block))
    handed = places.groupBy("chrom", "_block").agg(*[F.sum(n).alias(f"_m_{n}") for n in sums])
    earlier = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = handed.select("chrom", "_block", *[F.coalesce(F.sum(f"_m_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums])
    within = Window.partitionBy("chrom", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    swept = places.withColumns({n: F.sum(n).over(within) for n in sums}).where("_asked").join(carry, ["chrom", "_block"])
    return swept.select("chrom", "at", *[(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in sums])


def runs_by_gap(rows: DataFrame, key: list[str], at: str, gap: int, name: str, block: int = BLOCK) -> DataFrame:
    """Add `name`, the first position of each row's run: a new one starts where `at` lies `gap` or more after all positions before."""
    before = running_max(rows, key, at, [], {"_before": F.col(at)}, block)
    opens = F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") >= gap), F.col(at))
    # rows of one position: all but the first have that position before them, so the run's start comes from the first
    return running_max(before, key, at, ["_before"], {name: opens}, block, before=False).drop("_before")


def nearest_edges(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, down_+, down_-, up_+, up_-): for each point (key, chrom, pos) the nearest edge at or below and at or above it, by strand.

    Edges have chrom, strand, edge and `what`, a struct; of edges at one place of a strand the least `what` counts. The results
    are structs (place, edge, what), null without an edge.
    """
    one = edges.groupBy("chrom", "strand", "edge").agg(F.min("what").alias("what"))
    blank = F.lit(None)
    what = one.schema["what"].dataType
    rows = one.select("chrom", F.col("edge").alias("pos"), F.lit(0).alias("late"), "strand", F.struct("edge", "what").alias("e"), blank.cast(points.schema[key].dataType).alias(key)).unionByName(
        points.select("chrom", "pos", F.lit(1).alias("late"), blank.cast("string").alias("strand"), F.struct(blank.cast("long").alias("edge"), blank.cast(what).alias("what")).alias("e"), key))
    rows = rows.withColumn("back", -F.col("pos"))

    def side(strand: str, place: str) -> Column:
        return F.when(F.col("strand") == strand, F.struct(F.col(place).alias("place"), F.col("e.edge").alias("edge"), F.col("e.what").alias("what")))

    down = running_max(rows, ["chrom"], "pos", ["late"], {f"down_{s}": side(s, "pos") for s in "+-"})
    both = running_max(down, ["chrom"], "back", ["late"], {f"up_{s}": side(s, "back") for s in "+-"})
    return both.where(F.col("late") == 1).select(key, *[f"{d}_{s}" for d in ("down", "up") for s in "+-"])
