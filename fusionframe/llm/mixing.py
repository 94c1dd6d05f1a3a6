"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, quoted

#: Where the rounding of a cell's rates starts, between 0 and 1.
PHASE = 0.381966
#: Rows of over 1/HEADS of their cell's words are rounded one by one, the largest first; a cell has fewer than HEADS of them.
HEADS = 1000


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    marked = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def cell_of(*columns: str) -> Column:
    """One text for the values of the columns; a null is a value of its own."""
    return F.to_json(F.array(*[F.col(quoted(c)).cast("string") for c in columns]))


def numbered(rows: DataFrame, by: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Sort rows by (`by`, *order) in ranges and return (rows with `part` and `at`, bases).

    `at` - bases.first + bases.before is a row's number from 1 among those of its `by`; bases has one row for each
    (part, by). A value of `by` with very many rows, or many equal rows, lies in many parts. The rows are written, so
    that numbers do not move when a task is run again; equal rows can change places.
    """
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    keys = [F.col(by), *order, F.col("_tie")]
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    written = materialize(ranged.withColumn("at", at), name).withColumn("part", F.shiftright("at", 33))
    counts = written.groupBy("part", by).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written, counts.select("part", by, (F.col("first") - 1).alias("first"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def cycling_weights(groups: DataFrame, column: str, cycle: int = 3) -> DataFrame:
    """Add `weight`: 1, 2 .. `cycle`, repeating, by code point order of the column, null last."""
    one = groups.withColumn("_all", F.lit(0))
    rows, bases = numbered(one, "_all", [F.col(quoted(column)).asc_nulls_last()], "groups")
    place = F.col("at") - F.col("first") + F.col("before") - 1
    return rows.join(bases, ["part", "_all"]).withColumn("weight", F.pmod(place, F.lit(cycle)) + 1).drop("part", "at", "first", "before", "_all")


def capped_targets(groups: DataFrame, most: float = 3.0) -> DataFrame:
    """Add `target`: the total of `mass` shared by `weight`; a group stops at `most` times its mass, the rest is shared again.

    Every round is one aggregate over the groups; the share per weight only rises, so the rounds end when no further
    group stops. All targets are 0 where the total is.
    """
    limit = F.col("mass") * F.lit(most)
    spare, weights, stopped = 0, 1, -1
    while True:
        share = F.col("weight") * F.lit(float(spare)) / F.lit(float(weights))
        stops = (limit < share) if stopped >= 0 else F.lit(False)
        r = groups.agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(stops, limit)), F.lit(0.0)).alias("taken"),
                       F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0)).alias("weights"), F.count_if(stops).alias("n")).first()
        if r["n"] == stopped or not r["total"] or not r["weights"]:
            break
        spare, weights, stopped = r["total"] - r["taken"], r["weights"], r["n"]
    return groups.withColumn("target", F.when(limit < share, limit).otherwise(share))


def balance(cells: DataFrame, margins: dict[str, DataFrame], most: float = 3.0, tolerance: float = 1e-12) -> DataFrame:
    """Add `rate` to cells (the columns of `margins`, mass): the rates of least relative entropy that meet all targets.

    Minimises sum(mass * (rate * log(rate) - rate)) with rate <= `most`, so that for every value of a margin (its table:
    value, target) the sum of mass * rate is its target. The minimum is rate = min(exp(sum of multipliers), most), with
    one multiplier for each target; the convex dual is climbed by Newton steps, margin by margin (the Hessian of one margin
    is diagonal), each an aggregate over the cells. Steps are held to 1, which bounds the rounds by the logarithm of the
    smallest rate. A value without target is free in its margin, one with target 0 gets rate 0. Raises ValueError where the
    targets of several margins contradict one another or are beyond `most`.
    """
    wanted = {c: t.select(F.col(t.columns[0]).alias("_value"), F.col(t.columns[1]).cast("double").alias("_target")) for c, t in margins.items()}
    names = cells.columns
    limit = F.lit(math.log(most))
    state = cells.select(*map(quoted, names), F.lit(0.0).alias("_eta"), F.lit(0.0).alias("_gap"))
    best, stale = math.inf, 0
    while True:
        gaps = []
        for i, (column, table) in enumerate(wanted.items()):
            rate = F.exp(F.least("_eta", limit))
            sums = state.groupBy(F.col(quoted(column)).alias("_value")).agg(
                F.sum(F.col("mass") * rate).alias("_got"), F.sum(F.when(F.col("_eta") < limit, F.col("mass") * rate).otherwise(0.0)).alias("_slope"))
            joined = sums.join(table, sums["_value"].eqNullSafe(table["_value"])).select(sums["_value"], "_got", "_slope", "_target")
            off = F.col("_target") - F.col("_got")
            step = F.when(F.col("_target") <= 0, F.lit(float("-inf"))).when(F.col("_slope") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), off / F.col("_slope")))).when(off < 0, -1.0).otherwise(0.0)
            steps = joined.select(F.col("_value"), step.alias("_step"), F.when(F.col("_target") > 0, F.abs(off) / F.col("_target")).otherwise(0.0).alias(f"_off{i}"))
            state = state.join(steps, F.col(quoted(column)).eqNullSafe(steps["_value"]), "left").withColumn("_eta", F.col("_eta") + F.coalesce("_step", F.lit(0.0))).drop("_value", "_step")
            gaps.append(F.coalesce(f"_off{i}", F.lit(0.0)))
        state = materialize(state.withColumn("_gap", F.greatest(*gaps, F.lit(0.0))).select(*map(quoted, names), "_eta", "_gap"), "rates")
        gap = state.agg(F.max("_gap")).first()[0] or 0.0
        if gap <= tolerance:
            return state.select(*map(quoted, names), F.exp(F.least("_eta", limit)).alias("rate"))
        stale = stale + 1 if gap > 0.99 * best else 0
        best = min(best, gap)
        if stale > 50:
            raise ValueError(f"the targets cannot be met together: off by {gap:.3g} of a target")


def round_rates(docs: DataFrame, cells: DataFrame, order: Column, most: int = 3, phase: float = PHASE) -> DataFrame:
    """Give rows (cell, size) the columns of `cells` (cell, mass, rate, ..) and `copies`, whole numbers up to `most`.

    The copies of a cell's rows hold about rate * mass words. Rows lie in order of size, the largest first, and of `order`.
    A cell's largest rows (over 1/1000 of its mass, so fewer than 1000) are rounded one after another, each so that the words
    taken so far come nearest to the rate; the rate of all others makes up for what is left, and the i-th of them gets
    floor(rate * i + phase) - floor(rate * (i - 1) + phase) copies, which is off by at most twice the largest of them.
    """
    rows, bases = numbered(docs.withColumn("_key", order), "cell", [F.desc("size"), F.col("_key")], "ordered")
    known = bases.join(cells, "cell")
    place = (F.col("at") - F.col("first") + F.col("before")).alias("place")
    placed = rows.join(known, ["part", "cell"]).select("*", place)
    large = placed.where(F.col("size") * HEADS > F.col("mass")).groupBy("cell").agg(
        F.first("rate").alias("r"), F.array_sort(F.collect_list(F.struct("place", "size"))).alias("heads"))

    def one(acc, x):
        due = acc["due"] + F.col("r") * x["size"]
        n = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((due - acc["got"]) / x["size"] + 0.5).cast("int")))
        return F.struct(due.alias("due"), (acc["got"] + n * x["size"]).alias("got"), F.array_append(acc["copies"], n).alias("copies"), (acc["words"] + x["size"]).alias("words"))

    start = F.struct(F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("got"), F.array().cast("array<int>").alias("copies"), F.lit(0).cast("long").alias("words"))
    folded = large.select("cell", F.aggregate("heads", start, one).alias("f")).select("cell", "f.copies", "f.got", "f.words")
    rest = F.col("mass") - F.coalesce("words", F.lit(0))
    slope = F.when(rest > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.round((F.col("rate") * F.col("mass") - F.coalesce("got", F.lit(0))) / rest, 12)))).otherwise(0.0)
    full = bases.join(cells.join(folded, "cell", "left").withColumn("slope", slope), "cell")
    i = F.col("place") - F.coalesce(F.size("copies"), F.lit(0))
    even = (F.floor(F.col("slope") * i + phase) - F.floor(F.col("slope") * (i - 1) + phase)).cast("int")
    out = rows.join(full, ["part", "cell"]).select("*", place)
    return out.withColumn("copies", F.when(i > 0, even).otherwise(F.get("copies", (F.col("place") - 1).cast("int")))).drop(
        "part", "at", "first", "before", "got", "words", "slope", "place", "_key")


def mix(docs: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Mix rows of (doc_id, source, size) by cycling weights of the sources: adds source_size, target, rate, copies and taken.

    Null sources are one source, the last; a null size counts 0; repeated rows are rows of their own, and an empty table gives
    none. Other columns are left out. The result depends on the rows alone, not on how they are split.
    """
    rows = docs.select(cell_of("source").alias("cell"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("cell", "source").agg(F.sum("size").alias("mass"))
    targets = materialize(capped_targets(cycling_weights(sources, "source", cycle), float(most)), "targets")
    rates = balance(targets.select("cell", "mass"), {"cell": targets.select("cell", "target")}, float(most))
    cells = materialize(targets.select("cell", "target").join(rates, "cell").withColumn("rate", F.round("rate", 12)), "cells")
    out = round_rates(rows, cells, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), most)
    return out.select("doc_id", "source", "size", F.col("mass").alias("source_size"), "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op11_mixing(spark, sf_dir) -> DataFrame:
    """All documents by entropy balancing of their sources; sizes in words, at most three copies of each."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


#: Targets and rates in closed form, the rounding of the large rows as a recursion.
OP11_SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as mass, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source
), o as (
  select *, (select sum(mass) from s) as total,
    sum(3.0 * mass) over w as upto, sum(weight) over (order by 3.0 * mass / weight, weight, source nulls last rows between current row and unbounded following) as open
  from s window w as (order by 3.0 * mass / weight, weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (
  select *, 3.0 * mass < weight * cast(total - coalesce(upto, 0) as double) / open as stops from o
), p as (
  select cast(total - coalesce((select sum(3 * mass) from c where stops), 0) as double) as spare, cast((select sum(weight) from c where not stops) as double) as open from c limit 1
), t as (
  select source, mass, case when stops then cast(3 * mass as double) else cast(weight as double) * p.spare / p.open end as target from c, p
), r as (
  select *, case when mass > 0 then round(least(target / mass, 3.0), 12) else 0.0 end as rate from t
), n as (
  select d.doc_id, d.source, d.size, r.mass, r.target, r.rate,
    row_number() over (partition by d.source order by d.size desc, md5(coalesce(cast(d.doc_id as varchar), ''))) as place
  from d join r on d.source is not distinct from r.source
), f as (
  select source, cast(0 as bigint) as place, cast(0 as double) as due, cast(0 as bigint) as got, cast(0 as bigint) as copies, cast(0 as bigint) as words from r
  union all
  select f.source, n.place, f.due + n.rate * n.size,
    f.got + n.size * cast(least(3, greatest(0, floor((f.due + n.rate * n.size - f.got) / n.size + 0.5))) as bigint),
    cast(least(3, greatest(0, floor((f.due + n.rate * n.size - f.got) / n.size + 0.5))) as bigint), f.words + n.size
  from f join n on n.source is not distinct from f.source and n.place = f.place + 1 and n.size * 1000 > n.mass
), l as (
  select source, max(place) as heads, max(got) as got, max(words) as words from f group by source
), x as (
  select n.*, l.heads, n.place - l.heads as i,
    case when n.mass > l.words then least(3.0, greatest(0.0, round((n.rate * n.mass - l.got) / (n.mass - l.words), 12))) else 0.0 end as slope
  from n join l on n.source is not distinct from l.source
), y as (
  select x.*, case when x.i > 0 then cast(floor(x.slope * x.i + 0.381966) - floor(x.slope * (x.i - 1) + 0.381966) as bigint) else f.copies end as copies
  from x left join f on f.source is not distinct from x.source and f.place = x.place
)
select doc_id, cast(size as bigint) as size, mass as source_size, target, cast(size * copies as bigint) as taken, rate, cast(copies as integer) as copies from y
"""
