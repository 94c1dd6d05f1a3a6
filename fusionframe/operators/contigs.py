"""From mapped contigs to pairs of breakpoints.

Hits have contig, id, tname, tstart, tend, qstart, qend, qstrand (1, -1), qlen, matches, mismatches and blocks, an array of
(t, q, len) in order of the target; q is the block's first base along the target, on strand -1 its highest. Sites have contig, sc_chrom,
sc_site and clip (1: the clip is right of the site, -1: left). A contig belongs to one site. Work on a contig's hits needs only these
hits together. Rows with a null contig join nothing.
"""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written_by

MIN_HIT, MIN_DISTANCE = 25, 10_000
END = ["ort", "tname", "tstart", "tend", "tpos", "qstart", "qend", "qpos", "qstrand", "matches", "percent"]


def _c(name: str) -> Column:
    return F.col(name)


def _bare(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def sort_hits(hits: DataFrame) -> DataFrame:
    """Add `n`, a contig's hits from 1 by matches (most first), target and id, and `run`: hits that follow on one target."""
    by = Window.partitionBy("contig").orderBy(F.desc("matches"), "tname", "id")
    rows = hits.withColumns({"n": F.row_number().over(by), "_new": (~F.lag("tname").over(by).eqNullSafe(_c("tname"))).cast("int")})
    return rows.withColumn("run", F.sum("_new").over(by)).drop("_new")


def _no_key(equal: Column) -> Column:
    """The condition as one that Spark does not take as a further key of a join, so that rows that lie by contig are not moved to join."""
    return F.coalesce(equal, F.lit(False))


def _percent(matches: Column | None = None) -> Column:
    return F.try_divide(_c("matches") if matches is None else matches, _c("qend") - _c("qstart") + 1)


def _over(*keys: str):
    """A window over all rows of one contig, or of one run or key of it; the rows lie by contig already, so it moves nothing."""
    return Window.partitionBy("contig", *keys)


def _whole(least: int) -> Column:
    return (_c("qstart") < least) & (_c("qlen") - _c("qend") < least)


def triage_contigs(hits: DataFrame, sites: DataFrame, read_len: int, least: int = MIN_HIT) -> DataFrame:
    """(contig, bad, site_mapped, best): contigs to leave out, contigs that map over their site, the most matches of a hit.

    Bad are contigs no longer than a read, with a perfect hit of one block over the whole contig, with a good hit over the
    whole contig beside the site, or with a left and a right part that map under 40 kb apart on one target, unless the left part (or an
    earlier right part) lies at the site. `hits` are sorted by `sort_hits`; contigs without a site are left out.
    """
    rows = hits.join(sites, "contig")
    percent, one, site = _percent(), F.size("blocks") == 1, _c("sc_site")
    near_end = (_c("qstart") <= least) | (_c("qlen") - _c("qend") <= least)
    perfect = near_end & (percent == 1) & one & _whole(least)
    here = _bare(_c("tname")) == _bare(_c("sc_chrom"))
    beside = near_end & _whole(least) & (percent > 0.9) & (_c("matches") > _c("qend") - _c("qstart") - 20) & (~here | ((_c("tstart") - site) * (_c("tend") - site) > 0))
    over = here & ((_c("tstart") + least / 2 - site) * (_c("tend") - least / 2 - site) < 0)
    mapped = near_end & over & ~((percent == 1) & one) & (_whole(least) | (_c("qend") - _c("qstart") > 0.9 * _c("qlen")))
    part = near_end & ~over
    left = _c("qstart") + _c("qend") < _c("qlen")
    at_left = here & F.when(_c("qstrand") > 0, (_c("tstart") < site) & (F.abs(_c("tend") - site) < 50)).otherwise(
        (F.abs(_c("tstart") - site) < 50) & (_c("tend") > site + least))
    at_right = here & F.when(_c("qstrand") > 0, (F.abs(_c("tstart") - site) < 50) & (_c("tend") > site)).otherwise(
        (_c("tstart") < site - least) & (F.abs(_c("tend") - site) < 50))
    span = F.struct("n", "tstart", "tend", "qstart", "qend")
    runs = rows.groupBy("contig", "run").agg(
        F.first("qlen").alias("qlen"), F.max("matches").alias("best"), F.min(F.when(perfect, _c("n"))).alias("perfect"), F.bool_or(beside).alias("beside"),
        F.min(F.when(mapped, _c("n"))).alias("mapped"),
        F.collect_list(F.when(part & left, span)).alias("lefts"), F.collect_list(F.when(part & ~left, span)).alias("rights"),
        F.min(F.when(part & left & at_left, _c("n"))).alias("l_stop"), F.min(F.when(part & ~left & at_right, _c("n"))).alias("r_stop"))
    first_left = F.array_min(F.transform("lefts", lambda x: x["n"]))

    def close(a: Column, b: Column) -> Column:
        gaps = [F.abs(a[x] - b[y]) for x in ("tstart", "tend") for y in ("tstart", "tend")]
        return (a["qend"] + least > b["qstart"]) & (F.least(*gaps) < 40_000)

    def asked(a: Column, b: Column) -> Column:
        lefts_go_on = _c("l_stop").isNull() | (a["n"] < _c("l_stop"))
        return lefts_go_on & (_c("r_stop").isNull() | ((a["n"] == first_left) & (b["n"] < _c("r_stop")))) & close(a, b)

    split = F.exists("lefts", lambda a: F.exists("rights", lambda b: asked(a, b)))
    flags = runs.select("contig", "qlen", "best", "perfect", "beside", "mapped", split.alias("split"))
    short = F.first("qlen") <= read_len
    seen = (F.min("mapped").isNotNull() & (F.min("perfect").isNull() | (F.min("mapped") < F.min("perfect"))) & ~F.bool_or("beside") & ~short)
    bad = short | F.min("perfect").isNotNull() | F.bool_or("beside") | F.bool_or("split")
    return flags.groupBy("contig").agg(bad.alias("bad"), seen.alias("site_mapped"), F.max("best").alias("best"))


def _end(prefix: str, **values: Column) -> list[Column]:
    return [values[k].alias(f"{k}{prefix}") for k in END]


def block_events(hits: DataFrame, sites: DataFrame, mapped: DataFrame, least: int = MIN_HIT) -> DataFrame:
    """Events within hits over the site: a duplication of over 10 bases, a deletion or read-through, or one block cut at the site.

    One row for each contig of `mapped` and run of hits on the site's target: contig, id, kind (one_block, dup, gap), itd, and both
    ends (columns of END with a and b). Hits within 1000 bases of the site are tried in order; one whose gaps all lie over 5 bases from the
    site ends its run, one with an end of under `least` bases is passed over. itd stays set for later runs of a contig.
    """
    rows = hits.join(sites, "contig").join(mapped.select("contig"), "contig", "left_semi").where(
        _no_key(_c("tname") == _c("sc_chrom")) & (_c("tstart") <= _c("sc_site") + 1000) & (_c("tend") >= _c("sc_site") - 1000))
    blocks, site, clip, strand = _c("blocks"), _c("sc_site"), _c("clip"), _c("qstrand")
    one = F.size("blocks") == 1

    def gap(i: Column) -> Column:
        a, b = F.get(blocks, i), F.get(blocks, i + 1)
        dup = F.when(_whole(least), strand * (b["q"] - a["q"]) - a["len"]).otherwise(0)
        return F.struct(dup.alias("dup"), a.alias("a"), b.alias("b"))

    gaps = F.when(one, F.array().cast("array<struct<dup:bigint,a:struct<t:bigint,q:bigint,len:bigint>,b:struct<t:bigint,q:bigint,len:bigint>>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("blocks") - 2), gap))
    fits = F.filter(gaps, lambda g: (g["dup"] > 10) | ((g["b"]["t"] + 5 >= site) & (g["a"]["t"] - 5 <= site)))
    rows = rows.withColumn("g", F.get(fits, F.lit(0)))
    dup = F.coalesce(_c("g.dup") > 10, F.lit(False))
    kind = F.when(one, "one_block").when(dup, "dup").when(_c("g").isNotNull(), "gap")
    after = _c("g.a.t") + _c("g.a.len")
    cut = F.when(strand > 0, _c("qstart") + site - _c("tstart")).otherwise(_c("qstart") + _c("tend") - site)
    rows = rows.withColumns({
        "kind": kind, "ort": clip * strand,
        "pa": F.when(one | dup, site).when(clip > 0, after).otherwise(_c("g.b.t")),
        "pb": F.when(one, site).when(dup, site - clip * _c("g.dup")).when(clip > 0, _c("g.b.t")).otherwise(after),
        "qa": F.when(one, cut).when(dup, _c("g.b.q")).otherwise(_c("g.a.q") + strand * _c("g.a.len")),
        "qb": F.when(one, cut).otherwise(_c("g.b.q"))})
    up, right = _c("ort") > 0, clip > 0
    rows = rows.withColumns({
        "qs1": F.when(up, _c("qstart")).otherwise(_c("qa")), "qe1": F.when(up, _c("qa")).otherwise(_c("qend")),
        "qs2": F.when(up, _c("qb")).otherwise(_c("qstart")), "qe2": F.when(up, _c("qend")).otherwise(_c("qb")),
        "ts1": F.when(right, _c("tstart")).otherwise(_c("pa")), "te1": F.when(right, _c("pa")).otherwise(_c("tend")),
        "ts2": F.when(~right, _c("tstart")).otherwise(_c("pb")), "te2": F.when(~right, _c("pb")).otherwise(_c("tend"))})
    rows = rows.withColumns({"m1": _c("qe1") - _c("qs1") + 1, "m2": _c("qe2") - _c("qs2") + 1})
    stops = _c("kind").isNull() | ((_c("m1") >= least) & (_c("m2") >= least))
    run = _over("run")
    rows = rows.withColumns({"stop": F.min(F.when(stops, _c("n"))).over(run), "dup_at": F.min(F.when(_c("kind") == "dup", _c("n"))).over(run)})
    seen = F.coalesce((_c("dup_at") <= _c("stop")) | (_c("dup_at").isNotNull() & _c("stop").isNull()), F.lit(False)).cast("int")
    out = rows.withColumn("itd", F.max(seen).over(_over().orderBy("run")) == 1).where(_c("kind").isNotNull() & (_c("n") == _c("stop")))
    one_lit = F.lit(1.0)
    return out.select(
        "contig", "id", "n", "kind", "itd", "qlen",
        *_end("a", ort=_c("ort"), tname=_c("tname"), tstart=_c("ts1"), tend=_c("te1"), tpos=_c("pa"), qstart=_c("qs1"), qend=_c("qe1"), qpos=_c("qa"), qstrand=strand, matches=_c("m1"), percent=one_lit),
        *_end("b", ort=-_c("ort"), tname=_c("tname"), tstart=_c("ts2"), tend=_c("te2"), tpos=_c("pb"), qstart=_c("qs2"), qend=_c("qe2"), qpos=_c("qb"), qstrand=strand, matches=_c("m2"), percent=one_lit))


def _trim(blocks: Column, skipped) -> Column:
    """(gone, at): the bases of the leading blocks that `skipped` holds for, and the first other block, null without one."""
    start = F.struct(F.lit(0).cast("long").alias("gone"), F.lit(None).cast("struct<t:bigint,q:bigint,len:bigint>").alias("at"))
    return F.aggregate(blocks, start, lambda acc, b: F.when(acc["at"].isNotNull(), acc).when(
        skipped(b), F.struct((acc["gone"] + b["len"]).alias("gone"), acc["at"].alias("at"))).otherwise(F.struct(acc["gone"].alias("gone"), b.alias("at"))))


def partial_hits(hits: DataFrame, sites: DataFrame, triage: DataFrame, contigs: DataFrame, least: int = MIN_HIT) -> DataFrame:
    """The hit of each good contig that ends at its site, trimmed to it: contig, id, the columns of END, repeat, overhang and junction.

    Hits on the site's target are tried in order, whole ones left out; what lies beyond the site is cut off by blocks. The end must
    come within 50 bases of the site, keep `least` bases and 80 % of its range; the last run with one counts. repeat is
    1 - matches / the sum of the matches of all hits tried (of other targets the first of each run). overhang is the contig's
    sequence (contigs: contig, seq) beyond the hit, junction its first 25 bases. Contigs without sequence have nulls there.
    """
    good = triage.where(~_c("bad")).select("contig", "best")
    rows = hits.join(sites, "contig").join(good, "contig").where(_c("qend") - _c("qstart") >= least)
    identity = (_c("matches") - _c("mismatches")) / (_c("qend") - _c("qstart") + 1)
    rows = rows.where(~(_whole(least) & (identity > 0.9)))
    site, clip, strand, blocks = _c("sc_site"), _c("clip"), _c("qstrand"), _c("blocks")
    here = _bare(_c("tname")) == _bare(_c("sc_chrom"))
    right = _trim(F.reverse(blocks), lambda b: b["t"] > site)
    left = _trim(blocks, lambda b: b["t"] + b["len"] < site)
    cut_right, cut_left = (clip > 0) & (_c("tend") > site), (clip < 0) & (_c("tstart") < site)
    rows = rows.withColumn("w", F.when(cut_right, right).when(cut_left, left))
    at = _c("w.at")
    over = F.when(cut_right, at["t"] + at["len"] - site).when(cut_left, site - at["t"])
    rows = rows.withColumns({
        "m": _c("matches") - F.coalesce(_c("w.gone"), F.lit(0)) - F.coalesce(over, F.lit(0)),
        "te": F.when(cut_right, site).otherwise(_c("tend")), "ts": F.when(cut_left, site).otherwise(_c("tstart")),
        "qe0": F.when(cut_right & (strand > 0) & at.isNotNull(), at["q"] + at["len"] - over).otherwise(_c("qend")),
        "qs0": F.when(cut_right & (strand < 0) & at.isNotNull(), at["q"] - at["len"] + over).otherwise(_c("qstart"))})
    kept = (_c("qe0") - _c("qs0") >= least) & (_c("m") >= least) & F.when(clip > 0, (site - _c("te") <= 50) & (_c("ts") <= site - least)).otherwise(
        (_c("ts") - site <= 50) & (_c("te") >= site + least))
    forward = clip * strand > 0
    rows = rows.withColumns({"qs": F.when(forward, _c("qstart")).otherwise(_c("qend") - _c("m")), "qe": F.when(forward, _c("qstart") + _c("m")).otherwise(_c("qend"))})
    part = F.try_divide(_c("m"), _c("qe") - _c("qs") + 1)
    rows = rows.withColumns({"here": here, "ok": F.coalesce(here & kept & (part >= 0.8), F.lit(False)), "part": part})
    rows = rows.withColumns({"hit": F.min(F.when(_c("ok"), _c("n"))).over(_over("run")), "first": F.min("n").over(_over("run"))})
    tried = F.when(_c("here"), _c("hit").isNull() | (_c("n") <= _c("hit"))).otherwise(_c("n") == _c("first"))  # a run has one target
    rows = rows.withColumns({"last": F.max("hit").over(_over()), "total": F.sum(F.when(tried, _c("matches"))).over(_over())})
    found = rows.where(_c("n") == _c("last")).join(contigs.select("contig", "seq"), "contig", "left")
    ort = F.when(_c("qs") + _c("qe") > _c("qlen"), -1).otherwise(1)
    overhang = F.when(ort < 0, F.substring("seq", F.lit(1), _c("qs") + 1)).otherwise(_c("seq").substr(_c("qe"), F.length("seq")))
    junction = F.when(F.length("overhang") <= 25, _c("overhang")).when(_c("ort") < 0, _c("seq").substr(_c("qstart") - 23, F.lit(25))).otherwise(_c("seq").substr(_c("qend"), F.lit(25)))
    out = found.select("contig", "id", "n", "qlen", "best", "sc_chrom", "sc_site", "clip", ort.alias("ort"), "tname", _c("ts").alias("tstart"), _c("te").alias("tend"),
                       F.when(clip > 0, _c("te")).otherwise(_c("ts")).alias("tpos"), _c("qs").alias("qstart"), _c("qe").alias("qend"),
                       F.when(ort > 0, _c("qe")).otherwise(_c("qs")).alias("qpos"), "qstrand", _c("m").alias("matches"), _c("part").alias("percent"),
                       (1 - _c("m") / _c("total")).alias("repeat"), overhang.alias("overhang"), "seq")
    return out.withColumn("junction", junction).drop("seq")


def _paired(pm: DataFrame, hits: DataFrame, *more: Column) -> DataFrame:
    """Each row of `pm` (key, contig, columns of END as p_) with all hits of its contig."""
    return pm.select("key", "contig", *[_c(c).alias(f"p_{c}") for c in END], *more).join(hits, "contig")


def overhang_local(pm: DataFrame, hits: DataFrame, read_len: int, least: int = MIN_HIT, min_distance: int = MIN_DISTANCE) -> DataFrame:
    """Partners of partial hits on their own target: key, contig, id, n and the columns of END of each partner.

    pm has a unique `key`. A hit that overlaps the partial hit is trimmed to its end by blocks. Partners lie on the other
    side of the end, at most read_len - 25 bases off along the contig, and have 99 % identity or 75 % with over `least` matches. Where a
    partner that completes the contig is nearer than `min_distance` on the target, farther ones of its run go. A pm one of whose runs
    has no partner gets none.
    """
    rows = _paired(pm, hits).where(_no_key(_bare(_c("tname")) == _bare(_c("p_tname"))))
    qpos, strand, blocks = _c("p_qpos"), _c("qstrand"), _c("blocks")
    overlap = F.when(_c("p_ort") > 0, (_c("qstart") < qpos) & (_c("qend") > qpos + 10)).otherwise((_c("qend") > qpos) & (_c("qstart") < qpos - 10))
    same = (F.abs(_c("qstart") - _c("p_qstart")) < 25) & (_c("qend") < 25)
    side = -_c("p_ort") * strand
    from_right = _trim(F.reverse(blocks), lambda b: F.when(strand > 0, b["q"] > qpos).otherwise(b["q"] < qpos))
    from_left = _trim(blocks, lambda b: F.when(strand > 0, b["q"] + b["len"] < qpos).otherwise(b["q"] - b["len"] > qpos))
    rows = rows.withColumn("w", F.when(overlap, F.when(side > 0, from_right).otherwise(from_left)))
    at = _c("w.at")
    over = F.when(side > 0, F.when(strand > 0, at["q"] + at["len"] - qpos).otherwise(qpos - at["q"])).otherwise(F.when(strand > 0, qpos - at["q"]).otherwise(at["q"] - qpos))
    cut = at.isNotNull() & (over >= 0)
    low_moves = cut & F.when(side > 0, strand < 0).otherwise(strand > 0)
    high_moves = cut & F.when(side > 0, strand > 0).otherwise(strand < 0)
    rows = rows.withColumns({
        "m": _c("matches") - F.coalesce(_c("w.gone"), F.lit(0)) - F.when(cut, over).otherwise(0),
        "te": F.when(cut & (side > 0), at["t"] + at["len"] - over + 1).otherwise(_c("tend")), "ts": F.when(cut & (side < 0), at["t"] + over + 1).otherwise(_c("tstart")),
        "qs": F.when(low_moves, qpos).otherwise(_c("qstart")), "qe": F.when(high_moves, qpos).otherwise(_c("qend"))})
    rows = rows.withColumns({"ort": F.when(_c("qs") + _c("qe") < 2 * qpos, 1).otherwise(-1), "part": F.try_divide(_c("m") - _c("mismatches"), _c("qe") - _c("qs") + 1)})
    rows = rows.withColumns({"tpos": F.when(strand * _c("ort") < 0, _c("ts")).otherwise(_c("te")), "at_q": F.when(_c("ort") < 0, _c("qs")).otherwise(_c("qe"))})
    other = (_c("ort") != _c("p_ort")) & ~((_c("p_qstart") > _c("qs") - 10) & (_c("p_qend") < _c("qe") + 10))
    good = ((_c("part") >= 0.99) & (_c("m") > 25)) | ((_c("m") > least) & (_c("part") > 0.75))
    kept = ~same & other & (F.abs(_c("at_q") - qpos) <= read_len - 25) & F.coalesce(good, F.lit(False))
    rows = rows.withColumns({"kept": kept, "dist": F.abs(_c("tpos") - _c("p_tpos"))})
    completes = _c("kept") & (_c("qlen") - (_c("p_matches") + _c("m")) < least)
    run = _over("key", "run")
    near = F.min(F.when(completes & (_c("dist") < min_distance), _c("dist"))).over(run)
    rows = rows.withColumns({"partners": F.count_if("kept").over(run), "nearest": F.coalesce(near, F.lit(min_distance))})
    rows = rows.withColumn("fewest", F.min("partners").over(_over("key")))
    out = rows.where(_c("kept") & (_c("fewest") > 0) & ((_c("nearest") >= min_distance) | (_c("dist") <= _c("nearest"))))
    return out.select("key", "contig", "id", "n", "ort", "tname", _c("ts").alias("tstart"), _c("te").alias("tend"), "tpos", _c("qs").alias("qstart"), _c("qe").alias("qend"),
                      F.when(_c("ort") > 0, _c("qs")).otherwise(_c("qe")).alias("qpos"), "qstrand", _c("m").alias("matches"), _c("part").alias("percent"))


def overhang_remote(pm: DataFrame, hits: DataFrame, least: int = MIN_HIT) -> DataFrame:
    """Partners of partial hits on other targets: key, contig, id, n and the columns of END of each partner.

    pm has a unique `key` and `overhang`. The best hit of the overhang is the longest that starts (or ends) between 15 bases before
    and 50 after the partial hit's end; it needs 90 % identity. Partners have at most 10 matches fewer, 90 %, and overlap the partial hit by
    at most 15 bases or leave a gap of at most 50.
    """
    rows = _paired(pm, hits, F.length("overhang").alias("over_len")).where(_c("matches") >= least).withColumn("part", _percent())
    turned = F.when(_c("qstart") + _c("qend") > 2 * _c("p_qpos"), -1).otherwise(1) != _c("p_ort")
    next_to = F.when(_c("p_ort") > 0, (_c("qstart") > _c("p_qend") - 15) & (_c("qstart") < _c("p_qend") + 50)).otherwise(
        (_c("qend") < _c("p_qstart") + 15) & (_c("qend") > _c("p_qstart") - 50))
    # Hits come by matches, most first: the longest sets the length, and of those that reach it the last sets the identity.
    tried = turned & next_to
    rows = rows.withColumn("length", F.least(F.max(F.when(tried, _c("matches"))).over(_over("key")), _c("over_len")))
    last = F.max(F.when(tried & (_c("matches") >= _c("length")), F.struct("n", "part"))).over(_over("key"))["part"]
    rows = rows.withColumn("best_part", last).where((_c("length") > 0) & (_c("best_part") >= 0.9))
    ort = F.when(_c("qstart") + _c("qend") > _c("qlen"), -1).otherwise(1)
    gap = F.when(_c("p_ort") > 0, _c("qstart") - _c("p_qend")).otherwise(_c("p_qstart") - _c("qend"))
    far = rows.where((_bare(_c("tname")) != _bare(_c("p_tname"))) & (_c("matches") >= _c("length") - 10) & (_c("part") >= 0.9)
                                       & (ort != _c("p_ort")) & (gap >= -15) & (gap <= 50) & (_c("p_matches") >= least))
    return far.select("key", "contig", "id", "n", ort.alias("ort"), "tname", "tstart", "tend", F.when(ort * _c("qstrand") > 0, _c("tend")).otherwise(_c("tstart")).alias("tpos"),
                      "qstart", "qend", F.when(ort > 0, _c("qend")).otherwise(_c("qstart")).alias("qpos"), "qstrand", "matches", _c("part").alias("percent"))


def overhang_second(pm: DataFrame, hits: DataFrame, least: int = MIN_HIT, min_distance: int = MIN_DISTANCE) -> DataFrame:
    """Partners of partial hits among second-pass hits of their overhangs: key, contig, id, n, the columns of END and repeat.

    `hits` are those of the overhang (contig: that of pm; qlen: its length). The nearest good hit within `min_distance` of the
    partial hit, at most 50 bases off along the contig, is taken alone, with repeat 0; without one, all hits of the greatest length that have
    80 % identity (and 80 % of the overhang or 98 %), with repeat 1 - length / the matches of all hits of 90 %.
    """
    rows = _paired(pm, hits).where(_c("matches") >= least).withColumn("part", _percent())
    shift = F.when(_c("p_ort") > 0, _c("p_qend")).otherwise(0)
    rows = rows.withColumns({"ort": -_c("p_ort"), "qs": _c("qstart") + shift, "qe": _c("qend") + shift})
    end_dist = F.least(F.abs(_c("tstart") - _c("p_tpos")), F.abs(_c("tend") - _c("p_tpos")))
    beside = F.when(_c("p_ort") > 0, F.abs(_c("qs") - _c("p_qend")) < 50).otherwise(F.abs(_c("qe") - _c("p_qstart")) < 50)
    near = (_c("tname") == _c("p_tname")) & (end_dist < min_distance)
    good = _c("part") >= 0.9
    dist = F.when(good & near, end_dist)
    before = F.min(dist).over(_over("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    taken = good & (~near | before.isNull() | (end_dist <= before))  # a hit near the end counts if none before it is nearer
    rows = rows.withColumns({"near": near, "good": good, "taken": taken, "beside": beside})
    key = _over("key")
    rows = rows.withColumns({"length": F.max(F.when(_c("taken"), _c("matches"))).over(key), "total": F.sum(F.when(_c("good"), _c("matches"))).over(key),
                             "pick": F.max(F.when(_c("taken") & _c("near") & _c("beside"), _c("n"))).over(key)})
    score = 1 - _c("length") / _c("total")
    enough = (_c("part") >= 0.8) & ((_c("matches") >= 0.8 * _c("qlen")) | (_c("part") >= 0.98)) & (_c("matches") == _c("length"))
    out = rows.where(_c("length").isNotNull()).where(F.when(_c("pick").isNotNull(), _c("n") == _c("pick")).otherwise(enough))
    return out.select("key", "contig", "id", "n", "ort", "tname", "tstart", "tend", F.when(_c("ort") * _c("qstrand") > 0, _c("tend")).otherwise(_c("tstart")).alias("tpos"),
                      _c("qs").alias("qstart"), _c("qe").alias("qend"), F.when(_c("ort") > 0, _c("qe")).otherwise(_c("qs")).alias("qpos"), "qstrand", "matches", _c("part").alias("percent"),
                      F.when(_c("pick").isNotNull(), 0.0).otherwise(score).alias("repeat"))


def choose_pairs(rows: list[dict], most: int, read_len: int, least: int, min_distance: int) -> list[dict]:
    """The pairs that stay of one site's: `events` within hits first, then the candidates of each contig in order (see `detect_pairs`)."""
    events = [r for r in rows if r["step"] == 0]
    total = lambda r: r["matchesa"] + r["matchesb"]
    apart = lambda r: abs(r["tposa"] - r["tposb"])
    n, bad, mapped = rows[0]["n_contigs"], rows[0]["n_bad"], rows[0]["n_mapped"]
    kept = sorted(events, key=lambda r: (r["place"], r["n"]))
    whole = any(not r["itd"] and total(r) > r["qlen"] - least and apart(r) < min_distance for r in kept)
    contigs: dict = {}
    for r in sorted((r for r in rows if r["step"]), key=lambda r: (r["place"], r["step"], r["n"])):
        contigs.setdefault(r["contig"], []).append(r)
    if (whole and n == bad + mapped) or not contigs:
        return kept
    cells: dict = {}  # places in `kept`, in order, by both targets and both positions in steps of 50; each pair either way round

    def held(r):
        return [(r[f"tname{x}"], r[f"tname{y}"], r[f"tpos{x}"] // 50, r[f"tpos{y}"] // 50) for x, y in ("ab", "ba")]

    def note(i):
        for cell in set(held(kept[i])):
            bisect.insort(cells.setdefault(cell, []), i)

    def near_one(r):
        """The first of `kept` within 50 bases of both ends, either way round."""
        found = []
        for da, db in itertools.product((-1, 0, 1), repeat=2):
            near = cells.get((r["tnamea"], r["tnameb"], r["tposa"] // 50 + da, r["tposb"] // 50 + db), ())
            found.append(next((i for i in near if any(
                r["tnamea"] == kept[i][f"tname{x}"] and r["tnameb"] == kept[i][f"tname{y}"] and abs(r["tposa"] - kept[i][f"tpos{x}"]) < 50 and abs(r["tposb"] - kept[i][f"tpos{y}"]) < 50
                for x, y in ("ab", "ba"))), None))
        return min((i for i in found if i is not None), default=None)

    by_contig: dict = {}
    for r in events:
        by_contig.setdefault(r["contig"], []).append(r)
    for i in range(len(kept)):
        note(i)
    for contig, found in contigs.items():
        own = by_contig.get(contig, [])
        best_local = max(map(total, own), default=0)
        done = any(not r["itd"] and r["matchesa"] + r["matchesb"] / r["qlen"] > 0.99 for r in own)
        local = [] if done else [r for r in found if r["step"] == 1]
        for r in local:
            if best_local >= total(r) or apart(r) > min_distance:
                continue
            best_local = total(r)
            done = done or min(r["matchesa"], r["matchesb"]) > 2 * least or best_local > r["qlen"] - least
        others = [] if done else [r for r in found if r["step"] == 2]
        if not done and not others and not local:
            others = [r for r in found if r["step"] == 3]
        wanted = []
        for r in local + others:
            near = r["tnamea"] == r["tnameb"] and apart(r) < min_distance
            if (near and not r["site_mapped"] and total(r) < best_local) or (not near and total(r) < best_local + 5):
                continue
            wanted.append((r, near))
        if not wanted or (len(wanted) >= most and wanted[0][0]["qlen"] < read_len + 5):
            continue
        floor = sorted((total(r) for r, _ in wanted), reverse=True)[most - 1] if len(wanted) > most else 0
        mine = []
        for r, _ in wanted:
            r = r | {"tposa": r["enda"], "tposb": r["endb"]}
            if total(r) < floor or total(r) < r["best"]:
                continue
            if len(mine) == most:
                break
            if r["tnamea"] == r["tnameb"] and apart(r) < min_distance:
                mine.append(r)
                break
            at = near_one(r)
            if at is not None:
                if r["matchesa"] * r["matchesb"] > kept[at]["matchesa"] * kept[at]["matchesb"]:
                    for cell in set(held(kept[at])):
                        cells[cell].remove(at)
                    kept[at] = r
                    note(at)
                continue
            if r["second"]:
                mine = []
                break
            mine.append(r)
        kept += mine
        for i in range(len(kept) - len(mine), len(kept)):
            note(i)
    return kept


def detect_pairs(hits: DataFrame, sites: DataFrame, contigs: DataFrame, second_hits: DataFrame, read_len: int, most: int = 10, least: int = MIN_HIT,
                 min_distance: int = MIN_DISTANCE) -> DataFrame:
    """Pairs of breakpoints from sorted hits: contig, id, step, itd and both ends (columns of END with a and b), repeata and repeatb.

    step 0 are events within hits over the site (`block_events`). Contigs with a partial hit at the site that are not explained by one get
    partners on its target (1), else on others (2), else from second-pass hits (3). A contig's candidates must reach its local matches and its best hit; those of a
    short contig with `most` or more go, of more only the `most` best stay. A candidate within 50 bases of a pair of the site takes its place if
    the product of its matches is greater; a far one whose second end explains the contig as well on that target ends the contig without
    pairs, a near one ends it with that. Where an event explains a site and all its contigs are bad or map over it, only events stay. Contigs come by
    length, the longest first, and name. Only the last step sees all pairs of a site together. Hits and intermediate tables are written by contig to the
    folder of spark.checkpoint.dir.
    """
    hits = written_by(hits, "hits", "contig")  # read by every step below; these write by contig as well, so that no step moves the hits
    triage = written_by(triage_contigs(hits, sites, read_len, least), "triage", "contig")
    events = block_events(hits, sites, triage.where("site_mapped"), least)
    pm = written_by(partial_hits(hits, sites, triage, contigs, least).withColumn("key", _c("contig")), "partial", "contig")
    b_end = ["contig", "id", "n", *[_c(c).alias(f"{c}b") for c in END]]
    partners = overhang_local(pm, hits, read_len, least, min_distance).select(F.lit(1).alias("step"), *b_end, F.lit(None).cast("double").alias("repeat2"))
    partners = partners.unionByName(overhang_remote(pm, hits, least).select(F.lit(2).alias("step"), *b_end, F.lit(None).cast("double").alias("repeat2")))
    partners = partners.unionByName(overhang_second(pm, second_hits, least, min_distance).select(F.lit(3).alias("step"), *b_end, _c("repeat").alias("repeat2")))
    a_end = pm.select("contig", "sc_site", "qlen", "best", _c("repeat").alias("repeat1"), *[_c(c).alias(f"{c}a") for c in END])
    pairs = a_end.join(partners, "contig").withColumn("key", F.concat_ws("/", _c("contig").cast("string"), "step", _c("n").cast("string")))

    def outer(x: str) -> Column:
        return F.when(_c(f"qstrand{x}") * _c(f"ort{x}") < 0, _c(f"tstart{x}")).otherwise(_c(f"tend{x}"))

    pairs = pairs.withColumns({"enda": outer("a"), "endb": outer("b"), **{f"q{x}": F.when(_c(f"ort{x}") > 0, _c(f"qend{x}")).otherwise(_c(f"qstart{x}")) for x in "ab"}})
    pairs = written_by(pairs, "pairs", "contig")
    first = _c("enda") - _c("sc_site") > 50
    fixed = {"tpos": ("enda", "endb"), "qpos": ("qa", "qb")}
    second = pairs.select("key", "contig", *[F.when(first, _c(fixed.get(c, (f"{c}a",))[0])).otherwise(_c(fixed.get(c, ("", f"{c}b"))[1])).alias(c) for c in END],
                          (_c("matchesa") + _c("matchesb")).alias("sum"), "qlen")
    again = overhang_local(second, hits, read_len, least, min_distance).select("contig", "key", _c("matches").alias("m2"), _c("tpos").alias("t2"))
    both = again.join(second.select("contig", "key", "sum", "qlen", "matches", "tpos"), ["contig", "key"])
    explains = (_c("matches") + _c("m2") >= _c("sum")) | (F.least("matches", "m2") > 2 * least) | (_c("matches") + _c("m2") > _c("qlen") - 2 * least)
    local = both.where((F.abs(_c("t2") - _c("tpos")) <= min_distance) & explains).select("contig", "key").distinct().withColumn("second", F.lit(True))
    pairs = pairs.join(local, ["contig", "key"], "left").withColumns({"second": F.coalesce("second", F.lit(False)), "itd": F.lit(False)})
    fields = ["contig", "id", "n", "step", "itd", "qlen", *[f"{c}{x}" for x in "ab" for c in END if c != "percent"], "repeata", "repeatb"]
    pairs = pairs.withColumns({"repeata": _c("repeat1"), "repeatb": _c("repeat2")}).select(*fields, "enda", "endb", "second", "best")
    none = F.lit(None)
    events = events.withColumns({"step": F.lit(0), "repeata": F.lit(0.0), "repeatb": F.lit(0.0)}).select(
        *fields, none.cast("long").alias("enda"), none.cast("long").alias("endb"), F.lit(False).alias("second"), none.cast("long").alias("best"))
    counted = contigs.select("contig").join(sites, "contig").join(triage.select("contig", "bad", "site_mapped"), "contig", "left")
    per_site = counted.groupBy("sc_chrom", "sc_site", "clip").agg(F.count("*").alias("n_contigs"), F.count_if("bad").alias("n_bad"), F.count_if("site_mapped").alias("n_mapped"))
    where = counted.select("contig", "sc_chrom", "sc_site", "clip", F.coalesce("site_mapped", F.lit(False)).alias("site_mapped")).join(per_site, ["sc_chrom", "sc_site", "clip"])
    rows = pairs.unionByName(events).join(where, "contig").where(_c("n_contigs") > _c("n_bad"))
    rows = rows.withColumn("place", F.struct(-_c("qlen"), _c("contig")))
    schema = rows.select(*fields).schema

    def choose(table):
        listed = table.to_pylist()
        for r in listed:
            r["place"] = tuple(r["place"].values())
        kept = choose_pairs(listed, most, read_len, least, min_distance)
        return pa.Table.from_pylist([{k: r[k] for k in fields} for r in kept], schema=table.select(fields).schema)

    return rows.groupBy("sc_chrom", "sc_site", "clip").applyInArrow(choose, schema)


def requantify(pairs: DataFrame, events: DataFrame, maps: DataFrame, near: int = 50, cutoff: int = 5, least: int = MIN_HIT) -> DataFrame:
    """Read support of pairs (ord, chra, posa, chrb, posb) on the events of their contigs: ord, event, swapped, readsa, areaa, readsb, areab.

    An event (unique `event`, ord, contig and both ends with tname, tpos, qpos, ort) of a pair counts if both ends lie within `near` bases of the pair's, straight or,
    failing that, swapped. maps are the reads of the pair's sides mapped to its contigs: ord, side (a, b: the end that the read was gathered
    for), contig and the columns of `junction_support`. An end takes the reads of its own side; with no row for that side and contig it has 0 reads and area 1.
    """
    from .evidence import junction_support

    e = events.select("event", "ord", "contig", *[f"{c}{x}" for x in "ab" for c in ("tname", "tpos", "qpos", "ort")])

    def fits(x: str, y: str) -> Column:
        return ((_c("chra") == _c(f"tname{x}")) & (F.abs(_c("posa") - _c(f"tpos{x}")) < near) & (_c("chrb") == _c(f"tname{y}")) & (F.abs(_c("posb") - _c(f"tpos{y}")) < near))

    matched = pairs.select("ord", "chra", "posa", "chrb", "posb").join(e, "ord").withColumn("straight", fits("a", "b")).where(_c("straight") | fits("b", "a"))
    ends = matched.select("event", "ord", "contig", "straight", F.explode(F.array(*[F.struct(
        F.lit(x).alias("end"), F.when(_c("straight"), F.lit(x)).otherwise(F.lit(y)).alias("side"), _c(f"qpos{x}").alias("pos"), _c(f"ort{x}").alias("ort")) for x, y in ("ab", "ba")])).alias("p"))
    place = F.concat_ws("/", _c("ord").cast("string"), "side", _c("contig").cast("string"))  # the reads of one side on one contig
    points = ends.select("event", "ord", "straight", "contig", "p.*").withColumns({"key": F.concat_ws("/", _c("event").cast("string"), "end"), "place": place})
    read = maps.withColumn("place", place).drop("contig").withColumnRenamed("place", "contig")
    support = junction_support(read, points.select("key", _c("place").alias("contig"), "pos", "ort"), "key", cutoff, least)
    known = read.select(_c("contig").alias("place")).distinct().withColumn("known", F.lit(True))
    rows = points.join(support, "key").join(known, "place", "left").withColumn("area", F.when(_c("known"), _c("support")).otherwise(1))
    pick = lambda c, x: F.max(F.when(_c("end") == x, _c(c)))
    return rows.groupBy("ord", "event", (~_c("straight")).alias("swapped")).agg(pick("reads", "a").alias("readsa"), pick("area", "a").alias("areaa"), pick("reads", "b").alias("readsb"), pick("area", "b").alias("areab"))
