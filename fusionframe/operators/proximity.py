"""Ordered folds over near pairs, offset lookups and row bookkeeping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sweep import running_max, runs_by_gap

NEAR = 10


class _Places:
    """Kept entries by cells of both ends, so that a row meets those around it only, however many lie along one end."""

    def __init__(self, near: int):
        self.near, self.cells = near, {}

    def put(self, group: tuple, x: int, y: int, name, value=None) -> None:
        self.cells.setdefault((group, x // self.near, y // self.near), {})[name] = (x, y, value)

    def drop(self, group: tuple, x: int, y: int, name) -> None:
        del self.cells[(group, x // self.near, y // self.near)][name]

    def close(self, group: tuple, x: int, y: int):
        """(name, value) of the entries less than `near` away at both ends."""
        near, cx, cy = self.near, x // self.near, y // self.near
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                for name, (px, py, value) in self.cells.get((group, i, j), {}).items():
                    if abs(px - x) < near and abs(py - y) < near:
                        yield name, value


class FoldRaw:
    """Rows in order: a kept near pair drops a row; a swapped one too, and takes its first end as second end. Kept rows come at the end, as they may change."""

    def __init__(self, near: int):
        self.places, self.rows = _Places(near), []

    def add(self, r: tuple) -> bool:
        _, chra, posa, chrb, posb = r[:5]
        found = [(i, 0) for i, _ in self.places.close((chra, chrb), posa, posb)] + [(i, 1) for i, _ in self.places.close((chrb, chra), posb, posa)]
        if not found:
            self.places.put((chra, chrb), posa, posb, len(self.rows))
            self.rows.append(r)
            return False
        i, swapped = min(found)
        if swapped:
            k = self.rows[i]
            self.places.drop((k[1], k[3]), k[2], k[4], i)
            self.places.put((k[1], k[3]), k[2], posa, i)
            self.rows[i] = (*k[:4], posa, *k[5:])
        return False

    def rest(self) -> list[tuple]:
        return self.rows


class FoldBest:
    """Rows in order: dropped if a kept near pair has more reads (rank), or as many reads or as many matches (annotated). A null sum compares with none.

    The most reads and matches kept at a place decide, so places are held and not rows, and rows that stay go out at once.
    """

    def __init__(self, near: int, rank: bool):
        self.places, self.rank = _Places(near), rank

    def add(self, r: tuple) -> bool:
        group, x, y = (r[1], r[3]), r[2], r[4]
        reads, matches = (None if None in v else sum(v) for v in (r[5:7], r[7:9]))
        here = (None, None)
        for name, kept in self.places.close(group, x, y):
            if self._drops(reads, matches, kept):
                return False
            if name == (x, y):
                here = kept
        best = tuple(max((v for v in pair if v is not None), default=None) for pair in zip(here, (reads, matches)))
        self.places.put(group, x, y, (x, y), best)
        return True

    def _drops(self, reads, matches, kept: tuple) -> bool:
        more = reads is not None and kept[0] is not None
        if self.rank:
            return more and kept[0] > reads
        return (more and kept[0] >= reads) or (matches is not None and kept[1] is not None and kept[1] >= matches)

    def rest(self) -> list[tuple]:
        return []


class FoldCandidates:
    """Rows in order: each replaces the first kept row near it, either way round, if its product of matches is greater; without one near, it is kept."""

    def __init__(self, near: int):
        self.places, self.rows = _Places(near), []

    def add(self, r: tuple) -> bool:
        _, chra, posa, chrb, posb, matcha, matchb = r
        ends = [(posa, posb), (posb, posa)]
        spots = ends if chra == chrb else ends[:1] if chra < chrb else ends[1:]
        found = {i for x, y in spots for i, _ in self.places.close((), x, y)}
        if not found:
            self.places.put((), *spots[0], len(self.rows))
            self.rows.append((*spots[0], r[0], matcha * matchb))
            return False
        i = min(found)
        if matcha * matchb > self.rows[i][3]:
            self.places.drop((), *self.rows[i][:2], i)
            self.places.put((), *spots[0], i)
            self.rows[i] = (*spots[0], r[0], matcha * matchb)
        return False

    def rest(self) -> list[tuple]:
        return [(k[2],) for k in self.rows]


def _folded(blocks: DataFrame, fields: list[str], out: list[str], make, batch_rows: int = 10_000) -> DataFrame:
    """The rows `out` that the folds of all blocks keep. A block's rows come as a stream in order of `ord`; only what its fold keeps is held."""
    keys = ["c1", "c2", "block"]
    schema = blocks.select(*out).schema
    ordered = blocks.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys, "ord")

    def run(batches):
        at, fold, types = None, None, None

        def tables(rows):
            for i in range(0, len(rows), batch_rows):
                columns = zip(*rows[i:i + batch_rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], out)

        for batch in batches:
            types = [batch.schema.field(f).type for f in out]
            kept = []
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            for name, row in zip(names, zip(*(batch.column(f).to_pylist() for f in fields))):
                if name != at:
                    kept += fold.rest() if fold else []
                    at, fold = name, make()
                if fold.add(row):
                    kept.append(row)
            yield from tables(kept)
        if fold:
            yield from tables(fold.rest())

    return ordered.mapInArrow(run, schema)


def _near_blocks(rows: DataFrame, near: int) -> DataFrame:
    """Add c1, c2 (the chroms in order) and `block`: rows of different blocks are at least `near` apart at the end on c1 (the lower one on one chrom)."""
    place = F.when(F.col("chra") == F.col("chrb"), F.least("posa", "posb")).when(F.col("chra") < F.col("chrb"), F.col("posa")).otherwise(F.col("posb"))
    keyed = rows.select("*", F.least("chra", "chrb").alias("c1"), F.greatest("chra", "chrb").alias("c2"), place.alias("place"))
    return runs_by_gap(keyed, ["c1", "c2"], "place", near, "block").drop("place")


def dedupe_pairs(pairs: DataFrame, mode: str = "raw", near: int = NEAR) -> DataFrame:
    """Greedy proximity de-duplication in order of the unique column `ord` (see `FoldRaw`, `FoldBest`).

    Near pairs, direct or swapped, lie on one unordered pair of chroms at places less than `near` apart, so the
    rows are cut where that place jumps by `near` or more, and each block is folded alone. Rows with null ends go.
    """
    fields = ["ord", "chra", "posa", "chrb", "posb", "readsa", "readsb", "matcha", "matchb"]
    rows = pairs.select(*fields).dropna(subset=["ord", "chra", "posa", "chrb", "posb"])
    return _folded(_near_blocks(rows, near), fields, fields, lambda: FoldRaw(near) if mode == "raw" else FoldBest(near, mode == "rank"))


def merge_candidates(pairs: DataFrame, near: int = 50) -> DataFrame:
    """Ordered merge by the unique column `ord`: of pairs within `near` at both ends, either way round, the greater product of matches takes the place (see `FoldCandidates`).

    Rows are cut into blocks that no near pair crosses, as in `dedupe_pairs`, and each block is folded alone; rows with null ends or matches go.
    """
    fields = ["ord", "chra", "posa", "chrb", "posb", "matcha", "matchb"]
    rows = pairs.select(*fields).dropna(subset=fields)
    return pairs.join(_folded(_near_blocks(rows, near), fields, ["ord"], lambda: FoldCandidates(near)), "ord", "left_semi")


def merge_sites(sites: DataFrame, key: list[str], count: str, order: str) -> DataFrame:
    """Of rows with one key, the last by `order` whose count is over 0."""
    rest = [c for c in sites.columns if c not in key]
    last = sites.where(F.col(count) > 0).groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(*key, "r.*")


def offset_lookup(points: DataFrame, sites: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, offset, site columns) of the site at a point (chrom, side, pos): exact first, then the offsets from -most up."""
    shifts = F.explode(F.array(*[F.lit(d) for d in range(-most, most + 1)]))
    near = points.select(key, "chrom", "side", "pos", shifts.alias("offset")).withColumn("pos", F.col("pos") + F.col("offset"))
    rest = [c for c in sites.columns if c not in ("chrom", "side", "pos")]
    hit = near.join(sites, ["chrom", "side", "pos"])
    first = F.min_by(F.struct("offset", *rest), F.struct(F.col("offset") != 0, F.col("offset")))
    return hit.groupBy(key).agg(first.alias("r")).select(key, "r.*")


def top_hits(hits: DataFrame, k: int, read_len: int) -> DataFrame:
    """The hits (contig, ord, matches, qlen, best) of each contig that reach its k-th most matches and `best`, the first k of them by `ord`.

    A contig with k hits or more and under read_len + 5 bases is left out; with up to k hits only `best` is asked.
    """
    every = Window.partitionBy("contig")
    ranked = hits.withColumns({"_n": F.count("*").over(every), "_r": F.row_number().over(every.orderBy(F.desc("matches"), "ord"))})
    ranked = ranked.withColumn("_least", F.max(F.when(F.col("_r") == k, F.col("matches"))).over(every))
    kept = ranked.where(~((F.col("_n") >= k) & (F.col("qlen") < read_len + 5)) & ((F.col("_n") <= k) | (F.col("matches") >= F.col("_least"))) & (F.col("matches") >= F.col("best")))
    return kept.withColumn("_i", F.row_number().over(every.orderBy("ord"))).where(F.col("_i") <= k).drop("_n", "_r", "_least", "_i")


def chunk_by_sum(counts: list[int], limit: int) -> list[int]:
    """Chunk numbers from 1: a new one once the counts since its opening row, which adds nothing, are over `limit`."""
    out, chunk, total = [], 0, 0
    for n in counts:
        if chunk == 0 or total > limit:
            chunk, total = chunk + 1, 0
        else:
            total += n
        out.append(chunk)
    return out


def split_rows(rows: DataFrame, order: str, step: int, by: str) -> DataFrame:
    """Add `part`: rows of each `by` in runs of `step` by `order`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("part", F.floor((n - 1) / step).cast("long"))


def drop_pcr_dups(reads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One read, the first by `order`, of those alike in start, end, mate start, mate end and clip."""
    rest = [c for c in reads.columns if c not in keys]
    return reads.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def sample_fragments(reads: DataFrame, site: list[str], fragment: list[str], most: int = 2000, seed: int = 100001) -> DataFrame:
    """One row of each fragment, and of each site's fragments about `most`, chosen by a seeded hash of the fragment.

    The choice is the feature: a site with at most `most` fragments keeps all.
    """
    rest = [c for c in reads.columns if c not in {*site, *fragment}]
    one = reads.groupBy(*site, *fragment).agg(F.min(F.struct(*rest)).alias("r")) if rest else reads.select(*site, *fragment).distinct()
    size = one.groupBy(*site).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(*fragment, F.lit(seed)), F.lit(1_000_000)) / 1e6
    kept = one.join(size, site).where(place * F.col("_n") < most)
    return kept.select(*site, *fragment, *(["r.*"] if rest else []))


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Different unordered pairs (x, y) of two columns."""
    return rows.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def prune_nested(ranges: DataFrame, key: str, group: str) -> DataFrame:
    """Ranges of a group not contained in another one of it (of equal ones the first by `key` stays); `key` is unique, positions are whole numbers."""
    # a row is nested if one before it, of rows with lower starts and of equal starts with greater ends first, reaches its end
    rows = ranges.select(F.col(group).alias("_g"), F.col(key).alias("_k"), "st", "en").dropna().withColumn("_back", -F.col("en"))
    reach = running_max(rows, ["_g"], "st", ["_back", "_k"], {"reach": F.col("en")})
    nested = reach.where(F.col("reach") >= F.col("en")).select(F.col("_k").alias(key)).distinct()
    return ranges.join(nested, key, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: str, no_empty: bool = False, no_zero: bool = False) -> DataFrame:
    """Base rows with the columns that differ taken from delta, and delta's new rows; empty or zero values can be left out."""
    def fresh(c):
        value = F.col(f"d.{c}")
        if no_empty:
            value = F.when(value.cast("string") != "", value)
        if no_zero:
            value = F.when(value.cast("string") != "0", value)
        return F.coalesce(value, F.col(f"b.{c}")) if no_empty or no_zero else F.when(F.col(f"d.{key}").isNotNull(), value).otherwise(F.col(f"b.{c}"))
    joined = base.alias("b").join(delta.alias("d"), F.col(f"b.{key}") == F.col(f"d.{key}"), "full")
    return joined.select(F.coalesce(f"d.{key}", f"b.{key}").alias(key), *[fresh(c).alias(c) for c in base.columns if c != key])


def drop_header_rows(rows: DataFrame, column: str) -> DataFrame:
    """Without the header rows that concatenated files repeat."""
    return rows.where(F.col(column).isNull() | (F.col(column).cast("string") != column))


def name_conflicts(left: DataFrame, right: DataFrame, cooked) -> DataFrame:
    """(name, spellings) of names that two sources spell differently, compared by the column function `cooked`."""
    both = left.select(F.col(left.columns[0]).alias("raw")).union(right.select(right.columns[0])).distinct()
    spelled = both.groupBy(cooked(F.col("raw")).alias("name")).agg(F.array_join(F.array_sort(F.collect_set("raw")), ",").alias("spellings"), F.count("*").alias("n"))
    return spelled.where("n > 1").drop("n")
