"""Hard negatives by best-first search in STR-packed R-trees."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize
from .topk import quantize

LEAF, FAN = 128, 8
TILE_BYTES = 32 << 20
CHUNK = 8192
#: The fit of the tiles' cuts reads about so many vectors, and at most so many numbers.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000


def str_order(x: np.ndarray, leaf: int, dims: int = 3) -> np.ndarray:
    """Order of the rows by sort-tile-recursive: slabs of the widest coordinate, in each slabs of the next, leaves in order of the last."""
    if not x.shape[1]:
        return np.arange(len(x))
    wide = np.argsort(-np.var(x.astype(np.float64), axis=0), kind="stable")[:dims]

    def tile(rows, axes):
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        if len(axes) == 1 or len(rows) <= leaf:
            return [rows]
        pages = -(-len(rows) // leaf)
        size = leaf * -(-pages // int(np.ceil(pages ** (1 / len(axes)))))
        return [part for i in range(0, len(rows), size) for part in tile(rows[i:i + size], axes[1:])]
    return np.concatenate(tile(np.arange(len(x)), list(wide)))


class Tree:
    """Rows in STR order with minimum bounding boxes, level by level: leaves of `leaf` rows, above them `fan` boxes each."""

    def __init__(self, ids, labels, x, leaf: int = LEAF, fan: int = FAN):
        order = str_order(x, leaf)
        self.ids, self.labels, self.x, self.leaf, self.fan = ids[order], labels[order], x[order], leaf, fan
        heads = np.arange(0, len(x), leaf)
        lo, hi = np.minimum.reduceat(self.x, heads, axis=0), np.maximum.reduceat(self.x, heads, axis=0)
        self.lo, self.hi = [lo.astype(np.float64)], [hi.astype(np.float64)]
        while len(self.lo[-1]) > 1:
            heads = np.arange(0, len(self.lo[-1]), fan)
            self.lo.append(np.minimum.reduceat(self.lo[-1], heads, axis=0))
            self.hi.append(np.maximum.reduceat(self.hi[-1], heads, axis=0))

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level, the least and the greatest inner product of each query with a point of each box, from the coordinates' intervals."""
        plus, minus = np.maximum(q, 0.0), np.minimum(q, 0.0)
        return ([plus @ l.T + minus @ h.T for l, h in zip(self.lo, self.hi)], [plus @ h.T + minus @ l.T for l, h in zip(self.lo, self.hi)])


def best_first(tree: Tree, q, least, most, allowed, windows, floors, k: int, slack: float = 0.0):
    """For each window (lo, hi) of scores the k first allowed rows, best score first, ties by id: lists of (-score, id).

    Boxes come from a queue by their greatest possible score. A box is passed over if for every window its interval misses the window or
    lies strictly below the k-th score found so far (at the start: the window's floor); once that holds
    for the queue's first box and the upper ends, it holds for all.
    """
    found = [[] for _ in windows]
    need = [max(lo, f) for (lo, _), f in zip(windows, floors)]
    top = len(tree.lo) - 1
    queue = [(-most[top][0], top, 0)]
    while queue:
        upper, level, node = heapq.heappop(queue)
        upper = slack - upper
        if upper < min(need):
            break
        lower = least[level][node] - slack
        alive = [w for w, (_, hi) in enumerate(windows) if upper >= need[w] and lower <= hi]
        if not alive:
            continue
        if level:
            width, bound = len(tree.lo[level - 1]), min(need[w] for w in alive)
            for child in range(node * tree.fan, min(width, (node + 1) * tree.fan)):
                value = most[level - 1][child]
                if value + slack >= bound:
                    heapq.heappush(queue, (-value, level - 1, child))
            continue
        rows = slice(node * tree.leaf, (node + 1) * tree.leaf)
        scores, ok = tree.x[rows] @ q, allowed[rows]
        for w in alive:
            hits = np.flatnonzero(ok & (scores >= need[w]) & (scores <= windows[w][1]))
            if len(hits):
                ids = tree.ids[rows][hits]
                found[w] = heapq.nsmallest(k, found[w] + [(-int(s), int(i)) for s, i in zip(scores[hits], ids)])
                if len(found[w]) == k:
                    need[w] = max(need[w], -found[w][-1][0])
    return found


def _matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both as doubles where all products are exact in them, else as Python integers with some slack for the bounds."""
    peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    if peak < 2 ** 53:
        return q.astype(np.float64), x.astype(np.float64), 0.0
    return q.astype(object), x.astype(object), 1e-9 * peak


def _searches(q_table: pa.Table, c_table: pa.Table, width: int):
    """(row of q_table, tree, exact query, bounds, slack) for each query."""
    q, x, slack = _exact(_matrix(q_table, "vec", width), _matrix(c_table, "vec", width))
    tree = Tree(c_table.column("vec_id").to_numpy(), c_table.column("label").to_numpy(), x)
    for at in range(0, len(q), 512):
        least, most = tree.bounds(q[at:at + 512].astype(np.float64))
        for i in range(len(q[at:at + 512])):
            yield at + i, tree, q[at + i], [m[i] for m in least], [m[i] for m in most], slack


def tiled(rows: DataFrame, tile_bytes: int = TILE_BYTES, spread: int = 16) -> DataFrame:
    """Write rows (vec_id, label, vec) with `tile`, a text: STR slabs of two coordinates, cut so that a tile holds at most `tile_bytes`.

    The cuts are fitted on a bounded sample of vectors by a hash of the id; every row gets its tile by them, and a tile with more rows than
    its share (very many equal vectors) is dealt by row number. A small table still gets up to `spread` tiles of 1024 rows. There are
    at most 65536 slabs, whose counts are the only data that go through the driver.
    """
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    per_tile = max(1, min(tile_bytes // (8 * max(1, dim)), max(1024, -(-n // spread))))
    tiles = min(65536, max(1, -(-n // per_tile)))
    wanted = min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = [r.vec for r in rows.where(place < min(1.0, wanted / max(1, n))).where(F.size("vec") == dim).select("vec").limit(2 * wanted).collect()] if tiles > 1 and dim else []
    slab = F.lit(0)
    if sample:
        x = np.array(sample, np.float64)
        a, b = np.argsort(-x.var(axis=0), kind="stable")[[0, -1 if dim == 1 else 1]]
        outer = int(np.ceil(np.sqrt(tiles)))
        inner = -(-tiles // outer)
        cut_a = np.quantile(x[:, a], np.arange(1, outer) / outer)
        where = np.searchsorted(cut_a, x[:, a], side="right")
        cuts_b = [np.quantile(x[where == i, b], np.arange(1, inner) / inner) if (where == i).any() else np.zeros(inner - 1) for i in range(outer)]

        def bucket(cuts: Column, axis) -> Column:
            value = F.coalesce(F.get("vec", F.lit(int(axis))), F.lit(0)).cast("double")
            return F.size(F.filter(cuts, lambda c: c <= value))

        numbers = lambda v: F.array(*[F.lit(float(c)) for c in v]).cast("array<double>")
        first = bucket(numbers(cut_a), a)
        slab = first * inner + bucket(F.get(F.array(*[numbers(c) for c in cuts_b]), first), b)
    placed = materialize(rows.select("vec_id", "label", "vec", slab.cast("int").alias("slab"), F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("uid")), "slabs")
    counts = placed.groupBy("dim", "slab").agg(F.count("*").alias("n")).select("dim", "slab", F.ceil(F.col("n") / per_tile).alias("parts"))
    dealt = placed.join(F.broadcast(counts), ["dim", "slab"])  # at most 65536 slabs of each length of vectors
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    return dealt.select("vec_id", "label", "vec", "dim", F.concat_ws("-", "dim", "slab", part).alias("tile"))


ANCHORS = "tile string, dim int, vec_id long, label long, vec array<long>, floor double, lo array<double>, hi array<double>, a_lo array<double>, a_hi array<double>, least double, most double"


def _home(k: int):
    """For each tile its box, the box of its anchors, and each anchor with its k-th best score of one label within the tile."""
    def run(key, table):
        width = table.column("dim")[0].as_py()
        mine = table.filter(table.column("anchor"))
        x = _matrix(table, "vec", width).astype(np.float64)
        q = _matrix(mine, "vec", width).astype(np.float64)
        tile, out, floors = table.column("tile")[0].as_py(), [], []
        for i, tree, vec, least, most, slack in _searches(mine, table, width):
            own, label = mine.column("vec_id")[i].as_py(), mine.column("label")[i].as_py()
            hits = best_first(tree, vec, least, most, (tree.labels == label) & (tree.ids != own), [(-np.inf, np.inf)], [-np.inf], k, slack)[0]
            floors.append(float(-hits[-1][0]) - slack if len(hits) == k else -np.inf)
            out.append((tile, width, own, label, mine.column("vec")[i].as_py(), floors[-1]) + (None,) * 6)
        box = (tile, width, None, None, None, None, x.min(0).tolist(), x.max(0).tolist())
        out.append(box + ((q.min(0).tolist(), q.max(0).tolist(), min(floors), np.inf) if len(q) else (None,) * 4))
        names = [c.split()[0] for c in ANCHORS.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), *[pa.list_(pa.float64())] * 4, pa.float64(), pa.float64()]
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, types, zip(*out))})
    return run


def tile_pairs(boxes: DataFrame, needs: DataFrame, chunks: int, per_block: int = 1024) -> DataFrame:
    """(home, tile, chunk): the tiles that can hold a wanted score of an anchor of `home`.

    boxes: tile, dim, lo, hi. needs: tile (the anchors' home), dim, a_lo, a_hi, least, most (wanted scores). Only the
    boxes meet, in blocks of `per_block` by `per_block`; vectors move for the pairs that are left.
    """
    n = boxes.count()
    blocks = max(1, -(-n // per_block))

    def dealt(df, own, other):
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides come from one table: their columns must not be the same
        return fresh.withColumn(own, F.pmod(F.xxhash64("tile"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key, left, right):
        homes, tiles = [], []
        if left.num_rows and right.num_rows:
            width = key[2].as_py()
            lo, hi, a_lo, a_hi = (_matrix(t, c, width) for t, c in ((right, "lo"), (right, "hi"), (left, "a_lo"), (left, "a_hi")))
            least, most = left.column("least").to_numpy(), left.column("most").to_numpy()
            names, others = left.column("tile").to_pylist(), right.column("tile").to_pylist()
            for i, name in enumerate(names):
                ends = np.stack([a_lo[i] * lo, a_lo[i] * hi, a_hi[i] * lo, a_hi[i] * hi])
                upper, lower = ends.max(0).sum(1), ends.min(0).sum(1)
                slack = 1e-9 * np.abs(ends).max(0).sum(1) * (np.abs(ends).max(initial=0) * max(1, width) >= 2 ** 53)
                for j in np.flatnonzero((upper + slack >= least[i]) & (lower - slack <= most[i])):
                    homes.append(name)
                    tiles.append(others[j])
        return pa.table({"home": pa.array(homes, pa.string()), "tile": pa.array(tiles, pa.string())})

    keys = ["hb", "tb", "dim"]
    pairs = dealt(needs, "hb", "tb").groupBy(*keys).cogroup(dealt(boxes, "tb", "hb").groupBy(*keys)).applyInArrow(meet, "home string, tile string")
    return materialize(pairs.withColumn("chunk", F.pmod(F.xxhash64("home"), F.lit(chunks)).cast("int")), "tile_pairs")


def _against(anchors: DataFrame, tiles: DataFrame, pairs: DataFrame, search, schema: str) -> DataFrame:
    """Anchors (home, ..) against the rows of the tiles paired with their home, in groups of a tile and a chunk of homes."""
    asked = anchors.join(pairs, "home")
    met = pairs.select(F.col("tile").alias("tile"), F.col("chunk").alias("chunk")).distinct()
    rows = tiles.join(met, "tile").select("tile", "chunk", "vec_id", "label", "vec")
    return asked.groupBy("tile", "chunk").cogroup(rows.groupBy("tile", "chunk")).applyInArrow(search, schema)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Hard negatives of the anchors among rows (vec_id long, label long, vec array<long>).

    Scores are integer inner products; higher ones come first, ties by smaller vec_id. An anchor's positives are its first `positives`
    other rows of its label. For each of them come the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score, where the window is empty for a negative positive_score.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; positives without a negative give no row.
    Rows with nulls must be filtered before; scores must fit in 64 bits. Only vectors of one length meet; rows of the anchor's own id are skipped; rows
    that share a vec_id count each, but an anchor's id is asked once (its row of least label and vector). An empty table gives no rows.
    """
    tiles = materialize(tiled(rows, tile_bytes), "tiles").withColumn("anchor", anchor)
    home = materialize(tiles.groupBy("tile").applyInArrow(_home(positives), ANCHORS), "home")
    boxes = home.where("lo is not null").select("tile", "dim", "lo", "hi")
    homes = home.where("a_lo is not null").select("tile", "dim", "a_lo", "a_hi", "least", "most")
    own = home.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "vec", "tile", "dim", "floor")).alias("r"))
    anchors = materialize(own.select("vec_id", "r.label", "r.vec", F.col("r.tile").alias("home"), "r.dim", "r.floor"), "anchors")
    chunks = max(1, -(-anchors.count() // CHUNK))

    def find_positives(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids, labels, floors = (left.column(c).to_pylist() for c in ("vec_id", "label", "floor"))
            for i, tree, vec, least, most, slack in _searches(left, right, left.column("dim")[0].as_py()):
                hits = best_first(tree, vec, least, most, (tree.labels == labels[i]) & (tree.ids != ids[i]), [(-np.inf, np.inf)], [floors[i]], positives, slack)[0]
                out += [(ids[i], p, -s) for s, p in hits]
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("anchor_id", "positive_id", "positive_score"))})

    near = _against(anchors, tiles, tile_pairs(boxes, homes, chunks), find_positives, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    listed = near.groupBy("anchor_id").agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("wanted"))  # at most `positives` each; a repeated row is asked once
    asked = materialize(anchors.join(listed, anchors["vec_id"] == listed["anchor_id"]).drop("anchor_id", "floor"), "asked")
    scores = F.col("wanted.positive_score").cast("array<double>")
    windows = asked.groupBy("home", "dim").agg(F.min(F.array_min(scores)).alias("p"), F.max(F.array_max(scores)).alias("m"))
    needs = homes.drop("least", "most").join(windows.select(F.col("home").alias("tile"), (F.least(F.col("p"), F.col("p") * low / 100) - 1).alias("least"),
                                                            (F.greatest(F.col("m"), F.lit(0.0)) * high / 100 + 1).alias("most")), "tile")

    def find_negatives(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            ids, labels, wanted = (left.column(c).to_pylist() for c in ("vec_id", "label", "wanted"))
            for i, tree, vec, least, most, slack in _searches(left, right, left.column("dim")[0].as_py()):
                windows = [(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in wanted[i]]
                found = best_first(tree, vec, least, most, (tree.labels != labels[i]) & (tree.ids != ids[i]), windows, [-np.inf] * len(windows), negatives, slack)
                out += [(ids[i], w["positive_id"], w["positive_score"], n, -s) for w, hits in zip(wanted[i], found) for s, n in hits]
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})

    far = _against(asked, tiles, tile_pairs(boxes, needs, chunks), find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives of every 50th embedding; the label of every 7th is moved on by one."""
    rows = (
        load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
        .where("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null "
               "and not isnan(x) and abs(x) < cast('Infinity' as double))")
        .select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), quantize("embedding", 256).alias("vec"))
    )
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: floor(256.0 * cast(x as double))) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same, cast(list_inner_product(a.vec, c.vec) as bigint) as score
  from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id and len(a.vec) = len(c.vec)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
