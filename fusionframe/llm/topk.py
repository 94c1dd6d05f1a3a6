"""Exact top-k inner products with multi-resolution segment bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load

LEVELS = (4, 16, 32)
OUT = "query_id long, vec_id long, score long"


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment, sqrt(length) * mean and the norm of the deviations from it."""
    means, norms = [], []
    for part in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1):
        mean = part.mean(axis=1, keepdims=True) if part.shape[1] else np.zeros((len(x), 1))
        means.append(mean[:, 0] * np.sqrt(part.shape[1]))
        norms.append(np.sqrt(((part - mean) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(norms, axis=1)


def block_top_k(q_ids, q, c_ids, c, k: int, levels=LEVELS):
    """The k best candidates of one block for each query: arrays of query id, vec id, score.

    With x.q = sum over segments of the means' part and the deviations' part, and the
    latter at most the product of their norms, |x|^2 + |q|^2 - 2 * bound is a lower bound
    of the squared distance and `bound` an upper bound of the inner product. Coarse
    bounds come first, finer ones only for survivors, exact integers last; where most pairs of a tile survive,
    bounds and products are those of the whole tile.
    """
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    stats = [(segment_stats(qf, s), segment_stats(cf, s)) for s in levels]
    peak = float(np.abs(qf).max(initial=0)) * float(np.abs(cf).max(initial=0)) * max(1, q.shape[1])
    exact_q, exact_c = (qf, cf) if peak < 2 ** 53 else (q.astype(object), c.astype(object))
    slack = 1e-9 * peak + 1e-6
    out = []
    step = max(1, (1 << 20) // max(1, len(c)))
    for at in range(0, len(q), step):
        rows = slice(at, at + step)

        def bound(level):
            (qm, qs), (cm, cs) = stats[level]
            return qm[rows] @ cm.T + qs[rows] @ cs.T

        def pair_bound(level, qi, ci):
            (qm, qs), (cm, cs) = stats[level]
            return (qm[at + qi] * cm[ci]).sum(1) + (qs[at + qi] * cs[ci]).sum(1)

        def pair_exact(qi, ci):
            return (exact_q[at + qi] * exact_c[ci]).sum(1)

        coarse = bound(0)
        others = q_ids[rows, None] != c_ids[None, :]
        coarse[~others] = -np.inf
        n, width = coarse.shape
        floor = np.full(n, -np.inf)
        if width > k:
            seeds = np.argpartition(-coarse, k - 1, axis=1)[:, :k]
            qi = np.repeat(np.arange(n), k)
            seen = pair_exact(qi, seeds.ravel()).astype(np.float64).reshape(n, k)
            seen[~np.take_along_axis(others, seeds, axis=1)] = -np.inf
            floor = seen.min(axis=1)
        least = (floor - slack)[:, None]
        alive = (coarse >= least) & others
        for level in range(1, len(levels)):
            if np.count_nonzero(alive) * 8 > alive.size:
                alive &= bound(level) >= least
            else:
                qi, ci = np.nonzero(alive)
                alive[qi, ci] = pair_bound(level, qi, ci) >= least[qi, 0]
        if peak < 2 ** 53 and np.count_nonzero(alive) * 8 > alive.size:
            # Most pairs survive: one product of the tile, exact as no partial sum reaches 2**53; pairs below the k-th score go.
            whole = np.where(alive, qf[rows] @ cf.T, -np.inf)
            if width > k:
                alive &= whole >= np.partition(whole, width - k, axis=1)[:, width - k, None]
            qi, ci = np.nonzero(alive)
            score = whole[qi, ci].astype(np.int64)
        else:
            qi, ci = np.nonzero(alive)
            score = pair_exact(qi, ci).astype(np.int64) if len(qi) else np.empty(0, np.int64)
        order = np.lexsort((c_ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        first = np.searchsorted(qi, qi, side="left")
        keep = np.arange(len(qi)) - first < k
        out.append((q_ids[at + qi[keep]], c_ids[ci[keep]], score[keep]))
    return [np.concatenate(parts) for parts in zip(*out)]


def top_k(vectors: DataFrame, is_query, k: int = 5, block_rows: int = 1024, query_rows: int = 16384) -> DataFrame:
    """The k highest inner products of each query row of (vec_id, vec array<long>) with all other rows.

    Queries and candidates are dealt into blocks of bounded size by hash; each pair of
    blocks is one group, which returns k rows for each query. Only vectors of equal length meet;
    repeated ids of candidates count as rows of their own, a query skips all rows of
    its own id, and ties go to the smaller id. Null vectors or ids must be filtered before.
    """
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    q_blocks = max(1, -(-n_queries // query_rows))
    # Blocks of 16384 candidates; smaller ones only as long as they are at most 64, so that few vectors use all cores.
    c_blocks = max(1, -(-n // 16384), min(64, -(-n // block_rows)))

    def expand(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    dim = F.size("vec").alias("dim")
    c = vectors.select("vec_id", "vec", dim, F.pmod(F.xxhash64("vec_id", "vec"), F.lit(c_blocks)).cast("int").alias("cb"),
                       expand(q_blocks).alias("qb"))
    q = vectors.where(is_query).select("vec_id", "vec", dim,
                                       F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"),
                                       expand(c_blocks).alias("cb"))

    def matrix(table, width):
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, width)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        width = left.column("dim")[0].as_py()
        ids, vec, score = block_top_k(*matrix(left, width), *matrix(right, width), k)
        return pa.table({"query_id": ids, "vec_id": vec, "score": score})

    keys = ["dim", "cb", "qb"]
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, OUT)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def quantize(column: str, factor: int):
    return F.transform(column, lambda x: F.floor(F.lit(factor).cast("double") * x.cast("double")).cast("long"))


def op1_top_k(spark, sf_dir) -> DataFrame:
    """The five highest inner products of every 50th embedding with all others."""
    vectors = (
        load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
        .where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null "
               "and not isnan(x) and abs(x) < cast('Infinity' as double))")
        .select("vec_id", quantize("embedding", 256).alias("vec"))
    )
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256.0 * cast(x as double))) as vec
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_inner_product(q.vec, c.vec) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.vec) = len(c.vec)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
         vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
