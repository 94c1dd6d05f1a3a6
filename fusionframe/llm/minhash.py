"""Near copies by SimHash links and MinHash bands, each link checked on the shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_runs, lookup_join, materialize, salted_join
from .simhash import components, fingerprint, fingerprint_links
from .words import gram_hashes, joined_words, mix

BANDS, ROWS = 14, 5
#: Classes of a bucket above which its pairs are compared in blocks, and the classes and text bytes of a block.
PAIRED, BLOCK_ROWS, BLOCK_BYTES = 32, 2048, 8 << 20
_RNG = np.random.default_rng(42)
_MULT = _RNG.integers(1, 2 ** 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, BANDS * ROWS).astype(np.uint64)
_FOLD = _RNG.integers(1, 2 ** 63, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of all `width`-word shingles in lower case; one of all words where they are fewer."""
    hashes = joined_words([(text or "").lower().encode("utf-8")])[3]
    return np.unique(gram_hashes(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at:at + 1024, None] * _MULT + _ADD).min(axis=0))
    return mix((mix(least).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _prints(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            same, sizes, lengths, fps, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, width)
                words = (text or "").lower().encode("utf-8")
                same.append(xxhash.xxh3_128_digest(b" ".join(words.split())))
                sizes.append(len(hashes))
                lengths.append(len(words))
                fps.append(fingerprint([mix(hashes)]))
                keys.append(bands(hashes).view(np.int64) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(lengths, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["uid", "doc_id", "same", "size", "bytes", "fp", "bands"])
    return docs.select("uid", F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "uid long, doc_id long, same binary, size long, bytes long, fp long, bands array<long>")


def _simhash_keys(classes: DataFrame) -> DataFrame:
    """(rep, size, bytes, key): each class with the component of its SimHash fingerprint, whose links differ in 2 bits or fewer."""
    prints = classes.where("size > 0").select("rep", "size", "bytes", "fp")
    comp = components(fingerprint_links(materialize(prints.select("fp").distinct(), "fps"))).select(F.col("node").alias("fp"), "root")
    root = F.coalesce("root", "fp")
    return prints.join(comp, "fp", "left").select("rep", "size", "bytes", F.xxhash64(F.lit("simhash"), root).alias("key"))


def _near_size(a: str, b: str):
    """Whether sets of these sizes can reach 0.8 in similarity."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _centre_pairs(keyed: DataFrame) -> DataFrame:
    """(member, centre): each class with one class of each of its buckets, the same one wherever it lies."""
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "size")).alias("c"))
    buckets = materialize(buckets.where("n > 1").select("key", "n", F.col("c.rep").alias("centre"), F.col("c.size").alias("c_size")), "buckets")
    met = lookup_join(keyed, buckets, "key", "n", keyed.count())
    return met.where(_near_size("size", "c_size") & (F.col("rep") != F.col("centre"))).select(F.col("rep").alias("member"), "centre").distinct()


def _mixed(keyed: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of the buckets whose classes no chain of links joins yet: (key, rep, size, bytes, root, few, classes, all_bytes, few_rows, few_bytes).

    `few` marks the classes outside the bucket's largest component. Only they are compared with the others,
    so a large group of near copies is compared with no more than its bucket's strangers.
    """
    rooted = keyed.join(comp, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialize(rooted, "rooted")
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max(F.struct("n", "root", "bytes"))
    mixed = parts.groupBy("key").agg(main.alias("main"), F.count("*").alias("roots"), F.sum("n").alias("classes"), F.sum("bytes").alias("all_bytes")).where("roots > 1")
    mixed = mixed.select("key", F.col("main.root").alias("main"), "classes", "all_bytes", (F.col("classes") - F.col("main.n")).alias("few_rows"),
                         (F.col("all_bytes") - F.col("main.bytes")).alias("few_bytes"))
    return materialize(rooted.join(mixed, "key").withColumn("few", F.col("root") != F.col("main")).drop("main"), "mixed")


def _cross_pairs(mixed: DataFrame) -> DataFrame:
    """(member, centre): the pairs of small buckets that are not joined yet; each class has at most PAIRED - 1 in a bucket."""
    small = mixed.where(F.col("classes") <= PAIRED)
    few = small.where("few").select("key", F.col("rep").alias("member"), F.col("root").alias("m_root"), F.col("size").alias("m_size"))
    both = few.join(small, "key").where((F.col("root") != F.col("m_root")) & _near_size("size", "m_size")
                                        & (~F.col("few") | (F.col("member") < F.col("rep"))))
    return both.select("member", F.col("rep").alias("centre")).distinct()


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i of the rows `left` and j of `right`, of sets of distinct hashes with similarity 0.8 or more.

    Shared hashes are counted for all pairs at once: frequent ones by products of 0/1 matrices, rare ones by the pairs that hold them.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.argsort(which, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]  # the rows that hold each hash, hash by hash
    first = np.cumsum(counts) - counts
    shared = np.zeros((len(left), len(right)), np.float32)
    l_at, r_at = np.full(len(sets), -1), np.full(len(sets), -1)
    l_at[left], r_at[right] = np.arange(len(left)), np.arange(len(right))
    rare = max(8, len(sets) // 64)
    for c in np.unique(counts[(counts > 1) & (counts <= rare)]).tolist():
        starts, step = first[counts == c], max(1, (1 << 20) // (c * c))
        for at in range(0, len(starts), step):
            rows = holder[starts[at:at + step, None] + np.arange(c)]
            i, j = np.broadcast_arrays(l_at[rows][:, :, None], r_at[rows][:, None, :])
            keep = (i >= 0) & (j >= 0)
            np.add.at(shared, (i[keep], j[keep]), np.float32(1))
    often = np.flatnonzero(counts > rare)
    for at in range(0, len(often), 1024):
        tile = often[at:at + 1024]
        n = counts[tile]
        places = np.repeat(first[tile] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        held = np.zeros((len(sets), len(tile)), np.float32)
        held[holder[places], np.repeat(np.arange(len(tile)), n)] = 1
        shared += held[left] @ held[right].T
    return np.nonzero(9 * shared.astype(np.int64) >= 4 * (sizes[left][:, None] + sizes[right][None, :]))


def joining(pairs, roots: list[int]) -> list[tuple[int, int]]:
    """Of pairs of row numbers, those that join components not joined before, where rows of one root are joined."""
    up = {r: r for r in roots}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in pairs:
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def _block_links(mixed: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b): links of similarity 0.8 or more that join the classes of large buckets, compared block by block.

    The few and all classes of a bucket are dealt into blocks of bounded rows and bytes, and each block of the few meets each of all.
    A class is moved once for each block of the other side, and no row is made for a pair that is not linked.
    """
    large = mixed.where(F.col("classes") > PAIRED)

    def blocks(rows: str, size: str):
        return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")

    def place(f, a, left, right):
        return F.struct(f.alias("f"), a.alias("a"), left.alias("left"), right.alias("right"))

    own_f, own_a = (F.pmod(F.xxhash64("rep"), F.col(n)).cast("int") for n in ("n_few", "n_all"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    as_right = F.transform(F.sequence(zero, F.col("n_few") - 1), lambda f: place(f, own_a, no, yes))
    as_left = F.transform(F.sequence(zero, F.col("n_all") - 1), lambda a: place(own_f, a, yes, no))
    places = F.when(F.col("n_all") == 1, F.array(place(zero, zero, F.col("few"), yes))).when(F.col("few"), F.concat(as_right, as_left)).otherwise(as_right)
    dealt = large.withColumns({"n_few": blocks("few_rows", "few_bytes"), "n_all": blocks("classes", "all_bytes")}) \
        .select("key", "rep", "root", F.explode(places).alias("p")).select("key", "rep", "root", "p.*")

    def check(batches):
        for _, (reps, roots, lefts, rights, found) in key_runs(batches, ["key", "f", "a"], ["rep", "root", "left", "right", "text"]):
            left, right = np.flatnonzero(lefts), np.flatnonzero(rights)
            if not len(left) or not len(right):
                continue
            i, j = alike([shingles(t, width) for t in found], left, right)
            pairs = joining(zip(left[i].tolist(), right[j].tolist()), roots)
            a, b = ([f(reps[x], reps[y]) for x, y in pairs] for f in (min, max))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # merged: Spark sizes `dealt` as before its explode, and would broadcast it
    return dealt.join(texts.withColumnRenamed("uid", "rep").hint("merge"), "rep").repartition("key", "f", "a").sortWithinPartitions("key", "f", "a") \
        .mapInArrow(check, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more, by the shingle sets of both texts."""
    left = pairs.join(texts.select(F.col("uid").alias("member"), F.col("text").alias("left")), "member")
    counts = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    right = counts.join(texts.select(F.col("uid").alias("centre"), F.col("text").alias("right")), "centre")

    def check(batches):
        for batch in batches:
            held: dict = {}
            a, b = [], []
            for m, c, x, y in zip(*(batch.column(k).to_pylist() for k in ("member", "centre", "left", "right"))):
                for k, text in ((m, x), (c, y)):
                    if k not in held:
                        held[k] = shingles(text, width)
                shared = len(np.intersect1d(held[m], held[c], assume_unique=True))
                if 5 * shared >= 4 * (len(held[m]) + len(held[c]) - shared):
                    a.append(min(m, c))
                    b.append(max(m, c))
                if len(held) > 500:
                    held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return salted_join(left, right, "centre", "n", pairs.count(), ["member"]).select("member", "centre", "left", "right") \
        .mapInArrow(check, "a long, b long").distinct()


def first_of_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """The `uid` of one row of each group of near copies, for rows of (uid, doc_id, text).

    `uid` is a written, unique row id. Rows of the same lower-case words are one class;
    classes link where the Jaccard similarity of their shingle sets is 0.8 or more. Candidates share a bucket: the
    component of their SimHash fingerprints, linked as in `simhash`, or, as those rarely reach similarity 0.8, a MinHash band.
    Links are checked on the sets: first with one centre of each bucket, then between all
    classes of a bucket that are not in one component yet, so no pair that shares a bucket
    is left unchecked unless it is joined already. The first row by (doc_id, uid) stays, null ids last.
    Null and wordless texts are one class.
    """
    prints = materialize(_prints(docs, width), "prints")
    classes = materialize(prints.groupBy("same").agg(
        F.min("uid").alias("rep"), F.min("size").alias("size"), F.min("bytes").alias("bytes"), F.min("fp").alias("fp"), F.min("bands").alias("bands"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("first")).drop("same"), "classes")
    keyed = materialize(classes.select("rep", "size", "bytes", F.explode("bands").alias("key")).unionByName(_simhash_keys(classes)), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = materialize(keyed.join(shared, "key", "left_semi"), "keyed")
    texts = materialize(docs.select("uid", "text").join(keyed.select(F.col("rep").alias("uid")).distinct(), "uid", "left_semi"), "texts")
    comp = components(_verified(materialize(_centre_pairs(keyed), "pairs"), texts, width)).select(F.col("node").alias("rep"), "root")
    mixed = _mixed(keyed, comp)
    late = _verified(materialize(_cross_pairs(mixed), "pairs"), texts, width).unionByName(_block_links(mixed, texts, width))
    known = comp.select(F.col("rep").alias("uid"), "root")
    bridges = late.join(known.withColumnsRenamed({"uid": "a", "root": "ra"}), "a", "left").join(known.withColumnsRenamed({"uid": "b", "root": "rb"}), "b", "left") \
        .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y") \
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    upper = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = classes.select("rep", "first").join(comp, "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(upper, "root", "left")
    return rooted.groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("first").alias("first")).select("first.uid")
