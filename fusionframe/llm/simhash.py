"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, lookup_join, materialize


def fingerprint(parts) -> int:
    """Signed 64-bit fingerprint of arrays of uint64 hashes: a bit is set if over half of all hashes have it."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    packed = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def simhash(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint of the word shingles; no words give 0."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    spans = list(zip(starts[:n].tolist(), last))
    return fingerprint(np.array([digest(joined[s:e], 42) for s, e in spans[at:at + 8192]], dtype="<u8") for at in range(0, n, 8192))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of every row."""
    def run(batches):
        for batch in batches:
            fps = [simhash(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (a < b) of fingerprints in a distinct column `fp` that differ in 1 to `radius` (at most 3) bits.

    Two 32-bit segments. Either the high one differs in at most one bit, or, when it
    differs in more, the low one differs in at most `radius - 2`. So the
    high table is probed with a ball of radius 1 and the low one with radius
    `radius - 2`; each fetched match is verified on all 64 bits.

    Both sides are sorted and merged: Spark sizes the balls as it sizes `distinct`, before the explode, and would broadcast them.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    ball = [0] + [1 << i for i in range(32)]

    def keyed(column, segment, flips):
        keys = F.array(*[F.lit(v).cast("long") for v in flips])
        return distinct.select("fp", F.explode(F.transform(keys, lambda v: column.bitwiseXOR(v))).alias("k")) \
            .withColumn("seg", F.lit(segment))

    low_ball = ball if radius == 3 else [0]
    probes = keyed(high, 0, ball)
    table = distinct.select("fp", high.alias("k"), F.lit(0).alias("seg"))
    if radius > 1:
        probes = probes.unionByName(keyed(low, 1, low_ball))
        table = table.unionByName(distinct.select("fp", low.alias("k"), F.lit(1).alias("seg")))
    distance = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    return (
        probes.alias("p").join(table.alias("t").hint("merge"), (F.col("p.k") == F.col("t.k")) & (F.col("p.seg") == F.col("t.seg"))
                               & (F.col("p.fp") < F.col("t.fp")) & (distance <= radius))
        .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star rounds.

    Only nodes with a link are returned. Each round is written to the shared folder,
    and rounds go on until the edge set no longer changes (their number grows with the logarithm of the nodes).
    """
    edges = materialize(links.select("a", "b"), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for rows of (doc_id, text).

    Fingerprints within `radius` bits link; component_id is the smallest doc_id that
    can be reached. Null and wordless texts have fingerprint 0 and link like others.
    Copies share a fingerprint, so only distinct fingerprints are compared. Rows with
    a null doc_id are kept; their id never becomes a component id unless all are null.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    stats = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "stats")
    links = fingerprint_links(stats.select("fp"), radius)
    comp = components(links).select(F.col("node").alias("fp"), "root")
    rooted = stats.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(first, "root").select("fp", "n", "component_id")
    return lookup_join(prints, labels, "fp", "n", prints.count())


def op6_simhash(spark, sf_dir) -> DataFrame:
    """The fingerprint of every document and the least doc_id that it is linked with."""
    out = near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
