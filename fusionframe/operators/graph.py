"""Connected components by rounds of joins, each round written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again, so that its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def written_by(df: DataFrame, name: str, key: str, deal: bool = False) -> DataFrame:
    """The table, written in buckets of `key` and read again: joins, groups and windows by `key` move it no more.

    Its rows lie by `key` already, as after a join or window by it, or `deal` moves them there first; others would make many small files. It is
    a table of the session's catalog with its files in the shared folder; there are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df = df.repartition(buckets, key) if deal else df
    df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of the undirected edges (a, b).

    In a round every node with a lower neighbour points at its least one, pointers are doubled until they end at nodes without one, and
    edges move to where their ends point. At most half of the nodes are left by a round, so there are about log2(nodes) rounds of about
    log2(longest chain) doublings; they go on until no edge is left. Neighbours are reduced to their least within each task first, so a node
    with very many edges moves few rows. Loops are nodes of their own; null ends go.
    """
    edges = edges.select("a", "b").dropna()
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    parents = written(nodes.select("node", F.col("node").alias("root")), "parents")
    links = written(edges.where("a <> b").distinct(), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = written(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select("a", "to"), "hops")
        while True:
            onward = hop.select(F.col("a").alias("to"), F.col("to").alias("next"))
            longer = written(hop.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hops")
            hop = longer.select("a", "to")
            if longer.where("moved").isEmpty():
                break
        parents = written(parents.join(hop.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "parents")
        moved = links.join(hop.select("a", F.col("to").alias("a2")), "a", "left").join(hop.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b", "left")
        ends = moved.select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
        links = written(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    return parents
