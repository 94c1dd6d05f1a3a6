"""Two-pass external shuffle of whole rows into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from .common import all_but, load, new_path, quoted


def rendezvous_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash of (key, shard); a further shard only takes keys into itself."""
    scored = [F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scored)["s"]


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its strings, and 8 for each column."""
    texts = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    return sum(texts, F.lit(8 * len(df.columns))).cast("long")


def write_shards(df: DataFrame, path: str, key: str, order: list[str], shards: int = 24, seed: int = 42,
                 bucket_bytes: int = 4 << 20) -> None:
    """Scatter whole rows into buckets of their shard, shuffle each bucket, and write the shards.

    Pass 1 sends every row to a bucket of about `bucket_bytes` of its shard by a seeded
    hash of `order`, and a shard with more bytes (one key with many rows) has more buckets.
    Rows alike in `order` that are over 1/1000 of all rows are dealt by their number as well, so that
    they part; all other places depend on rows and seed alone, not on how the input is split. Pass 2 shuffles each
    bucket (Spark's `shuffle` is a Fisher-Yates) and writes the columns of `df` with
    `grown_shard` (with one more shard), `bucket` and `place` to the folder of the shard,
    each file in this order. `order` fixes a row's place before the shuffle. A null key
    is a key of its own.
    """
    cols = df.columns
    shard = rendezvous_shard(F.col(quoted(key)), shards, seed)
    rows = df.groupBy(shard.alias("shard")).agg(F.sum(_row_bytes(df)).alias("bytes"), F.count("*").alias("n")).collect()  # one for each shard
    sizes = {r.shard: r.bytes for r in rows}
    buckets = [max(1, -(-sizes.get(s, 0) // bucket_bytes)) for s in range(shards)]
    keys = [F.col(quoted(c)) for c in order]
    deal = F.xxhash64(*keys, F.lit(seed + 1))
    alike = df.groupBy(deal.alias("deal")).agg(F.count("*").alias("n"))
    often = [r.deal for r in alike.where(F.col("n") * 1000 > F.lit(sum(r.n for r in rows))).where("n > 1").collect()]  # at most 1000
    number = F.when(deal.isin(often), F.monotonically_increasing_id()) if often else F.lit(None).cast("long")
    placed = df.select(
        F.struct(*[F.col(quoted(c)).alias(c) for c in cols]).alias("_row"), F.xxhash64(*keys, F.lit(seed)).alias("_ord"),
        F.xxhash64(deal, number).alias("_deal"),
        shard.alias("shard"),
        rendezvous_shard(F.col(quoted(key)), shards + 1, seed).alias("grown_shard"),
    ).withColumn("bucket", F.pmod("_deal", F.array(*[F.lit(n) for n in buckets])[F.col("shard")]).cast("int")).drop("_deal")
    packed = (
        placed.repartition(sum(buckets), "shard", "bucket").groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("_ord", "_row", "grown_shard")).alias("_rows"))
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.shuffle(F.array_sort("_rows"), seed).alias("_rows"))
    )
    (packed.select("shard", "bucket", F.posexplode("_rows").alias("place", "_r"))
     .select(*[F.col("_r._row")[c].alias(c) for c in cols], F.col("_r.grown_shard").alias("grown_shard"), "shard", "bucket", "place")
     .sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path))


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written rows with `slot`, gapless from 0 in each shard: the rows of all earlier buckets, and the place."""
    rows = spark.read.schema(schema).parquet(path)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "bucket").agg(F.count("*").alias("_n")).select(
        "shard", "bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    # one short row for each bucket: broadcast, so that the texts are not moved a second time
    return rows.join(F.broadcast(base), ["shard", "bucket"]).withColumn("slot", F.col("_base") + F.col("place")).drop("_base")


def external_shuffle(df: DataFrame, key: str, order: list[str], shards: int = 24, seed: int = 42,
                     bucket_bytes: int = 4 << 20) -> DataFrame:
    """Write the shards to the shared folder and read them again.

    Returns the columns of `df` as written, with `shard`, `slot` and `grown_shard`. Slots
    are counted on the written rows, so a recomputed task cannot shift them. An empty
    table gives an empty result. Columns of `df` named like one of the added ones are left out.
    """
    df = df.select(*all_but(df, "shard", "slot", "grown_shard", "bucket", "place"))
    spark, cols = df.sparkSession, df.columns
    path = new_path(spark, "shards")
    write_shards(df, path, key, order, shards, seed, bucket_bytes)
    added = [StructField(name, IntegerType()) for name in ("grown_shard", "bucket", "place", "shard")]
    schema = StructType([*df.schema.fields, *added])
    return read_shards(spark, path, schema).select(*map(quoted, cols), "shard", "slot", "grown_shard")


def op5_external_shuffle(spark, sf_dir) -> DataFrame:
    """All documents in 24 shards by the law `key`, of the written rows; null texts have no bytes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = external_shuffle(docs, "doc_id", ["doc_id", "text"])
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                      F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                      F.col("grown_shard").cast("int").alias("grown_shard"))
