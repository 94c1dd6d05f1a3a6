"""Helpers shared by the operators: table access, shared storage and hot-key joins."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may leave it unset: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dir()
    return path.rstrip("/")


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete all tables that this process wrote to the shared folder; for use once their results are saved."""
    jvm, n = spark.sparkContext._jvm, len(_WRITTEN)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def written() -> int:
    """How many tables this process has written to the shared folder and not deleted."""
    return len(_WRITTEN)


def drop_between(spark: SparkSession, first: int, last: int) -> None:
    """Delete the written tables numbered from `first` up to `last`, the latter kept."""
    kept = _WRITTEN[:first] + _WRITTEN[last:]
    _WRITTEN[:] = _WRITTEN[first:last]
    drop_written(spark)
    _WRITTEN[:] = kept


def quoted(name: str) -> str:
    """The name for F.col, also with dots or backticks in it."""
    return "`" + name.replace("`", "``") + "`"


def all_but(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df without those named; an operator's own columns replace them."""
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in {n.lower() for n in names}]


def salted_join(left: DataFrame, right: DataFrame, key: str, count_col: str, total: int, deal: list[str]) -> DataFrame:
    """Inner join of many-rowed `left` to `right`, unique on `key`, whose rows may be large: nothing of them is broadcast.

    `count_col` of `right` holds the key's rows in `left`. A key with over 1/1000 of all rows (at most 1000 keys, which alone
    are broadcast) is dealt over as many parts as it has thousandths, by a hash of the columns `deal` of `left`.
    """
    parts = F.ceil(F.col(count_col) * 1000 / F.lit(max(1, total))).cast("int")
    sized = right.withColumn("_parts", F.when(F.col(count_col) * 1000 > F.lit(total), parts).otherwise(1)).drop(count_col)
    hot = F.broadcast(sized.where("_parts > 1").select(key, F.col("_parts").alias("_hot")))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*deal), F.coalesce("_hot", F.lit(1))).cast("int")).drop("_hot")
    spread = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def lookup_join(left: DataFrame, right: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Inner join of many-rowed `left` to `right`, unique on `key`, safe for hot keys.

    `count_col` of `right` holds the key's rows in `left`. Keys with over 1/1000 of
    all rows are at most 1000, so their side is broadcast; all others are shuffled. For rows of `right` of bounded
    size only; see `salted_join` for others.
    """
    hot = F.col(count_col) * 1000 > F.lit(total)
    hot_keys = right.where(hot).drop(count_col)
    cold_keys = right.where(~hot).drop(count_col)
    tagged = left.join(F.broadcast(hot_keys.select(key, F.lit(True).alias("_hot"))), key, "left")
    return (
        tagged.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_keys), key)
        .unionByName(tagged.where(F.col("_hot").isNull()).drop("_hot").join(cold_keys, key))
    )


def key_runs(batches, keys: list[str], columns: list[str]):
    """(key values, one list for each of the columns) of each run of rows with equal keys in a sorted stream of Arrow batches."""
    last, held = None, None
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        lists = [batch.column(c).to_pylist() for c in columns]
        start = 0
        while start < len(marks):
            stop = start + 1
            while stop < len(marks) and marks[stop] == marks[start]:
                stop += 1
            if marks[start] != last:
                if held is not None:
                    yield last, held
                last, held = marks[start], [[] for _ in columns]
            for have, new in zip(held, lists):
                have += new[start:stop]
            start = stop
    if held is not None:
        yield last, held
