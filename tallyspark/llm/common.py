"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it; one of our own only where
    that is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "tallyspark-checkpoints")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column | str) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_ids(texts: DataFrame) -> bool:
    """Whether a non-null doc_id comes twice."""
    return not texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def numbered(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For texts (doc_id, text) whose doc_ids repeat: (row, doc_id, text), where rows of one doc_id and text share a
    number and numbers rise with doc_id, and the names (row, doc_id)."""
    keyed = texts.where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    pairs = keyed.select("doc_id", "hash").distinct().repartitionByRange(partitions(texts), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    # ids of sorted ranges rise with the order, whatever the ranges' sizes
    names = cut(pairs.withColumn("row", F.monotonically_increasing_id()))
    return keyed.join(names, ["doc_id", "hash"]).select("row", "doc_id", "text"), names.select("row", "doc_id")


#: A key with more than one in HOT of all rows is frequent; there are fewer than HOT of them, so they may be broadcast.
HOT = 1000


def join_uneven(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, spread: Column, may_broadcast: Column | None = None) -> DataFrame:
    """`rows` left-joined to `per_key`, which has one row a key, on `keys`; one key may hold any share of the rows.

    `weight` names the column of `per_key` that counts the rows of its key. Frequent keys are broadcast (fewer than
    HOT; of them only those where `may_broadcast`, if their payload is not small anyway) and their rows, scattered
    by the hash of `spread`, meet no partner in the shuffle that joins all others.
    """
    payload = [c for c in per_key.columns if c not in keys]
    total = per_key.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    often = F.col(weight) > F.lit(total / HOT)
    often = F.coalesce(often if may_broadcast is None else often & may_broadcast, F.lit(False))
    packed = per_key.select(*keys, often.alias("_often"), F.struct(*payload).alias("_payload"))
    hot = packed.where("_often").select(*keys, F.col("_payload").alias("_hot"))
    # a salt of 0 that the optimizer does not fold: a literal would leave the join's keys
    zero = F.pmod(F.col("_payload")[weight], F.lit(1)).cast("int")
    cold = packed.where("not _often").select(*keys, zero.alias("_salt"), F.col("_payload").alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(997))).cast("int"))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *(found[c].alias(c) for c in payload))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) with the smallest node reachable, for the nodes of the given links.

    Alternates large-star and small-star steps, each a group-by with map-side minima, until no link
    changes; rounds grow with the logarithm of the longest path. Nothing is collected but two sums.
    Links with a null end and self-links are ignored.
    """
    links = (
        edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .where("a < b and a is not null and b is not null")
        .distinct()
    )
    links = cut(links)
    seen = None
    while True:
        both = links.union(links.select("b", "a")).toDF("node", "near")
        low = both.groupBy("node").agg(F.min("near").alias("low"))
        low = low.select("node", F.least("node", "low").alias("low"))
        # large star: link each larger neighbour to the smallest of the neighbourhood
        large = both.where("near > node").join(low, "node").select(F.col("low").alias("a"), F.col("near").alias("b")).where("a < b").distinct()
        # small star: link each node's smaller neighbours and the node itself to the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(small_low, "b")
        small = joined.select(F.col("low").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("low").alias("a"), "b")).where("a < b").distinct()
        links = cut(small)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    stars = links.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
