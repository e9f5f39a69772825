"""Receipts and bank lines as streams: each micro-batch replaces its rows by key and matches what they can change.

The tables are Parquet folders, one a version; a batch writes the next version and then names it, so a batch that is
run again after a lost driver starts from the same version and gives the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.config import Config, MatchingConfig
from tallyspark.operators.incremental import PAIRS, incremental_run, status_of_pair
from tallyspark.operators.runs import OPEN


def replace_by_key(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`table` with the rows of `batch`; a row of the same keys is replaced, of several in the batch the last by `order` stays."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    once = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return table.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


class Version:
    """A table of Parquet versions under a folder; version n is the state after batch n - 1."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, number: int) -> DataFrame:
        """The state before batch `number`; empty before the first."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{number}") if number else self.spark.createDataFrame([], self.schema)

    def write(self, number: int, df: DataFrame) -> None:
        """The state after batch `number`."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{number + 1}")


RECEIPTS = "org long, id long, merchant string, date date, total double, currency string, payment string, is_duplicate boolean, status string, created_at timestamp_ntz"
TRANSACTIONS = "org long, id long, merchant string, date date, amount double, currency string, payment string, created_at timestamp_ntz"
MATCHES = "org long, r_id long, t_id long, score double, status string"


def match_stream(stream: DataFrame, folder: str, config: Config = MatchingConfig(), similarity: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that keeps receipts, transactions and matches under `folder` up to date with a stream of both sides (side:
    receipt or transaction, and the columns of both). Start it with a checkpoint location and a trigger.

    Each batch replaces its rows by (org, id), so one that comes again changes nothing, and scores the unlocked receipts
    again that its rows, or transactions locked since the last batch, can meet; `pairs` keeps the run's pairs for the next.
    """
    spark = stream.sparkSession
    tables = {name: Version(spark, f"{folder}/{name}", schema) for name, schema in (("receipts", RECEIPTS), ("transactions", TRANSACTIONS), ("matches", MATCHES), ("pairs", PAIRS))}

    def run(batch: DataFrame, number: int) -> None:
        for side, name in (("receipt", "receipts"), ("transaction", "transactions")):
            table = tables[name].read(number)
            tables[name].write(number, replace_by_key(table, batch.where(F.col("side") == side).select(table.columns), ["org", "id"], "created_at"))
        before, after = ({name: tables[name].read(at) for name in ("receipts", "transactions")} for at in (number, number + 1))
        matches = tables["matches"].read(number)
        found = incremental_run(before, after, batch.select("side", "org", "id"), tables["pairs"].read(number), matches, config, similarity)
        tables["pairs"].write(number, found)
        # open rows of receipts that are locked stay as they were, all others are the run's
        locked = matches.where("status in ('confirmed', 'auto')").select("org", "r_id").distinct()
        is_open = F.col("status").isin(*OPEN)
        stays = matches.where(~is_open).unionByName(matches.where(is_open).join(locked, ["org", "r_id"], "left_semi").select(matches.columns))
        tables["matches"].write(number, stays.unionByName(tables["pairs"].read(number + 1).withColumn("status", status_of_pair()).select(matches.columns)))

    return stream.writeStream.foreachBatch(run)
