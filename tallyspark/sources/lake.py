"""The product's tables as Parquet, partitioned by organization, so that a read of one prunes all others' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table under its name, in a folder an organization; a large organization is spread over several files."""
    for name, df in tables.items():
        spread = F.pmod(F.xxhash64(*(c for c in ("id", "r_id", "t_id") if c in df.columns)), F.lit(16)) if {"id", "r_id"} & set(df.columns) else F.lit(0)
        df.repartition("org", spread).write.mode(mode).partitionBy("org").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, org: int | None = None) -> DataFrame:
    """A table, or one organization's rows of it."""
    df = spark.read.parquet(f"{path}/{name}")
    return df if org is None else df.where(F.col("org") == org)
