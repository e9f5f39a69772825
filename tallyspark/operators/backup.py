"""Snapshots: every table as Parquet with a manifest, or sealed in chunks; retention by name, restore into an empty place.

A sealed snapshot is of one moment: the files of all tables are listed until two listings in a row agree, and only those
are read. Each task packs its rows into chunks, Arrow batches under gzip, which are sealed with AES-256-GCM; snapshot,
table and place are the associated data, so that a chunk that was altered, swapped or taken from elsewhere is refused, and
the sealed manifest tells how many there are. No table passes the driver or one task.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = 1
#: Tables of a snapshot, parents first, and those left out: they hold nothing worth restoring. Fixed values.
SNAPSHOT_TABLES = (
    "organizations", "users", "memberships", "security_events", "org_settings", "subscriptions", "categories", "merchants", "bank_accounts", "imports", "receipts", "receipt_extractions", "transactions", "matches", "audit_logs",
)
EXCLUDED_TABLES = ("sessions", "password_reset_tokens", "email_verification_tokens", "rate_limits", "jobs")


def write_snapshot(tables: dict[str, DataFrame], path: str, created_at: str) -> dict[str, int]:
    """Each table as Parquet under `path`, then the manifest, whose presence says that the snapshot is whole; excluded
    tables are left out. Returns the rows of each."""
    spark, counts = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        if name in EXCLUDED_TABLES:
            continue
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    manifest = json.dumps({"format": FORMAT, "created_at": created_at, "rows": counts})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_manifest.d")
    return counts


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a whole snapshot; raises for another format or where rows are missing."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest.d").first()[0])
    if manifest["format"] != FORMAT:
        raise ValueError(f"snapshot of format {manifest['format']}, this reads {FORMAT}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["rows"]}
    for name, df in tables.items():
        if df.count() != manifest["rows"][name]:
            raise ValueError(f"{name} of the snapshot is not whole")
    return tables


def _published(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> dict[str, int]:
    """Write tables into a staging folder beside `target` and give it that name at once, when all is written; refuses where
    the target has data. What fails on the way leaves nothing behind and can be tried again."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    goal, staging = place(target), f"{target}.staging-{uuid.uuid4().hex}"
    system = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(goal) and len(system.listStatus(goal)):
        raise ValueError("refusing to restore: the target already has data")
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        counts = {name: spark.read.schema(df.schema).parquet(f"{staging}/{name}").count() for name, df in tables.items()}
        if system.exists(goal):
            system.delete(goal, False)  # empty
        if not system.rename(place(staging), goal):
            raise OSError(f"{staging} could not be renamed")
    finally:
        system.delete(place(staging), True)
    return counts


def restore(spark: SparkSession, path: str, target: str) -> dict[str, int]:
    """A snapshot's tables under an empty place, all of them or none."""
    return _published(spark, read_snapshot(spark, path), target)


def pinned(spark: SparkSession, paths: dict[str, str], tries: int = 20) -> dict[str, DataFrame]:
    """The Parquet tables under `paths` as they are at one moment: their files are listed until nothing changes between
    two listings. Files are never altered in place, so what is written later doesn't show."""

    def listed() -> dict[str, tuple[str, ...]]:
        return {name: tuple(sorted(spark.read.parquet(path).inputFiles())) for name, path in paths.items()}

    seen = listed()
    for _ in range(tries):
        now = listed()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the tables change too fast for a snapshot")
    return {name: spark.read.option("basePath", path).parquet(*seen[name]) if seen[name] else spark.read.parquet(path).limit(0) for name, path in paths.items()}


#: Rows of a sealed chunk, at most.
CHUNK_ROWS = 10_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's rows: part (the task), number, rows, payload."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            rows = batch.slice(at, CHUNK_ROWS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            payload = gzip.compress(sink.getvalue().to_pybytes(), 6, mtime=0)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (number, pa.int32()), (rows.num_rows, pa.int64()), (payload, pa.binary()))], names=["part", "number", "rows", "payload"])
            number += 1


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0):
            yield from pa.ipc.open_stream(gzip.decompress(payload.as_py()))


def _place(snapshot: str, name: str) -> Column:
    """The associated data of a chunk."""
    return F.concat(F.lit(f"{snapshot}/{name}/"), F.col("part").cast("string"), F.lit("/"), F.col("number").cast("string"))


def write_sealed(tables: dict[str, DataFrame], path: str, created_at: str, key: bytes) -> dict[str, int]:
    """Each table in sealed chunks under `path`, then the sealed manifest; excluded tables are left out. `key` has 32
    bytes. Returns the rows of each."""
    spark, snapshot, told = next(iter(tables.values())).sparkSession, uuid.uuid4().hex, {}
    lock = lambda value, about: F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), about)
    for name, df in tables.items():
        if name in EXCLUDED_TABLES:
            continue
        chunks = df.mapInArrow(_packed, "part int, number int, rows long, payload binary")
        chunks.select("part", "number", "rows", lock(F.col("payload"), _place(snapshot, name)).alias("sealed")).write.mode("errorifexists").parquet(f"{path}/{name}")
        found = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        told[name] = {"schema": df.schema.json(), "chunks": found.chunks, "rows": found.rows}
    manifest = json.dumps({"format": FORMAT, "created_at": created_at, "tables": told})
    row = spark.range(1).select(F.lit(snapshot).alias("snapshot"), lock(F.lit(manifest).cast("binary"), F.lit(f"{snapshot}/manifest")).alias("sealed"))
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest.d")
    return {name: t["rows"] for name, t in told.items()}


def read_sealed(spark: SparkSession, path: str, key: bytes) -> dict[str, DataFrame]:
    """The tables of a sealed snapshot; raises for a wrong key, another format, an altered manifest, or chunks that are
    missing or too many. A chunk that is not what it says fails where it is read."""
    row = spark.read.parquet(f"{path}/_manifest.d").first()
    opened = lambda value, about: F.try_aes_decrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), about)
    text = spark.range(1).select(opened(F.lit(bytes(row.sealed)), F.lit(f"{row.snapshot}/manifest")).cast("string")).first()[0]
    if text is None:
        raise ValueError("the snapshot can't be opened with this key, or its manifest was altered")
    manifest, out = json.loads(text), {}
    if manifest["format"] != FORMAT:
        raise ValueError(f"snapshot of format {manifest['format']}, this reads {FORMAT}")
    for name, told in manifest["tables"].items():
        chunks = spark.read.schema("part int, number int, rows long, sealed binary").parquet(f"{path}/{name}")
        found = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part", "number").alias("kinds"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        if (found.n, found.kinds, found.rows) != (told["chunks"], told["chunks"], told["rows"]):
            raise ValueError(f"{name} of the snapshot is not whole")
        plain = opened(F.col("sealed"), _place(row.snapshot, name))
        whole = F.coalesce(plain, F.raise_error(F.lit(f"a chunk of {name} was altered")).cast("binary"))
        out[name] = chunks.select(whole.alias("payload")).mapInArrow(_unpacked, StructType.fromJson(json.loads(told["schema"])))
    return out


def restore_sealed(spark: SparkSession, path: str, target: str, key: bytes) -> dict[str, int]:
    """A sealed snapshot's tables under an empty place, all of them or none."""
    return _published(spark, read_sealed(spark, path, key), target)


def to_delete(names: DataFrame, keep: int = 14) -> DataFrame:
    """(name): the snapshots beyond the newest `keep`, one at least; names sort by time, other names stay."""
    mine = names.where(F.col("name").endswith(".rcbk"))
    newest = Window.orderBy(F.desc("name"))  # a list of file names, one a day
    return mine.withColumn("n", F.row_number().over(newest)).where(F.col("n") > max(1, keep)).select("name")


def sealed(text: Column, key: Column) -> Column:
    """A text sealed with AES-256-GCM, as base 64; `key` has 32 bytes."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT")))


def unsealed(value: Column, key: Column) -> Column:
    """The text of `sealed`; null where the key is wrong or the value was altered."""
    return F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")
