import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import backup

KEY = b"k" * 32


def rows_of(df):
    return sorted(map(repr, df.collect()))


def lake(spark, tmp_path):
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, 678901)
    receipts = [(i % 3, i, None if i % 7 == 0 else f"é {i}", decimal.Decimal(i) / 8, at, [i, None], float("nan") if i == 5 else i / 3, bytes([i % 256])) for i in range(500)]
    spark.createDataFrame(receipts, "org long, id long, name string, total decimal(12,3), at timestamp_ntz, parts array<int>, score double, raw binary").repartition(3).write.partitionBy("org").parquet(str(tmp_path / "lake/receipts"))
    spark.range(40).toDF("id").write.parquet(str(tmp_path / "lake/matches"))
    spark.range(9).toDF("id").write.parquet(str(tmp_path / "lake/jobs"))
    return {n: str(tmp_path / "lake" / n) for n in ("receipts", "matches", "jobs")}


def test_a_sealed_snapshot_is_of_one_moment_and_comes_back_whole(spark, tmp_path):
    paths = lake(spark, tmp_path)
    tables = backup.pinned(spark, paths)
    want = {n: rows_of(df) for n, df in tables.items()}
    # written between the reads of two tables: not in the snapshot
    spark.range(100, 120).toDF("id").write.mode("append").parquet(paths["matches"])
    place = str(tmp_path / "s.rcbk")
    assert backup.write_sealed(tables, place, "2026-01-02", KEY) == {"receipts": 500, "matches": 40}
    assert not any(b"\xc3\xa9 12" in f.read_bytes() for f in (tmp_path / "s.rcbk").rglob("*.parquet"))
    assert backup.restore_sealed(spark, place, str(tmp_path / "new"), KEY) == {"receipts": 500, "matches": 40}
    for name in ("receipts", "matches"):
        back = spark.read.parquet(str(tmp_path / "new" / name))
        assert rows_of(back.select(tables[name].columns)) == want[name]
    with pytest.raises(ValueError, match="refusing"):
        backup.restore_sealed(spark, place, str(tmp_path / "new"), KEY)
    with pytest.raises(ValueError, match="key"):
        backup.read_sealed(spark, place, b"o" * 32)


@pytest.fixture(autouse=True)
def small_batches(spark):
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_swapped_cut_and_repeated_chunks_are_refused_and_a_failed_restore_can_be_repeated(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    spark.range(35).toDF("id").coalesce(1).write.parquet(str(tmp_path / "lake"))
    spark.range(5).toDF("id").write.parquet(str(tmp_path / "other"))
    place = str(tmp_path / "s")
    backup.write_sealed(backup.pinned(spark, {"first": str(tmp_path / "other"), "second": str(tmp_path / "lake")}), place, "x", KEY)
    whole = spark.read.parquet(f"{place}/second").collect()
    assert len(whole) == 4
    good = spark.createDataFrame(whole, "part int, number int, rows long, sealed binary")

    def put(rows):
        spark.createDataFrame(rows, good.schema).write.mode("overwrite").parquet(f"{place}/second")

    a, b, c, d = whole
    for rows, said in (([a, b, c], "not whole"), ([a, b, c, c], "not whole"), ([(a[0], a[1], a[2], b[3]), (b[0], b[1], b[2], a[3]), c, d], "altered"), ([a, b, c, (*d[:3], bytes(d[3])[:-1] + b"\0")], "altered")):
        put(rows)
        with pytest.raises(Exception, match=said):
            backup.restore_sealed(spark, place, str(tmp_path / "new"), KEY)
        assert not (tmp_path / "new").exists() and not list(tmp_path.glob("new.staging*"))
    put(whole)
    assert backup.restore_sealed(spark, place, str(tmp_path / "new"), KEY) == {"first": 5, "second": 35}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "new/second")).collect()) == list(range(35))
