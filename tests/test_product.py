import datetime
from dataclasses import asdict
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.config import MatchingConfig, configurations, with_rules
from tallyspark.functions.money import fixed2
from tallyspark.functions.reasons import parse_breakdown, translate_reason
from tallyspark.operators import backup, billing
from tallyspark.operators.ingest import ingest_receipts
from tallyspark.operators.reads import export_header, write_export
from tallyspark.operators.runs import propose
from tallyspark.operators.score import with_similarity
from tallyspark.sources import demo
from tallyspark.sources.documents import own_key, pdf_text, read_blobs
from tallyspark.sources.lake import read_table, write_tables
from tallyspark.sources.statements import commit_imports, parse_files
from tallyspark.streaming.ingest import MATCHES, match_stream

DAY = datetime.date(2026, 9, 28)


def test_three_hundred_receipts_match_in_seconds(spark):
    """300 receipts, 1 200 bank lines of one day, 97 amounts, 40 merchants: bounded pairs, and a time that no plan that
    repeats itself keeps."""
    names = [f"merchant {i}" for i in range(40)]
    r = spark.createDataFrame([(0, i, names[i % 40], DAY, 10.0 + i % 97, "EUR", "card") for i in range(300)], "org long, id long, merchant string, date date, total double, currency string, payment string")
    t = spark.createDataFrame([(0, i, names[i % 40], DAY, -(10.0 + i % 97), "EUR", "card") for i in range(1200)], "org long, id long, merchant string, date date, amount double, currency string, payment string")
    propose(r, t, similarity=with_similarity).count()
    began = time.time()
    pairs = propose(r, t, similarity=with_similarity).count()
    assert pairs <= 15_000 and time.time() - began < 30


def test_fixed_text_is_that_of_the_binary_value(spark):
    values = [1.005, 0.125, 8.345, 2.675, -1.005, 0.0, 1e9 + 0.125, -47.85, 0.004, 1.255, 10.235]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", fixed2(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["1.00", "0.13", "8.35", "2.67", "-1.00", "0.00", "1000000000.13", "-47.85", "0.00", "1.25", "10.23"]


def test_stored_configurations(spark):
    text = '{"weights": {"amount": 0.1, "paymentMethod": 0.2}, "amount": {"maxRelativeDelta": 0.1}, "date": {"maxDaysAfter": 9}, "maxCandidatesPerReceipt": 7}'
    c = MatchingConfig.from_json(text)
    assert (c.weights.payment_method, c.amount.max_relative, c.date.max_after, c.max_candidates) == (0.2, 0.1, 9, 7)
    assert c.merged({"thresholds": {"auto": 95}}).weights.amount == 0.1
    with pytest.raises(ValueError):
        c.merged({"thresholds": {"auto": 10}})
    rows = spark.createDataFrame([(1, text), (2, None), (3, "{")], "org long, matching_config string")
    found = {r.org: r.cfg.asDict(recursive=True) for r in configurations(rows).collect()}
    assert found[1] == asdict(c) and found[2] == found[3] == asdict(MatchingConfig())
    ruled, own = with_rules(spark.createDataFrame([(1,), (2,), (9,)], "org long"), rows)
    values = ruled.select("org", own.date.max_after.alias("after"), own.max_candidates.alias("cap"), own.weights.amount.alias("w")).collect()
    assert sorted(map(tuple, values)) == [(1, 9, 7, 0.1), (2, 5, 50, 0.4), (9, 5, 50, 0.4)]


def test_export_is_written_in_order(spark, tmp_path):
    at = [datetime.datetime(2026, 1, d) for d in (1, 2, 3)]
    lines = spark.createDataFrame([(1, 0, 5, at[0], "a"), (1, 0, 6, at[2], "b"), (1, 1, 7, at[1], "c"), (2, 0, 8, at[1], "d")], "org long, part int, id long, at timestamp_ntz, line string")
    audit = write_export(lines, str(tmp_path / "export"))
    files = sorted((tmp_path / "export" / "org=1").glob("part-*.txt"))
    text = b"".join(f.read_bytes() for f in files).decode()
    assert text == export_header() + "\r\nb\r\na\r\nc\r\n" and text.startswith("\ufeffReceipt ID,Receipt file,")
    assert {(r.org, r.detail) for r in audit.collect()} == {(1, "3 rows"), (2, "1 rows")}


def test_snapshot_and_restore(spark, tmp_path):
    tables = {"receipts": spark.range(5).toDF("id"), "matches": spark.range(3).toDF("id"), "jobs": spark.range(9).toDF("id")}
    path = str(tmp_path / "backup-20240116T120000Z.rcbk")
    assert backup.write_snapshot(tables, path, "2024-01-16") == {"receipts": 5, "matches": 3}
    assert backup.restore(spark, path, str(tmp_path / "new")) == {"receipts": 5, "matches": 3}
    with pytest.raises(ValueError, match="refusing"):
        backup.restore(spark, path, str(tmp_path / "new"))
    spark.range(2).toDF("id").write.mode("overwrite").parquet(f"{path}/matches")
    with pytest.raises(ValueError, match="not whole"):
        backup.read_snapshot(spark, path)
    key, other = F.lit("k" * 32), F.lit("o" * 32)
    row = spark.range(1).select(backup.sealed(F.lit("secret é"), key).alias("s")).select(backup.unsealed(F.col("s"), key).alias("a"), backup.unsealed(F.col("s"), other).alias("b"), F.contains("s", F.lit("secret")).alias("c")).first()
    assert tuple(row) == ("secret é", None, False)
    names = spark.createDataFrame([(f"backup-2024010{d}T000000Z.rcbk",) for d in range(1, 6)] + [("other.txt",)], "name string")
    assert sorted(r.name for r in backup.to_delete(names, 2).collect()) == [f"backup-2024010{d}T000000Z.rcbk" for d in (1, 2, 3)]
    assert backup.to_delete(names, 0).count() == 4


def test_plan_changes_are_checked():
    now = datetime.datetime(2024, 1, 16)
    assert billing.check_plan("free", now) is None
    assert billing.check_plan("pro", now, "2024-01-16") == datetime.datetime(2024, 1, 16, 23, 59, 59, 999000)
    for bad in (("gold", None, None), ("pro", None, None), ("pro", "2024-1-1", None), ("pro", "2024-02-31", None), ("pro", "2024-01-15", None), ("pro", "2028-01-01", None), ("pro", "2024-06-01", 0), ("free", None, 2_000_000)):
        with pytest.raises(ValueError):
            billing.check_plan(bad[0], now, bad[1], bad[2])


def test_pdf_tokens():
    body = b"BT (Caf\\351 \\(a\\)) Tj 0 -15 Td [(A) -50 (B) -500 (C)] TJ T* <48 65 6C 6c 6F 01> Tj ET\nBT (second block) Tj ET"
    import zlib

    for stream in (body, zlib.compress(body), zlib.compress(body)[2:-4]):
        assert pdf_text(b"%PDF-1.4\nstream\n" + stream + b"\nendstream") == "Café (a)\nAB  C\nHello\nsecond block"
    assert pdf_text(b"%PDF-1.4\nstream\nBT (short) Tj ET\nendstream") is None and pdf_text(None) is None


def test_blobs_of_an_organization(spark, tmp_path):
    for org, name in (("org_1", "a.pdf"), ("org_1", "b/c.pdf"), ("org_10", "d.pdf")):
        (tmp_path / org / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / org / name).write_bytes(name.encode())
    assert sorted(bytes(r.content).decode() for r in read_blobs(spark, str(tmp_path), "org_1").collect()) == ["a.pdf", "b/c.pdf"]
    with pytest.raises(ValueError):
        read_blobs(spark, str(tmp_path), "../x")
    keys = spark.createDataFrame([("org_1/a",), ("org_10/a",), ("org_1/../x",)], "k string")
    assert [r[0] for r in keys.select(own_key(F.col("k"), F.lit("org_1"))).collect()] == [True, False, False]


def test_refused_statements_are_told(spark):
    files = [("empty", " \n"), ("null", None), ("binary", "date,amount\n\0"), ("large", "x" * (11 << 20)), ("odd", "foo,bar\n1,2\n3,4"), ("good", "date,amount,text\n2026-01-02,5,a")]
    got = parse_files(spark.createDataFrame(files, "file string, content string")).collect()
    assert {(r.file, r.row_number, r.issue) for r in got} == {("empty", 0, "empty"), ("null", 0, "empty"), ("binary", 0, "not text"), ("large", 0, "too large"), ("odd", 0, "missing column"), ("good", 2, None)}


RECEIPTS = "org long, id long, checksum string, merchant string, date date, total double, currency string, payment string, invoice string, category string, is_duplicate boolean, duplicate_of long, status string, created_at timestamp_ntz, overall double"


def test_demonstration_from_document_to_match(spark):
    found = demo.entries(spark, 24)
    none = lambda schema: spark.createDataFrame([], schema)
    names = spark.createDataFrame([(1, "Food"), (1, "Software")], "org long, name string")
    bank = commit_imports(demo.statement(found), none("org long, checksum string"), none("org long, fingerprint string"), none("org long, account_name string"), names)
    t = bank["transactions"].withColumn("id", F.col("row_number").cast("long"))
    t = t.select("org", "id", F.col("merchant_norm").alias("merchant"), "date", "amount", "currency", F.col("payment_method").alias("payment"))
    assert bank["imports"].first().imported == t.count() == 16 and bank["issues"].count() == 0
    out = ingest_receipts(demo.receipts(found), none(RECEIPTS), t, none(MATCHES), none("org long, merchant_id string, name string, normalized string"), names, similarity=with_similarity)
    kind = {r.id: r.kind for r in found.collect()}
    rows = {r.id: r for r in out["receipts"].collect()}
    assert {i for i, r in rows.items() if r.is_duplicate} == {i for i, k in kind.items() if k == "duplicate"}
    assert all(rows[i].duplicate_of == i - 1 and rows[i].status == "needs_review" for i, k in kind.items() if k == "duplicate")
    assert all(rows[i].status == "completed" for i, k in kind.items() if k == "exact")
    assert all(rows[i].status in ("completed", "needs_review") for i, k in kind.items() if k in ("later", "more"))
    assert all(rows[i].status == "unmatched" for i, k in kind.items() if k == "receipt_only")
    matched = {(r.r_id, r.status) for r in out["matches"].collect() if r.status in ("auto", "suggested")}
    assert {i for i, _ in matched} == {i for i, k in kind.items() if k in ("exact", "later", "more")}
    trail = out["audit"].groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in trail}["receipt.extracted"] == 20 and {r["action"]: r["count"] for r in trail}["receipt.duplicate_flagged"] == 4
    # the same documents again change nothing
    again = ingest_receipts(demo.receipts(found), out["receipts"], t, none(MATCHES), out["merchants"], names, similarity=with_similarity)
    assert again["merchants"].count() == out["merchants"].count()
    assert {(r.id, r.status, r.is_duplicate) for r in again["receipts"].collect()} == {(r.id, r.status, r.is_duplicate) for r in rows.values()}


def test_stream_equals_batch(spark, tmp_path):
    schema = "side string, org long, id long, merchant string, date date, total double, amount double, currency string, payment string, is_duplicate boolean, status string, created_at timestamp_ntz"
    at = datetime.datetime(2026, 9, 28)
    r = [("receipt", i % 2, i, f"shop {i}", DAY, 10.0 + 5 * i, None, "EUR", "card", False, "processing", at) for i in range(6)]
    t = [("transaction", i % 2, 100 + i, f"shop {i}", DAY, None, -(10.0 + 5 * i), "EUR", "card", None, None, at) for i in range(6)]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([r[:3] + t[:2], t[2:], r[3:], r[:3]]):  # the last batch comes again
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    job = match_stream(stream, str(tmp_path / "state")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert job.awaitTermination(240)
    last = max((tmp_path / "state" / "matches").iterdir(), key=lambda p: int(p.name[1:]))
    got = {(m.org, m.r_id, m.t_id, m.status) for m in spark.read.schema(MATCHES).parquet(str(last)).collect()}
    assert {g for g in got if g[3] in ("auto", "suggested")} == {(i % 2, i, 100 + i, "auto") for i in range(6)}


def test_an_organization_is_a_partition(spark, tmp_path):
    rows = spark.createDataFrame([(o, i, f"x{i}") for o in range(3) for i in range(20)], "org long, id long, name string")
    write_tables({"receipts": rows}, str(tmp_path / "lake"))
    mine = read_table(spark, str(tmp_path / "lake"), "receipts", 1).select("id")
    assert mine.count() == 20
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_breakdowns_are_read_once_and_rules_tried_by_their_start(spark):
    """A stored text is parsed once; words of a sentence are cut out once each; texts that are none give null."""
    texts = spark.createDataFrame([('{"score": 1.5, "signals": [{"name": "date", "reason": "x"}]}',), ("nothing",), ("",), ("{}",), (None,)], "text string")
    read = texts.select(parse_breakdown(F.col("text")).alias("b"))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.b and (r.b.score, r.b.signals[0].reason) for r in read.collect()] == [(1.5, "x"), None, None, None, None]
    said = spark.createDataFrame([("Amounts differ by day",), ("Amounts differ",), ("Same date",), ("Transaction 2 days after receipt",), ("3 days before receipt, outside tolerance",), ("Merchant similarity 7%, too low",), ("Same date.",), (None,)], "s string")
    french = said.select(translate_reason(F.col("s")).alias("s"))
    plan = french._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 30 and plan.count("RLIKE") <= 14
    assert [r.s for r in french.collect()] == ["Les montants diffèrent de jour", "Amounts differ", "Même date", "Opération 2 jours après le justificatif", "3 jours avant le justificatif, hors tolérance", "Similarité du commerçant 7 %, trop faible", "Same date.", None]
