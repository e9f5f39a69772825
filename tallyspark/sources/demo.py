"""Demonstration data by rule: receipts as PDFs and the bank statement that belongs to them, of six kinds in turn.

Kinds: exact, a day later, charged a little more, without bank line, repeated receipt, without receipt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.adapters import MERCHANTS
from tallyspark.sources.documents import receipt_pdf

KINDS = ("exact", "later", "more", "receipt_only", "duplicate", "bank_only")


def entries(spark: SparkSession, count: int, org: int = 1) -> DataFrame:
    """`described` entries, `count` of one organization."""
    return described(spark.range(count).select(F.lit(org).cast("long").alias("org"), "id"))


def described(rows: DataFrame) -> DataFrame:
    """(org, id, kind, merchant, cents, date) for rows (org, id); a repeated receipt has what the one before it has."""
    k = F.col("id")
    kind = F.element_at(F.array(*(F.lit(x) for x in KINDS)), (k % len(KINDS) + 1).cast("int"))
    of = F.when(kind == "duplicate", k - 1).otherwise(k)
    name = F.element_at(F.array(*(F.lit(m) for m in MERCHANTS)), (of % len(MERCHANTS) + 1).cast("int"))
    day = F.date_add(F.lit("2026-01-05").cast("date"), (of * 9).cast("int"))
    return rows.select("org", k.alias("id"), kind.alias("kind"), name.alias("merchant"), (of * 735 + 1990).alias("cents"), day.alias("date"))


def _money(cents) -> str:
    return f"concat(cast({cents} div 100 as string), '.', lpad(cast({cents} % 100 as string), 2, '0'))"


def receipts(found: DataFrame) -> DataFrame:
    """(org, id, file, content, mime, name, created_at): the PDFs of all entries that have a receipt."""
    text = F.concat(
        F.upper("merchant"), F.lit("\n12 Avenue Habib\nInvoice No: INV-"), F.col("id").cast("string"), F.lit("\nDate: "), F.date_format("date", "d MMM yyyy"), F.lit("\nItem   "), F.expr(_money("cents")),
        F.lit("\nTOTAL   "), F.expr(_money("cents")), F.lit("\nPaid by card\nCurrency: EUR"),
    )
    rows = found.where("kind <> 'bank_only'")
    created = F.timestamp_add("HOUR", F.col("id"), F.lit("2026-06-01").cast("timestamp_ntz"))
    return rows.select("org", "id", F.concat_ws("/", F.col("org").cast("string"), F.col("id").cast("string")).alias("file"), receipt_pdf(text).alias("content"), F.lit("application/pdf").alias("mime"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("name"), created.alias("created_at"))


def statement(found: DataFrame) -> DataFrame:
    """(org, file, content, account_name): one statement of all entries that have a bank line, of a bounded demonstration."""
    charged = F.when(F.col("kind") == "more", F.expr("cents + cents div 100")).otherwise(F.col("cents"))
    posted = F.when(F.col("kind") == "later", F.date_add("date", 1)).otherwise(F.col("date"))
    rows = found.where("kind not in ('receipt_only', 'duplicate')").withColumn("charged", charged)
    line = F.concat(F.date_format(posted, "dd/MM/yyyy"), F.lit(',"POS '), F.upper("merchant"), F.lit('",'), F.expr(_money("charged")), F.lit(",,EUR"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda r: r["line"])
    whole = F.concat(F.lit("Booking Date,Description,Debit,Credit,Currency\n"), F.array_join(lines, "\n"))
    return rows.groupBy("org").agg(whole.alias("content")).select("org", F.lit("demo.csv").alias("file"), "content", F.lit("Demo account").alias("account_name"))
