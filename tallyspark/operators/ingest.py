"""Receipts from document to match: extract, name the merchant, suggest a category, stop repeats, match, end in a state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.config import Config, MatchingConfig
from tallyspark.functions.reasons import duplicate_reason
from tallyspark.functions.text import normalize_merchant, suggest_category
from tallyspark.operators.actions import audit_rows, matching_run, processed_status, upsert_merchants, with_category_named
from tallyspark.operators.assign import flag_duplicates
from tallyspark.session import cut
from tallyspark.sources.documents import extract_documents


def ingest_receipts(documents: DataFrame, receipts: DataFrame, transactions: DataFrame, matches: DataFrame, merchants: DataFrame, categories: DataFrame, config: Config = MatchingConfig(), remote: Callable | None = None, similarity=None) -> dict[str, DataFrame]:
    """New documents (org, id, file, content, mime, name, created_at) through the whole pipeline.

    `receipts` are the earlier ones: org, id, checksum, merchant, date, total, currency, payment, invoice, category,
    is_duplicate, duplicate_of, status, created_at, overall. Returns receipts (all), matches, merchants and audit. A
    repeat of an earlier receipt needs review and is not matched; the others end as their run says. Receipts that
    come again replace themselves.
    """
    read = extract_documents(documents, remote).withColumn("merchant_norm", normalize_merchant(F.col("merchant")))
    read = with_category_named(read, categories, suggest_category(F.col("merchant_norm"), F.col("merchant")))
    fields = cut(read.select(
        "org", "id", F.sha2("content", 256).alias("checksum"), F.nullif("merchant_norm", F.lit("")).alias("merchant"), F.col("merchant").alias("merchant_raw"), "date", "total", "currency", F.col("payment_method").alias("payment"), F.col("invoice_number").alias("invoice"), "category", "created_at", "overall", "provider",
    ))
    kept = receipts.join(fields.select("org", "id"), ["org", "id"], "left_anti")
    columns = [c for c in receipts.columns if c in fields.columns]
    everything = kept.unionByName(fields.select(*columns, F.lit(False).alias("is_duplicate"), F.lit(None).cast("long").alias("duplicate_of"), F.lit("matching").alias("status")))
    everything = cut(everything)
    # repeats are sought among the receipts that are none themselves; only new ones are flagged
    candidates = everything.where("not is_duplicate").select("org", "id", "checksum", "merchant", "date", "total", "invoice", "created_at")
    flags = flag_duplicates(candidates, config).join(fields.select("org", "id"), ["org", "id"], "left_semi")
    flags = cut(flags.join(candidates.select("org", "id", "invoice", F.col("date").alias("_d")), ["org", "id"]).join(candidates.select("org", F.col("id").alias("original"), F.col("date").alias("_o")), ["org", "original"]))
    new = fields.select("org", "id", F.lit(True).alias("_new"))
    flagged = everything.join(flags.select("org", "id", "original"), ["org", "id"], "left").withColumn("is_duplicate", F.col("is_duplicate") | F.col("original").isNotNull()).withColumn("duplicate_of", F.coalesce("original", "duplicate_of")).drop("original")
    run = matching_run(flagged.join(new, ["org", "id"]).drop("_new"), transactions, matches, config, similarity)
    ended = run["receipts"].select("org", "id", F.when(F.col("is_duplicate"), "needs_review").otherwise(processed_status(F.when(F.col("status") != "matching", F.col("status")), F.col("overall"))).alias("_ended"))
    done = flagged.join(ended, ["org", "id"], "left").withColumn("status", F.coalesce("_ended", "status")).drop("_ended")
    said = F.concat(F.lit("via "), "provider", F.lit(", confidence "), F.floor(F.col("overall") * 100 + F.lit(0.5)).cast("long").cast("string"), F.lit("%"))
    audit = audit_rows(fields, "receipt.extracted", "receipt", F.col("id"), said)
    audit = audit.unionByName(audit_rows(flags, "receipt.duplicate_flagged", "receipt", F.col("id"), duplicate_reason(F.col("rule"), F.col("invoice"), F.datediff("_d", "_o")))).unionByName(run["audit"])
    seen = fields.select("org", F.col("merchant_raw").alias("name"), F.coalesce("merchant", F.lit("")).alias("normalized"))
    return {"receipts": done, "matches": run["matches"], "merchants": upsert_merchants(merchants, seen), "audit": audit, "stats": run["stats"]}
