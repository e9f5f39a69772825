"""The product's reads: lists, search, paging, dashboard, export. All scope by organization first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import csv_cell, number_text
from tallyspark.functions.tables import EXPORT_COLUMNS
from tallyspark.functions.text import like_term

MATCHED, LIVE, OFFERED = ("confirmed", "auto"), ("suggested", "confirmed", "auto"), ("suggested", "confirmed", "auto", "alternate")
#: Null totals and confidences stand where a database with nulls as the largest value puts them.
RECEIPT_SORTS = {
    "newest": F.desc_nulls_first, "oldest": F.asc_nulls_last, "amount_desc": F.desc_nulls_first, "amount_asc": F.asc_nulls_last, "confidence_asc": F.asc_nulls_last,
}
SORT_COLUMN = {"newest": "created_at", "oldest": "created_at", "amount_desc": "total", "amount_asc": "total", "confidence_asc": "confidence"}


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page, numbered from 1, of 1 to 100 rows. `order` must end in a unique key."""
    size, number = min(max(size, 1), 100), max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """`df` under the conditions that are given."""
    for condition in conditions:
        df = df if condition is None else df.where(condition)
    return df


def best_status(matches: DataFrame) -> DataFrame:
    """(org, r_id, match_status): the best status of each receipt: confirmed, auto, suggested, alternate; rejected ones don't count."""
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "auto", 1).when(F.col("status") == "suggested", 2).otherwise(3)
    return matches.where("status <> 'rejected'").groupBy("org", "r_id").agg(F.min_by("status", rank).alias("match_status"))


def list_receipts(receipts: DataFrame, matches: DataFrame, *, org: int, status: str | None = None, category: str | None = None, search: str | None = None, columns: Sequence[str] = ("invoice",), sort: str = "newest", number: int = 1, size: int = 25) -> DataFrame:
    """A page of receipts with their best match status; the search reads `columns` and the total as text."""
    term = None
    if search:
        term = like_term(number_text(F.col("total")), search)
        for c in columns:
            term = term | like_term(F.coalesce(F.col(c), F.lit("")), search)
    found = where_all(receipts.where(F.col("org") == org), None if status is None else F.col("status") == status, None if category is None else F.col("category") == category, term)
    key, by = SORT_COLUMN.get(sort, "created_at"), RECEIPT_SORTS.get(sort, F.desc_nulls_first)
    # the page is cut first: statuses are looked up for its rows only
    rows = page(found, [by(key), F.asc("id")], number, size)
    return rows.join(F.broadcast(rows.select(F.col("id").alias("r_id"))).join(matches.where(F.col("org") == org), "r_id").transform(best_status).drop("org"), rows["id"] == F.col("r_id"), "left").drop("r_id")


def list_matches(matches: DataFrame, receipts: DataFrame, transactions: DataFrame, *, org: int, statuses: Sequence[str] = LIVE, number: int = 1, size: int = 25) -> DataFrame:
    """A page of matches with both sides, highest score first."""
    top = page(matches.where((F.col("org") == org) & F.col("status").isin(*statuses)), [F.desc("score"), F.asc("r_id"), F.asc("t_id")], number, size)
    r = receipts.where(F.col("org") == org).select(F.col("id").alias("r_id"), "total", "invoice")
    t = transactions.where(F.col("org") == org).select(F.col("id").alias("t_id"), "amount")
    return top.join(r, "r_id", "left").join(t, "t_id", "left")


def unmatched(rows: DataFrame, matches: DataFrame, key: str, statuses: Sequence[str] = LIVE) -> DataFrame:
    """Rows (org, id, …) with no match of the given statuses; `key` is r_id or t_id."""
    return rows.join(matches.where(F.col("status").isin(*statuses)).select("org", F.col(key).alias("id")).distinct(), ["org", "id"], "left_anti")


def dashboard(receipts: DataFrame, transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts and the reconciliation rate of each organization, one pass over each table."""
    r = receipts.groupBy("org").agg(
        F.count_if(~F.col("is_duplicate")).alias("receipts"), F.count_if("is_duplicate").alias("duplicates"))
    t = transactions.groupBy("org").agg(F.count(F.lit(1)).alias("transactions"))
    m = matches.groupBy("org").agg(
        F.count_if(F.col("status").isin(*MATCHED)).alias("matched"), F.count_if(F.col("status") == "suggested").alias("needs_review"))
    no_r = unmatched(receipts.where("not is_duplicate"), matches, "r_id").groupBy("org").agg(F.count(F.lit(1)).alias("unmatched_receipts"))
    no_t = unmatched(transactions, matches, "t_id").groupBy("org").agg(F.count(F.lit(1)).alias("unmatched_transactions"))
    out = r
    for part in (t, m, no_r, no_t):
        out = out.join(part, "org", "full")
    out = out.na.fill(0)
    rate = F.when(F.col("receipts") > 0, F.least(F.lit(100.0), F.floor(F.col("matched") / F.col("receipts") * 1000 + F.lit(0.5)) / 10)).otherwise(F.lit(0.0))
    return out.withColumn("rate", rate)


def top_currency(transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """Of each organization the currency of most matched money, in cents."""
    live = matches.where(F.col("status").isin(*MATCHED)).select("org", F.col("t_id").alias("id"))
    cents = F.floor(F.abs("amount") * 100 + F.lit(0.5)).cast("long")
    sums = live.join(transactions, ["org", "id"]).groupBy("org", "currency").agg(F.sum(cents).alias("cents"))
    return sums.groupBy("org").agg(F.max(F.struct(F.col("cents"), F.col("currency"))).alias("top")).select("org", "top.currency", "top.cents")


def modal_currency(receipts: DataFrame) -> DataFrame:
    """The most frequent currency of each organization, the alphabetically first of equals."""
    counts = receipts.where("currency is not null").groupBy("org", "currency").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("org").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("currency"), F.col("n"))).alias("top")).select("org", "top.currency", "top.n")


def category_spend(receipts: DataFrame, limit: int = 9) -> DataFrame:
    """Spend by category, largest first: the report's top rows."""
    sums = receipts.where("not is_duplicate").groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(
        F.sum(F.floor(F.col("total") * 100 + F.lit(0.5)).cast("long")).alias("raw"), F.count(F.lit(1)).alias("receipts"))
    return sums.orderBy(F.desc_nulls_first("raw"), F.asc("category")).limit(limit).select("category", F.coalesce("raw", F.lit(0)).alias("cents"), "receipts")


def receipt_label() -> Column:
    """Duplicate, Matched, Needs review or Unmatched, the first that holds."""
    return F.when(F.col("is_duplicate"), "Duplicate").when(F.col("match_status").isin(*MATCHED), "Matched").when(F.col("match_status") == "suggested", "Needs review").otherwise("Unmatched")


def export_rows(receipts: DataFrame, matches: DataFrame, transactions: DataFrame, scope: str = "all") -> DataFrame:
    """(org, part, id, at, line): CSV lines, 16 cells each, of receipts with their live match, then, for scope
    `unmatched`, of transactions without receipt. Written in the order of part, at descending, id.

    `receipts` has file, merchant_raw, tax and created_at, `matches` has method, `transactions` has description.
    """
    live = matches.where(F.col("status").isin(*LIVE)).select("org", F.col("r_id").alias("id"), "t_id", F.col("status").alias("match_status"), "score", "method")
    t = transactions.select("org", F.col("id").alias("t_id"), "amount", F.col("date").alias("t_date"), "description")
    rows = receipts.join(live, ["org", "id"], "left").join(t, ["org", "t_id"], "left").withColumn("label", receipt_label())
    keep = {"all": F.lit(True), "matched": F.col("match_status").isin(*MATCHED), "review": F.col("match_status") == "suggested", "unmatched": F.col("label") == "Unmatched"}[scope]
    cells = [
        F.col("id"), F.col("file"), F.col("merchant_raw"), F.date_format("date", "yyyy-MM-dd"), number_text(F.col("total")), F.col("currency"), number_text(F.col("tax")), F.col("invoice"), F.col("category"), F.col("t_id"), F.col("description"),
        F.date_format("t_date", "yyyy-MM-dd"), number_text(F.col("amount")), F.concat(number_text(F.col("score")), F.lit("%")), F.col("method"), F.col("label"),
    ]
    out = rows.where(keep).select("org", F.lit(0).alias("part"), "id", F.col("created_at").cast("timestamp_ntz").alias("at"), F.concat_ws(",", *(csv_cell(c) for c in cells)).alias("line"))
    if scope != "unmatched":
        return out
    lone = unmatched(transactions, matches, "t_id")
    empty = F.lit("")
    cells = [
        empty, empty, empty, empty, empty, F.col("currency"), empty, empty, F.col("category"), F.col("id"), F.col("description"), F.date_format("date", "yyyy-MM-dd"), number_text(F.col("amount")), empty, empty,
        F.lit("Transaction without receipt"),
    ]
    return out.unionByName(lone.select("org", F.lit(1).alias("part"), "id", F.col("date").cast("timestamp_ntz").alias("at"), F.concat_ws(",", *(csv_cell(c) for c in cells)).alias("line")))


def write_export(lines: DataFrame, path: str) -> DataFrame:
    """Write `export_rows` as text files of CR LF lines under a folder for each organization, in their order; the header
    with its byte order mark begins the first. Returns the audit rows (org, action, entity_type, entity_id, detail)."""
    header = lines.select("org").distinct().select("org", F.lit(-1).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(export_header()).alias("line"))
    everything = lines.unionByName(header).withColumn("value", F.concat("line", F.lit("\r")))
    order = ["org", "part", F.desc_nulls_first("at"), "id"]
    everything.repartitionByRange(*order).sortWithinPartitions(*order).select("org", "value").write.partitionBy("org").text(path)
    return lines.groupBy("org").agg(F.count(F.lit(1)).alias("n")).select("org", F.lit("export.generated").alias("action"), F.lit("organization").alias("entity_type"), F.col("org").alias("entity_id"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def export_header() -> str:
    """The export's first line, behind a byte order mark."""
    return "﻿" + ",".join(EXPORT_COLUMNS)


def quota_usage(receipts: DataFrame, now: str) -> DataFrame:
    """Receipts that count against the quota in the month of `now`, by organization."""
    since = F.date_trunc("month", F.lit(now).cast("timestamp_ntz"))
    return receipts.where(~F.col("is_duplicate") & (F.col("created_at") >= since) & (F.col("created_at") < F.lit(now).cast("timestamp_ntz"))).groupBy("org").agg(F.count(F.lit(1)).alias("used"))
