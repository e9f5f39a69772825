"""Queries of the product's lists, dashboard and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import reads
from tallyspark.plans.adapted import NAMED, SAID
from tallyspark.plans.registry import query
from tallyspark.sources.adapters import matches, receipts, sql, table, transactions

LIVE = "('suggested', 'confirmed', 'auto')"
BEST = """, best AS (SELECT org, r_id, arg_min(status, CASE status WHEN 'confirmed' THEN 0 WHEN 'auto' THEN 1 WHEN 'suggested' THEN 2 ELSE 3 END) AS match_status
    FROM matches WHERE status <> 'rejected' GROUP BY org, r_id)"""
RM = sql("receipts", "matches")
ALL = sql("receipts", "transactions", "matches")


@query(RM + BEST + " SELECT org, r_id, match_status FROM best")
def receipt_best_status(spark, sf_dir):
    """The best match status of each receipt."""
    return reads.best_status(matches(spark, sf_dir))


@query(RM + BEST + """ SELECT r.id, r.total, r.invoice, match_status FROM (SELECT * FROM receipts WHERE org = 2 ORDER BY total DESC NULLS FIRST, id LIMIT 25 OFFSET 25) r
    LEFT JOIN best b ON b.org = r.org AND b.r_id = r.id""")
def receipt_list_page(spark, sf_dir):
    """Page 2 of an organization's receipts, largest first."""
    return reads.list_receipts(receipts(spark, sf_dir), matches(spark, sf_dir), org=2, sort="amount_desc", number=2).select("id", "total", "invoice", "match_status")


@query(RM + """ SELECT id, total, invoice FROM receipts WHERE org = 1 AND status = 'completed' AND (lower(invoice) LIKE '%12%' OR CAST(total AS VARCHAR) LIKE '%12%')
    ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""")
def search_receipts(spark, sf_dir):
    """Completed receipts of an organization that say 12 in invoice number or total."""
    return reads.list_receipts(receipts(spark, sf_dir), matches(spark, sf_dir), org=1, status="completed", search="12", size=100).select("id", "total", "invoice")


def _page_sql(statuses: str) -> str:
    return ALL + f""" SELECT m.r_id, m.t_id, m.score, m.status, r.total, t.amount FROM
      (SELECT * FROM matches WHERE org = 3 AND status IN {statuses} ORDER BY score DESC, r_id, t_id LIMIT 25) m
      LEFT JOIN receipts r ON r.org = 3 AND r.id = m.r_id LEFT JOIN transactions t ON t.org = 3 AND t.id = m.t_id"""


@query(_page_sql("('suggested')"))
def review_queue_page(spark, sf_dir):
    """The first page of suggestions, most confident first."""
    found = reads.list_matches(matches(spark, sf_dir), receipts(spark, sf_dir), transactions(spark, sf_dir), org=3, statuses=("suggested",))
    return found.select("r_id", "t_id", "score", "status", "total", "amount")


@query(_page_sql("('confirmed', 'auto')"))
def matched_page(spark, sf_dir):
    """The first page of matched pairs."""
    found = reads.list_matches(matches(spark, sf_dir), receipts(spark, sf_dir), transactions(spark, sf_dir), org=3, statuses=reads.MATCHED)
    return found.select("r_id", "t_id", "score", "status", "total", "amount")


@query(RM + f" SELECT org, id FROM receipts r WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = r.org AND m.r_id = r.id AND m.status IN {LIVE})")
def unmatched_receipts(spark, sf_dir):
    """Receipts without live match."""
    return reads.unmatched(receipts(spark, sf_dir).where("not is_duplicate"), matches(spark, sf_dir), "r_id").select("org", "id")


@query(ALL + f" SELECT org, id FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = t.org AND m.t_id = t.id AND m.status IN {LIVE})")
def unmatched_transactions(spark, sf_dir):
    """Transactions without live match."""
    return reads.unmatched(transactions(spark, sf_dir), matches(spark, sf_dir), "t_id").select("org", "id")


@query(ALL + f""", a AS (SELECT org, count(*) FILTER (NOT is_duplicate) AS receipts, count(*) FILTER (is_duplicate) AS duplicates FROM receipts GROUP BY org),
    b AS (SELECT org, count(*) AS transactions FROM transactions GROUP BY org),
    c AS (SELECT org, count(*) FILTER (status IN ('confirmed', 'auto')) AS matched, count(*) FILTER (status = 'suggested') AS needs_review FROM matches GROUP BY org),
    d AS (SELECT org, count(*) AS unmatched_receipts FROM receipts r WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = r.org AND m.r_id = r.id AND m.status IN {LIVE}) GROUP BY org),
    e AS (SELECT org, count(*) AS unmatched_transactions FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = t.org AND m.t_id = t.id AND m.status IN {LIVE}) GROUP BY org)
    SELECT org, receipts, duplicates, transactions, matched, needs_review, coalesce(unmatched_receipts, 0) AS unmatched_receipts, coalesce(unmatched_transactions, 0) AS unmatched_transactions,
      least(100.0::DOUBLE, floor(matched::DOUBLE / receipts * 1000 + 0.5) / 10) AS rate FROM a JOIN b USING (org) JOIN c USING (org) LEFT JOIN d USING (org) LEFT JOIN e USING (org)""")
def dashboard_stats(spark, sf_dir):
    """Counts and reconciliation rate by organization."""
    return reads.dashboard(receipts(spark, sf_dir), transactions(spark, sf_dir), matches(spark, sf_dir))


@query(ALL + """ SELECT org, arg_max(currency, (cents, currency)) AS currency, max(cents) AS cents FROM (SELECT t.org, t.currency, CAST(sum(CAST(floor(abs(amount) * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
    FROM matches m JOIN transactions t ON t.org = m.org AND t.id = m.t_id WHERE m.status IN ('confirmed', 'auto') GROUP BY t.org, t.currency) GROUP BY org""")
def top_currency(spark, sf_dir):
    """The currency of most matched money."""
    return reads.top_currency(transactions(spark, sf_dir), matches(spark, sf_dir))


@query(RM + " SELECT org, currency, n FROM (SELECT org, currency, count(*) AS n, row_number() OVER (PARTITION BY org ORDER BY count(*) DESC, currency) AS k FROM receipts GROUP BY org, currency) WHERE k = 1")
def modal_currency(spark, sf_dir):
    """The most frequent currency."""
    return reads.modal_currency(receipts(spark, sf_dir))


@query(RM + """ SELECT category, coalesce(CAST(sum(CAST(floor(total * 100 + 0.5) AS BIGINT)) AS BIGINT), 0) AS cents, count(*) AS receipts FROM receipts WHERE NOT is_duplicate
    GROUP BY category ORDER BY cents DESC, category LIMIT 9""")
def category_spend_top9(spark, sf_dir):
    """Spend of the nine largest categories."""
    return reads.category_spend(receipts(spark, sf_dir))


def _plain(column: str) -> str:
    """A number of whole cents as the shortest text."""
    cents = f"CAST(floor(abs({column}) * 100 + 0.5) AS BIGINT)"
    cut = f"regexp_replace(regexp_replace(CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'), '0+$', ''), '\\.$', '')"
    return f"(CASE WHEN {column} < 0 AND {cents} > 0 THEN '-' ELSE '' END || {cut})"


def _exported(spark, sf_dir, scope: str):
    """The export of receipts with file and tax, of pairs with their method, of transactions with their text."""
    tax = F.floor(F.floor(F.col("total") * 100 + F.lit(0.5)) / 6) / 100
    r = receipts(spark, sf_dir).withColumns({"file": F.concat(F.lit("scan, "), F.col("id").cast("string"), F.lit(".pdf")), "tax": tax})
    m = matches(spark, sf_dir).withColumn("method", F.when(F.col("r_id") % 2 == 0, "deterministic").otherwise("semantic"))
    return reads.export_rows(r, m, transactions(spark, sf_dir), scope).select("org", "part", "id", "line")


EXPORT = ALL + SAID + NAMED + f""", joined AS (SELECT r.*, m.t_id, m.status AS match_status, m.score, t.amount, t.date AS t_date, merchant_raw, description, floor(floor(total * 100 + 0.5) / 6) / 100 AS tax,
      CASE WHEN m.r_id IS NULL THEN '' WHEN r.id % 2 = 0 THEN 'deterministic' ELSE 'semantic' END AS method,
      CASE WHEN is_duplicate THEN 'Duplicate' WHEN m.status IN ('confirmed', 'auto') THEN 'Matched' WHEN m.status = 'suggested' THEN 'Needs review' ELSE 'Unmatched' END AS label
    FROM receipts r JOIN named ON named.r_id = r.id LEFT JOIN (SELECT * FROM matches WHERE status IN {LIVE}) m ON m.org = r.org AND m.r_id = r.id LEFT JOIN transactions t ON t.org = m.org AND t.id = m.t_id LEFT JOIN said ON said.t_id = t.id),
  lines AS (SELECT org, CAST(0 AS INTEGER) AS part, id, label, match_status, CAST(id AS VARCHAR) || ',"scan, ' || CAST(id AS VARCHAR) || '.pdf",' || merchant_raw || ',' || coalesce(strftime(date, '%Y-%m-%d'), '') || ',' || coalesce({_plain('total')}, '') || ',' || currency
    || ',' || coalesce({_plain('tax')}, '') || ',' || invoice || ',' || category || ',' || coalesce(CAST(t_id AS VARCHAR), '') || ',' || coalesce(description, '') || ',' || coalesce(strftime(t_date, '%Y-%m-%d'), '') || ',' || coalesce({_plain('amount')}, '')
    || ',' || coalesce(CAST(score AS VARCHAR) || '%', '') || ',' || method || ',' || label AS line FROM joined)"""


@query(EXPORT + " SELECT org, part, id, line FROM lines")
def export_all(spark, sf_dir):
    """A CSV line of 16 cells for each receipt and live match."""
    return _exported(spark, sf_dir, "all")


@query(EXPORT + " SELECT org, part, id, line FROM lines WHERE match_status IN ('confirmed', 'auto')")
def export_matched(spark, sf_dir):
    """The export's lines of matched pairs."""
    return _exported(spark, sf_dir, "matched")


@query(EXPORT + f""" SELECT org, part, id, line FROM lines WHERE label = 'Unmatched' UNION ALL
    SELECT org, CAST(1 AS INTEGER), id, ',,,,,' || currency || ',,,' || category || ',' || CAST(id AS VARCHAR) || ',' || description || ',' || strftime(date, '%Y-%m-%d') || ',' || {_plain('amount')} || ',,,Transaction without receipt'
    FROM transactions t JOIN said ON said.t_id = t.id WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = t.org AND m.t_id = t.id AND m.status IN {LIVE})""")
def export_unmatched_union(spark, sf_dir):
    """Unmatched receipts, then transactions without receipt."""
    return _exported(spark, sf_dir, "unmatched")


@query(RM + " SELECT org, count(*) AS used FROM receipts WHERE NOT is_duplicate AND created_at >= TIMESTAMP '1998-06-01' AND created_at < TIMESTAMP '1998-06-20 12:00:00' GROUP BY org")
def quota_usage_month(spark, sf_dir):
    """Receipts of the month so far."""
    return reads.quota_usage(receipts(spark, sf_dir), "1998-06-20 12:00:00")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_trail(spark, sf_dir):
    """The 50 latest entries of the trail."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")
