"""Queries of the screens: details, lists, pages, suggestions, account data."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import lists, search
from tallyspark.plans.adapted import NAMED, SAID
from tallyspark.plans.matching import CAPPED, SCORED
from tallyspark.plans.registry import query
from tallyspark.session import shared_folder
from tallyspark.sources import adapters
from tallyspark.sources.adapters import accounts, audit, categories, imports, matches, receipts, sql, transactions

LIVE = "('suggested', 'confirmed', 'auto')"
RC, RM = sql("receipts", "categories"), sql("receipts", "matches")
#: The receipt that the details show, whichever organization owns it.
RECEIPT = 100


def _each_org(one) -> DataFrame:
    return reduce(DataFrame.unionByName, [one(org) for org in range(5)])


def _booked(spark, sf_dir):
    """Transactions with their account."""
    return transactions(spark, sf_dir).withColumn("account", F.col("id") % 2)


@query(RC + f" SELECT r.org, r.id, r.status, r.total, r.category, c.color AS category_color FROM receipts r LEFT JOIN categories c ON c.org = r.org AND c.name = r.category WHERE r.id = {RECEIPT}")
def receipt_detail(spark, sf_dir):
    """One receipt, which only its own organization sees."""
    r, c = receipts(spark, sf_dir), categories(spark, sf_dir)
    return _each_org(lambda org: lists.get_receipt(r, c, org, RECEIPT)).select("org", "id", "status", "total", "category", "category_color")


@query(sql("audit") + " SELECT id, action, detail FROM audit WHERE org = 3 AND entity_type = 'receipt' AND entity_id = 8 ORDER BY created_at DESC, id DESC LIMIT 50")
def receipt_trail(spark, sf_dir):
    """The latest 50 entries about one receipt."""
    return lists.trail_of(audit(spark, sf_dir), 3, "receipt", 8).select("id", "action", "detail")


@query(sql("audit") + " SELECT id, action, entity_id FROM audit WHERE org = 1 ORDER BY created_at DESC, id DESC LIMIT 12")
def recent_activity(spark, sf_dir):
    """The twelve latest entries of an organization."""
    return lists.recent_activity(audit(spark, sf_dir), 1).select("id", "action", "entity_id")


@query(sql("matches", "transactions") + SAID + """ SELECT m.org, m.r_id, m.t_id, m.score, m.status, t.amount, description FROM matches m JOIN transactions t ON t.org = m.org AND t.id = m.t_id JOIN said USING (t_id)
    WHERE m.r_id BETWEEN 100 AND 140 AND m.org = 4 AND m.status IN ('suggested', 'alternate', 'confirmed', 'auto')""")
def matches_of_receipts(spark, sf_dir):
    """The pairs that receipts are offered, one read each."""
    m, t = matches(spark, sf_dir), transactions(spark, sf_dir)
    found = [lists.matches_of(m, t, 4, receipt) for receipt in range(100, 141)]
    return reduce(DataFrame.unionByName, found).select("org", "r_id", "t_id", "score", "status", "amount", "description")


@query(sql("receipts", "matches", "transactions") + SAID + NAMED + """, found AS (SELECT m.r_id, m.t_id, m.score, merchant_raw, description FROM matches m JOIN named USING (r_id) JOIN transactions t ON t.org = m.org AND t.id = m.t_id JOIN said USING (t_id)
    WHERE m.org = 2 AND m.status IN ('suggested', 'confirmed', 'auto') AND (lower(merchant_raw) LIKE '%market%' OR lower(description) LIKE '%market%'))
    SELECT *, (SELECT count(*) FROM found) AS total_rows FROM found ORDER BY score DESC, r_id, t_id LIMIT 25 OFFSET 25""")
def match_search_page(spark, sf_dir):
    """The second page of live pairs that say market, with the number of all."""
    found = lists.search_matches(matches(spark, sf_dir), receipts(spark, sf_dir), transactions(spark, sf_dir), org=2, search="market", number=2)
    return found.select("r_id", "t_id", "score", "merchant_raw", "description", "total_rows")


#: Terms that are searched by postings: plain, in capitals, with wildcards, and one too short for a posting.
TERMS = ("market", "UBER", "star%cks", "b_e bottle", "aa")


@query(sql("transactions") + SAID + " SELECT term, t.id FROM transactions t JOIN said ON t_id = t.id, (VALUES " + ", ".join(f"('{x}')" for x in TERMS) + ") x(term) WHERE t.org = 1 AND lower(description) LIKE '%' || lower(term) || '%'")
def search_by_postings(spark, sf_dir):
    """Bank lines of an organization that match five terms, found through the stored trigram index."""
    rows = transactions(spark, sf_dir).select("org", "id", "description")
    columns = {"description": F.col("description")}
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    search.write_index(rows, columns, path)
    found = [search.search(rows, columns, path, 1, term).select(F.lit(term).alias("term"), "id") for term in TERMS]
    return reduce(DataFrame.unionByName, found)


@query(sql("transactions", "matches") + SAID + f""", found AS (SELECT t.id, t.date, t.amount, description FROM transactions t JOIN said ON t_id = t.id WHERE t.org = 1 AND lower(description) LIKE '%uber%'
    AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = t.org AND m.t_id = t.id AND m.status IN {LIVE})) SELECT *, (SELECT count(*) FROM found) AS total_rows FROM found ORDER BY date DESC, id LIMIT 10""")
def unmatched_transactions_page(spark, sf_dir):
    """The ten newest transactions without match that say uber."""
    found = lists.unmatched_transactions(transactions(spark, sf_dir), matches(spark, sf_dir), org=1, search="uber", size=10)
    return found.select("id", "date", "amount", "description", "total_rows")


@query(RM + f""", found AS (SELECT id, total, status FROM receipts r WHERE org = 3 AND NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.org = r.org AND m.r_id = r.id AND m.status IN {LIVE}))
    SELECT f.id, f.total, f.status, (SELECT count(*) FROM found) AS total_rows FROM found f JOIN receipts r ON r.id = f.id ORDER BY r.created_at DESC, f.id LIMIT 25""")
def unmatched_receipts_page(spark, sf_dir):
    """The newest receipts without match."""
    return lists.unmatched_receipts(receipts(spark, sf_dir), matches(spark, sf_dir), org=3).select("id", "total", "status", "total_rows")


@query(sql("transactions", "categories", "accounts") + SAID + """, found AS (SELECT t.*, id % 2 AS account, description FROM transactions t JOIN said ON t_id = id WHERE t.org = 0 AND (lower(description) LIKE '%ikea%' OR CAST(amount AS VARCHAR) LIKE '%ikea%')),
    top AS (SELECT *, (SELECT count(*) FROM found) AS total_rows FROM found ORDER BY amount, id LIMIT 25)
    SELECT f.id, f.amount, f.category, c.color AS category_color, a.account_name, total_rows FROM top f LEFT JOIN categories c ON c.org = f.org AND c.name = f.category LEFT JOIN accounts a ON a.org = f.org AND a.account = f.account""")
def transaction_list_page(spark, sf_dir):
    """An organization's largest spends with category and account."""
    found = lists.list_transactions(_booked(spark, sf_dir), categories(spark, sf_dir), accounts(spark, sf_dir), org=0, search="ikea", sort="amount_desc")
    return found.select("id", "amount", "category", "category_color", "account_name", "total_rows")


@query(sql("transactions") + " SELECT id, amount FROM (SELECT * FROM transactions WHERE org = 1 AND CAST(amount AS VARCHAR) LIKE '%99%' ORDER BY amount DESC, id LIMIT 25)")
def transaction_search_amount(spark, sf_dir):
    """Transactions whose amount reads 99, smallest spend first."""
    found = lists.list_transactions(_booked(spark, sf_dir).withColumn("description", F.lit("")), categories(spark, sf_dir), accounts(spark, sf_dir), org=1, search="99", sort="amount_asc")
    return found.select("id", "amount")


@query(sql("imports", "accounts") + " SELECT i.id, i.filename, i.row_count, a.account_name FROM (SELECT * FROM imports WHERE org = 2 ORDER BY created_at DESC, id DESC LIMIT 25) i LEFT JOIN accounts a ON a.org = i.org AND a.account = i.account")
def import_list(spark, sf_dir):
    """The latest imports of an organization."""
    return lists.list_imports(imports(spark, sf_dir), accounts(spark, sf_dir), 2).select("id", "filename", "row_count", "account_name")


@query(RM + """ SELECT id, status <> 'processing' AS done, status, FALSE AS failed, is_duplicate AS duplicate,
    status <> 'processing' AND EXISTS (SELECT 1 FROM matches m WHERE m.org = r.org AND m.r_id = r.id AND m.status IN ('auto', 'confirmed')) AS matched FROM receipts r WHERE org = 0 AND id < 100""")
def receipt_progress(spark, sf_dir):
    """Whether the first hundred receipts are done and matched, of those that the organization owns."""
    return lists.progress(receipts(spark, sf_dir), matches(spark, sf_dir), 0, range(100))


@query(RC + """ SELECT coalesce(c.name, 'Uncategorised') AS name, coalesce(c.color, '#94A3B8') AS color, coalesce(CAST(sum(CAST(floor(total * 100 + 0.5) AS BIGINT)) AS BIGINT), 0) AS cents, count(*) AS receipts
    FROM receipts r LEFT JOIN categories c ON c.org = r.org AND c.name = r.category WHERE r.org = 1 AND NOT is_duplicate GROUP BY 1, 2""")
def category_breakdown(spark, sf_dir):
    """Spend by category with its colour."""
    return lists.category_breakdown(receipts(spark, sf_dir), categories(spark, sf_dir), 1)


@query(sql("receipts", "transactions") + """, span AS (SELECT org, min(date) - 2 AS first, max(date) + 5 AS last FROM receipts WHERE id % 50 = 1 AND date IS NOT NULL GROUP BY org)
    SELECT t.org, t.id FROM transactions t JOIN span s USING (org) WHERE t.date BETWEEN s.first AND s.last""")
def transactions_in_span(spark, sf_dir):
    """Transactions on days that could meet one of some receipts."""
    some = receipts(spark, sf_dir).where("id % 50 = 1 and date is not null")
    return lists.within_span(transactions(spark, sf_dir), lists.date_span(some)).select("org", "id")


@query(sql("memberships") + """ SELECT DISTINCT org FROM memberships m WHERE user_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM memberships o WHERE o.org = m.org AND o.user_id <> m.user_id)""")
def sole_organizations(spark, sf_dir):
    """Organizations that would go with the accounts of users with an even number."""
    return lists.sole_organizations(adapters.memberships(spark, sf_dir), F.col("user_id") % 2 == 0)


_WORKSPACE = ("receipts", "transactions", "matches", "imports", "categories", "accounts", "audit")


@query(sql(*_WORKSPACE) + " " + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t} WHERE org <> 2" for t in _WORKSPACE))
def clear_workspace(spark, sf_dir):
    """Rows of seven tables after an organization's are cleared."""
    tables = {name: getattr(adapters, name)(spark, sf_dir) for name in _WORKSPACE}
    left = lists.without_organizations(tables, spark.createDataFrame([(2,)], "org long"))
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count") for name, df in left.items()])


@query(sql("receipts", "transactions", "matches", "imports", "categories", "audit") + """ SELECT 'receipts' AS section, id AS key, total AS amount FROM receipts WHERE org = 4 UNION ALL SELECT 'transactions', id, amount FROM transactions WHERE org = 4
    UNION ALL SELECT 'matches', r_id * 10000000 + t_id % 1000000, score FROM matches WHERE org = 4 UNION ALL SELECT 'imports', id, row_count FROM imports WHERE org = 4 UNION ALL SELECT 'audit', id, NULL FROM audit WHERE org = 4 UNION ALL SELECT 'categories', NULL, NULL FROM categories WHERE org = 4""")
def account_export(spark, sf_dir):
    """All rows of an organization as JSON documents, read back."""
    tables = {name: getattr(adapters, name)(spark, sf_dir) for name in ("receipts", "transactions", "matches", "imports", "categories", "audit")}
    found = lists.account_export(tables, 4).withColumn("j", F.from_json("row", "id long, total double, amount double, r_id long, t_id long, score double, row_count double"))
    key = F.coalesce("j.id", F.col("j.r_id") * 10000000 + F.col("j.t_id") % 1000000)
    return found.select("section", key.alias("key"), F.coalesce("j.total", "j.amount", "j.score", "j.row_count").alias("amount"))


#: The scores of plans.matching over the newest 400 transactions of one receipt, days outside the window scoring 0.
SUGGESTED = (
    sql("receipts", "transactions")
    + """, newest AS (SELECT * FROM transactions WHERE org = 0 ORDER BY date DESC, id LIMIT 400),
    capped AS (SELECT r.org, r.id AS r_id, t.id AS t_id, r.total, r.date AS r_date, r.currency AS r_currency, r.payment AS r_payment, t.amount, t.date AS t_date, t.currency AS t_currency, t.payment AS t_payment,
      CAST(floor(abs(total) * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(abs(amount) * 100 + 0.5) AS BIGINT) AS t_cents FROM receipts r JOIN newest t ON t.org = r.org WHERE r.id = 2)"""
    + SCORED[len(CAPPED) :].replace("WHEN t_date > r_date", "WHEN t_date - r_date > 5 OR r_date - t_date > 2 THEN 0 WHEN t_date > r_date")
)


@query(SUGGESTED + """ SELECT t_id, tenths, CASE WHEN tenths >= 900 THEN 'auto' WHEN tenths >= 700 THEN 'review' WHEN tenths >= 400 THEN 'possible' ELSE 'none' END AS classification FROM scored ORDER BY tenths DESC, t_date DESC, t_id LIMIT 12""")
def suggested_transactions(spark, sf_dir):
    """The twelve best of an organization's newest 400 transactions for one receipt."""
    r = receipts(spark, sf_dir).withColumn("merchant", F.col("merchant_raw")).where("org = 0 and id = 2")
    found = lists.suggest_transactions(r, transactions(spark, sf_dir).withColumn("merchant", F.col("description")))
    return found.select("t_id", F.floor(F.col("score") * 10 + F.lit(0.5)).cast("long").alias("tenths"), "classification")
