"""Lists and details behind the product's screens: filters, search, sort, one page with the total of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import Config, MatchingConfig, with_rules
from tallyspark.functions.money import number_text
from tallyspark.functions.tables import NO_CATEGORY, NO_COLOR
from tallyspark.functions.text import like_term
from tallyspark.operators.reads import LIVE, MATCHED, OFFERED, page, unmatched, where_all
from tallyspark.operators.score import classify, score_pairs

IN_PROGRESS = ("processing", "extracting", "matching")
#: An amount is signed, so the largest spend comes first in rising order.
TRANSACTION_SORTS = {"newest": ("date", F.desc_nulls_first), "oldest": ("date", F.asc_nulls_last), "amount_desc": ("amount", F.asc_nulls_last), "amount_asc": ("amount", F.desc_nulls_first)}


def with_total(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A page's rows with the number of all rows found."""
    return rows.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total_rows"))))  # one row


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the colour of `category`, null where the organization has none of that name; a small dimension."""
    names = categories.select("org", F.col("name").alias("category"), F.col("color").alias("category_color"))
    return rows.join(names, ["org", "category"], "left")


def get_receipt(receipts: DataFrame, categories: DataFrame, org: int, receipt: int) -> DataFrame:
    """One receipt of the organization; the organization is part of the lookup."""
    return with_category(receipts.where((F.col("org") == org) & (F.col("id") == receipt)).limit(1), categories)


def trail_of(audit: DataFrame, org: int, entity_type: str, entity: int, limit: int = 50) -> DataFrame:
    """The latest entries about an entity."""
    mine = audit.where((F.col("org") == org) & (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity))
    return mine.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_activity(audit: DataFrame, org: int, limit: int = 12) -> DataFrame:
    """The latest entries of an organization."""
    return audit.where(F.col("org") == org).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def matches_of(matches: DataFrame, transactions: DataFrame, org: int, receipt: int) -> DataFrame:
    """The pairs that a receipt is offered, with their transactions, best first."""
    mine = matches.where((F.col("org") == org) & (F.col("r_id") == receipt) & F.col("status").isin(*OFFERED))
    t = transactions.where(F.col("org") == org).select(F.col("id").alias("t_id"), "amount", "date", "currency", "description")
    return mine.join(t, "t_id").orderBy(F.desc("score"), "t_id")


def search_matches(matches: DataFrame, receipts: DataFrame, transactions: DataFrame, *, org: int, statuses: Sequence[str] = LIVE, search: str | None = None, number: int = 1, size: int = 25) -> DataFrame:
    """A page of pairs with both sides, best first; the search reads merchant and bank text."""
    m = matches.where((F.col("org") == org) & F.col("status").isin(*statuses))
    r = receipts.where(F.col("org") == org).select(F.col("id").alias("r_id"), "merchant_raw", "total")
    t = transactions.where(F.col("org") == org).select(F.col("id").alias("t_id"), "description", "amount")
    said = like_term(F.coalesce("merchant_raw", F.lit("")), search) | like_term(F.coalesce("description", F.lit("")), search) if search else None
    found = where_all(m.join(r, "r_id").join(t, "t_id"), said)
    return with_total(page(found, [F.desc("score"), F.asc("r_id"), F.asc("t_id")], number, size), found)


def unmatched_transactions(transactions: DataFrame, matches: DataFrame, *, org: int, search: str | None = None, number: int = 1, size: int = 25) -> DataFrame:
    """A page of transactions without live match, newest first."""
    free = unmatched(transactions.where(F.col("org") == org), matches.where(F.col("org") == org), "t_id")
    found = where_all(free, like_term(F.col("description"), search) if search else None)
    return with_total(page(found, [F.desc_nulls_first("date"), F.asc("id")], number, size), found)


def unmatched_receipts(receipts: DataFrame, matches: DataFrame, *, org: int, number: int = 1, size: int = 25) -> DataFrame:
    """A page of receipts without live match that are no duplicates, newest first."""
    found = unmatched(receipts.where((F.col("org") == org) & ~F.col("is_duplicate")), matches.where(F.col("org") == org), "r_id")
    return with_total(page(found, [F.desc_nulls_first("created_at"), F.asc("id")], number, size), found)


def suggest_transactions(receipt: DataFrame, transactions: DataFrame, search: str | None = None, config: Config = MatchingConfig(), similarity=None) -> DataFrame:
    """The twelve best of the newest 400 transactions (25 with a search) for one receipt, matched or not: score and
    class of the rounded score. `receipt` has one row; `similarity` adds that column to the pairs."""
    mine = transactions.join(F.broadcast(receipt.select("org")), "org", "left_semi")
    newest = where_all(mine, like_term(F.col("description"), search) if search else None).orderBy(F.desc_nulls_first("date"), "id").limit(25 if search else 400)
    r = receipt.select("org", *(F.col(c).alias(f"r_{c}") for c in ("id", "merchant", "date", "total", "currency", "payment")))
    t = newest.select("org", *(F.col(c).alias(f"t_{c}") for c in ("id", "merchant", "date", "amount", "currency", "payment")))
    pairs = t.join(F.broadcast(r), "org")
    scored = score_pairs(similarity(pairs) if similarity else pairs.withColumn("similarity", F.lit(None).cast("double")), config)
    best = scored.orderBy(F.desc("score"), F.desc_nulls_first("t_date"), "t_id").limit(12)
    ruled, own = with_rules(best, config)
    return ruled.withColumn("classification", classify(F.col("score"), own)).select(best.columns)


def list_transactions(transactions: DataFrame, categories: DataFrame, accounts: DataFrame, *, org: int, search: str | None = None, sort: str = "newest", number: int = 1, size: int = 25) -> DataFrame:
    """A page of transactions with category and account; the search reads text and amount."""
    term = like_term(F.col("description"), search) | like_term(number_text(F.col("amount")), search) if search else None
    found = where_all(transactions.where(F.col("org") == org), term)
    column, by = TRANSACTION_SORTS.get(sort, TRANSACTION_SORTS["newest"])
    rows = with_total(page(found, [by(column), F.asc("id")], number, size), found)
    return with_category(rows, categories).join(accounts.select("org", "account", "account_name"), ["org", "account"], "left")


def list_imports(imports: DataFrame, accounts: DataFrame, org: int, limit: int = 25) -> DataFrame:
    """The latest imports with their accounts."""
    rows = imports.where(F.col("org") == org).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return rows.join(accounts.select("org", "account", "account_name"), ["org", "account"], "left")


def progress(receipts: DataFrame, matches: DataFrame, org: int, ids: Sequence[int]) -> DataFrame:
    """Whether up to 100 receipts are done, failed, duplicates, matched; others' and unknown ones are left out."""
    if len(ids) > 100:
        raise ValueError("at most 100 receipts at a time")
    rows = receipts.where((F.col("org") == org) & F.col("id").isin(*ids))
    live = matches.where((F.col("org") == org) & F.col("status").isin(*MATCHED)).select(F.col("r_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    done = ~F.col("status").isin(*IN_PROGRESS)
    return rows.join(live, "id", "left").select("id", done.alias("done"), "status", (F.col("status") == "failed").alias("failed"), F.col("is_duplicate").alias("duplicate"), (done & F.coalesce("_hit", F.lit(False))).alias("matched"))


def category_breakdown(receipts: DataFrame, categories: DataFrame, org: int, limit: int = 9) -> DataFrame:
    """Spend of the organization by category and colour, largest first; sums of nothing count as the largest."""
    rows = receipts.where((F.col("org") == org) & ~F.col("is_duplicate")).join(categories.where(F.col("org") == org).select("org", F.col("name").alias("category"), "name", "color"), ["org", "category"], "left")
    cents = F.floor(F.col("total") * 100 + F.lit(0.5)).cast("long")
    sums = rows.groupBy(F.coalesce("name", F.lit(NO_CATEGORY)).alias("name"), F.coalesce("color", F.lit(NO_COLOR)).alias("color")).agg(F.sum(cents).alias("raw"), F.count(F.lit(1)).alias("receipts"))
    return sums.orderBy(F.desc_nulls_first("raw"), "name").limit(limit).select("name", "color", F.coalesce("raw", F.lit(0)).alias("cents"), "receipts")


def date_span(receipts: DataFrame, config: Config = MatchingConfig()) -> DataFrame:
    """(org, first, last): the days that transactions must fall on to meet a receipt of the organization; null bounds,
    which let all pass, where a receipt has no date."""
    spans = receipts.groupBy("org").agg(F.bool_or(F.col("date").isNull()).alias("open"), F.min("date").alias("low"), F.max("date").alias("high"))
    spans, c = with_rules(spans, config)
    closed = ~F.col("open")
    return spans.select("org", F.when(closed, F.date_sub("low", c.date.max_before)).alias("first"), F.when(closed, F.date_add("high", c.date.max_after)).alias("last"))


def within_span(transactions: DataFrame, span: DataFrame) -> DataFrame:
    """Transactions on the days of `date_span`: one row an organization."""
    inside = F.col("first").isNull() | F.col("date").isNull() | F.col("date").between(F.col("first"), F.col("last"))
    return transactions.join(span, "org").where(inside).drop("first", "last")


def sole_organizations(memberships: DataFrame, user: Column) -> DataFrame:
    """(org): organizations of the users under `user` that have no other member, which go with their accounts."""
    # members are counted within each organization: they never meet each other
    asked, known = F.coalesce(user, F.lit(False)), F.col("user_id").isNotNull()
    orgs = memberships.groupBy("org").agg(F.max(asked & known).alias("_mine"), F.max(asked & ~known).alias("_unknown"), (F.min("user_id") == F.max("user_id")).alias("_sole"))
    return orgs.where((F.col("_mine") & (F.col("_sole") | F.col("org").isNull())) | F.col("_unknown")).select("org")


def without_organizations(tables: dict[str, DataFrame], orgs: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the given organizations (org)."""
    return {name: df.join(orgs, "org", "left_anti") for name, df in tables.items()}


def account_export(tables: dict[str, DataFrame], org: int) -> DataFrame:
    """(section, row): all rows of an organization as JSON, ready for `write.json` or `write.text` by section."""
    out = None
    for name, df in tables.items():
        rows = df.where(F.col("org") == org)
        part = rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
