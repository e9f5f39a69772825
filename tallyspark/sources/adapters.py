"""The product's tables as projections of the given TPC-H-like tables; integer arithmetic only, nothing random.

`SQL` holds the same projections for DuckDB, as common table expressions by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that queries take for now.
NOW = "2024-01-16 12:00:00"
MERCHANTS = (
    "Carrefour Market", "Amazon Marketplace", "Starbucks", "Blue Bottle Coffee", "Monoprix", "Spotify AB", "Uber Trip", "Café de Flore",
    "Air France", "The Garden Company", "Netflix", "Ikea Paris",
)

SQL = {
    "receipts": """receipts AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS org, o_orderkey AS id,
      CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS total, CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
      CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'TND' END AS currency, o_orderdate AS created_at,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'needs_review' ELSE 'processing' END AS status,
      o_orderpriority AS category, o_orderkey % 13 = 0 AS is_duplicate,
      CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'cash' ELSE 'card' END AS payment,
      'INV-' || CAST(o_orderkey // 3 AS VARCHAR) AS invoice,
      CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS confidence FROM orders)""",
    "transactions": """transactions AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS org, o_orderkey + 1000000000 AS id,
      -CAST((CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * (97 + o_orderkey % 7) + 50) // 100 AS DOUBLE) / 100 AS amount,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 2 AS INTEGER) AS date,
      CASE WHEN o_orderkey % 11 = 0 THEN 'GBP' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'TND' END END AS currency,
      CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cash' ELSE 'card' END AS payment, o_orderpriority AS category FROM orders)""",
    "matches": """matches AS (SELECT org, r_id, t_id, l_linenumber, CAST(60 + l_linenumber * 5 AS BIGINT) AS score,
      CASE l_linenumber % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'suggested' WHEN 3 THEN 'alternate' ELSE 'rejected' END AS status
      FROM (SELECT CAST(o_custkey % 5 AS BIGINT) AS org, l_orderkey AS r_id, l_partkey + 1000000000 AS t_id, min(l_linenumber) AS l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_partkey))""",
    "categories": """categories AS (SELECT CAST(org AS BIGINT) AS org, name, color FROM range(5) o(org), (VALUES ('1-URGENT', '#F59E0B'), ('2-HIGH', '#3B82F6'), ('3-MEDIUM', '#8B5CF6'), ('4-NOT SPECIFIED', NULL)) c(name, color))""",
    "accounts": """accounts AS (SELECT CAST(org AS BIGINT) AS org, CAST(a AS BIGINT) AS account, CASE a WHEN 0 THEN 'Main account' ELSE 'Card' END AS account_name, CASE a WHEN 0 THEN 'EUR' ELSE 'TND' END AS currency FROM range(5) o(org), range(2) k(a))""",
    "imports": """imports AS (SELECT CAST(s_suppkey % 5 AS BIGINT) AS org, s_suppkey AS id, s_name || '.csv' AS filename, CAST(s_suppkey % 2 AS BIGINT) AS account, sha256(s_name) AS checksum, CAST(s_nationkey * 10 AS BIGINT) AS row_count,
      TIMESTAMP '1998-01-01' + to_days(CAST((s_suppkey * 7) % 61 AS INTEGER)) AS created_at FROM supplier)""",
    "audit": """audit AS (SELECT event_id AS id, CAST(user_id % 5 AS BIGINT) AS org, event_type AS action, 'receipt' AS entity_type, CAST(user_id AS BIGINT) AS entity_id, props AS detail, ts AS created_at FROM events)""",
    "users": """users AS (SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_mktsegment AS persona FROM customer)""",
    "memberships": """memberships AS (SELECT c_custkey AS user_id, c_custkey % 50 AS org, CASE WHEN c_custkey < 50 THEN 'owner' ELSE 'member' END AS role FROM customer WHERE c_custkey % 3 = 0 OR c_custkey < 50
      UNION ALL SELECT c_custkey, (c_custkey + 1) % 50, 'member' FROM customer WHERE c_custkey % 7 = 0)""",
    "subscriptions": """subscriptions AS (SELECT CAST(org AS BIGINT) AS org, CASE org % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'business' END AS plan, CAST(CASE org % 3 WHEN 0 THEN 50 WHEN 1 THEN 500 ELSE 2500 END AS BIGINT) AS quota,
      CASE WHEN org % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(org AS INTEGER)) END AS period_end FROM range(50) o(org))""",
    "jobs": """jobs AS (SELECT event_id AS id, event_type AS type,
      CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
      CAST(event_id % 6 AS INTEGER) AS attempts, 5 AS max_attempts, ts AS run_at, ts + INTERVAL 5 MINUTE AS locked_until, user_id FROM events)""",
}


def sql(*names: str) -> str:
    """WITH clause of the named projections."""
    return "WITH " + ", ".join(SQL[n] for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _currency(key: Column) -> Column:
    return F.when(key % 3 == 0, "EUR").when(key % 3 == 1, "USD").otherwise("TND")


def _payment(key: Column, by: int) -> Column:
    return F.when(key % by == 0, None).when(key % by == 1, "cash").otherwise("card")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with their extracted fields, from orders; some without total or date."""
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*(F.lit(m) for m in MERCHANTS)), (F.col("o_custkey") % len(MERCHANTS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 5).alias("org"), k.alias("id"), name.alias("merchant_raw"), F.when(k % 97 != 0, F.col("o_totalprice")).alias("total"),
        F.when(k % 89 != 0, F.to_date("o_orderdate")).alias("date"), _currency(k).alias("currency"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("processing").alias("status"),
        F.col("o_orderpriority").alias("category"), (k % 13 == 0).alias("is_duplicate"), _payment(k, 7).alias("payment"),
        F.concat(F.lit("INV-"), F.expr("o_orderkey div 3").cast("string")).alias("invoice"), ((k * 37 % 101).cast("double") / 100).alias("confidence"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines, from orders with amounts and dates shifted and merchants written as banks do."""
    k = F.col("o_orderkey")
    cents = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("long")
    name = F.upper(F.element_at(F.array(*(F.lit(m) for m in MERCHANTS)), (F.col("o_custkey") % len(MERCHANTS) + 1).cast("int")))
    said = F.when(k % 4 == 0, F.concat(F.lit("POS "), name, F.lit(" 2391"))).when(k % 4 == 1, F.concat(F.lit("SQ *"), name)).when(k % 4 == 2, F.concat(name, F.lit(" #"), (k % 50).cast("string")))
    return table(spark, sf_dir, "orders").withColumn("_c", cents * (97 + k % 7) + 50).select(
        (F.col("o_custkey") % 5).alias("org"), (k + 1000000000).alias("id"), said.otherwise(F.substring(name, 2, 100)).alias("description"),
        (-F.expr("_c div 100").cast("double") / 100).alias("amount"), F.date_add(F.to_date("o_orderdate"), (k % 9 - 2).cast("int")).alias("date"),
        F.when(k % 11 == 0, "GBP").otherwise(_currency(k)).alias("currency"), _payment(k, 5).alias("payment"), F.col("o_orderpriority").alias("category"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt-transaction links with their status, from line items."""
    n = F.col("l_linenumber") % 5
    state = F.when(n == 0, "auto").when(n == 1, "confirmed").when(n == 2, "suggested").when(n == 3, "alternate").otherwise("rejected")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("org"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("org", F.col("l_orderkey").alias("r_id"), (F.col("l_partkey") + 1000000000).alias("t_id"), (60 + F.col("l_linenumber") * 5).cast("long").alias("score"), state.alias("status"), "l_linenumber")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows, from events."""
    n = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(n == 0, "queued").when(n == 1, "running").when(n == 2, "done").otherwise("failed").alias("status"),
        (F.col("event_id") % 6).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.col("ts").alias("run_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("locked_until"), "user_id",
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four categories of each organization; one has no colour, and a fifth name of receipts is none of them."""
    rows = [(org, name, color) for org in range(5) for name, color in (("1-URGENT", "#F59E0B"), ("2-HIGH", "#3B82F6"), ("3-MEDIUM", "#8B5CF6"), ("4-NOT SPECIFIED", None))]
    return spark.createDataFrame(rows, "org long, name string, color string")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bank accounts of each organization."""
    rows = [(org, a, ("Main account", "Card")[a], ("EUR", "TND")[a]) for org in range(5) for a in range(2)]
    return spark.createDataFrame(rows, "org long, account long, account_name string, currency string")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported statements, from suppliers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k % 5).alias("org"), k.alias("id"), F.concat("s_name", F.lit(".csv")).alias("filename"), (k % 2).alias("account"), F.sha2("s_name", 256).alias("checksum"),
        (F.col("s_nationkey") * 10).cast("long").alias("row_count"), F.date_add(F.lit("1998-01-01").cast("date"), (k * 7 % 61).cast("int")).cast("timestamp_ntz").alias("created_at"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit trail, from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("long").alias("org"), F.col("event_type").alias("action"), F.lit("receipt").alias("entity_type"), F.col("user_id").cast("long").alias("entity_id"), F.col("props").alias("detail"), F.col("ts").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, from customers."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"), F.col("c_mktsegment").alias("persona"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who belongs to which of fifty organizations; the first fifty users own one each."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    own = c.where("c_custkey % 3 = 0 or c_custkey < 50").select(k.alias("user_id"), (k % 50).alias("org"), F.when(k < 50, "owner").otherwise("member").alias("role"))
    return own.unionByName(c.where("c_custkey % 7 = 0").select(k.alias("user_id"), ((k + 1) % 50).alias("org"), F.lit("member").alias("role")))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of each of fifty organizations; some never end."""
    k = F.col("id")
    plan = F.when(k % 3 == 0, "free").when(k % 3 == 1, "pro").otherwise("business")
    quota = F.when(k % 3 == 0, 50).when(k % 3 == 1, 500).otherwise(2500).cast("long")
    end = F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).cast("timestamp_ntz"))
    return spark.range(50).select(k.alias("org"), plan.alias("plan"), quota.alias("quota"), end.alias("period_end"))
