"""Queries of what actions do to matches, receipts and the trail, of plans, and of the queue."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import backup_name, backup_time
from tallyspark.operators import actions, billing, counters, runs
from tallyspark.operators.backup import to_delete
from tallyspark.plans.registry import query
from tallyspark.plans.state import CHOSEN, IS_CHOSEN, _chosen
from tallyspark.sources import adapters
from tallyspark.sources.adapters import NOW, jobs, matches, receipts, sql, table

CHANGED = CHOSEN.replace("WITH ", "WITH " + sql("receipts")[5:] + ", ", 1)
KEY = "CAST(r_id AS VARCHAR) || ':' || CAST(t_id AS VARCHAR)"


def _states(found: dict[str, DataFrame]) -> DataFrame:
    """The receipts' states after an action, and its audit rows, in one table."""
    r = found["receipts"].select("org", F.col("id").cast("string").alias("entity"), "status", F.lit(None).cast("string").alias("detail"))
    return r.unionByName(found["audit"].select("org", F.col("entity_id").alias("entity"), F.col("action").alias("status"), "detail"))


@query(CHANGED + f""", mine AS (SELECT m.* FROM matches m WHERE {IS_CHOSEN}) SELECT r.org, CAST(r.id AS VARCHAR) AS entity, CASE WHEN r.id IN (SELECT r_id FROM mine) THEN 'completed' ELSE status END AS status, NULL AS detail FROM receipts r
    UNION ALL SELECT org, {KEY}, 'match.confirmed', 'receipt ' || r_id || ' ↔ transaction ' || t_id || ' at ' || score || '%' FROM mine""")
def confirm_states_and_trail(spark, sf_dir):
    """Receipts' states and the trail after confirming the chosen pairs."""
    return _states(actions.confirm(matches(spark, sf_dir), receipts(spark, sf_dir), _chosen(spark, sf_dir), "ann"))


@query(CHANGED + f""", mine AS (SELECT m.* FROM matches m WHERE {IS_CHOSEN}), left_over AS (SELECT DISTINCT org, r_id FROM matches m WHERE status <> 'rejected' AND NOT {IS_CHOSEN})
    SELECT r.org, CAST(r.id AS VARCHAR) AS entity, CASE WHEN r.id NOT IN (SELECT r_id FROM mine) THEN status WHEN EXISTS (SELECT 1 FROM left_over l WHERE l.org = r.org AND l.r_id = r.id) THEN 'needs_review' ELSE 'completed' END AS status, NULL AS detail FROM receipts r
    UNION ALL SELECT org, {KEY}, 'match.rejected', NULL FROM mine""")
def reject_states_and_trail(spark, sf_dir):
    """Receipts' states and the trail after rejecting the chosen pairs."""
    return _states(actions.reject(matches(spark, sf_dir), receipts(spark, sf_dir), _chosen(spark, sf_dir), "ann"))


@query(CHANGED + f""", mine AS (SELECT m.* FROM matches m WHERE {IS_CHOSEN}) SELECT r.org, CAST(r.id AS VARCHAR) AS entity, CASE WHEN r.id IN (SELECT r_id FROM mine) THEN 'completed' ELSE status END AS status, NULL AS detail FROM receipts r
    UNION ALL SELECT org, {KEY}, 'match.manual', 'manually matched at ' || (score + 1) || '%' FROM mine""")
def manual_states_and_trail(spark, sf_dir):
    """Receipts' states and the trail after matching the chosen pairs by hand; pairs already there are scored again in the trail."""
    scored = _chosen(spark, sf_dir).withColumn("score", F.col("score") + 1)
    return _states(actions.match_by_hand(matches(spark, sf_dir), receipts(spark, sf_dir), scored, "ann"))


@query(CHANGED + f""" SELECT org, {KEY} AS entity, status, NULL AS detail FROM matches m WHERE NOT {IS_CHOSEN} UNION ALL SELECT org, {KEY}, 'match.unlinked', NULL FROM matches m WHERE {IS_CHOSEN}""")
def unlink_effect(spark, sf_dir):
    """The matches after unlinking the chosen pairs, and the trail."""
    found = actions.unlink(matches(spark, sf_dir), receipts(spark, sf_dir), _chosen(spark, sf_dir), "ann")
    m = found["matches"].select("org", actions.match_key().alias("entity"), "status", F.lit(None).cast("string").alias("detail"))
    return m.unionByName(found["audit"].select("org", F.col("entity_id").alias("entity"), F.col("action").alias("status"), "detail"))


@query(sql("receipts", "matches") + """, gone AS (SELECT org, id FROM receipts WHERE org = 3 AND id % 10 = 0) SELECT 'receipts' AS name, org, id FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.org = r.org AND g.id = r.id)
    UNION ALL SELECT 'matches', org, r_id * 10000000 + t_id % 1000000 FROM matches m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.org = m.org AND g.id = m.r_id) UNION ALL SELECT 'files', org, id FROM gone UNION ALL SELECT 'receipt.deleted', org, id FROM gone""")
def delete_receipts_cascade(spark, sf_dir):
    """Receipts and matches after a delete, the files that go, and the trail."""
    rows = receipts(spark, sf_dir)
    out = actions.delete_receipts({"receipts": rows, "matches": matches(spark, sf_dir)}, rows.where("org = 3 and id % 10 = 0"), "ann")
    named = lambda name, df, key: df.select(F.lit(name).alias("name"), "org", key.cast("long").alias("id"))
    m = named("matches", out["matches"], F.col("r_id") * 10000000 + F.col("t_id") % 1000000)
    trail = out["audit"].select(F.col("action").alias("name"), "org", F.col("entity_id").cast("long").alias("id"))
    return named("receipts", out["receipts"], F.col("id")).unionByName(m).unionByName(named("files", out["files"], F.col("id"))).unionByName(trail)


@query(sql("receipts") + """, edited AS (SELECT org, id, id % 20 = 3 AS touched, CASE WHEN id % 20 = 3 THEN 12.5 ELSE total END AS total, CASE WHEN id % 40 = 3 THEN 'CHF' WHEN id % 40 = 23 THEN NULL ELSE currency END AS currency,
      CASE WHEN id % 20 = 3 THEN 'skoda auto' ELSE payment END AS merchant, is_duplicate AND id % 20 <> 7 AS is_duplicate, is_duplicate AS was FROM receipts)
    SELECT org, id, total, currency, merchant, is_duplicate, touched AS edited, CASE WHEN touched THEN 'edited merchant, total, currency' END AS detail, id % 20 = 7 AS lowered FROM edited""")
def edit_receipts_effect(spark, sf_dir):
    """Receipts after edits by hand, values, emptied fields, rebuilt keys and lowered flags, with what the trail says of each."""
    rows = receipts(spark, sf_dir).select("org", "id", "total", "currency", F.col("payment").alias("merchant"), "is_duplicate")
    k = F.col("id") % 40
    hand = rows.where("id % 20 in (3, 7)").select(
        "org", "id", F.when(k % 20 == 3, 12.5).alias("total"), F.when(k == 3, "CHF").alias("currency"), F.when(k % 20 == 3, "POS ŠKODA AUTO 2391").alias("merchant"),
        F.when(k == 23, F.array(F.lit("currency"))).alias("cleared"), F.when(k % 20 == 7, False).alias("is_duplicate"),
    )
    out = actions.edit_receipts(rows, hand, "ann")
    said = out["audit"].groupBy(F.col("entity_id").cast("long").alias("id")).agg(F.max("detail").alias("detail"), F.bool_or(F.col("action") == "receipt.duplicate_cleared").alias("lowered"))
    joined = out["receipts"].join(said, "id", "left")
    return joined.select("org", "id", "total", "currency", "merchant", "is_duplicate", F.col("edited_by_user").alias("edited"), "detail", F.coalesce("lowered", F.lit(False)).alias("lowered"))


@query(sql("receipts") + " SELECT org, id, CASE WHEN id % 3 = 0 AND status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN id % 3 = 0 AND status = 'processing' THEN 'processing_failed' END AS failure_code FROM receipts")
def mark_failed_effect(spark, sf_dir):
    """Receipts in progress whose job used up its attempts fail."""
    rows = receipts(spark, sf_dir)
    return actions.mark_failed(rows, rows.where("id % 3 = 0")).select("org", "id", "status", "failure_code")


@query("""WITH seen AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS org, 'Shop ' || (o_custkey % 40) AS name, 'shop ' || (o_custkey % 20) AS normalized FROM orders), known AS (SELECT DISTINCT org, 'old ' || normalized AS name, normalized FROM seen WHERE normalized < 'shop 15')
    SELECT org, name, normalized FROM known UNION ALL SELECT org, min(name), normalized FROM seen WHERE normalized >= 'shop 15' GROUP BY org, normalized""")
def merchant_upsert(spark, sf_dir):
    """Merchants by organization and key, known ones under their name, new ones under the first that was read."""
    k = F.col("o_custkey")
    seen = table(spark, sf_dir, "orders").select((k % 5).alias("org"), F.concat(F.lit("Shop "), (k % 40).cast("string")).alias("name"), F.concat(F.lit("shop "), (k % 20).cast("string")).alias("normalized"))
    known = seen.where("normalized < 'shop 15'").select("org", F.lit("m").alias("merchant_id"), F.concat(F.lit("old "), "normalized").alias("name"), "normalized").distinct()
    return actions.upsert_merchants(known, seen).select("org", "name", "normalized")


@query("""SELECT CAST(r_regionkey + 100 AS BIGINT) AS org, name, color FROM region, (VALUES ('Food', '#F59E0B'), ('Transport', '#3B82F6'), ('Software', '#8B5CF6'), ('Office', '#64748B'), ('Travel', '#06B6D4'), ('Equipment', '#EC4899'), ('Marketing', '#F97316'), ('Utilities', '#14B8A6'), ('Other', '#94A3B8')) c(name, color)
    UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), 'free', '50' FROM region UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), 'owner', CAST(r_regionkey AS VARCHAR) FROM region""")
def provisioned_organizations(spark, sf_dir):
    """The categories, subscription and owner that new organizations begin with."""
    key = F.col("r_regionkey").cast("long")
    out = actions.provision(table(spark, sf_dir, "region").select((key + 100).alias("org"), key.alias("user_id")))
    subs = out["subscriptions"].select("org", F.col("plan").alias("name"), F.col("quota").cast("string").alias("color"))
    owners = out["memberships"].select("org", F.col("role").alias("name"), F.col("user_id").cast("string").alias("color"))
    return out["categories"].select("org", "name", "color").unionByName(subs).unionByName(owners)


# plans

EFFECTIVE = sql("subscriptions", "memberships", "users") + f""", state AS (SELECT *, plan <> 'free' AND coalesce(period_end < TIMESTAMP '{NOW}', FALSE) AS expired,
    CASE WHEN plan <> 'free' THEN CAST(ceil((epoch_us(period_end) - epoch_us(TIMESTAMP '{NOW}'))::DOUBLE / 86400000000) AS BIGINT) END AS days_left FROM subscriptions),
  plans AS (SELECT email, s.org, s.plan, quota, expired, days_left FROM state s JOIN memberships m ON m.org = s.org AND m.role = 'owner' JOIN users u USING (user_id))"""


def _plans(spark, sf_dir):
    return billing.plans(adapters.subscriptions(spark, sf_dir), adapters.memberships(spark, sf_dir), adapters.users(spark, sf_dir), NOW)


@query(EFFECTIVE + " SELECT email, org, plan, quota, expired, days_left FROM plans")
def plan_list(spark, sf_dir):
    """Every organization's plan with its owner."""
    return _plans(spark, sf_dir).drop("period_end")


@query(EFFECTIVE + " SELECT email, org, plan, days_left FROM plans WHERE plan <> 'free' AND days_left <= 7")
def expiring_plans(spark, sf_dir):
    """Paid plans that end within a week or have ended, with their owners."""
    return billing.expiring(_plans(spark, sf_dir), 7).select("email", "org", "plan", "days_left")


@query(EFFECTIVE + " SELECT org, plan FROM plans WHERE email = 'customer.000000007@example.com'")
def plan_by_email(spark, sf_dir):
    """The plan of one owner, by an address in another case."""
    return billing.plans_of(_plans(spark, sf_dir), "  Customer.000000007@Example.com ").select("org", "plan")


@query(sql("receipts", "subscriptions") + f""", state AS (SELECT *, plan <> 'free' AND coalesce(period_end < TIMESTAMP '1998-06-20 12:00:00', FALSE) AS expired FROM (SELECT org, plan, quota // 50 AS quota, period_end - INTERVAL 9343 DAYS AS period_end FROM subscriptions)),
    used AS (SELECT org, count(*) AS n FROM receipts WHERE NOT is_duplicate AND created_at >= TIMESTAMP '1998-06-01' AND created_at < TIMESTAMP '1998-06-20 12:00:00' GROUP BY org)
    SELECT s.org, expired, CASE WHEN expired THEN 50 ELSE quota END AS effective_quota, coalesce(n, 0) AS used, coalesce(n, 0) >= CASE WHEN expired THEN 50 ELSE quota END AS refused FROM state s LEFT JOIN used u USING (org)""")
def quota_decision(spark, sf_dir):
    """Whether each organization may add receipts this month."""
    subs = adapters.subscriptions(spark, sf_dir).withColumn("quota", F.expr("quota div 50")).withColumn("period_end", F.col("period_end") - F.expr("INTERVAL 9343 DAYS"))
    return billing.quota_state(subs, receipts(spark, sf_dir), "1998-06-20 12:00:00").select("org", "expired", "effective_quota", "used", "refused")


@query(EFFECTIVE + " SELECT org, CASE WHEN org = 4 THEN 'business' ELSE plan END AS plan, CASE WHEN org = 4 THEN 700 ELSE quota END AS quota, CASE WHEN org = 4 THEN TIMESTAMP '2024-12-31 23:59:59.999' ELSE period_end END AS period_end, CASE WHEN org = 4 THEN plan || ' to business until 2024-12-31, ref A1' END AS detail FROM subscriptions")
def plan_change(spark, sf_dir):
    """Subscriptions after one organization's plan changes, with the trail."""
    out = billing.set_plan(adapters.subscriptions(spark, sf_dir), 4, "business", datetime.datetime(2024, 1, 16, 12), "2024-12-31", 700, "A1")
    return out["subscriptions"].join(out["audit"].select("org", "detail"), "org", "left").select("org", "plan", "quota", "period_end", "detail")


# the queue

J = sql("jobs")


def _named_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).withColumn("id", F.col("id").cast("string")).select("id", "type", "status", "attempts", "max_attempts", "run_at", "locked_until")


@query(J + f" SELECT CAST(id AS VARCHAR) AS id, status FROM jobs UNION ALL SELECT DISTINCT CAST(id + 5000000 AS VARCHAR), 'queued' FROM jobs n WHERE id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM jobs k WHERE k.id = n.id + 5000000) UNION ALL SELECT 'backup_2024-01-16', 'queued'")
def queue_enqueue(spark, sf_dir):
    """The queue after jobs are added, some of them known or twice, and the day's backup, asked for twice."""
    known = _named_jobs(spark, sf_dir)
    some = known.where("cast(id as bigint) % 100 = 0").withColumn("status", F.lit("queued"))
    new = some.unionByName(some.withColumn("id", (F.col("id").cast("long") + 5000000).cast("string"))).unionByName(some.withColumn("id", (F.col("id").cast("long") + 5000000).cast("string")).withColumn("run_at", F.col("run_at") + F.expr("INTERVAL 1 HOUR")))
    return runs.daily_job(runs.daily_job(runs.enqueue(known, new), NOW), NOW).select("id", "status")


@query(J + f" SELECT CAST(id AS VARCHAR) AS id, CASE WHEN status = 'running' AND locked_until < TIMESTAMP '{NOW}' AND attempts >= max_attempts THEN 'failed' ELSE status END AS status FROM jobs")
def queue_give_up(spark, sf_dir):
    """The queue after jobs that keep stopping their worker are given up."""
    return runs.give_up(_named_jobs(spark, sf_dir), NOW).select("id", "status")


@query(J + f""", due AS (SELECT * FROM (SELECT *, CASE WHEN status = 'running' AND locked_until < TIMESTAMP '{NOW}' AND attempts >= max_attempts THEN 'failed' ELSE status END AS s FROM jobs)
    WHERE ((s = 'queued' AND run_at <= TIMESTAMP '{NOW}') OR (s = 'running' AND locked_until < TIMESTAMP '{NOW}')) AND attempts < max_attempts ORDER BY run_at, CAST(id AS VARCHAR) LIMIT 50)
    SELECT CAST(j.id AS VARCHAR) AS id, CASE WHEN d.id IS NULL THEN CASE WHEN j.status = 'running' AND j.locked_until < TIMESTAMP '{NOW}' AND j.attempts >= j.max_attempts THEN 'failed' ELSE j.status END
      WHEN d.type NOT IN ('click', 'view') THEN 'failed' WHEN d.type = 'click' THEN 'done' WHEN d.attempts + 1 < d.max_attempts THEN 'queued' ELSE 'failed' END AS status FROM jobs j LEFT JOIN due d USING (id)""")
def worker_round(spark, sf_dir):
    """The queue after one round of a worker with 50 slots: clicks succeed, views fail, other types have no handler."""
    handlers = {"click": lambda taken: taken.where("false"), "view": lambda taken: taken}
    return runs.work_off(_named_jobs(spark, sf_dir), handlers, NOW, 50).select("id", "status")


@query(J + f""", s AS (SELECT count(*) FILTER (status = 'running') AS running, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(run_at) FILTER (status = 'queued' AND run_at <= TIMESTAMP '{NOW}'))) / 1000000) AS oldest FROM jobs)
    SELECT NOT (coalesce(oldest, 0) > 300 AND running = 0) AS queue, TRUE AS backup, NOT (coalesce(oldest, 0) > 300 AND running = 0) AS healthy FROM s UNION ALL SELECT FALSE, FALSE, FALSE FROM s""")
def health_checks(spark, sf_dir):
    """Health as it is with a fresh backup, and without running jobs and with an old one."""
    rows, names = jobs(spark, sf_dir), "name string"
    fresh = runs.health(rows, NOW, spark.createDataFrame([("backups/backup-20240115T230000Z.rcbk",), ("backups/backup-20240101T000000Z.rcbk",)], names))
    stale = runs.health(rows.where("status <> 'running'"), NOW, spark.createDataFrame([("backups/backup-20240114T230000Z.rcbk",)], names))
    return fresh.unionByName(stale)


@query("""WITH names AS (SELECT strftime(ts, 'b/backup-%Y%m%dT%H%M%SZ.rcbk') AS name, date_trunc('second', ts) AS made FROM events WHERE event_id % 50 = 0), ranked AS (SELECT *, row_number() OVER (ORDER BY name DESC) AS n FROM names)
    SELECT name, made, n > 14 AS expired FROM ranked""")
def backup_retention(spark, sf_dir):
    """Snapshots named by their time, read back, and which of them go when 14 are kept."""
    named = table(spark, sf_dir, "events").where("event_id % 50 = 0").select(backup_name(F.col("ts"), "b/").alias("name"))
    gone = to_delete(named, 14).withColumn("expired", F.lit(True))
    return named.join(gone, "name", "left").select("name", backup_time(F.col("name")).alias("made"), F.coalesce("expired", F.lit(False)).alias("expired"))


@query("""WITH tries AS (SELECT user_id, list(struct_pack(a := epoch_us(ts), f := event_type <> 'purchase') ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
    folded AS (SELECT user_id, list_reduce(l, lambda s, x: CASE WHEN x.a < s.a THEN s WHEN NOT x.f THEN struct_pack(a := 0::BIGINT, f := s.f, n := 0::BIGINT, locks := s.locks)
        WHEN s.n + 1 >= 8 THEN struct_pack(a := x.a + 900000000, f := s.f, n := 0::BIGINT, locks := list_append(s.locks, x.a)) ELSE struct_pack(a := 0::BIGINT, f := s.f, n := s.n + 1, locks := s.locks) END,
        struct_pack(a := 0::BIGINT, f := FALSE, n := 0::BIGINT, locks := []::BIGINT[])) AS s FROM (SELECT user_id, list_transform(l, lambda x: struct_pack(a := x.a, f := x.f, n := 0::BIGINT, locks := []::BIGINT[])) AS l FROM tries))
    SELECT CAST(user_id AS VARCHAR) AS key, unnest(s.locks) AS locked_at FROM folded""")
def lockouts(spark, sf_dir):
    """When eight failures in a row lock a user for a quarter of an hour."""
    tries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "purchase").alias("failed"))
    return counters.lockouts(tries)

