"""Queries of queue, counters and state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.dates import backoff_seconds
from tallyspark.operators import counters, runs
from tallyspark.plans.registry import query
from tallyspark.sources.adapters import NOW, jobs, matches, sql, table

M = sql("matches")
J = sql("jobs")
#: The chosen pairs of the transition queries: of each receipt whose key divides by 4, its line 3 or 2.
CHOSEN = M + ", chosen AS (SELECT org, r_id, t_id FROM matches WHERE r_id % 4 = 0 AND l_linenumber = 2)"
OPEN_OF = """(status IN ('suggested', 'alternate') AND (EXISTS (SELECT 1 FROM chosen c WHERE c.org = m.org AND c.r_id = m.r_id) OR EXISTS (SELECT 1 FROM chosen c WHERE c.org = m.org AND c.t_id = m.t_id)))"""
IS_CHOSEN = "EXISTS (SELECT 1 FROM chosen c WHERE c.org = m.org AND c.r_id = m.r_id AND c.t_id = m.t_id)"


def _chosen(spark, sf_dir):
    return matches(spark, sf_dir).where("r_id % 4 = 0 and l_linenumber = 2")


@query(CHOSEN + f" SELECT org, r_id, t_id, CASE WHEN {IS_CHOSEN} THEN 'confirmed' ELSE status END AS status FROM matches m WHERE {IS_CHOSEN} OR NOT {OPEN_OF}")
def confirm_match_effect(spark, sf_dir):
    """The matches after confirming the chosen pairs."""
    return runs.confirm(matches(spark, sf_dir), _chosen(spark, sf_dir)).select("org", "r_id", "t_id", "status")


@query(CHOSEN + f" SELECT org, r_id, t_id, CASE WHEN {IS_CHOSEN} THEN 'rejected' ELSE status END AS status FROM matches m")
def reject_match_effect(spark, sf_dir):
    """The matches after rejecting the chosen pairs."""
    return runs.reject(matches(spark, sf_dir), _chosen(spark, sf_dir)).select("org", "r_id", "t_id", "status")


@query(CHOSEN + f""", after AS (SELECT org, r_id, t_id, status FROM matches m WHERE NOT {IS_CHOSEN} AND NOT {OPEN_OF} UNION ALL SELECT DISTINCT org, r_id, t_id, 'confirmed' FROM chosen),
    sure AS (SELECT * FROM after WHERE status IN ('confirmed', 'auto'))
    SELECT org, r_id, t_id, status, status IN ('confirmed', 'auto') AND ((SELECT count(*) FROM sure s WHERE s.org = a.org AND s.r_id = a.r_id) > 1 OR (SELECT count(*) FROM sure s WHERE s.org = a.org AND s.t_id = a.t_id) > 1) AS conflict FROM after a""")
def manual_match_effect(spark, sf_dir):
    """The matches after matching the chosen pairs by hand, with conflicts."""
    return runs.match_by_hand(matches(spark, sf_dir), _chosen(spark, sf_dir).dropDuplicates(["org", "r_id", "t_id"])).select("org", "r_id", "t_id", "status", "conflict")


@query(J + f""" SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running,
    count(*) FILTER (status = 'failed' AND run_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS) AS failed_recently,
    CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(run_at) FILTER (status = 'queued' AND run_at <= TIMESTAMP '{NOW}'))) / 1000000) AS BIGINT) AS oldest_seconds FROM jobs""")
def queue_stats(spark, sf_dir):
    """The queue at an instant."""
    return runs.queue_stats(jobs(spark, sf_dir), NOW)


@query(J + f""" SELECT id, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE ((status = 'queued' AND run_at <= TIMESTAMP '{NOW}') OR (status = 'running' AND locked_until < TIMESTAMP '{NOW}'))
    AND attempts < max_attempts ORDER BY run_at, id LIMIT 20""")
def queue_claim(spark, sf_dir):
    """The jobs that 20 free slots would claim."""
    return runs.claim(jobs(spark, sf_dir), NOW, 20).select("id", "status", "attempts")


@query(J + f""" SELECT id, CASE WHEN status <> 'running' THEN status WHEN id % 8 <> 1 THEN 'done' WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status FROM jobs""")
def queue_finish(spark, sf_dir):
    """The queue after its running jobs end, some of them badly."""
    rows = jobs(spark, sf_dir)
    return runs.finish(rows, NOW, rows.where("id % 8 = 1").select("id")).select("id", "status")


@query(J + f" SELECT id, status FROM jobs WHERE NOT (status IN ('done', 'failed') AND run_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)")
def queue_prune(spark, sf_dir):
    """The queue without old finished jobs."""
    return runs.prune(jobs(spark, sf_dir), NOW).select("id", "status")


@query("SELECT event_id AS id, least(10.0::DOUBLE * pow(2.0::DOUBLE, event_id % 6), 600.0::DOUBLE) AS seconds FROM events")
def backoff_schedule(spark, sf_dir):
    """Seconds that each job waits before its next attempt."""
    return jobs(spark, sf_dir).select("id", backoff_seconds(F.col("attempts") + 1).alias("seconds"))


@query("""WITH RECURSIVE hits AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS moment FROM events),
    chain AS (SELECT key, min(moment) AS opened FROM hits GROUP BY key UNION ALL
      SELECT c.key, (SELECT min(h.moment) FROM hits h WHERE h.key = c.key AND h.moment >= c.opened + 21600000000) FROM chain c WHERE EXISTS (SELECT 1 FROM hits h WHERE h.key = c.key AND h.moment >= c.opened + 21600000000))
    SELECT c.key, c.opened, count(*) AS hits FROM chain c JOIN hits h ON h.key = c.key AND h.moment >= c.opened AND h.moment < c.opened + 21600000000 GROUP BY c.key, c.opened""")
def rate_limit_fixed_window(spark, sf_dir):
    """Windows of six hours from each user's first hit."""
    hits = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return counters.fixed_windows(hits, 6 * 3600)


@query("""WITH marked AS (SELECT event_id, user_id, ts, CAST(event_type = 'error' AS INTEGER) AS f, sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    SELECT * FROM (SELECT event_id, user_id, CAST(sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak FROM marked) WHERE streak >= 3""")
def lockout_runs(spark, sf_dir):
    """Events that end three failures in a row or more."""
    runs_ = counters.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs_.where("streak >= 3").select("event_id", "user_id", "streak")
