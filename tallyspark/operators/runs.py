"""State transitions as pure functions: tables and a command in, new tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.config import Config, MatchingConfig
from tallyspark.functions.dates import backoff_seconds, backup_time
from tallyspark.operators.assign import greedy_assignment, near
from tallyspark.operators.candidates import capped_pairs
from tallyspark.operators.score import escalate, score_pairs
from tallyspark.session import cut, stored

OPEN = ("suggested", "alternate")


def unlocked(receipts: DataFrame, transactions: DataFrame, matches: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What a run considers: receipts that are no duplicates, and on both sides what is not matched already."""
    r, t = receipts, transactions
    if "is_duplicate" in receipts.columns:
        r = r.where("not is_duplicate")
    if matches is not None:
        locked = matches.where("status in ('confirmed', 'auto')")
        r = r.join(locked.select("org", F.col("r_id").alias("id")).distinct(), ["org", "id"], "left_anti")
        t = t.join(locked.select("org", F.col("t_id").alias("id")).distinct(), ["org", "id"], "left_anti")
    return r, t


def score_run(receipts: DataFrame, transactions: DataFrame, config: Config = MatchingConfig(), similarity=None, provider=None) -> DataFrame:
    """Every scored pair of a run, of any class: (org, r_id, t_id, score, escalated, position, classification, method)
    and where it lies (`NEAR`). A plan, not stored: `kept` takes from it what a run goes on with.

    `similarity` adds the column of that name to the candidate pairs; without it the merchant signal doesn't apply.
    `provider` escalates undecided pairs.
    """
    pairs = capped_pairs(receipts, transactions, config)
    pairs = similarity(stored(pairs)) if similarity else pairs.withColumn("similarity", F.lit(None).cast("double"))
    scored = score_pairs(pairs, config)
    if provider:
        scored = escalate(stored(scored), provider, config)
    else:
        scored = scored.withColumn("escalated", F.lit(False)).withColumn("method", F.lit("deterministic"))
    return scored.select("org", "r_id", "t_id", "score", "escalated", "position", "classification", "method", *near(F.col("r_date"), F.col("r_total")))


def graded(scored: DataFrame) -> DataFrame:
    """The scored pairs of any class but none."""
    # Spark would push a filter on the class under the scores by repeating all of their expressions, but not past a row number
    return scored.withColumn("_row", F.monotonically_increasing_id()).where("classification <> 'none' and _row >= 0").drop("_row")


def kept(scored: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """The scored pairs of any class but none, without those that `matches` has as rejected, stored."""
    rows = graded(scored)
    if matches is None:
        return stored(rows)
    # by receipt alone, so that the pairs of one stay together
    refused = matches.where("status = 'rejected'").groupBy("org", "r_id").agg(F.collect_set("t_id").alias("_refused"))
    known = rows.join(refused.hint("merge"), ["org", "r_id"], "left").where(~F.coalesce(F.array_contains("_refused", F.col("t_id")), F.lit(False)))
    return stored(known.select(scored.columns))


def assign_run(scored: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """The kept pairs of a run with their status; rejected pairs stay out before the assignment."""
    best = greedy_assignment(kept(scored, matches), ready=True)
    status = F.when(F.col("best") & (F.col("classification") == "auto"), "auto").when(F.col("best"), "suggested").otherwise("alternate")
    return best.withColumn("status", status).select("org", "r_id", "t_id", "score", "classification", "method", "status")


def propose(receipts: DataFrame, transactions: DataFrame, matches: DataFrame | None = None, config: Config = MatchingConfig(), similarity=None, provider=None) -> DataFrame:
    """A matching run: (org, r_id, t_id, score, classification, method, status) of the kept pairs.

    Duplicates and what is matched already stay out, as do rejected pairs, before the assignment. Settings (org,
    matching_config) in the place of `config` give each organization its own rules.
    """
    r, t = unlocked(receipts, transactions, matches)
    return assign_run(score_run(r, t, config, similarity, provider), matches)


def write_back(matches: DataFrame, proposals: DataFrame, receipts: DataFrame) -> DataFrame:
    """`matches` after a run over `receipts` (org, id): their open rows are replaced by the proposals; rejections stay."""
    run = receipts.select("org", F.col("id").alias("r_id")).distinct()
    stale = matches.where(F.col("status").isin(*OPEN)).join(run, ["org", "r_id"], "left_semi").select("org", "r_id", "t_id")
    kept = matches.join(stale, ["org", "r_id", "t_id"], "left_anti")
    return kept.unionByName(proposals.select("org", "r_id", "t_id", "score", "status"), allowMissingColumns=True)


def _without_rivals(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    rivals = matches.where(F.col("status").isin(*OPEN))
    gone = rivals.join(chosen.select("org", "r_id"), ["org", "r_id"], "left_semi").unionByName(rivals.join(chosen.select("org", "t_id"), ["org", "t_id"], "left_semi"))
    return matches.join(gone.select("org", "r_id", "t_id").distinct(), ["org", "r_id", "t_id"], "left_anti")


def confirm(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """`matches` with the chosen pairs (org, r_id, t_id) confirmed and open rows of either side gone."""
    mine = chosen.select("org", "r_id", "t_id").distinct()
    rows = matches.join(mine, ["org", "r_id", "t_id"], "left_semi").withColumn("status", F.lit("confirmed"))
    rest = _without_rivals(matches.join(mine, ["org", "r_id", "t_id"], "left_anti"), mine)
    return rest.unionByName(rows)


def reject(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """`matches` with the chosen pairs as tombstones."""
    mine = chosen.select("org", "r_id", "t_id").distinct().withColumn("_hit", F.lit(True))
    return matches.join(mine, ["org", "r_id", "t_id"], "left").withColumn("status", F.when(F.col("_hit"), "rejected").otherwise(F.col("status"))).drop("_hit")


def match_by_hand(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """`matches` with the chosen pairs (org, r_id, t_id, score) confirmed, open rows of either side gone; an earlier
    confirmed or auto pair of a side stays and both are marked `conflict`."""
    pairs = chosen.select("org", "r_id", "t_id", "score").withColumn("status", F.lit("confirmed"))
    rest = _without_rivals(matches.join(pairs, ["org", "r_id", "t_id"], "left_anti"), pairs)
    out = rest.unionByName(pairs, allowMissingColumns=True)
    sure = out.where("status in ('confirmed', 'auto')")
    twice_r = sure.groupBy("org", "r_id").count().where("count > 1").select("org", "r_id").withColumn("_r", F.lit(True))
    twice_t = sure.groupBy("org", "t_id").count().where("count > 1").select("org", "t_id").withColumn("_t", F.lit(True))
    out = out.join(twice_r, ["org", "r_id"], "left").join(twice_t, ["org", "t_id"], "left")
    return out.withColumn("conflict", F.col("status").isin("confirmed", "auto") & (F.coalesce("_r", F.lit(False)) | F.coalesce("_t", F.lit(False)))).drop("_r", "_t")


def unlink(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """`matches` without the chosen pairs."""
    return matches.join(chosen.select("org", "r_id", "t_id"), ["org", "r_id", "t_id"], "left_anti")


def delete_receipts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the receipts (org, id) and what hangs on them: matches and extractions by r_id."""
    out = {}
    for name, df in tables.items():
        key = "id" if name == "receipts" else "r_id"
        out[name] = df.join(ids.select("org", F.col("id").alias(key)), ["org", key], "left_anti") if key in df.columns else df
    return out


def claim(jobs: DataFrame, now: str, slots: int = 1) -> DataFrame:
    """The oldest due jobs, as many as there are slots, claimed: queued and due, or running with an expired lease
    and attempts left."""
    at = F.lit(now).cast("timestamp_ntz")
    due = ((F.col("status") == "queued") & (F.col("run_at") <= at)) | ((F.col("status") == "running") & (F.col("locked_until") < at))
    taken = jobs.where(due & (F.col("attempts") < F.col("max_attempts"))).orderBy("run_at", "id").limit(slots)
    return taken.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("locked_until", at + F.expr("INTERVAL 5 MINUTES"))


def finish(jobs: DataFrame, now: str, failed: DataFrame | None = None) -> DataFrame:
    """Running jobs done, or, where `failed` (id) names them, queued again after a backoff until attempts run out."""
    at = F.lit(now).cast("timestamp_ntz")
    mark = jobs.withColumn("_f", F.lit(False)) if failed is None else jobs.join(failed.select("id", F.lit(True).alias("_f")).distinct(), "id", "left")
    running, bad = F.col("status") == "running", F.coalesce("_f", F.lit(False))
    again = bad & (F.col("attempts") < F.col("max_attempts"))
    status = F.when(~running, F.col("status")).when(again, "queued").when(bad, "failed").otherwise("done")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return mark.withColumn("run_at", F.when(running & again, at + wait).otherwise(F.col("run_at"))).withColumn("status", status).drop("_f")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """`jobs` and the new ones (its columns) whose id is not queued already; of several of one id the first by run_at, then
    by the other columns."""
    first = Window.partitionBy("id").orderBy("run_at", *(c for c in jobs.columns if c not in ("id", "run_at")))
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(jobs.columns)
    return jobs.unionByName(once.join(jobs.select("id"), "id", "left_anti").select(jobs.columns))


def daily_job(jobs: DataFrame, now: str, type_: str = "backup", hour: int = 2) -> DataFrame:
    """`jobs` with the day's job of a type, named by the UTC day, once a day and not before the hour."""
    at = F.lit(now).cast("timestamp_ntz")
    row = jobs.sparkSession.range(1).select(F.concat_ws("_", F.lit(type_), F.date_format(at, "yyyy-MM-dd")).alias("id"), F.lit(type_).alias("type"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), at.alias("run_at"), F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    return enqueue(jobs, row.where(F.hour(at) >= hour))


def give_up(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs whose lease expired with no attempt left have failed: they keep stopping their worker."""
    at = F.lit(now).cast("timestamp_ntz")
    lost = (F.col("status") == "running") & (F.col("locked_until") < at) & (F.col("attempts") >= F.col("max_attempts"))
    return jobs.withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def health(jobs: DataFrame, now: str, backups: DataFrame | None = None, stuck_seconds: int = 300, max_age_hours: float = 36) -> DataFrame:
    """(queue, backup, healthy): false for the queue if a job waits too long and none runs; for the newest of the
    `backups` (name) if it is too old; null where there is none."""
    stats = queue_stats(jobs, now).select((~((F.coalesce("oldest_seconds", F.lit(0)) > stuck_seconds) & (F.col("running") == 0))).alias("queue"))
    if backups is None:
        age = stats.sparkSession.range(1).select(F.lit(None).cast("boolean").alias("backup"))
    else:
        age = backups.agg(F.max(backup_time(F.col("name"))).alias("at")).select((F.timestamp_diff("SECOND", "at", F.lit(now).cast("timestamp_ntz")) <= max_age_hours * 3600).alias("backup"))
    return stats.crossJoin(F.broadcast(age)).select("queue", "backup", (F.col("queue") & F.coalesce("backup", F.lit(True))).alias("healthy"))  # one row each


def work_off(jobs: DataFrame, handlers: dict, now: str, slots: int = 2) -> DataFrame:
    """One round of a worker: due jobs are claimed and each type's run by its handler, a function of those jobs that
    returns the ids of the failed ones (id); jobs of a type without handler fail for good. Returns all jobs after it."""
    jobs = cut(give_up(jobs, now))
    taken = cut(claim(jobs, now, slots))
    failed = None
    for type_, handler in handlers.items():
        bad = handler(taken.where(F.col("type") == type_)).select("id")
        failed = bad if failed is None else failed.unionByName(bad)
    unknown = taken.where(~F.col("type").isin(*handlers))
    after = finish(taken.join(unknown.select("id"), "id", "left_anti"), now, failed)
    rest = jobs.join(taken.select("id"), "id", "left_anti")
    return rest.unionByName(after.select(jobs.columns)).unionByName(unknown.withColumn("status", F.lit("failed")).select(jobs.columns))


def queue_stats(jobs: DataFrame, now: str) -> DataFrame:
    """Counts by state and the age in seconds of the oldest job that waits."""
    at = F.lit(now).cast("timestamp_ntz")
    waiting = (F.col("status") == "queued") & (F.col("run_at") <= at)
    return jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"),
        F.count_if((F.col("status") == "failed") & (F.col("run_at") > at - F.expr("INTERVAL 24 HOURS"))).alias("failed_recently"),
        F.timestamp_diff("SECOND", F.min(F.when(waiting, F.col("run_at"))), at).alias("oldest_seconds"),
    )


def prune(jobs: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Without finished jobs that are older."""
    old = F.col("run_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return jobs.where(~(F.col("status").isin("done", "failed") & old))
