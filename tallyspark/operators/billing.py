"""Plans: what a subscription entitles to now, who owns it, and what changing it checks."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import days_left
from tallyspark.functions.tables import PLAN_QUOTAS
from tallyspark.operators.actions import audit_rows
from tallyspark.operators.reads import quota_usage


def effective(subscriptions: DataFrame, now: str) -> DataFrame:
    """Adds effective_plan, effective_quota, expired and days_left: a paid plan whose period ended has the free limit."""
    at = F.lit(now).cast("timestamp_ntz")
    known = F.when(F.col("plan").isin(*PLAN_QUOTAS), F.col("plan")).otherwise("free")
    expired = (known != "free") & F.coalesce(F.col("period_end") < at, F.lit(False))
    left = F.when(expired | (known != "free"), days_left(F.col("period_end").cast("timestamp"), F.lit(now).cast("timestamp")))
    return subscriptions.withColumns({
        "effective_plan": F.when(expired, "free").otherwise(known), "effective_quota": F.when(expired, F.lit(PLAN_QUOTAS["free"]).cast("long")).otherwise(F.col("quota")), "expired": expired, "days_left": left,
    })


def quota_state(subscriptions: DataFrame, receipts: DataFrame, now: str) -> DataFrame:
    """Adds used and refused: whether this month's receipts have reached the limit."""
    used = quota_usage(receipts, now).withColumnRenamed("used", "_used")
    found = effective(subscriptions, now).join(used, "org", "left").withColumn("used", F.coalesce("_used", F.lit(0))).drop("_used")
    return found.withColumn("refused", F.col("used") >= F.col("effective_quota"))


def plans(subscriptions: DataFrame, memberships: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """Every organization's plan with its owner's email."""
    owners = memberships.where("role = 'owner'").select("org", "user_id")
    return effective(subscriptions, now).join(owners, "org").join(users.select("user_id", "email"), "user_id").select("email", "org", "plan", "quota", "period_end", "expired", "days_left")


def plans_of(found: DataFrame, email: str) -> DataFrame:
    """`plans` of one owner; case and space around the address are of no matter."""
    return found.where(F.col("email") == email.strip().lower())


def expiring(found: DataFrame, days: int) -> DataFrame:
    """Paid `plans` that end within so many days or have ended, soonest first."""
    return found.where((F.col("plan") != "free") & (F.col("days_left") <= days)).orderBy("days_left", "org")


def check_plan(plan: str, now: datetime.datetime, until: str | None = None, quota: int | None = None) -> datetime.datetime | None:
    """The end of the period, the whole last day included; raises for an unknown plan, an end that is missing, unreadable,
    past or over three years off, or an odd quota."""
    if plan not in PLAN_QUOTAS:
        raise ValueError(f"unknown plan {plan}")
    if quota is not None and not 1 <= quota <= 1_000_000:
        raise ValueError("the quota must lie between 1 and 1000000")
    if plan == "free":
        return None
    if not until or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", until):
        raise ValueError("a paid plan needs an end date like 2027-10-30")
    end = datetime.datetime.fromisoformat(until) + datetime.timedelta(days=1, milliseconds=-1)
    if not now <= end <= now + datetime.timedelta(days=3 * 366):
        raise ValueError("the end date is past or more than three years off")
    return end


def set_plan(subscriptions: DataFrame, org: int | Column, plan: str, now: datetime.datetime, until: str | None = None, quota: int | None = None, reference: str | None = None) -> dict[str, DataFrame]:
    """Subscriptions with the organizations moved to a plan, and the trail."""
    end = check_plan(plan, now, until, quota)
    mine = F.col("org") == org if isinstance(org, int) else org
    changed = subscriptions.withColumns({
        "quota": F.when(mine, F.lit(quota or PLAN_QUOTAS[plan]).cast("long")).otherwise(F.col("quota")), "period_end": F.when(mine, F.lit(end).cast("timestamp_ntz")).otherwise(F.col("period_end")),
        "plan": F.when(mine, plan).otherwise(F.col("plan")),
    })
    said = F.concat(F.col("plan"), F.lit(f" to {plan}" + (f" until {until}" if end else "") + (f", ref {reference}" if reference else "")))
    return {"subscriptions": changed, "audit": audit_rows(subscriptions.where(mine), "plan.changed", "organization", F.col("org"), said, "Support")}
