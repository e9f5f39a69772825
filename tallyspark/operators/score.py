"""Five weighted signals with vetoes, as Column expressions over candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import Config, MatchingConfig, with_rules
from tallyspark.functions.money import minor_units, round_up
from tallyspark.functions.similarity import merchant_similarity_column
from tallyspark.session import cut


#: What `score_pairs` adds.
SCORED = ("s_amount", "s_date", "s_merchant", "s_currency", "s_payment", "veto", "raw_score", "score", "classification")


def amount_signal(total: Column, amount: Column, config: MatchingConfig) -> Column:
    """1 within tolerance, falling to 0 at the relative bound; null where an amount is missing."""
    a, b = minor_units(F.abs(total)), minor_units(F.abs(amount))
    delta = F.abs(a - b)
    relative = delta / F.greatest(a, b, F.lit(1))
    return (
        F.when(total.isNull() | amount.isNull(), None)
        .when(delta <= minor_units(F.lit(config.amount.exact_tolerance)), 1.0)
        .when(relative > config.amount.max_relative, 0.0)
        .otherwise(1 - relative / config.amount.max_relative)
    )


def date_signal(receipt: Column, posted: Column, config: MatchingConfig) -> Column:
    """1 on the day, falling to just over 0 at the end of the window; null where a date is missing."""
    days = F.datediff(posted, receipt)
    limit = F.when(days >= 0, config.date.max_after).otherwise(config.date.max_before)
    return F.when(days.isNull(), None).when(F.abs(days) <= config.date.exact_days, 1.0).when(F.abs(days) > limit, 0.0).otherwise(1 - F.abs(days) / (limit + 1))


def merchant_signal(similarity: Column, config: MatchingConfig) -> Column:
    """The similarity rescaled from the floor; null where a name is missing."""
    floor = config.merchant.floor
    return F.when(similarity.isNull(), None).when(similarity < floor, 0.0).otherwise((similarity - floor) / (1 - floor))


def score_pairs(pairs: DataFrame, config: Config = MatchingConfig()) -> DataFrame:
    """Adds the five signals, score (one decimal), raw_score, classification and veto to `pairs` with r_, t_ and
    `similarity` columns.

    The weighted mean counts the signals that apply. Vetoes: amount, then currency, then date. A currency
    mismatch caps below auto; any veto where amount or date scores 0, or is missing, caps below possible. The
    class follows the unrounded score.
    """
    kept = pairs.columns
    pairs, config = with_rules(pairs, config)
    w, t = config.weights, config.thresholds
    same = (F.col("r_currency") == F.col("t_currency")) | (F.upper("r_currency") == F.upper("t_currency"))  # mostly equal as they are
    frame = pairs.select(
        "*", amount_signal(F.col("r_total"), F.col("t_amount"), config).alias("s_amount"), date_signal(F.col("r_date"), F.col("t_date"), config).alias("s_date"),
        merchant_signal(F.col("similarity"), config).alias("s_merchant"), same.cast("double").alias("s_currency"), (F.col("r_payment") == F.col("t_payment")).cast("double").alias("s_payment"),
    )
    weighted = (("s_amount", w.amount), ("s_date", w.date), ("s_merchant", w.merchant), ("s_currency", w.currency), ("s_payment", w.payment_method))
    zero = F.lit(0.0)
    total = sum((F.coalesce(F.col(c) * weight, zero) for c, weight in weighted), zero)
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(x).cast("double")).otherwise(zero) for c, x in weighted), zero)
    mean = F.when(weight > 0, total / weight * 100).otherwise(zero)
    no_amount, no_date = F.coalesce(F.col("s_amount"), zero) == 0, F.coalesce(F.col("s_date"), zero) == 0
    veto = (
        F.when((F.col("s_amount") == 0), "amount")
        .when(F.col("s_currency") == 0, "currency")
        .when(F.col("s_date") == 0, "date")
    )
    frame = frame.withColumn("veto", veto).withColumn("raw_score", mean)
    capped = F.when(F.col("veto") == "currency", F.least("raw_score", F.lit(t.auto - 1.0))).otherwise(F.col("raw_score"))
    capped = F.when(F.col("veto").isNotNull() & (no_amount | no_date), F.least(capped, F.lit(t.possible - 1.0))).otherwise(capped)
    frame = frame.withColumn("raw_score", F.greatest(zero, F.least(F.lit(100.0), capped)))
    frame = frame.withColumn("score", round_up(F.col("raw_score"), 1)).withColumn("classification", classify(F.col("raw_score"), config))
    return frame.select(*kept, *SCORED)


def classify(score: Column, config: MatchingConfig = MatchingConfig()) -> Column:
    """auto, review, possible or none."""
    t = config.thresholds
    return F.when(score >= t.auto, "auto").when(score >= t.review, "review").when(score >= t.possible, "possible").otherwise("none")


def with_similarity(pairs: DataFrame) -> DataFrame:
    """Adds the merchant similarity of each pair, null where a name is empty, once per distinct pair of names.

    `pairs` is read twice: store a costly plan first."""
    name = lambda c: F.nullif(c, F.lit(""))
    distinct = pairs.select(name("r_merchant").alias("_r"), name("t_merchant").alias("_t")).where("_r is not null and _t is not null").distinct()
    alike = cut(distinct.withColumn("similarity", merchant_similarity_column("_r", "_t")))
    return _with_names(pairs, alike, (name("r_merchant") == F.col("_r")) & (name("t_merchant") == F.col("_t"))).drop("_r", "_t")


#: As many pairs of names go to the tasks whole.
FEW_NAMES = 20000


def _with_names(pairs: DataFrame, names: DataFrame, condition: Column) -> DataFrame:
    """`pairs` with what is known of their names; while these are few, the pairs stay where they are."""
    return pairs.join(F.broadcast(names) if names.count() <= FEW_NAMES else names, condition, "left")


def needs_semantics(config: MatchingConfig = MatchingConfig()) -> Column:
    """Whether a scored pair is worth a semantic comparison: undecided names, near amount, no veto."""
    m = config.merchant
    return (F.col("similarity") >= m.semantic_low) & (F.col("similarity") < m.semantic_high) & (F.col("s_amount") > 0.9) & F.col("veto").isNull()


def escalate(scored: DataFrame, provider, config: Config = MatchingConfig()) -> DataFrame:
    """`scored` with undecided pairs scored again by the better of both similarities.

    `provider` maps a DataFrame (a, b) of distinct names to (a, b, semantic); what it leaves out or null keeps
    its deterministic score. Adds method and escalated. `scored` is read twice: store a costly plan first.
    """
    ruled, own = with_rules(scored, config)
    marked = ruled.select(*scored.columns, F.coalesce(needs_semantics(own), F.lit(False)).alias("escalated"))
    asked = marked.where("escalated").select(F.col("r_merchant").alias("a"), F.col("t_merchant").alias("b")).distinct()
    answers = cut(provider(asked).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "semantic"))
    joined = _with_names(marked, answers, F.col("escalated") & (F.col("r_merchant") == F.col("_a")) & (F.col("t_merchant") == F.col("_b")))
    # without a better answer the similarity stays, and with it all that follows from it
    better = F.col("semantic") > F.col("similarity")
    again = joined.withColumn("method", F.when(better, "semantic").otherwise("deterministic")).withColumn("similarity", F.greatest("similarity", "semantic"))
    return score_pairs(again.drop("_a", "_b", "semantic", *SCORED), config).select(*marked.columns, "method")
