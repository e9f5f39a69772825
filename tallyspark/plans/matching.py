"""Queries on candidate pairs, scores, assignment and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import normalize_merchant
from tallyspark.operators.actions import matching_run
from tallyspark.operators.assign import best_of, duplicate_edges, flag_duplicates, greedy_assignment, mutual_best
from tallyspark.operators.candidates import candidate_pairs, capped_pairs
from tallyspark.operators.incremental import incremental_run
from tallyspark.operators.reads import unmatched
from tallyspark.operators.runs import graded, kept, propose, score_run
from tallyspark.operators.score import escalate, score_pairs, with_similarity
from tallyspark.plans.registry import query
from tallyspark.plans.similar import SIMS
from tallyspark.session import cut, stored
from tallyspark.sources.adapters import matches, receipts, sql, table, transactions

#: Candidate pairs as a plain range join, every one.
ALL_PAIRS = (
    sql("receipts", "transactions")
    + """, money AS (SELECT *, CAST(floor(abs(total) * 100 + 0.5) AS BIGINT) AS cents FROM receipts),
    paid AS (SELECT *, CAST(floor(abs(amount) * 100 + 0.5) AS BIGINT) AS t_cents FROM transactions),
    pairs AS (SELECT r.org, r.id AS r_id, t.id AS t_id FROM money r JOIN paid t ON r.org = t.org
      WHERE (r.date IS NULL OR t.date - r.date BETWEEN -2 AND 5)
        AND (r.total IS NULL OR ((abs(cents - t_cents) <= 1 OR abs(cents - t_cents) <= CAST(0.05 AS DOUBLE) * greatest(cents, t_cents))
          AND abs(floor(abs(amount) + 0.5) - floor(total + 0.5)) <= greatest(1, ceil(total * CAST(0.05 AS DOUBLE)) + 1))))"""
)
#: The pairs that a cap of 50 can leave: receipts without total and date meet the first 50 transactions of their organization.
PAIRS = (
    sql("receipts", "transactions")
    + """, few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY id) AS n FROM transactions) WHERE n <= 50),
    money AS (SELECT *, CAST(floor(abs(total) * 100 + 0.5) AS BIGINT) AS cents FROM receipts),
    paid AS (SELECT *, CAST(floor(abs(amount) * 100 + 0.5) AS BIGINT) AS t_cents FROM transactions),
    pairs AS (SELECT r.org, r.id AS r_id, t.id AS t_id, r.total, r.date AS r_date, r.currency AS r_currency, r.payment AS r_payment, t.amount, t.date AS t_date,
        t.currency AS t_currency, t.payment AS t_payment, cents, t_cents FROM money r JOIN paid t ON r.org = t.org
      WHERE (r.date IS NULL OR t.date - r.date BETWEEN -2 AND 5)
        AND (r.total IS NULL OR ((abs(cents - t_cents) <= 1 OR abs(cents - t_cents) <= CAST(0.05 AS DOUBLE) * greatest(cents, t_cents))
          AND abs(floor(abs(amount) + 0.5) - floor(total + 0.5)) <= greatest(1, ceil(total * CAST(0.05 AS DOUBLE)) + 1)))
        AND (r.date IS NOT NULL OR r.total IS NOT NULL OR t.id IN (SELECT f.id FROM few f WHERE f.org = r.org)))"""
)
CAPPED = (
    PAIRS
    + """, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, r_id
      ORDER BY CASE WHEN total IS NOT NULL THEN floor(abs(amount) + 0.5) END NULLS FIRST, t_id) AS position FROM pairs) WHERE position <= 50)"""
)
SCORED = (
    CAPPED
    + """, signals AS (SELECT *,
        CASE WHEN total IS NULL THEN NULL WHEN abs(cents - t_cents) <= 1 THEN 1.0::DOUBLE
          WHEN abs(cents - t_cents)::DOUBLE / greatest(cents, t_cents, 1) > 0.05::DOUBLE THEN 0 ELSE 1 - abs(cents - t_cents)::DOUBLE / greatest(cents, t_cents, 1) / 0.05::DOUBLE END AS s_amount,
        CASE WHEN r_date IS NULL THEN NULL WHEN t_date = r_date THEN 1.0::DOUBLE WHEN t_date > r_date THEN 1 - (t_date - r_date)::DOUBLE / 6 ELSE 1 - (r_date - t_date)::DOUBLE / 3 END AS s_date,
        CASE WHEN r_currency = t_currency THEN 1.0::DOUBLE ELSE 0 END AS s_currency,
        CASE WHEN r_payment = t_payment THEN 1.0::DOUBLE WHEN r_payment <> t_payment THEN 0 END AS s_payment FROM capped),
      means AS (SELECT *, (coalesce(s_amount * 0.4::DOUBLE, 0) + coalesce(s_date * 0.2::DOUBLE, 0) + s_currency * 0.05::DOUBLE + coalesce(s_payment * 0.05::DOUBLE, 0))
        / ((CASE WHEN s_amount IS NULL THEN 0 ELSE 0.4::DOUBLE END) + (CASE WHEN s_date IS NULL THEN 0 ELSE 0.2::DOUBLE END) + 0.05::DOUBLE + (CASE WHEN s_payment IS NULL THEN 0 ELSE 0.05::DOUBLE END)) * 100 AS mean,
        CASE WHEN s_amount = 0 THEN 'amount' WHEN s_currency = 0 THEN 'currency' WHEN s_date = 0 THEN 'date' END AS veto FROM signals),
      raws AS (SELECT *, CASE WHEN veto IS NOT NULL AND (coalesce(s_amount, 0) = 0 OR coalesce(s_date, 0) = 0) THEN least(CASE WHEN veto = 'currency' THEN least(mean, 89.0::DOUBLE) ELSE mean END, 39.0::DOUBLE)
        WHEN veto = 'currency' THEN least(mean, 89.0::DOUBLE) ELSE mean END AS raw FROM means),
      scored AS (SELECT *, CAST(floor(raw * 10 + 0.5) AS BIGINT) AS tenths, CASE WHEN raw >= 90 THEN 'auto' WHEN raw >= 70 THEN 'review' WHEN raw >= 40 THEN 'possible' ELSE 'none' END AS classification FROM raws)"""
)
#: Rank of a pair on either side, by the strict order of the assignment.
RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY org, r_id ORDER BY tenths DESC, r_id, position, t_id) AS of_r,
    row_number() OVER (PARTITION BY org, t_id ORDER BY tenths DESC, r_id, position, t_id) AS of_t FROM scored WHERE classification <> 'none')"""
#: The pairs that taking them best first claims, one organization after the other: a fold over the sorted pairs.
TAKEN = """, sorted AS (SELECT org, list(struct_pack(r := [r_id], t := [t_id]) ORDER BY tenths DESC, r_id, position, t_id) AS l FROM scored WHERE classification <> 'none' GROUP BY org),
    folded AS (SELECT org, list_reduce(l, lambda s, x: CASE WHEN list_contains(s.r, x.r[1]) OR list_contains(s.t, x.t[1]) THEN s ELSE struct_pack(r := list_append(s.r, x.r[1]), t := list_append(s.t, x.t[1])) END,
      struct_pack(r := []::BIGINT[], t := []::BIGINT[])) AS s FROM sorted),
    taken AS (SELECT org, unnest(s.r) AS r_id, unnest(s.t) AS t_id FROM folded)"""
#: The scores of a run: receipts that are no duplicates.
RUN = SCORED.replace("FROM money r JOIN paid t ON r.org = t.org", "FROM money r JOIN paid t ON r.org = t.org AND NOT r.is_duplicate")


def _pairs(spark, sf_dir):
    return candidate_pairs(receipts(spark, sf_dir).drop("merchant_raw"), transactions(spark, sf_dir).drop("description"))


def _scored(spark, sf_dir):
    return score_pairs(capped_pairs(receipts(spark, sf_dir), transactions(spark, sf_dir)).withColumn("similarity", F.lit(None).cast("double")))


def _tenths():
    return F.floor(F.col("raw_score") * 10 + F.lit(0.5)).cast("long").alias("tenths")


def _tenths_of_score():
    return F.floor(F.col("score") * 10 + F.lit(0.5)).cast("long").alias("tenths")


def _named(spark, sf_dir):
    """Both sides with merchant keys, stored: candidates read each side several times."""
    r = receipts(spark, sf_dir).withColumn("merchant", normalize_merchant(F.col("merchant_raw")))
    t = transactions(spark, sf_dir).withColumn("merchant", normalize_merchant(F.col("description")))
    keep = ["org", "id", "merchant", "date", "currency", "payment"]
    return stored(r.select(*keep, "total")), stored(t.select(*keep, "amount"))


@query(ALL_PAIRS + " SELECT org, r_id, t_id FROM pairs")
def candidate_pairs_band_join(spark, sf_dir):
    """Pairs within the date window and amount band, every one: a date or total that is missing rules nothing out."""
    return _pairs(spark, sf_dir).select("org", "r_id", "t_id")


@query(CAPPED + " SELECT org, r_id, t_id, CAST(position AS BIGINT) AS position FROM capped")
def candidate_cap_topk(spark, sf_dir):
    """The first 50 candidates of each receipt."""
    return capped_pairs(receipts(spark, sf_dir), transactions(spark, sf_dir)).select("org", "r_id", "t_id", F.col("position").cast("long"))


@query(SCORED + """ SELECT org, r_id, t_id, CAST(floor(s_amount * 1000000 + 0.5) AS BIGINT) AS amount_ppm, CAST(floor(s_date * 1000000 + 0.5) AS BIGINT) AS date_ppm,
    CAST(s_currency AS BIGINT) AS same_currency, CAST(s_payment AS BIGINT) AS same_payment, veto FROM scored""")
def score_signals(spark, sf_dir):
    """The signals of each candidate pair, in millionths."""
    ppm = lambda c: F.floor(F.col(c) * 1000000 + F.lit(0.5)).cast("long")
    return _scored(spark, sf_dir).select("org", "r_id", "t_id", ppm("s_amount").alias("amount_ppm"), ppm("s_date").alias("date_ppm"), F.col("s_currency").cast("long").alias("same_currency"), F.col("s_payment").cast("long").alias("same_payment"), "veto")


@query(SCORED + " SELECT org, r_id, t_id, tenths, classification FROM scored")
def score_classified(spark, sf_dir):
    """Score in tenths and class of each candidate pair."""
    return _scored(spark, sf_dir).select("org", "r_id", "t_id", _tenths(), "classification")


@query(SCORED + RANKED + " SELECT org, r_id, t_id, tenths, classification FROM ranked WHERE of_r = 1")
def best_candidate_per_receipt(spark, sf_dir):
    """The best bank line of each receipt that has one."""
    pairs = graded(score_run(receipts(spark, sf_dir), transactions(spark, sf_dir)))
    return best_of(pairs, "r_id").select("org", "r_id", "t_id", _tenths_of_score(), "classification")


@query(SCORED + RANKED + " SELECT org, r_id, t_id, tenths FROM ranked WHERE of_r = 1 AND of_t = 1")
def mutual_best_round1(spark, sf_dir):
    """Pairs that are best on both sides."""
    pairs = kept(score_run(receipts(spark, sf_dir), transactions(spark, sf_dir)))
    return mutual_best(pairs).select("org", "r_id", "t_id", _tenths_of_score())


@query(SCORED + TAKEN + " SELECT org, r_id, t_id, tenths, classification, t.r_id IS NOT NULL AS best FROM scored LEFT JOIN taken t USING (org, r_id, t_id) WHERE classification <> 'none'")
def greedy_one_to_one(spark, sf_dir):
    """Every kept pair, and whether the one-to-one assignment takes it."""
    pairs = kept(score_run(receipts(spark, sf_dir), transactions(spark, sf_dir)))
    return greedy_assignment(pairs, ready=True).select("org", "r_id", "t_id", _tenths_of_score(), "classification", "best")


@query(SCORED + TAKEN + " SELECT org, r_id, t_id, tenths, classification, t.r_id IS NOT NULL AS best FROM scored LEFT JOIN taken t USING (org, r_id, t_id) WHERE classification <> 'none'")
def incremental_assignment(spark, sf_dir):
    """A run over most receipts and bank lines, and then one over what has come since, on the pairs of the first: as one
    run over all would have it."""
    after = {"receipts": receipts(spark, sf_dir).drop("merchant_raw", "is_duplicate"), "transactions": transactions(spark, sf_dir).drop("description")}
    late = {"receipts": F.col("id") % 7 == 3, "transactions": F.col("id") % 11 == 5}
    before = {name: df.where(~late[name]) for name, df in after.items()}
    done = stored(greedy_assignment(kept(score_run(before["receipts"], before["transactions"])), ready=True))
    changed = [df.where(late[name]).select(F.lit(name[:-1]).alias("side"), "org", "id") for name, df in after.items()]
    found = incremental_run(before, after, changed[0].unionByName(changed[1]), done, _no_matches(spark))
    return found.select("org", "r_id", "t_id", _tenths_of_score(), "classification", "best")


@query(RUN + TAKEN + """ SELECT org, id, 'receipt' AS side FROM receipts r WHERE NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.org = r.org AND t.r_id = r.id)
    UNION ALL SELECT org, id, 'transaction' FROM transactions x WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.org = x.org AND t.t_id = x.id)""")
def unmatched_after_run(spark, sf_dir):
    """Receipts and transactions that a run leaves without partner."""
    done = propose(receipts(spark, sf_dir), transactions(spark, sf_dir)).where("status <> 'alternate'")
    r = unmatched(receipts(spark, sf_dir).where("not is_duplicate").select("org", "id"), done, "r_id", ("auto", "suggested")).withColumn("side", F.lit("receipt"))
    t = unmatched(transactions(spark, sf_dir).select("org", "id"), done, "t_id", ("auto", "suggested")).withColumn("side", F.lit("transaction"))
    return r.unionByName(t)


@query(RUN + TAKEN + """ SELECT org, CASE WHEN t.r_id IS NULL THEN 'alternate' WHEN classification = 'auto' THEN 'auto' ELSE 'suggested' END AS status, classification, count(*) AS pairs
    FROM scored LEFT JOIN taken t USING (org, r_id, t_id) WHERE classification <> 'none' GROUP BY ALL""")
def run_statistics(spark, sf_dir):
    """Kept pairs of a run by status and class."""
    return propose(receipts(spark, sf_dir), transactions(spark, sf_dir)).groupBy("org", "status", "classification").agg(F.count(F.lit(1)).alias("pairs"))


def _no_matches(spark):
    return spark.createDataFrame([], "org long, r_id long, t_id long, score double, status string")


ENDED = RUN + TAKEN + """, pairs_kept AS (SELECT s.*, t.r_id IS NOT NULL AS best FROM scored s LEFT JOIN taken t USING (org, r_id, t_id) WHERE classification <> 'none'),
    best AS (SELECT *, CASE WHEN classification = 'auto' THEN 'auto' ELSE 'suggested' END AS ended FROM pairs_kept WHERE best),
    states AS (SELECT r.org, r.id, CASE WHEN r.is_duplicate THEN r.status WHEN b.ended = 'auto' THEN 'completed' WHEN b.ended = 'suggested' THEN 'needs_review' ELSE 'unmatched' END AS status, r.is_duplicate FROM receipts r LEFT JOIN best b ON b.org = r.org AND b.r_id = r.id)"""


@query(ENDED + """ SELECT org, CAST(id AS VARCHAR) AS entity, status, NULL AS detail FROM states UNION ALL SELECT org, CAST(r_id AS VARCHAR), 'match.' || ended, regexp_replace(CAST(tenths / 10 AS VARCHAR), '\\.0$', '') || '% via deterministic' FROM best""")
def run_states_and_trail(spark, sf_dir):
    """Receipts' states after a run, and what the trail says of the best pairs."""
    out = matching_run(receipts(spark, sf_dir), transactions(spark, sf_dir), _no_matches(spark))
    r = out["receipts"].select("org", F.col("id").cast("string").alias("entity"), "status", F.lit(None).cast("string").alias("detail"))
    return r.unionByName(out["audit"].select("org", F.col("entity_id").alias("entity"), F.col("action").alias("status"), "detail"))


@query(ENDED + """, kept_pairs AS (SELECT org, count(*) AS pairs, count(*) FILTER (best AND classification = 'auto') AS auto, count(*) FILTER (best AND classification = 'review') AS review, count(*) FILTER (best AND classification = 'possible') AS possible FROM pairs_kept GROUP BY org),
    lines AS (SELECT org, count(*) AS transactions FROM transactions GROUP BY org), tried AS (SELECT org, count(*) AS scored FROM scored GROUP BY org)
    SELECT org, count(*) AS receipts, any_value(transactions) AS transactions, any_value(scored) AS scored, any_value(pairs) AS pairs, any_value(auto) AS auto, any_value(review) AS review, any_value(possible) AS possible,
    count(*) FILTER (status = 'unmatched') AS unmatched FROM states JOIN kept_pairs USING (org) JOIN lines USING (org) JOIN tried USING (org) WHERE NOT is_duplicate GROUP BY org""")
def run_outcome(spark, sf_dir):
    """What a run did in each organization."""
    return matching_run(receipts(spark, sf_dir), transactions(spark, sf_dir), _no_matches(spark))["stats"].drop("semantic")


@query(sql("receipts", "transactions", "matches") + """ SELECT org, r_id, t_id, status FROM matches WHERE status IN ('confirmed', 'auto') OR status = 'rejected'""")
def run_keeps_decisions(spark, sf_dir):
    """What users and earlier runs decided is still there after a run over all unlocked receipts."""
    out = matching_run(receipts(spark, sf_dir), transactions(spark, sf_dir), matches(spark, sf_dir))
    decided = matches(spark, sf_dir).where("status in ('confirmed', 'auto', 'rejected')").select("org", "r_id", "t_id")
    return out["matches"].join(decided, ["org", "r_id", "t_id"], "left_semi").select("org", "r_id", "t_id", "status")


#: Settings of four of five organizations, as stored, and in full; the fifth has none.
SETTINGS = {
    1: '{"date": {"maxDaysAfter": 1, "maxDaysBefore": 0}, "amount": {"maxRelativeDelta": 0.02}, "maxCandidatesPerReceipt": 3}',
    2: '{"weights": {"amount": 0.6, "date": 0.1, "currency": 0.1, "paymentMethod": 0.2}, "thresholds": {"auto": 85, "review": 60, "possible": 30}}',
    3: '{"date": {"maxDaysAfter": 9, "maxDaysBefore": 4, "exactToleranceDays": 1}, "amount": {"maxRelativeDelta": 0.01}, "maxCandidatesPerReceipt": 10, "else": 1}',
    4: '{"amount": {"exactToleranceAbs": 1.0}, "thresholds": {"possible": 55}, "weights": "none"}',
}
_CFG = """cfg AS (SELECT CAST(org AS BIGINT) AS org, * EXCLUDE (org) FROM (VALUES (0, 2, 5, 0, 0.05::DOUBLE, 1, 0.4::DOUBLE, 0.2::DOUBLE, 0.05::DOUBLE, 0.05::DOUBLE, 90.0::DOUBLE, 70.0::DOUBLE, 40.0::DOUBLE, 50),
      (1, 0, 1, 0, 0.02, 1, 0.4, 0.2, 0.05, 0.05, 90, 70, 40, 3), (2, 2, 5, 0, 0.05, 1, 0.6, 0.1, 0.1, 0.2, 85, 60, 30, 50), (3, 4, 9, 1, 0.01, 1, 0.4, 0.2, 0.05, 0.05, 90, 70, 40, 10), (4, 2, 5, 0, 0.05, 100, 0.4, 0.2, 0.05, 0.05, 90, 70, 55, 50))
      c(org, before, after, exact_days, rel, exact, w_amount, w_date, w_currency, w_payment, auto, review, possible, cap)), """
#: Where the plain SQL has a value that a configuration gives.
_PLACES = (
    ("WITH ", "WITH " + _CFG), ("BETWEEN -2 AND 5", "BETWEEN -c.before AND c.after"), ("CAST(0.05 AS DOUBLE) * greatest(cents, t_cents)", "c.rel * greatest(cents, t_cents)"), ("ceil(total * CAST(0.05 AS DOUBLE))", "ceil(total * c.rel)"),
    ("ON r.org = t.org", "ON r.org = t.org JOIN cfg c ON c.org = r.org"), ("cents, t_cents FROM money", "cents, t_cents, c.* EXCLUDE (org) FROM money"), ("FROM transactions) WHERE n <= 50", "FROM transactions) JOIN cfg USING (org) WHERE n <= cap"), ("WHERE position <= 50", "WHERE position <= cap"),
    ("abs(cents - t_cents) <= 1 THEN", "abs(cents - t_cents) <= exact THEN"), ("> 0.05::DOUBLE THEN", "> rel THEN"), ("/ 0.05::DOUBLE END", "/ rel END"), ("WHEN t_date = r_date THEN", "WHEN abs(t_date - r_date) <= exact_days THEN"), ("(t_date - r_date)::DOUBLE / 6", "(t_date - r_date)::DOUBLE / (after + 1)"), ("(r_date - t_date)::DOUBLE / 3", "(r_date - t_date)::DOUBLE / (before + 1)"),
    ("s_amount * 0.4::DOUBLE", "s_amount * w_amount"), ("s_date * 0.2::DOUBLE", "s_date * w_date"), ("s_currency * 0.05::DOUBLE", "s_currency * w_currency"), ("s_payment * 0.05::DOUBLE", "s_payment * w_payment"),
    ("ELSE 0.4::DOUBLE", "ELSE w_amount"), ("ELSE 0.2::DOUBLE", "ELSE w_date"), (" + 0.05::DOUBLE + ", " + w_currency + "), ("ELSE 0.05::DOUBLE", "ELSE w_payment"), ("89.0::DOUBLE", "auto - 1"), ("39.0::DOUBLE", "possible - 1"), ("raw >= 90", "raw >= auto"), ("raw >= 70", "raw >= review"), ("raw >= 40", "raw >= possible"),
)


def _by_organization(text: str) -> str:
    for plain, own in _PLACES:
        if plain not in text:
            raise ValueError(plain)
        text = text.replace(plain, own, 1) if plain == "WITH " else text.replace(plain, own)
    return text


OWN_SCORES = _by_organization(SCORED)


def _settings(spark, sf_dir):
    """Stored settings of the organizations that the customers belong to."""
    org = F.col("c_custkey") % 5
    stored = F.lit(None).cast("string")
    for number, text in SETTINGS.items():
        stored = F.when(org == number, text).otherwise(stored)
    return cut(table(spark, sf_dir, "customer").select(org.alias("org"), stored.alias("matching_config")).distinct().where("matching_config is not null"))


@query(OWN_SCORES + " SELECT org, r_id, t_id, CAST(position AS BIGINT) AS position, tenths, classification FROM scored")
def configured_scores(spark, sf_dir):
    """Candidates and scores where each organization has its own window, band, weights, thresholds and cap."""
    config = _settings(spark, sf_dir)
    pairs = capped_pairs(receipts(spark, sf_dir), transactions(spark, sf_dir), config)
    return score_pairs(pairs.withColumn("similarity", F.lit(None).cast("double")), config).select("org", "r_id", "t_id", F.col("position").cast("long"), _tenths(), "classification")


@query(OWN_SCORES + TAKEN + " SELECT org, r_id, t_id, tenths, classification, CASE WHEN t.r_id IS NULL THEN 'alternate' WHEN classification = 'auto' THEN 'auto' ELSE 'suggested' END AS status FROM scored LEFT JOIN taken t USING (org, r_id, t_id) WHERE classification <> 'none'")
def configured_run(spark, sf_dir):
    """A whole run with each organization's own configuration, in one plan."""
    found = propose(receipts(spark, sf_dir).drop("is_duplicate"), transactions(spark, sf_dir), config=_settings(spark, sf_dir))
    return found.select("org", "r_id", "t_id", _tenths_of_score(), "classification", "status")


#: The merchants' keys by their number, whole and, as every fourth bank line has them, without the first letter.
KEYS = (
    ("carrefour", "arrefour"), ("amazon marketplace", "mazon marketplace"), ("starbucks", "tarbucks"), ("blue bottle coffee", "lue bottle coffee"), ("monoprix", "onoprix"), ("spotify", "potify"), ("uber", "ber trip"),
    ("cafe flore", "afe flore"), ("air france", "ir france"), ("garden", "he garden"), ("netflix", "etflix"), ("ikea", "kea paris"),
)
_BY_NUMBER = ", ".join(f"({n}, '{whole}', '{cut_}')" for n, (whole, cut_) in enumerate(KEYS))
#: The scores with the merchant signal: its similarity between the key of the receipt and that of the bank line.
NAMED_SCORES = (
    CAPPED
    + f""", keys AS (SELECT * FROM (VALUES {_BY_NUMBER}) k(number, whole, part)),
    names AS (SELECT o_orderkey AS id, whole, CASE WHEN o_orderkey % 4 = 3 THEN part ELSE whole END AS banked FROM orders JOIN keys ON number = o_custkey % 12),
    labelled AS (SELECT c.*, r.whole AS a, t.banked AS b FROM capped c JOIN names r ON r.id = c.r_id JOIN names t ON t.id + 1000000000 = c.t_id),
    np AS (SELECT DISTINCT a, b FROM labelled), {SIMS}, alike AS (SELECT l.*, sim, CASE WHEN sim < 0.35::DOUBLE THEN 0 ELSE (sim - 0.35::DOUBLE) / (1 - 0.35::DOUBLE) END AS s_merchant FROM labelled l JOIN sims USING (a, b))"""
    + SCORED[len(CAPPED) :]
    .replace("FROM capped)", "FROM alike)")
    .replace("coalesce(s_date * 0.2::DOUBLE, 0) + s_currency", "coalesce(s_date * 0.2::DOUBLE, 0) + s_merchant * 0.3::DOUBLE + s_currency")
    .replace("ELSE 0.2::DOUBLE END) + 0.05::DOUBLE", "ELSE 0.2::DOUBLE END) + 0.3::DOUBLE + 0.05::DOUBLE")
)


@query(NAMED_SCORES + " SELECT org, r_id, t_id, CAST(floor(sim * 1000000 + 0.5) AS BIGINT) AS similarity, tenths, classification, veto FROM scored")
def score_with_merchants(spark, sf_dir):
    """Scores with all five signals, similarity computed once per distinct pair of names."""
    r, t = _named(spark, sf_dir)
    scored = score_pairs(with_similarity(stored(capped_pairs(r, t))))
    return scored.select("org", "r_id", "t_id", F.floor(F.col("similarity") * 1000000 + F.lit(0.5)).cast("long").alias("similarity"), _tenths(), "classification", "veto")


@query(NAMED_SCORES + """ SELECT org, r_id, t_id, sim >= 0.3::DOUBLE AND sim < 0.8::DOUBLE AND coalesce(s_amount > 0.9::DOUBLE, FALSE) AND veto IS NULL AS asked FROM scored""")
def escalation_gate(spark, sf_dir):
    """Which candidate pairs are worth a semantic comparison; a service that knows nothing changes no score."""
    r, t = _named(spark, sf_dir)
    # the pairs are stored, their scores are worked out again where they are read: these take twice the room
    scored = score_pairs(with_similarity(stored(capped_pairs(r, t)))).withColumn("was", F.col("score"))
    silent = lambda names: names.withColumn("semantic", F.lit(None).cast("double"))
    return escalate(scored, silent).select("org", "r_id", "t_id", (F.col("escalated") & (F.col("score") == F.col("was")) & (F.col("method") == "deterministic")).alias("asked"))


@query(NAMED_SCORES + """ SELECT org, r_id, t_id, CAST(floor(greatest(sim, CASE WHEN asked THEN 0.95::DOUBLE ELSE 0 END) * 1000000 + 0.5) AS BIGINT) AS similarity, CASE WHEN asked THEN 'semantic' ELSE 'deterministic' END AS method
    FROM (SELECT *, sim >= 0.3::DOUBLE AND sim < 0.8::DOUBLE AND coalesce(s_amount > 0.9::DOUBLE, FALSE) AND veto IS NULL AS asked FROM scored)""")
def escalated_scores(spark, sf_dir):
    """Candidate pairs after a service that finds all undecided names alike."""
    r, t = _named(spark, sf_dir)
    scored = score_pairs(with_similarity(stored(capped_pairs(r, t))))
    found = escalate(scored, lambda names: names.withColumn("semantic", F.lit(0.95)))
    return found.select("org", "r_id", "t_id", F.floor(F.col("similarity") * 1000000 + F.lit(0.5)).cast("long").alias("similarity"), "method")


@query("""WITH keyed AS (SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents)
    SELECT k.doc_id, m.original FROM keyed k JOIN (SELECT checksum, min(doc_id) AS original FROM keyed GROUP BY checksum) m USING (checksum) WHERE k.doc_id <> m.original""")
def dup_identical_file(spark, sf_dir):
    """Documents whose bytes equal an earlier one's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    first = docs.groupBy("checksum").agg(F.min("doc_id").alias("original"))
    return docs.join(first, "checksum").where("doc_id <> original").select("doc_id", "original")


def _repeated_receipts(spark, sf_dir):
    """Receipts and repeats of every tenth, a day on, under a higher id, with a cent more where the key is even."""
    k = F.col("id")
    base = receipts(spark, sf_dir).select("org", "id", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("merchant_raw")), 256).alias("checksum"), F.lower("merchant_raw").alias("merchant"), "date", "total", F.lit(None).cast("string").alias("invoice"), "created_at")
    again = base.where(k % 10 == 0).select("org", (k + 500000000).alias("id"), F.sha2(k.cast("string"), 256).alias("checksum"), "merchant", F.date_add("date", 1).alias("date"), F.when(k % 2 == 0, F.floor(F.col("total") * 100 + F.lit(1.5)) / 100).otherwise(F.col("total")).alias("total"), "invoice", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return base.unionByName(again)


REPEATED = sql("receipts") + """, base AS (SELECT org, id, CAST((id * 0) AS BIGINT) + org * 100000 AS z, total, date, created_at FROM receipts),
  custs AS (SELECT o_orderkey AS id, o_custkey % 12 AS name FROM orders),
  all_rows AS (SELECT b.org, b.id, name, total, date, created_at FROM base b JOIN custs USING (id)
    UNION ALL SELECT b.org, b.id + 500000000, name, CASE WHEN b.id % 2 = 0 THEN floor(total * 100 + 1.5) / 100 ELSE total END, date + 1, created_at + INTERVAL 1 DAY FROM base b JOIN custs USING (id) WHERE b.id % 10 = 0),
  money AS (SELECT *, CAST(floor(total * 100 + 0.5) AS BIGINT) AS cents FROM all_rows WHERE total IS NOT NULL)"""


@query(REPEATED + """ SELECT a.org, a.id, b.id AS original, CASE WHEN a.date IS NULL OR b.date IS NULL THEN 70 ELSE CAST(92 - 12 * abs(a.date - b.date) AS BIGINT) END AS confidence
    FROM money a JOIN money b ON a.org = b.org AND a.name = b.name AND abs(a.cents - b.cents) <= 1 AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id))
    WHERE a.date IS NULL OR b.date IS NULL OR abs(a.date - b.date) <= 3""")
def dup_same_amount_date(spark, sf_dir):
    """Earlier receipts of the same merchant and amount within three days, with the confidence in hundredths."""
    return duplicate_edges(_repeated_receipts(spark, sf_dir)).select("org", "id", "original", F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("long").alias("confidence"))


#: Receipts with files and invoice numbers that repeat, of one merchant each or none, and no total.
FILED = """WITH filed AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS org, o_orderkey AS id, 'f' || (o_orderkey * 7 % 400) AS checksum, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'shop ' || (o_orderkey % 3) END AS merchant,
    CASE WHEN o_orderkey % 2 = 0 THEN ' inv-' ELSE 'INV-' END || (o_orderkey % 300) AS invoice, o_orderdate AS created_at FROM orders WHERE o_orderkey < 1500),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, checksum, merchant, invoice ORDER BY created_at, id) AS n FROM filed) WHERE n = 1),
  pairs AS (SELECT a.org, a.id, b.id AS original, CASE WHEN a.checksum = b.checksum THEN 1 ELSE 2 END AS rule FROM filed a JOIN firsts b ON a.org = b.org AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id))
    AND (a.checksum = b.checksum OR (upper(trim(a.invoice)) = upper(trim(b.invoice)))))"""


@query(FILED + " SELECT org, id, original, CAST(rule AS INTEGER) AS rule, CASE rule WHEN 1 THEN 100 ELSE 97 END AS confidence FROM pairs")
def dup_file_and_invoice(spark, sf_dir):
    """Earlier receipts with the same file or invoice number."""
    k = F.col("o_orderkey")
    number = F.concat(F.when(k % 2 == 0, " inv-").otherwise("INV-"), (k % 300).cast("string"))
    rows = table(spark, sf_dir, "orders").where("o_orderkey < 1500").select(
        (F.col("o_custkey") % 5).alias("org"), k.alias("id"), F.concat(F.lit("f"), (k * 7 % 400).cast("string")).alias("checksum"), F.when(k % 5 != 0, F.concat(F.lit("shop "), (k % 3).cast("string"))).alias("merchant"),
        F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("total"), number.alias("invoice"), F.col("o_orderdate").alias("created_at"),
    )
    return duplicate_edges(rows).select("org", "id", "original", "rule", F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("int").alias("confidence"))


@query(REPEATED + """, edges AS (SELECT a.org, a.id, a.created_at, b.id AS original FROM money a JOIN money b ON a.org = b.org AND a.name = b.name AND abs(a.cents - b.cents) <= 1 AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id))
      WHERE a.date IS NULL OR b.date IS NULL OR abs(a.date - b.date) <= 3),
    sorted AS (SELECT org, list(struct_pack(id := [id], o := originals) ORDER BY created_at, id) AS l FROM (SELECT org, id, created_at, list(original) AS originals FROM edges GROUP BY ALL) GROUP BY org),
    folded AS (SELECT org, list_reduce(l, lambda s, x: CASE WHEN len(list_intersect(x.o, s.id)) < len(x.o) THEN struct_pack(id := list_append(s.id, x.id[1]), o := s.o) ELSE s END, struct_pack(id := []::BIGINT[], o := []::BIGINT[])) AS s FROM sorted),
    flagged AS (SELECT org, unnest(s.id) AS id FROM folded)
    SELECT e.org, e.id, min(e.original) AS original, CAST(3 AS INTEGER) AS rule FROM edges e JOIN flagged f USING (org, id) WHERE NOT EXISTS (SELECT 1 FROM flagged g WHERE g.org = e.org AND g.id = e.original) GROUP BY e.org, e.id""")
def duplicate_chain_flags(spark, sf_dir):
    """Receipts flagged as repeats of an earlier one that is none itself."""
    return flag_duplicates(_repeated_receipts(spark, sf_dir)).select("org", "id", "original", "rule")
