import datetime
import json
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.operators import candidates
from tallyspark.operators.candidates import candidate_pairs, cap_candidates, capped_pairs
from tallyspark.plans.catalog import QUERIES

RECEIPTS = "org long, id long, date date, total double, currency string, payment string"
LINES = "org long, id long, date date, amount double, currency string, payment string"


def day(n):
    return None if n is None else datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_no_side_goes_whole_through_the_driver(spark):
    """Small files may hold many rows; what is sent whole is bounded."""
    for name in ("candidate_pairs_band_join", "candidate_cap_topk"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= (4 if name == "candidate_cap_topk" else 0)


def tables(spark, odd):
    rng = random.Random(5)
    amount = lambda: rng.choice([0.0, 0.01, 0.5, 1.0, 10.0, 100.0, 104.99, 105.0, round(rng.uniform(90, 112), 2), round(rng.uniform(1, 9e5), 2)])
    maybe = lambda x, share: None if rng.random() < share else x
    r = [(i % 3, i, day(maybe(rng.randrange(20), 0.15)), maybe(amount(), 0.15), "EUR", None) for i in range(300)]
    t = [(i % 3, 1000 + i, day(maybe(rng.randrange(-4, 25), odd)), maybe(-amount(), odd), maybe("EUR", 0.1), "card") for i in range(900)]
    return spark.createDataFrame(r, RECEIPTS), spark.createDataFrame(t, LINES)


def test_walk_leaves_what_the_cap_leaves(spark, monkeypatch):
    """Also where lines lack date or amount, organizations have their own rules, and a crowded cell is dealt out."""
    config = spark.createDataFrame([(1, json.dumps({"maxCandidatesPerReceipt": 4, "amount": {"maxRelativeDelta": 1.5}, "date": {"maxDaysAfter": 0}})), (2, json.dumps({"amount": {"maxRelativeDelta": 0}}))], "org long, matching_config string")
    monkeypatch.setattr(candidates, "CELL_RECEIPTS", 7)
    for odd, rules in ((0, ()), (0.1, ()), (0.1, (config,)), (0, (config,))):
        r, t = tables(spark, odd)
        want = cap_candidates(candidate_pairs(r, t, *rules), *rules)
        got = capped_pairs(r, t, *rules)
        key = lambda df: sorted(df.collect(), key=lambda x: (x.org, x.r_id, x.position))
        assert (rows := key(got.select(want.columns))) == key(want) and len(rows) > 2000
        one = capped_pairs(r, t, *rules, most=1) if rules else capped_pairs(r, t, most=1)
        assert sorted(x.r_id for x in one.collect()) == sorted(x.r_id for x in want.where(F.col("position") == 1).collect())


def test_pairs_before_the_cap_are_all_pairs(spark):
    """Also of receipts without total or date, which meet more lines than a cap lets through."""
    r, t = tables(spark, 0.1)
    cents = lambda x: math.floor(abs(x) * 100 + 0.5)

    def fits(a, b):
        if a.org != b.org or (a.date and b.date and not -2 <= (b.date - a.date).days <= 5):
            return False
        if a.total is None or b.amount is None:
            return True
        gap, units = abs(cents(a.total) - cents(b.amount)), abs(math.floor(abs(b.amount) + 0.5) - math.floor(a.total + 0.5))
        return (gap <= 1 or gap <= 0.05 * max(cents(a.total), cents(b.amount))) and units <= max(1, math.ceil(a.total * 0.05) + 1)

    lines = t.collect()
    want = sorted((a.org, a.id, b.id) for a in r.collect() for b in lines if fits(a, b))
    got = sorted(tuple(x) for x in candidate_pairs(r, t).select("org", "r_id", "t_id").collect())
    assert got == want
    nothing = {x.id for x in r.where("date is null and total is null").collect()}
    assert nothing and all(n == 300 for n in Counter(x[1] for x in got if x[1] in nothing).values())


def test_few_settings_do_not_deal_the_pairs_by_organization(spark, monkeypatch):
    """Rows stay where they are while their organizations' settings are few; organizations without any have the defaults."""
    settings = spark.createDataFrame([(1, json.dumps({"maxCandidatesPerReceipt": 4})), (2, "no settings")], "org long, matching_config string")
    rows = spark.createDataFrame([(0,), (1,), (2,), (None,)], "org long")
    plans = []
    for few in (config.FEW_SETTINGS, 1):
        monkeypatch.setattr(config, "FEW_SETTINGS", few)
        ruled, rules = config.with_rules(rows, settings)
        plans.append(ruled._jdf.queryExecution().sparkPlan().toString())
        found = {r.org: (r.most, r.auto) for r in ruled.select("org", rules.max_candidates.alias("most"), rules.thresholds.auto.alias("auto")).collect()}
        assert found == {0: (50, 90.0), 1: (4, 90.0), 2: (50, 90.0), None: (50, 90.0)}
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
