"""The assignment in blocks against the rule taken pair by pair, and how much it writes."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.operators import assign
from tallyspark.operators.assign import NEAR, best_of, greedy_assignment, mutual_best
from tallyspark.plans.catalog import QUERIES

PAIR = "org long, r_id long, t_id long, score double, escalated boolean, position int"


def drawn(seed, receipts=60):
    """Pairs of a few scores, so that ties are many; receipts and transactions that are equal make long chains."""
    rng, rows = random.Random(seed), []
    for org in range(2):
        for r in range(receipts):
            met = rng.sample(range(40), rng.randrange(1, 12)) if r % 2 else range(30)
            rows += [(org, r, 100 + t, 90.0 if r % 2 == 0 else float(rng.randrange(40, 44)), rng.random() < 0.3, i + 1) for i, t in enumerate(met)]
    return rows


def taken(rows):
    claimed, out = set(), set()
    for org, r, t, *_ in sorted(rows, key=lambda x: (-x[3], x[1], x[4], x[5], x[2])):
        if not {(org, "r", r), (org, "t", t)} & claimed:
            claimed |= {(org, "r", r), (org, "t", t)}
            out.add((org, r, t))
    return out


@pytest.mark.parametrize("most, placed", [(2000000, True), (40, True), (2000000, False)])
def test_blocks_take_what_the_rule_takes(spark, monkeypatch, most, placed):
    monkeypatch.setattr(assign, "BLOCK_PAIRS", most)
    rows = drawn(most + placed)
    frame = spark.createDataFrame(rows, PAIR).repartition(7)
    if placed:
        day = F.when(F.col("r_id") % 9 > 0, (F.col("r_id") * 5).cast("int"))
        frame = frame.withColumn(NEAR[0], day).withColumn(NEAR[1], F.lit(3.25).cast("float"))
    got = greedy_assignment(frame).collect()
    assert len(got) == len(rows)
    assert {(x.org, x.r_id, x.t_id) for x in got if x.best} == taken(rows)


def test_best_of_sides(spark):
    rows = drawn(3)
    frame = spark.createDataFrame(rows, PAIR)
    order = lambda x: (-x[3], x[1], x[4], x[5], x[2])
    best = lambda at: {min((y for y in rows if (y[0], y[at]) == key), key=order) for key in {(x[0], x[at]) for x in rows}}
    assert {tuple(x) for x in best_of(frame, "r_id").collect()} == best(1)
    assert {tuple(x) for x in best_of(frame, "t_id").collect()} == best(2)
    assert {tuple(x) for x in mutual_best(frame).collect()} == best(1) & best(2)


@pytest.mark.parametrize("name", ["greedy_one_to_one", "configured_run", "score_with_merchants", "escalation_gate", "escalated_scores"])
def test_pairs_are_never_checkpointed(spark, monkeypatch, name):
    """A checkpoint keeps rows as Java objects, ten times as large as a column file, and each round of the assignment had one."""
    written, plain = [], session.cut

    def counted(df):
        done = plain(df)
        written.append(done.count())
        return done

    for module in ("assign", "runs", "score"):
        monkeypatch.setattr(f"tallyspark.operators.{module}.cut", counted, raising=False)
    monkeypatch.setattr("tallyspark.plans.matching.cut", counted, raising=False)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 800
    assert max(written, default=0) < 400


def test_pairs_are_stored_and_their_scores_are_not(spark, monkeypatch):
    """Escalation stores both named sides and the capped pairs, once each; scores would take twice the pairs' room."""
    from tallyspark.plans import matching

    real, columns = matching.stored, []
    monkeypatch.setattr(matching, "stored", lambda df: columns.append(df.columns) or real(df))
    matching.escalated_scores(spark, "/root/testdata/sf0.001")
    assert len(columns) == 3 and "position" in columns[2] and not any({"score", "s_amount", "similarity"} & set(c) for c in columns)
