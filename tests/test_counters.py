import random

import pytest

from tallyspark.operators.counters import fixed_windows, lockouts

SECOND = 1_000_000


def windows(hits, seconds):
    out = []
    for key in {k for k, _ in hits}:
        opened, n = None, 0
        for at in sorted(a for k, a in hits if k == key):
            if opened is None or at >= opened + seconds * SECOND:
                if opened is not None:
                    out.append((key, opened, n))
                opened, n = at, 0
            n += 1
        out.append((key, opened, n))
    return sorted(out)


def locks(attempts, most, seconds):
    out = []
    for key in {a[0] for a in attempts}:
        count, until = 0, 0
        for _, at, _, failed in sorted(a for a in attempts if a[0] == key):
            if at < until:
                continue
            count = count + 1 if failed else 0
            if count >= most:
                out.append((key, at))
                count, until = 0, at + seconds * SECOND
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_against_folds(spark, hot):
    rng = random.Random(8 + hot)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for span, seconds in ((200, 5), (3000, 30)):
            key = lambda: "hot" if hot and rng.random() < 0.9 else rng.choice("abcdefghijk")
            hits = [(key(), rng.randrange(1, span) * SECOND) for _ in range(900)]
            got = fixed_windows(spark.createDataFrame(hits, "key string, at long"), seconds)
            assert sorted(map(tuple, got.collect())) == windows(hits, seconds)
            for most, failing in ((3, 0.7), (8, 0.93)):
                tries = [(key(), rng.randrange(1, span) * SECOND, i, rng.random() < failing) for i in range(900)]
                got = lockouts(spark.createDataFrame(tries, "key string, at long, seq long, failed boolean"), most, seconds)
                assert sorted(map(tuple, got.collect())) == locks(tries, most, seconds)
        assert fixed_windows(spark.createDataFrame([], "key string, at long"), 5).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_key_is_worked_on_by_all_tasks(spark):
    hits = spark.range(20_000).selectExpr("'k' AS key", "id * 1000000 AS at", "id AS seq", "true AS failed")
    out = lockouts(hits, 8, 900)
    assert out.rdd.glom().map(len).filter(lambda n: n > 0).count() == 4
    # eight failures a second apart lock for 900 seconds
    assert sorted(r.locked_at // SECOND for r in out.collect()) == [7 + 907 * i for i in range(-(-(20_000 - 7) // 907))]
