import random

from pyspark.sql import functions as F

from tallyspark.llm.common import join_uneven, numbered, repeated_ids


def test_uneven_join_equals_the_plain_one(spark):
    """A key with a third of the rows, null keys, keys without partner; with and without a bound on what is broadcast."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", None, f"k{rng.randrange(500)}"])) for i in range(3000)]
    left = spark.createDataFrame(rows, "i long, k string")
    right = left.where("k is not null and k < 'k4'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    want = sorted((tuple(r) for r in left.join(right, "k", "left").select("i", "k", "n", "first").collect()), key=repr)
    for bound in (None, F.length("k") > 10):
        got = join_uneven(left, right, ["k"], "n", F.col("i"), bound)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    salted = [line for line in join_uneven(left, right, ["k"], "n", F.col("i"))._jdf.queryExecution().toString().splitlines() if "Join LeftOuter" in line]
    assert any("_salt" in line for line in salted)


def test_numbers_rise_with_the_ids(spark):
    rows = [(5, "b"), (5, "a"), (5, "a"), (2, None), (9, ""), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_ids(frame) and not repeated_ids(frame.where("doc_id <> 5"))
    each, names = numbered(frame)
    got = sorted((r.row, r.doc_id, r.text) for r in each.collect())
    assert [d for _, d, _ in got] == [2, 5, 5, 5, 9] and len({r for r, _, _ in got}) == 4
    assert {r.row for r in names.collect()} == {r for r, _, _ in got}
