import random

from pyspark.sql import functions as F

from tallyspark.llm.toxicity import score_toxicity

BAD = ["idiot", "moron", "scum", "achlichpf", "achlichun"]


def corpus(seed, n=3000):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["you", "the"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = rng.choices(words, k=rng.randint(20, 200))
        if toxic:
            for _ in range(rng.randint(3, 6)):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    gold = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(d, gold)
    assert got.count() == len(docs)
    held = got.where("held_out").join(gold, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1 and 800 < right[3] < 1200


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 0), (None, "x", 1)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in score_toxicity(docs, none).collect()] == [(0.0, 0)] * 3
    assert score_toxicity(docs.limit(0), none).collect() == []
