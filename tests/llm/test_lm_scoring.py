import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from tallyspark.llm.lm_scoring import AdaptivePpm, LowOrders, code_table, gram_probabilities, score_adaptive, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(docs, order=4):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    counts, model = Counter(), AdaptivePpm(order)
    for d, t in docs:
        if not held[d]:
            counts.update(tokens(t))
            raw = bytes([0xFE] * order) + (t or "").encode() + b"\xff"
            for i in range(order, len(raw)):
                model.learn(raw[i - order : i], raw[i])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        out[d] = (held[d], len(w), sum(counts[x] > 0 for x in w), total, base, model.score((t or "").encode(), learn=False))
    return out


def corpus():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["The", "the", "été", "a", "zzz\n", "😀", f"n{i % 7}"], k=rng.randint(0, 40)))) for i in range(200)]
    return [*docs, (1000, None), (1001, ""), (1002, "unseen éàü words Q"), (10, "ß")][:-1] + [(2010, "never-seen-ÿ")]


@pytest.mark.parametrize("order", [3, 4, 6])
def test_against_direct_model(spark, order):
    docs = corpus()
    got = {r[0]: tuple(r)[1:] for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string"), order=order).collect()}
    want = brute(docs, order)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4] == pytest.approx(want[d][4], abs=1e-6)
        assert got[d][5] == pytest.approx(want[d][5], rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 200, (3000, 3)) @ [1 << 16, 1 << 8, 1])  # UTF-8 never uses all bytes
    index, table = code_table(codes, rng.integers(1, 9, len(codes)).astype(float))
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)


def test_adaptive_and_edges(spark):
    frame = spark.createDataFrame([(1, "abababababab" * 5), (2, "q8#zk!x0vw@pL" * 1), (3, None)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_adaptive(frame).collect()}
    assert scores[1] > 60 * -math.log10(256) / 2 and scores[3] == pytest.approx(-math.log10(256))
    assert score_documents(spark.createDataFrame([], "doc_id long, text string, word string")).collect() == []
    one = score_documents(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()
    assert one[0].held_out and one[0].train_tokens == 0 and one[0].base_score == 0


def test_gram_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    seen = np.unique(rng.integers(0, 4, (400, 5)) @ [1 << 32, 1 << 24, 1 << 16, 1 << 8, 1])
    codes = np.unique(((seen >> 8)[:, None] << 8 | np.arange(256)).ravel())  # every symbol after every context
    n = np.where(np.isin(codes, seen), rng.integers(1, 9, len(codes)), 0)
    trigram = (codes >> 24 << 8) | (codes & 0xFF)
    kinds, where = np.unique(trigram, return_inverse=True)
    count = np.bincount(where, n)
    log = gram_probabilities(codes, n, 4, LowOrders(kinds[count > 0], count[count > 0]))
    assert np.allclose((10.0**log).reshape(-1, 256).sum(1), 1, atol=1e-4)


def test_null_and_repeated_ids_fill_no_batch_of_their_own(spark, monkeypatch):
    monkeypatch.setattr("tallyspark.llm.lm_scoring.BATCH_DOCS", 20)
    docs = [(None, f"text {i}") for i in range(60)] + [(7, "same text again")] * 60 + [(7, "another " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("batch"), F.lit("k").alias("key"), F.lit(0.5).alias("value"))
    scored = score_documents(frame)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan
    got = sorted((r.doc_id is None, r.n_tokens, round(r.score, 3)) for r in scored.collect())
    want = brute(docs)
    assert len(got) == 121 and sum(null for null, _, _ in got) == 60
    assert {n for null, n, _ in got if not null} == {4, 3001} and want[7][1] == 3001
