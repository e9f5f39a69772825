import random
import re
from collections import Counter

from tallyspark.llm.quality_rules import drop_rejected, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(5)}
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return (*base, len(w) < 10 or 100 * len(hit) > 20 * len(w))


def corpus():
    rng = random.Random(3)
    pieces = ["the", "Été", "x", "#", "a|b", "\n", "\r\n", " ", "\x0b", "same line here\n", "one two three four five six", "  ", "😀", "<b>"]
    docs = [" ".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(300)]
    docs += ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(200)]
    return [(i, t) for i, t in enumerate([*docs, None, "", "\n\n", "w " * 3000])]


def test_base_counts_against_brute_force(spark):
    docs = corpus()
    got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:7] for r in got} == {d: brute(t) for d, t in docs}
    assert not [r for r in got if r.base_failed and r.kept]


def test_verdict_and_pipeline_form(spark):
    prose = " ".join(f"word{i % 97} other{i}" for i in range(100))
    docs = [(1, prose, "k"), (2, " ".join(f"w{i}###" for i in range(50)), "s"), (3, " ".join(f"WORD{i}!!" for i in range(50)), "c"), (4, None, "n"), (5, prose, None), (None, prose, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    assert {r.doc_id: r.kept for r in quality_rules(frame).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}
    assert sorted(str(r.doc_id) for r in drop_rejected(frame).collect()) == ["1", "5", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules(empty).collect() == [] and drop_rejected(empty).collect() == []


def test_order_does_not_change_the_verdict(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    one = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert one == {r.doc_id: r.kept for r in quality_rules(docs, sample=0).collect()}


def rejected(text):
    """The further rules, written out on words and characters."""
    w = WORD.findall(text)
    chars, n = sum(map(len, w)), len(w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ascii_letters = [c for c in text if c.isascii() and c.isalpha()]
    return (
        sum(c in "#*$%&|<>" for c in text) > 0.08 * chars
        or 10 * (len(lines) - len(set(lines))) > 4 * len(lines)
        or not 2 * n <= chars <= 15 * n
        or 2 * text.count("!") > n
        or 10 * sum(c.isupper() for c in ascii_letters) > 7 * max(len(ascii_letters), 1)
        or (n >= 20 and max(Counter(w).values()) > 0.4 * n)
    )


def test_kept_against_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "be", "gamma", "DELTA", "é", "x!", "#", "supercalifragilistic", "I", "a"]
    docs = [" ".join(f"{w}{rng.randint(0, 9 ** rng.randint(0, 3))}" if rng.random() < 0.8 else w for w in rng.choices(words[: rng.randint(1, 10)], k=rng.randint(5, 80))) for _ in range(600)]
    docs += [d.replace(" ", "\n", 6) for d in docs[:200]] + [d.upper() for d in docs[:100]] + [None, "", "long " * 100_000, "w " + "y" * 2_000_000]
    rows = list(enumerate(docs))
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: not brute(t)[5] and not rejected(t or "") for i, t in rows}
    assert 100 < sum(got.values()) < 800
