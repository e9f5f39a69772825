import hashlib
import random
import re

from tallyspark.llm import decontamination
from tallyspark.llm.decontamination import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= owners
        names = sorted(map(str, found))
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items, size=10):
    d = spark.createDataFrame(docs, "doc_id long, text string, key string" if len(docs[0]) > 2 else "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, size)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "ÉTÉ", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 10, 11, 25, 40])))) for i in range(30)]
    items += [(100, ""), (101, None), (102, "..."), (103, "solo"), (104, items[4][1])]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                w = rng.choice(items)[1] or ""
                w = w.split(" ")
                a = rng.randrange(len(w))
                parts.append(rng.choice([" ", "-", ". "]).join(w[a : a + rng.randint(5, 30)]).replace("w", rng.choice("wW")))
            else:
                parts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 20))))
        docs.append((i, rng.choice(["", "  "]) + "\n".join(parts) + rng.choice(["", "!"])))
    docs += [(500, None), (501, ""), (502, "Solo"), (503, "w1 " * 50)]
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        assert run(spark, docs, items) == brute(docs, items, 10)


def test_repeats_and_short_windows(spark):
    docs = [(1, "a a a a a a b"), (2, "b a"), (3, "A b a")]
    items = [(1, "a a"), (2, "a a a a a"), (3, "b a")]
    for size in (1, 2, 3):
        assert run(spark, docs, items, size) == brute(docs, items, size)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "two one x three four"), (3, "four none")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    assert {r.doc_id: (r.n_items, r.n_near_items) for r in decontaminate(d, b, 4, slop=2).collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b", "k"), (2, "c", None)], "doc_id long, text string, key string")
    assert [(r.doc_id, r.key) for r in drop_contaminated(docs, items).collect()] == [(2, None)]
    assert drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 2


def test_proximity_against_brute_force(spark):
    rng = random.Random(11)
    items = [(1, "a b c d")] + [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 4, 6])))) for i in range(2, 12)]
    texts = [(0, "x x x x a x b x c d"), (1, ""), (2, "d c b a")] + [(i, " ".join(rng.choices("abcdefghxy", k=rng.choice([3, 8, 15])))) for i in range(3, 60)]

    def near(text, item, slop):
        t, w = text.split(), item.split()
        width = min(4, len(w))
        spots = lambda i, shift: t[max(0, i + shift - slop) : max(0, i + shift + slop + 1)]
        return any(all(w[i] in spots(i, shift) for i in range(s, s + width)) for s in range(len(w) - width + 1) for shift in range(-len(w) - slop, len(t) + slop))

    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 2):
        expected = {i: sum(near(t, w, slop) for _, w in items) for i, t in texts}
        assert expected[0]
        assert {r.doc_id: r.n_near_items for r in decontaminate(d, b, 4, slop=slop).collect()} == expected


def test_letters_beyond_a_to_z_are_not_folded(spark):
    """A capital sigma's lower case depends on its neighbours across a full stop."""
    text = "Ε.Σ. one two three"
    d = spark.createDataFrame([(1, "before " + text), (2, "before " + text.lower())], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(d, b, 4).collect()} == {1: 5, 2: 0}


def test_null_and_repeated_ids_and_clashing_columns(spark):
    docs = [(None, "a b c", 1, "x"), (None, "c d", 2, "y"), (5, "a b", 3, "z"), (5, "q r", 4, None), (5, "q r", 4, None), (6, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, key long, row string")
    b = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "q r")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate(d, b).collect()), key=repr)
    assert got == sorted([(None, 3, 2, 1), (None, 2, 0, 0), (5, 2, 2, 1), (5, 2, 0, 0), (5, 2, 0, 0), (6, 0, 0, 0)], key=repr)
    assert sorted((tuple(r) for r in drop_contaminated(d, b).collect()), key=repr) == sorted([docs[1], docs[3], docs[4], docs[5]], key=repr)


def test_periodic_and_long_texts(spark):
    """A text and an item of one period meet at very many shifts."""
    docs = [(1, "a b " * 3000), (2, "x " * 40_000 + "p q r s"), (3, "a a a")]
    items = [(1, "a b " * 200), (2, "p q r s"), (3, "b b")]
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert run(spark, docs, items) == brute(docs, items, 10)
