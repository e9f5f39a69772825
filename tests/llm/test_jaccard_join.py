import random
import re

from tallyspark.llm import jaccard_join
from tallyspark.llm.jaccard_join import drop_near_duplicates, jaccard_components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(docs, size, num, den):
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(300)]
    docs = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 9, 10, 12, 20, 30, 60, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            docs.append(" ".join(words))
    docs += ["", None, "   ", "Hello there", "hello THERE", "x", "x"]
    return list(enumerate(docs))


def run(spark, docs, size, num, den):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, size, num, den).collect()}


def test_against_brute_force(spark):
    for seed, size, num in ((1, 3, 90), (2, 5, 80), (3, 3, 60)):
        docs = corpus(seed)
        assert run(spark, docs, size, num, 100) == brute(docs, size, num, 100)


def test_large_group_meets_in_blocks(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(130)]
    docs = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(130)] = f"n{rng.randrange(1000)}"
        docs.append((i, " ".join(words)))
    assert run(spark, docs, 3, 90, 100) == brute(docs, 3, 90, 100)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rep string")
    assert jaccard_components(empty).collect() == []
    assert drop_near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", "r"), (1, "a b c d e f", None), (None, "a b c d e f", "n")], "doc_id long, text string, rep string")
    assert sorted((str(r.doc_id), r.rep) for r in drop_near_duplicates(docs).collect()) == [("1", None), ("None", "n")]


def test_every_link_is_counted_once(spark):
    """Equal sets, groups of differing near copies, several blocks, and documents that meet in several routes."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(130)]
    group = []
    for _ in range(1100):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(130)] = f"n{rng.randrange(40)}"
        group.append(" ".join(words))
    texts = [t for _, t in corpus(4)] + group + group[:30]
    for size, num in ((3, 90), (5, 80)):
        sets = [shingles(t, size) for t in texts]
        expected = dict.fromkeys(range(len(texts)), 0)
        for i, a in enumerate(sets):
            for j in range(i):
                inter = len(a & sets[j])
                if inter and 100 * inter >= num * (len(a) + len(sets[j]) - inter):
                    expected[i] += 1
                    expected[j] += 1
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.n_links for r in jaccard_components(frame, size, num, 100).collect()} == expected


def test_components_alone_of_long_groups(spark, monkeypatch):
    """Groups longer than a block are settled through few documents; a chain's ends are not linked with each other."""
    rng = random.Random(13)
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    monkeypatch.setattr(jaccard_join, "LONG_BLOCKS", 2)
    docs = []
    for g in range(3):
        base = [f"g{g}b{i}" for i in range(130)]
        for _ in range(150):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(130)] = f"n{rng.randrange(1000)}"
            docs.append(" ".join(words))
    chain = [f"c{i}" for i in range(220)]
    docs += [" ".join(chain[4 * i : 4 * i + 120]) for i in range(25)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    for rounds in (1, 4):
        monkeypatch.setattr(jaccard_join, "SETTLE_ROUNDS", rounds)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, 3, 90, 100, count_links=False).collect()}
        assert got == brute(docs, 3, 90, 100)


def test_chains_between_settled_documents(spark, monkeypatch):
    """Documents that different first ones settle may be linked with each other: no chain falls apart."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 1)
    monkeypatch.setattr(jaccard_join, "LONG_BLOCKS", 1)
    rng = random.Random(21)
    docs = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(130)]
        docs += [" ".join(words[10 * i : 10 * i + 100]) for i in range(4)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 3, 80, 100)
    assert len({c for _, c in want.values()}) == 6
    for rounds in (2, 4):
        monkeypatch.setattr(jaccard_join, "SETTLE_ROUNDS", rounds)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, 3, 80, 100, count_links=False).collect()}
        assert got == want


def test_another_text_under_the_id_of_a_copy_stays(spark):
    one, two, three = ("a b c d e f g h i j k l", "p q r s t u v w x y z", "one two three four five six seven")
    rows = [(1, one), (9, one), (9, two), (4, two + " "), (9, three), (9, three)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, drop_near_duplicates(frame).collect())) == sorted([(1, one), (4, two + " "), (9, three), (9, three)])


def test_null_and_repeated_ids_and_clashing_columns(spark):
    one, two = "a b c d e f g h i j k l", "p q r s t u v w x y z"
    rows = [(5, one, 1), (5, two, 2), (5, two, 2), (9, one, 3), (None, one, 4), (None, None, 5), (7, two + " ", 6), (8, None, 7), (3, "other text here", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, copies long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(frame).collect()), key=repr)
    assert got == sorted([(5, 10, 5, 1), (5, 9, 5, 1), (5, 9, 5, 1), (9, 10, 5, 1), (None, 10, None, 0), (None, 0, None, 0), (7, 9, 5, 1), (8, 0, 8, 0), (3, 1, 3, 0)], key=repr)
    kept = sorted(r.copies for r in drop_near_duplicates(frame).collect())
    assert kept == [1, 2, 2, 4, 5, 7, 8]


def test_a_long_text(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(["x", *words[:-1]])), (3, " ".join(words[::-1]))]
    assert run(spark, docs, 3, 90, 100) == {1: (59_998, 1), 2: (59_998, 1), 3: (59_998, 3)}
