import hashlib
import random

from tallyspark.llm.suffix_dedup import SEGMENT, remove_repeats, suffix_dedup


def brute(docs, width):
    seen, out = {}, {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            else:
                seen[w] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdé "
    passages = ["".join(rng.choices(letters, k=rng.randint(60, 300))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(1, 250))) for _ in range(rng.randint(0, 5))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[3][1]) for i in range(20)]
    docs += [(300, None), (301, ""), (302, "a" * 1000), (303, "ab" * 400), (304, "x" * 99), (305, "x" * 100)]
    near = list(docs[5][1] + passages[0])
    near[10] = "Z"
    docs.append((306, "".join(near)))
    return docs


def check(spark, docs, width=100, **conf):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup(frame, width).collect()}
    assert got == brute(docs, width)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_many_buckets_split_one_token(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = corpus(2)
        check(spark, docs + [(1000 + i, docs[7][1] + str(i) + docs[8][1]) for i in range(60)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, token string")
    assert suffix_dedup(empty).collect() == []
    unnamed = spark.createDataFrame([(None, "q" * 150), (None, "q" * 150), (1, "q" * 150)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup(unnamed).collect()) == [0, 0, 149]
    docs = [(1, "q" * 150 + "tail", "a"), (2, "q" * 150, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, token string")
    # the windows at 1..50 of the run repeat the one at 0, so its bytes 1..149 go
    assert {r.doc_id: (r.text, r.token) for r in remove_repeats(frame).collect()} == {1: ("qtail", "a"), 2: ("", None)}


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(3)
    one, two, three = ("".join(rng.choices("abcdef", k=n)) for n in (250, 120, 180))
    rows = [(5, one, 1), (5, two, 2), (5, two, 2), (7, three + one[:150], 3), (None, one, 4), (None, None, 5), (8, None, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, cuts long")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(frame).collect()), key=repr)
    assert got == sorted([(5, 250, 0, 0), (5, 120, 0, 0), (5, 120, 0, 0), (7, 330, 150, 1), (None, 250, 0, 0), (None, 0, 0, 0), (8, 0, 0, 0)], key=repr)
    kept = sorted((tuple(r) for r in remove_repeats(frame).collect()), key=repr)
    assert kept == sorted([(5, one, 1), (5, two, 2), (5, two, 2), (7, three, 3), (None, one, 4), (None, None, 5), (8, None, 6)], key=repr)


def test_a_text_longer_than_a_segment(spark):
    """Windows at a segment's end are whole, and a passage repeats across segments."""
    rng = random.Random(8)
    part = "".join(rng.choices("abcdefgh", k=3000))
    docs = [(1, part + "".join(rng.choices("abcdefgh", k=SEGMENT - 1500)) + part + "".join(rng.choices("xyz", k=500))), (2, "q" + part[100:260])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (3000, 1), 2: (160, 1)}
