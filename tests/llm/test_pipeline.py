import re

import corpus_pipeline
from tests.llm.test_decontamination import brute as decontaminated
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_quality_rules import brute as quality
from tests.llm.test_secrets import brute as secret_spans


def fixture():
    prose = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    item = " ".join(f"bench{j}" for j in range(20))
    docs = [(i, t) for i, t in enumerate(prose)]
    docs += [(100, prose[3]), (101, prose[4] + " tail"), (102, "short text"), (103, None), (104, " ".join(["again and again and again"] * 20))]
    docs += [(105, prose[5].replace("x", "y") + " " + item), (106, prose[6].replace("x", "z") + " token = 'abcdef0123456789abcdef' end"), (107, " ".join(f"q{i}###" for i in range(40)))]
    return docs, [(1, item), (2, "")]


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, want = frame, dict(docs)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / str(number)))
        now = spark.read.parquet(str(tmp_path / str(number)))
        if name == "quality_rules":
            want = {d: t for d, t in want.items() if not quality(t)[5] and "###" not in t}
        elif name == "ngram_jaccard_join":
            keep = components(sorted(want.items()), 5, 80, 100)
            want = {d: t for d, t in want.items() if keep[d][1] == d}
        elif name == "benchmark_decontamination":
            hit = decontaminated(sorted(want.items()), items, 10)
            want = {d: t for d, t in want.items() if not hit[d][4]}
        elif name == "secret_scans":
            assert secret_spans(want[106]) != "" and sum(secret_spans(t) != "" for t in want.values()) == 1
            want[106] = re.sub("token = 'abcdef0123456789abcdef", "[assign]", want[106])
            assert {r.doc_id: r.n_chars for r in now.collect()} == {d: len(t) for d, t in want.items()}
        if name != "best_fit_packing":
            assert {r.doc_id: r.text for r in now.collect()} == want
        else:
            assert {r.doc_id: r.length for r in now.collect()} == {d: len(t.encode()) + 1 for d, t in want.items()}
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.capacity) for r in rows)
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(now.collect())


def test_nulls_repeats_clashes_and_empty_tables(spark, tmp_path):
    docs, items = fixture()
    prose = [t for _, t in docs[:30]]
    secret, copied = prose[7].replace("w", "s") + " token = 'abcdef0123456789abcdef'", prose[8].replace("w", "c") + " " + items[0][1]
    rows = [(1, prose[0], "a", 1), (None, prose[1], "b", 2), (None, secret, "c", 3), (None, copied, "d", 4), (None, None, "e", 5), (2, prose[2], "f", 6), (2, prose[3], "g", 7), (2, prose[3], "g", 7), (3, prose[0], "h", 8), (4, "", "i", 9)]
    schema = "doc_id long, text string, row string, may long"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.createDataFrame(rows, schema)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{number}"))
        now = spark.read.parquet(str(tmp_path / f"s{number}"))
        assert now.columns == ["doc_id", "text", "row", "may"]
    left = sorted((tuple(r) for r in now.collect()), key=repr)
    clean = re.sub("token = 'abcdef0123456789abcdef", "[assign]", secret)
    assert left == sorted([(1, prose[0], "a", 1), (None, prose[1], "b", 2), (None, clean, "c", 3), (2, prose[2], "f", 6), (2, prose[3], "g", 7), (2, prose[3], "g", 7)], key=repr)
    packed = corpus_pipeline.packing(spark, now, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.length) for r in packed), key=repr) == sorted(((d, len(t.encode()) + 1) for d, t, *_ in left), key=repr)

    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
