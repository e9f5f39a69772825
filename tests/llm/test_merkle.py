import zlib
from collections import defaultdict
from hashlib import sha256

import pyspark.sql.functions as F
import pytest

from tallyspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def encode(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    return H(*map(encode, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i & 1, level[i ^ 1]) if (i ^ 1) < len(level) else None)
        i >>= 1
    return out


def fold(node, steps):
    for step in steps:
        node = H(node) if step is None else H(step[1], node) if step[0] else H(node, step[1])
    return node


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in langs[lang]])
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, row in enumerate(langs[lang]):
            steps = path(trees[lang], i) + path(top, k)
            tamper = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = fold(leaf(row, int(tamper)), steps)
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], H(*(s[1] for s in steps if s)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def digests(frame, bits):
    proved = merkle.manifest(frame, bits)
    folded = proved.withColumn("folded_root", merkle.climbed(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    out = folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(n, langs):
    return [(i, f"text {i} é", langs[i % len(langs)], f"s{i % 3}", 7 * i) for i in range(n)]


@pytest.mark.parametrize("bits", [2, 12])
def test_against_brute_force(spark, bits):
    odd = [(None, None, None, None, None), (None, "no id", "en", "", 3), (-5, "", "", "s", 0), (10**15, "long " * 20_000, "zz", None, None), (7, "same id", "en", "s", 1), (7, "same id", "en", "s", 1), (7, "other text", "en", "s", 1)]
    rows = made(101, ["en", "en", "en", "de"]) + odd + [(200, "max", "en", "s", 2**63 - 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("level", F.lit("x"))
    assert digests(frame.repartition(5), bits) == brute(rows)


@pytest.mark.parametrize("n", [1, 4, 17])
def test_heights_at_the_edge_of_a_pass(spark, n):
    rows = made(n, ["en"])
    assert digests(spark.createDataFrame(rows, SCHEMA), 2) == brute(rows)


def test_many_trees_and_repeated_rows(spark):
    rows = made(40, [f"l{i}" for i in range(23)]) + [(1, "same", "en", "s", 4)] * 300
    assert digests(spark.createDataFrame(rows, SCHEMA), 3) == brute(rows)


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], SCHEMA), 12) == []


def test_query_on_the_given_documents(spark):
    from tallyspark.llm.queries import QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
