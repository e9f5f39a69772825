import random

import public_tokenizers
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm.token_counts import _START, VOCABULARY, Machine, count_tokens, machine

PARTS = [*"ab'!?1½ \n-", "th", "ing", "tion", "'s", "'r", "'re", "ll", "é", "é", "ͅ", "İ", "日", "ß", "ſ", "Å", "😂", "\x00", "\x1c", "\x85", "　", "<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>", "̸", "aaaa", "----", "lets", "the "]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def counted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=800, deadline=None)
@given(texts)
def test_machine_counts_as_the_library(text):
    assert machine(VOCABULARY).count(text) == counted(test_machine_counts_as_the_library.library, text)


test_machine_counts_as_the_library.library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 9), st.randoms(use_true_random=False))
def test_maps_of_pieces_compose_in_any_order(text, size, rng):
    made = machine(VOCABULARY)
    for segment in made.segments(text):
        maps = [made.piece_map(segment[i : i + size]) for i in range(0, len(segment), size)] or [("", 0, None)]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [made.compose(*maps[i : i + 2])]
        _, n, end = made.compose(("", 0, _START), maps[0])
        assert n + made.close(end) == counted(test_machine_counts_as_the_library.library, segment)


def test_periodic_words_and_random_letters(library):
    made, rng = machine(VOCABULARY), random.Random(5)
    words = [c * n for c in "abe!-=" for n in (1, 2, 3, 5, 17, 100, 1000, 4097)]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 300))) for _ in range(500)]
    assert [made.count(w) for w in words] == [counted(library, w) for w in words]


def test_transitions_are_made_again_after_the_bound(library, monkeypatch):
    monkeypatch.setattr("tallyspark.llm.token_counts.KEPT", 50)
    made = Machine(public_tokenizers.path(VOCABULARY))
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(30))
        assert made.count(text) == counted(library, text)
    assert made.kept <= 50 and len(made.stretches) <= 50


@pytest.mark.parametrize("piece", [7, 1 << 15])
def test_documents(spark, library, piece):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, None), (None, "no id"), (500, ""), (501, None), (7, "again"), (7, "again"), (502, "a" * 40_000 + " " + "tion " * 9_000), (503, "<|endoftext|>" * 4_000), (504, "̸<|endoftext|≯" + "z" * 70_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(9).alias("row"), F.lit("x").alias("n"), F.lit(1).alias("piece"))
    got = sorted((tuple(r) for r in count_tokens(frame.repartition(3), piece=piece, block=4).collect()), key=repr)
    want = [(d, len((t or "").encode()), n := counted(library, t or ""), n > 2048) for d, t in rows]
    assert got == sorted(want, key=repr)
    assert count_tokens(frame.limit(0)).collect() == []


def test_query_on_the_given_documents(spark, library):
    from tallyspark.llm.queries import QUERIES

    got = QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    given_rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := counted(library, r.text or ""), n > 2048) for r in given_rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
