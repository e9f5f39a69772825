import re
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import product

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import conversation_repair
from tallyspark.llm.conversation_repair import charted, compose, repair, repair_conversations, repair_of

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault), by trying every edit at every place of a recursion."""

    @lru_cache(None)
    def best(i, state, inserted):
        # state: "" at the begin, s, u or a after such a row
        options = []
        wanted = "a" if state == "u" else "u"
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            options.append(add(2, "D", None, best(i + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                initial = role[:1]
                if initial == wanted or (initial == "s" and state == ""):
                    options.append(add(more, "K", (role, text), best(i + 1, initial, 0)))
                options.append(add(1 + more, "R", ({"u": "user", "a": "assistant"}[wanted], text), best(i + 1, wanted, 0)))
        if inserted < 2:
            options.append(add(5, "I", ({"u": "user", "a": "assistant"}[wanted], ""), best(i, wanted, inserted + 1)))
        return min((o for o in options if o), key=lambda o: o[:2], default=None)

    def add(cost, letter, row, rest):
        return rest and (cost + rest[0], letter + rest[1], (row, *rest[2]) if row else rest[2])

    return best(0, "", 0)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in kept:
            seen_text = text.rstrip(WS)
            fault = "blank" if not seen_text else "duplicate" if (role, text) in seen else "truncated" if seen_text[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        cost, audit, said = cheapest(tuple(judged))
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=repr)


def codes_of(rows):
    return "".join("x" if f in ("blank", "duplicate") else ((r[:1] if r[:1] in ("s", "u", "a") else "o").upper() if f else r[:1] if r[:1] in ("s", "u", "a") else "o") for r, _, f in rows)


roles = st.sampled_from(["system", "user", "assistant", "tool"])
row_lists = st.lists(st.tuples(roles, st.just("t"), st.sampled_from(["", "", "", "blank", "truncated"])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(row_lists, st.integers(0, 9))
def test_charts_give_the_cheapest_edits_and_compose(rows, at):
    want = cheapest(tuple(rows))[:2]
    codes = codes_of(rows)
    assert repair(codes) == want
    if codes:
        at = min(at, len(codes))
        assert repair_of(compose(conversation_repair.chart_of(codes[:at]), conversation_repair.chart_of(codes[at:]))) == want


def test_every_short_sequence_has_a_legal_repair():
    for n in range(5):
        for codes in product("suaoxU", repeat=n):
            cost, audit = repair("".join(codes))
            before, shape = "", ""
            letters = iter(codes)
            for letter in audit:
                code = next(letters).lower() if letter != "I" else ""
                before = code if letter == "K" else before if letter == "D" else "a" if before == "u" else "u"
                shape += "" if letter == "D" else before
            assert next(letters, None) is None and re.fullmatch("(s?(ua)+)?", shape), (codes, audit)


def test_long_stretches_compose_as_they_are_read():
    import random

    rng = random.Random(3)
    for n in (64, 65, 200, 777):
        codes = "".join(rng.choice("suauauaoxUA") for _ in range(n))
        assert repair_of(charted(codes)) == repair.__wrapped__(codes)


def made(n, seed=1):
    import random

    rng = random.Random(seed)
    texts = ["Yes.", "No?", "Well!", "cut short", " \t", "", None, "Dot. \n", "é?", "Yes."]
    rows = []
    for conv in range(n):
        rows += [(conv, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User"]), rng.choice(texts) or None) for t in rng.sample(range(12), rng.randint(1, 9))]
    return rows


def got(spark, frame):
    return sorted((tuple(r) for r in repair_conversations(frame).collect()), key=repr)


def test_against_brute_force(spark):
    rows = made(150) + [(None, 1, "user", "Hi."), (None, None, "assistant", "No."), (None, None, None, None), (900, None, "user", "a."), (900, None, "assistant", "b.")]
    rows += [(901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 5, "assistant", "Other."), (902, 1, "user", "Long. " * 20_000 + "."), (902, 2, "assistant", "x" * 90_000 + "!")]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("pos"), F.lit("x").alias("said"), F.lit(2).alias("part"))
    assert got(spark, frame.repartition(3)) == brute(rows)
    assert got(spark, frame.limit(0)) == []


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    rows = [(7, t, ("user", "assistant")[t % 2], ("Fine.", f"Row {t}.", "cut")[t % 3]) for t in range(700)] + made(20)
    monkeypatch.setattr(conversation_repair, "partitions", lambda df: 12)
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        sys.setrecursionlimit(limit)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_given_conversations(spark, sf):
    from tallyspark.llm.queries import QUERIES

    found = QUERIES["op11_conversation_repair"](spark, f"/root/testdata/{sf}")
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
