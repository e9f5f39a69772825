import hashlib
import random
from collections import defaultdict

from tallyspark.llm.chat_tree import build_tree, conversation_paths
from tallyspark.llm.queries import format_conversations


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    rng = random.Random(7)
    texts = ["", None, "Hi", "</s>", "<|user|>", "a\\b", "\\", "<\\|x", "[INST] [/INST]", "<<s>|>|>", "line\nline", "é😀", "<|>", "\\\\<s>"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 5)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.9 else rng.choice(["system", None, "od|>d", ""])
            rows.append((conv, turn, role, rng.choice(texts[: rng.choice([3, 14])])))
    return rows


def test_round_trip_and_tree(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_conversations(frame).collect()}
    convs = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        convs[conv].append((role or "", text or ""))
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        trained = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(trained), sha(trained))


def merged(intervals):
    out = []
    for start, stop in sorted(intervals):
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def test_layout_and_attention(spark):
    frame = spark.createDataFrame(corpus(), "conv_id long, turn long, role string, text string")
    paths = conversation_paths(frame)
    nodes, leaves = build_tree(paths)
    nodes, leaves = nodes.collect(), {bytes(r.leaf): r for r in leaves.collect()}
    got = {r.conv_id: r for r in format_conversations(frame).collect()}
    rows = paths.collect()
    above = defaultdict(set)
    count = defaultdict(int)
    for conv in rows:
        ids = [bytes(t.id) for t in conv.turns]
        for i, node in enumerate(ids):
            above[node] |= set(ids[:i])
            count[node] += 1
    by_id = {bytes(n.id): n for n in nodes}
    assert len(nodes) == len(by_id) == len(above)
    at = 0
    for n in sorted(nodes, key=lambda n: n.start):
        assert (n.start, n.stop) == (at, at + len(n.piece))
        at = n.stop
        parents = [by_id[a] for a in above[bytes(n.id)]]
        assert n.depth == len(parents) + 1 and n.pos == sum(len(a.piece) for a in parents) and n.conversations == count[bytes(n.id)]
        assert [(a.start, a.stop) for a in n.ancestors] == merged((a.start, a.stop) for a in parents)
        # depth first: a node's subtree is one run of the layout
        below = [m for m in nodes if bytes(n.id) in above[bytes(m.id)]]
        assert sum(len(m.piece) for m in below) == max([m.stop for m in below], default=n.stop) - n.stop
    for conv in rows:
        steps = [by_id[bytes(t.id)] for t in conv.turns]
        assert leaves[bytes(conv.turns[-1].id)].starts == [n.start for n in steps]
        before = sum(n.pos for n in steps)
        assert (got[conv.conv_id].positions, got[conv.conv_id].attended) == (before, before)
        places = [":".join(map(str, (n.start, n.stop, n.pos, n.conversations, ",".join(f"{a.start}-{a.stop}" for a in n.ancestors)))) for n in steps]
        assert got[conv.conv_id].layout_sha256 == sha("\n".join(map(sha, places)))


def test_long_conversation_and_common_turns(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(1500)]
    rows += [(c, t, "user", f"hello {t if t < 3 else c}") for c in range(2, 1500) for t in range(4)]
    rows += [(c, 0, "user", "x" * 300_000) for c in (5000, 5001)]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 1501 and got[1].n_turns == 1500 and got[2].n_turns == 4
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1))
    assert got[5000].turns_sha256 == got[5001].turns_sha256 == sha("user\n" + "x" * 300_000 + "\n")


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(empty).collect() == []
    rows = [(1, 0, "user", "x", "p"), (1, 0, "user", "x", "q"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string")
    assert {r.conv_id: r.n_turns for r in format_conversations(frame).collect()} == {1: 2, None: 1}
