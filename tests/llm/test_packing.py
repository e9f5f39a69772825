from collections import defaultdict

import numpy as np

from tallyspark.llm.packing import best_fit, joint_plan, pack, pack_documents, sequence_cost


def check(rows, lengths, capacities):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        docs[r.doc_id].append(r)
    for doc, length in lengths.items():
        pieces = sorted(docs[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at
            at += p.length
        assert at == length
    for members in bins.values():
        members.sort(key=lambda r: (r.offset, r.length))
        at = 0
        for m in members:
            assert m.offset == at
            at += m.length
        assert {m.bin_used for m in members} == {at}
        # downsized: the next smaller length would not hold it
        assert {m.capacity for m in members} == {min(c for c in capacities if c >= at)}


def test_packing_holds_everything(spark):
    rng = np.random.default_rng(1)
    lengths = {i: int(x) for i, x in enumerate(rng.lognormal(6.5, 1.2, 3000))} | {5000: 100_000, 5001: 0, 5002: 16384}
    frame = spark.createDataFrame([*lengths.items(), (None, 5), (6000, None), (6001, -1)], "doc_id long, length long")
    for shard_rows in (20_000, 500):
        rows = pack(frame, shard_rows=shard_rows).collect()
        check(rows, lengths | {None: 5}, (1024, 2048, 4096, 8192, 16384))
        waste = sum({r.bin_id: r.capacity - r.bin_used for r in rows}.values())
        assert waste < 0.1 * sum(lengths.values())


def total(lengths, opens, sizes, overhead=64, attention=24576):
    return sum(sequence_cost(c, overhead, attention) for c in best_fit(lengths, opens, sizes)[2])


def cheapest(lengths, sizes, overhead, attention):
    """The least cost of all ways to deal the lengths into bins."""
    best = [float("inf")]

    def deal(i, bins, _):
        if i == len(lengths):
            best[0] = min(best[0], sum(sequence_cost(min(c for c in sizes if c >= b), overhead, attention) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                deal(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :], None)
        deal(i + 1, [*bins, lengths[i]], None)

    deal(0, [], None)
    return best[0]


def test_against_the_exhaustive_packer():
    rng = np.random.default_rng(5)
    sizes, worst = [8, 16, 32, 64], 1.0
    for overhead, attention in ((1, 1000.0), (4, 50.0), (0, 30.0)):
        for _ in range(25):
            lengths = sorted(rng.integers(1, 65, rng.integers(1, 8)).tolist(), reverse=True)
            plan = joint_plan(lengths, sizes, overhead, attention)
            ours, least = total(lengths, plan, sizes, overhead, attention), cheapest(lengths, sizes, overhead, attention)
            assert least - 1e-9 <= ours <= min(total(lengths, [max(c, own) for own in sizes], sizes, overhead, attention) for c in sizes) + 1e-9
            worst = max(worst, ours / least)
    assert worst < 1.35


def test_several_sizes_cost_less_than_one():
    rng = np.random.default_rng(2)
    sizes = [1024, 2048, 4096, 8192, 16384]
    lengths = sorted(np.minimum(rng.lognormal(6.5, 1.2, 3000).astype(int) + 1, 16384).tolist(), reverse=True)
    plan = joint_plan(lengths, sizes, 64, 24576)
    final = best_fit(lengths, plan, sizes)[2]
    assert len(set(plan)) > 1 and min(final.count(c) for c in set(plan)) > 3
    assert total(lengths, plan, sizes) < 0.95 * total(lengths, [16384] * 5, sizes)


def test_plain_best_fit():
    assert best_fit([100, 50, 20], [64, 128, 4096], [64, 128, 4096]) == ([0, 1, 0], [0, 0, 100], [128, 64], [120, 50])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty).collect() == []
    docs = spark.createDataFrame([(1, None, 3), (2, "é", 4)], "doc_id long, text string, shard int")
    assert {r.doc_id: r.length for r in pack_documents(docs).collect()} == {1: 1, 2: 3}


def test_rows_of_one_id_and_length_are_spread_over_shards(spark):
    for doc in (None, 7):
        frame = spark.createDataFrame([(doc, 50)] * 5000, "doc_id long, length long")
        rows = pack(frame, shard_rows=500).collect()
        assert len(rows) == 5000
        per_shard = defaultdict(int)
        for r in rows:
            per_shard[r.bin_id >> 32] += 1
        assert len(per_shard) == 10 and max(per_shard.values()) < 1000
