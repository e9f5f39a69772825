"""Operator 2: variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once, and a sequence of capacity c costs overhead + c + c * c / attention:
what it holds costs per token, attention by the square, so neither many short nor few long sequences are free.
Documents are dealt by hash into shards of bounded size, and each shard packs longest first: a piece goes to the
open bin that it fills best; if none has room, a bin is opened. Which capacity is opened for which length class
(the lengths between two permitted ones) is chosen for all classes jointly: from the best plan that opens one
capacity for all, one class after the other moves to the capacity under which packing the whole shard costs
least, until no move helps. In the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected documents of a shard: enough small pieces to fill the gaps, few enough for one task.
SHARD_ROWS = 20_000
CAPACITIES = (1024, 2048, 4096, 8192, 16384)
#: Length at which attention costs as much again as all else: six times a hidden width of 4096.
ATTENTION = 24_576.0
_NAMES = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_used", "offset"]
_SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, capacity long, bin_used long, offset long"


def sequence_cost(capacity: np.ndarray | int, overhead: float, attention: float):
    """What a sequence of that capacity costs, in tokens."""
    return overhead + capacity + capacity * capacity / attention


def best_fit(lengths: list[int], opens: Sequence[int], sizes: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each length (longest first), and each bin's final capacity and contents; a length of class k
    (over sizes[k - 1], sizes[k] at most) that fits no open bin opens one of opens[k]."""
    places, offsets, used = [], [], []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for length in lengths:
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, where = room.pop(at)
        else:
            free, where = opens[bisect_left(sizes, length)], len(used)
            used.append(0)
        places.append(where)
        offsets.append(used[where])
        used[where] += length
        if free > length:
            insort(room, (free - length, where))
    return places, offsets, [sizes[bisect_left(sizes, u)] for u in used], used


def joint_plan(lengths: list[int], capacities: Sequence[int], overhead: float, attention: float) -> list[int]:
    """The capacity to open for each length class, chosen for all classes jointly."""
    sizes = sorted(capacities)
    price = {c: sequence_cost(c, overhead, attention) for c in sizes}
    known: dict[tuple[int, ...], float] = {}

    def cost(opens: list[int]) -> float:
        if tuple(opens) not in known:
            known[tuple(opens)] = sum(price[c] for c in best_fit(lengths, opens, sizes)[2])
        return known[tuple(opens)]

    present = sorted({bisect_left(sizes, x) for x in set(lengths)})
    best = min(([max(c, own) for own in sizes] for c in sizes), key=cost)
    while True:
        before = list(best)
        for k in present:
            best = min((best[:k] + [c] + best[k + 1 :] for c in sizes[k:]), key=cost)
        if best == before:
            return best


def _pack(capacities: Sequence[int], overhead: float, attention: float):
    sizes = sorted(capacities)
    longest = sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, shard = [], [], None
        for batch in batches:
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
                ids.append(batch.column(0))
                held.append(batch.column(1).to_numpy())
        if shard is None:
            return
        doc, size = pa.concat_arrays(ids), np.concatenate(held)
        # a document over the longest length is cut into full pieces and a rest
        many = np.maximum(-(-size // longest), 1)
        row = np.repeat(np.arange(len(doc)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(size[row] - piece * longest, longest)
        order = np.lexsort((piece, doc.fill_null(-1).to_numpy()[row], -length))
        row, piece, length = row[order], piece[order], length[order]
        opens = joint_plan(length.tolist(), sizes, overhead, attention)
        places, offsets, final, used = map(np.array, best_fit(length.tolist(), opens, sizes))
        for i in range(0, len(row), 50_000):
            s = slice(i, i + 50_000)
            columns = [piece[s].astype(np.int32), piece[s] * longest, length[s], (shard << 32) + places[s], final[places[s]], used[places[s]], offsets[s]]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row[s])), *(pa.array(c) for c in columns)], names=_NAMES)

    return run


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = 64.0, attention: float = ATTENTION, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`lengths` (doc_id, length) packed: doc_id, piece, start, length, bin_id, capacity, bin_used, offset.

    Each piece [start, start + length) of a document lies in bin bin_id at offset. Rows with a null or negative
    length are left out; a length of 0 takes a place and no room. A null doc_id is packed like others, a repeated
    one as often as it comes. Other columns are ignored.
    """
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length")).where("length >= 0")
    shards = max(1, -(-rows.count() // shard_rows))
    # by the row's number too: rows without doc_id, or that repeat one, are spread like others
    dealt = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, length, monotonically_increasing_id()), {shards}) as int)"))
    return dealt.repartitionById(shards, "shard").mapInArrow(_pack(capacities, overhead, attention), _SCHEMA)


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = 64.0, attention: float = ATTENTION) -> DataFrame:
    """`docs` packed by their byte tokens: a token for each UTF-8 byte and one that ends the document (null: empty).
    Null and repeated doc_ids as in `pack`."""
    return pack(docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("length")), capacities, overhead, attention)
