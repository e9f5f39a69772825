"""Counters anchored at events: fixed windows from a key's first hit, lockouts, and runs of failures.

Both sequential rules are automata that restart: a window opens with the first hit after the last one closed, a lock
ends and the count begins at 0. So what happens from a row on, if one restarts there, doesn't depend on what came
before: each row has the row at which its window or lock is made and the row at which the next one restarts, both found
at once for all rows of a task by sorted search. Rows are dealt by range into sorted runs, and a key may lie in several:
each run gives, for the keys at its two ends, the map from the state in which the run is entered to the state in which
it is left; a key's maps are applied in order, and with its entry each run follows its own chain of restarts. One key
with all rows is so worked on by all tasks, and what meets in one is a map a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut

_MAPS = "key string, run int, last bigint, ends array<bigint>, to_count array<int>, to_until array<bigint>, from_count array<int>, from_until array<bigint>"
_ENTRIES = "key string, run int, count int, until bigint"


class _Rows:
    """The rows of a run: each key's on a time scale of its own, one after the other, so that one sorted search serves all."""

    def __init__(self, batches: list[pa.RecordBatch], width: int) -> None:
        table = pa.Table.from_batches(batches)
        self.names = table.column("key").combine_chunks()
        self.at = table.column("at").to_numpy()
        self.value = table.column("value").to_numpy()
        self.n = n = len(self.at)
        code = self.names.dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        code = code.indices.to_numpy()
        fresh = np.ones(n, bool)
        fresh[1:] = code[1:] != code[:-1]
        self.key = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        self.stop = np.append(self.first[1:], n)
        span = self.at[self.stop - 1] - self.at[self.first] + width + 1
        self.scaled = self.at - self.at[self.first][self.key] + np.concatenate([[0], np.cumsum(span)[:-1]])[self.key]

    def after(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The first row of the same key at least `width` later, n if there is none."""
        found = np.searchsorted(self.scaled, self.scaled[rows] + width)
        return np.where(self.key[np.minimum(found, self.n - 1)] == self.key[rows], found, self.n) if len(rows) else found


def _window_steps(rows: _Rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A window is made where it restarts."""
    all_rows = np.arange(rows.n)
    return all_rows, rows.after(all_rows, width)


def _lock_steps(rows: _Rows, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """From a restart the first row with `most` failures in a row, all since, locks."""
    n, at = rows.n, np.arange(rows.n)
    barrier = np.maximum(np.where(rows.value == 0, at, -1), rows.first[rows.key] - 1)
    streak = at - np.maximum.accumulate(barrier)
    full = np.minimum.accumulate(np.where(streak >= most, at, n)[::-1])[::-1]
    due = at + most - 1
    made = np.where(due < n, full[np.minimum(due, n - 1)], n)
    made = np.where((made < n) & (rows.key[np.minimum(made, n - 1)] == rows.key), made, n)
    again = np.full(n, n)
    some = np.flatnonzero(made < n)
    again[some] = rows.after(made[some], width)
    return made, again


def _exits(rows: _Rows, made: np.ndarray, again: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a restart at each row of one key's part [low, high): count and lock end (0: none) in which the part is left."""
    n = high - low
    own = np.arange(n)
    jump = np.where(again[low:high] < high, again[low:high] - low, own)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    lock = made[low:high][jump]
    until = np.where(lock < high, rows.at[np.minimum(lock, rows.n - 1)] + width, 0)
    bad = np.flatnonzero(rows.value[low:high] == 0)
    streak = n - 1 - bad[-1] if len(bad) else n
    count = np.where(until > 0, 0, np.minimum(streak, n - jump))
    return count, until, jump


def _maps(width: int, most: int):
    """The maps of a run's first and last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows, number = _Rows(held, width), held[0].column(held[0].schema.get_field_index("run"))[0].as_py()
        made, again = _lock_steps(rows, width, most) if most else _window_steps(rows, width)
        out = []
        for key in sorted({0, len(rows.first) - 1}):
            low, high = int(rows.first[key]), int(rows.stop[key])
            count, until, _ = _exits(rows, made, again, width, low, high)
            if not most:
                count = np.zeros_like(count)
            at = rows.at[low:high]
            # a lock that is on when the run begins ends within `width` of its first row: one row more can be the next
            near = min(int(np.searchsorted(at, at[0] + width, "right")) + 1, len(at))
            change = np.flatnonzero((count[1:near] != count[: near - 1]) | (until[1:near] != until[: near - 1]))
            last_of = np.append(change, near - 1)
            froms = [(int(count[0]), int(until[0]))]
            fails = rows.value[low:high]
            good = np.flatnonzero(fails == 0)
            lead = int(good[0]) if len(good) else high - low
            for c in range(1, most):
                if c + lead >= most:
                    ends = int(at[most - c - 1]) + width
                    p = int(np.searchsorted(at, ends))
                    froms.append((0, ends) if p == len(at) else (int(count[p]), int(until[p])))
                elif lead == len(at):
                    froms.append((c + lead, 0))
                else:
                    froms.append((int(count[lead + 1]), int(until[lead + 1])) if lead + 1 < len(at) else (0, 0))
            out.append((rows.names[low].as_py(), number, int(at[-1]), at[last_of].tolist(), count[last_of].tolist(), until[last_of].tolist(), [a for a, _ in froms], [b for _, b in froms]))
        columns = list(zip(*out, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _MAPS.split(", ")])

    return run


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each run is entered, from a key's maps in order of the runs."""
    key, count, until = None, 0, 0
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            name, run, last, ends, to_count, to_until, from_count, from_until = (batch.column(k)[i].as_py() for k in range(8))
            if name != key:
                key, count, until = name, 0, 0
            out.append((name, run, count, until))
            if until > last:
                continue
            if until:
                place = int(np.searchsorted(ends, until))
                count, until = to_count[place], to_until[place]
            else:
                count, until = from_count[count], from_until[count]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["key", "run", "count", "until"])


def _restarts(rows: _Rows, made: np.ndarray, again: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All rows at which something restarts, by following the chains from `starts` together."""
    found = [starts]
    while len(starts):
        starts = again[starts[made[starts] < rows.n]]
        starts = starts[starts < rows.n]
        found.append(starts)
    return np.concatenate(found)


def _begin(rows: _Rows, entry: dict[str, tuple[int, int]], most: int, width: int) -> tuple[np.ndarray, list[tuple[str, int]], list[tuple[int, int]]]:
    """Where each key's chain begins in this run; locks that an entry count leads to; and, for windows, [row, row) of the
    entry's open window."""
    starts, locks, open_rows = rows.first.copy(), [], []
    for key in sorted({0, len(rows.first) - 1}):
        low, high = int(rows.first[key]), int(rows.stop[key])
        name = rows.names[low].as_py()
        count, until = entry.get(name, (0, 0))
        at = rows.at[low:high]
        if until:
            starts[key] = low + int(np.searchsorted(at, until))
            open_rows.append((low, int(starts[key])))
        elif count:
            good = np.flatnonzero(rows.value[low:high] == 0)
            lead = int(good[0]) if len(good) else high - low
            if count + lead >= most:
                locked = int(at[most - count - 1])
                locks.append((name, locked))
                starts[key] = low + int(np.searchsorted(at, locked + width))
            else:
                starts[key] = low + lead + 1
        starts[key] = rows.n if starts[key] >= high else starts[key]
    return starts[starts < rows.n], locks, open_rows


def _emit(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = _Rows(held, width)
        entry = {}
        for batch in held:
            known = batch.column(batch.schema.get_field_index("until"))
            for i in np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))[[0, -1]] if known.null_count < len(known) else []:
                entry[batch.column(batch.schema.get_field_index("key"))[int(i)].as_py()] = (batch.column(batch.schema.get_field_index("count"))[int(i)].as_py(), known[int(i)].as_py())
        made, again = _lock_steps(rows, width, most) if most else _window_steps(rows, width)
        starts, locks, open_rows = _begin(rows, entry, most, width)
        at = np.sort(_restarts(rows, made, again, starts))
        if most:
            hit = made[at]
            hit = hit[hit < rows.n]
            names = pa.concat_arrays([rows.names.take(pa.array(hit)), pa.array([k for k, _ in locks], pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([rows.at[hit], np.array([x for _, x in locks], np.int64)]))], names=["key", "locked_at"])
            return
        total = np.concatenate([[0], np.cumsum(rows.value)])
        ends = np.minimum(np.append(at[1:], rows.n), rows.stop[rows.key[at]]) if len(at) else at
        names, opened, hits = rows.names.take(pa.array(at)), rows.at[at], total[ends] - total[at]
        begun = [(low, high) for low, high in open_rows if high > low]
        kept = [rows.names[low].as_py() for low, _ in begun]
        names = pa.concat_arrays([names, pa.array(kept, pa.string())])
        opened = np.concatenate([opened, np.array([entry[k][1] - width for k in kept], np.int64)])
        hits = np.concatenate([hits, np.array([total[high] - total[low] for low, high in begun], np.int64)])
        yield pa.RecordBatch.from_arrays([names, pa.array(opened), pa.array(hits)], names=["key", "opened", "hits"])

    return run


def _scan(rows: DataFrame, order: list[str], width: int, most: int, schema: str) -> DataFrame:
    """`_emit` over `rows` (key, at, value, …) in runs sorted by `order`, each with the state in which it is entered."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "at", "value", F.spark_partition_id().alias("run")))
    maps = runs.mapInArrow(_maps(width, most), _MAPS)
    entries = maps.repartition(n, "key").sortWithinPartitions("key", "run").mapInArrow(_enter, _ENTRIES)
    # at most two rows a run
    return runs.join(F.broadcast(entries), ["key", "run"], "left").mapInArrow(_emit(width, most), schema)


def fixed_windows(hits: DataFrame, seconds: int) -> DataFrame:
    """(key, opened, hits): windows that open with a key's first hit after the last window closed.

    `hits`: key string, at bigint (microseconds); rows without either are left out. Hits of one instant collapse into
    counts before they are dealt.
    """
    counts = hits.where("key is not null and at is not null").groupBy("key", "at").agg(F.count(F.lit(1)).alias("value"))
    parts = _scan(counts, ["key", "at"], seconds * 1_000_000, 0, "key string, opened bigint, hits bigint")
    return parts.groupBy("key", "opened").agg(F.sum("hits").alias("hits"))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """`events` with streak: the failures in a row that end at each event, 0 at a success."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(by))
    inside = Window.partitionBy(key, "_g").orderBy(*order)
    return marked.withColumn("streak", F.sum("_f").over(inside)).drop("_f", "_g")


def lockouts(attempts: DataFrame, most: int = 8, lock_seconds: int = 900) -> DataFrame:
    """(key, locked_at): the failures that lock their key. `attempts`: key, at bigint (microseconds), seq, failed; rows
    without key or time are left out.

    The count rises with each failure and falls to 0 with a success or a lock; attempts while locked are refused and
    count nothing.
    """
    rows = attempts.where("key is not null and at is not null").select("key", "at", "seq", F.coalesce(F.col("failed"), F.lit(False)).cast("long").alias("value"))
    return _scan(rows, ["key", "at", "seq"], lock_seconds * 1_000_000, most, "key string, locked_at bigint")
