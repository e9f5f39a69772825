"""Operator 11: conversation structure repair by an error-correcting Earley parser.

A conversation's rows are read by a weighted grammar of roles. Beside its rules there are error productions: a row may
be passed over (D), a user or assistant may be read from a row of any role (R) or from no row at all (I). A chart's
items are dotted rules, and each keeps the least (cost, audit) that reaches it, audit being the edits' letters so far;
the completed chart yields the repair. Nonterminals stand at the left end of their rules only, so every item begins
with the conversation and a column's items are all that later columns need: charts of consecutive stretches of rows,
one for each item at their begin, compose. A conversation of any length is so parsed by many tasks: rows are dealt by
range into sorted runs, each run charts its stretch of a conversation, and the stretches are composed.

Of audits that reach one column, each ends with a row's letter and has as many of those, so none begins another, and
the least of two stays the least whatever follows: inserts belong to the row before which they stand.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions, shared_folder

#: Left side and right side; small letters are roles' initials.
RULES = (("Repair", ()), ("Repair", ("Talk",)), ("Talk", ("Head", "u", "a")), ("Talk", ("Talk", "u", "a")), ("Head", ()), ("Head", ("s",)))
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Initials that a reroled or inserted row can have.
MADE = "ua"
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a stretch that is charted at once.
STRETCH = 64
#: [\\x20\\x09-\\x0D], all that is no visible character.
_SPACE = " \t\n\x0b\x0c\r"

Item = tuple[int, int]
Column = dict[Item, tuple[int, str]]


def _awaits(item: Item) -> str | None:
    """The symbol behind the dot."""
    right = RULES[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


def _settle(column: Column, inserts: bool) -> Column:
    """The column with all that its items complete, and with `inserts` what they reach by reading rows that are not there."""
    out: Column = {}
    agenda = [(value, item) for item, value in column.items()]
    heapify(agenda)
    while agenda:
        value, item = heappop(agenda)
        if item in out:
            continue
        out[item] = value
        symbol = _awaits(item)
        if symbol is None:
            for rule, (_, right) in enumerate(RULES):
                if right[:1] == (RULES[item[0]][0],):
                    heappush(agenda, (value, (rule, 1)))
        elif inserts and symbol in MADE:
            heappush(agenda, ((value[0] + INSERT, value[1] + "I"), (item[0], item[1] + 1)))
    return out


def _predicted() -> Column:
    """Column 0: every rule that a repair can begin with, through left ends."""
    wanted, column = ["Repair"], {}
    for symbol in wanted:
        for rule, (left, right) in enumerate(RULES):
            if left == symbol:
                column[rule, 0] = (0, "")
                if right and right[0] not in (*wanted, "s", *MADE):
                    wanted.append(right[0])
    return _stays(_settle(column, False))


def _stays(column: Column) -> Column:
    """Items that later columns can use: those that await a role, and repairs, behind which rows may be passed over."""
    return {i: v for i, v in column.items() if (s := _awaits(i)) in ("s", "u", "a") or s is None and RULES[i[0]][0] == "Repair"}


def _scan(column: Column, code: str) -> Column:
    """The next column after a row: x may only be deleted, a capital stands for a truncated row, else its initial."""
    out: Column = {}

    def reach(item: Item, cost: int, audit: str) -> None:
        if item not in out or (cost, audit) < out[item]:
            out[item] = (cost, audit)

    more = CUT_SHORT if code.isupper() else 0
    for item, (cost, audit) in _settle(column, True).items():
        symbol, then = _awaits(item), (item[0], item[1] + 1)
        if symbol in ("s", "u", "a") or RULES[item[0]][0] == "Repair":
            reach(item, cost + DELETE, audit + "D")
        if code != "x" and symbol is not None:
            if symbol == code.lower():
                reach(then, cost + more, audit + "K")
            if symbol in MADE:
                reach(then, cost + REROLE + more, audit + "R")
    return _stays(_settle(out, False))


_BEGIN = _predicted()
#: All items that a stretch can begin with.
KERNEL = sorted({i for i in ((r, d) for r, (_, right) in enumerate(RULES) for d in range(len(right) + 1)) if i in _stays({i: (0, "")})})

#: What a stretch's charts give: for each item at its begin, the items at its end with the least (cost, audit) between.
Chart = dict[Item, Column]


@lru_cache(maxsize=1 << 14)
def chart_of(codes: str) -> Chart:
    """The charts of a short stretch."""
    out = {}
    for item in KERNEL:
        column: Column = {item: (0, "")}
        for code in codes:
            column = _scan(column, code)
        out[item] = column
    return out


def compose(one: Chart, two: Chart) -> Chart:
    """The charts of two stretches that follow each other."""
    out = {}
    for entry, middle in one.items():
        ends: Column = {}
        for item, (cost, audit) in middle.items():
            for end, (more, rest) in two[item].items():
                if end not in ends or (cost + more, audit + rest) < ends[end]:
                    ends[end] = (cost + more, audit + rest)
        out[entry] = ends
    return out


def composed(charts: list[Chart]) -> Chart:
    while len(charts) > 1:
        charts = [compose(*charts[i : i + 2]) if i + 1 < len(charts) else charts[i] for i in range(0, len(charts), 2)]
    return charts[0]


def charted(codes: str) -> Chart:
    """The charts of a stretch of any length."""
    return composed([chart_of(codes[i : i + STRETCH]) for i in range(0, len(codes), STRETCH)])


def _best(column: Column) -> tuple[int, str]:
    return min(v for i, v in _settle(column, True).items() if RULES[i[0]][0] == "Repair" and _awaits(i) is None)


@lru_cache(maxsize=1 << 16)
def repair(codes: str) -> tuple[int, str]:
    """Least (cost, audit) of a short conversation."""
    column = _BEGIN
    for code in codes:
        column = _scan(column, code)
    return _best(column)


def repair_of(chart: Chart) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    column: Column = {}
    for item in _BEGIN:
        for end, value in chart[item].items():
            if end not in column or value < column[end]:
                column[end] = value
    return _best(column)


def _written(chart: Chart) -> str:
    return json.dumps([[entry, [[end, *value] for end, value in column.items()]] for entry, column in chart.items()])


def _read(text: str) -> Chart:
    return {tuple(entry): {tuple(end): (cost, audit) for end, cost, audit in column} for entry, column in json.loads(text)}


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(`conv_id:turn`) % 20: 0 is dropped, 1 loses its text, 2 its
    [.!?], 3 comes twice, 4 becomes a user's. A null role or text, or a null in the key, is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("harm"),
    )
    kept = keyed.where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_PART = "conv_id long, part long, codes string, chart string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_FOUND = "conv_id long, pos long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _groups(rows: Iterator[tuple], keys: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:keys] != row[:keys]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _chart_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretch of each conversation in each run, from rows sorted by conv_id, part and pos."""

    def parts() -> Iterator[tuple]:
        for rows in _groups(_rows(batches), 2):
            conv, part = rows[0][:2]
            codes, counts, initials, times = [], [0, 0, 0], [], []
            for _, _, _, turn, initial, blank, repeated, short in rows:
                must = blank or repeated
                code = "x" if must else initial if initial in ("s", "u", "a") else "o"
                codes.append(code.upper() if short and not must else code)
                for i, fault in enumerate((blank, repeated and not blank, short and not must)):
                    counts[i] += fault
                initials.append(initial)
                if turn is not None:
                    times.append(turn)
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            text = "".join(codes)
            brief = len(text) <= STRETCH
            # turns come sorted
            span = (times[0], times[-1], len(set(times))) if times else (None, None, 0)
            yield conv, part, text if brief else None, None if brief else _written(charted(text)), *counts, illegal, initials[0], initials[-1], *span

    return _batches(parts(), _PART)


def _fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation, from its stretches in order; part -1 has no rows."""

    def found() -> Iterator[tuple]:
        for parts in _groups(_rows(batches), 1):
            conv, parts = parts[0][0], [p for p in parts if p[1] >= 0]
            counts = [sum(p[i] for p in parts) for i in (4, 5, 6, 7)]
            counts[3] += sum(a[9] + b[8] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            timed = [p for p in parts if p[10] is not None]
            # a turn on both sides of a cut is one
            distinct = sum(p[12] for p in timed) - sum(a[11] == b[10] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1][11] - timed[0][10] + 1 - distinct if timed else 0
            if not parts:
                cost, audit = 0, ""
            elif len(parts) == 1 and parts[0][2] is not None:
                cost, audit = repair(parts[0][2])
            else:
                cost, audit = repair_of(composed([chart_of(p[2]) if p[2] is not None else _read(p[3]) for p in parts]))
            yield conv, None, None, None, gaps, *counts, cost, audit

    return _batches(found(), _FOUND)


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from rows in order and their edits."""
    before = ""
    given = iter(rows)

    def made() -> str:
        nonlocal before
        before = "a" if before == "u" else "u"
        return NAMES[before]

    for letter in audit:
        if letter == "I":
            yield made(), ""
            continue
        role, text = next(given)
        if letter == "K":
            before = role[:1]
            yield role, text
        elif letter == "R":
            yield made(), text


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's result, from its found row and then its rows in order, which pass one by one."""

    def out() -> Iterator[tuple]:
        rows = _rows(batches)
        now = next(rows, None)
        while now is not None:
            head, following = now, None

            def own(conv=head[0]) -> Iterator[tuple[str, str]]:
                nonlocal following
                for row in rows:
                    if row[0] != conv or row[1] is None:
                        following = row
                        return
                    yield row[2], row[3]

            given, whole, joint = own(), sha256(), b""
            for role, text in repaired(given, head[-1]):
                whole.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
            for _ in given:
                pass
            yield head[0], *head[4:], whole.hexdigest()
            now = following

    return _batches(out(), _OUT)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Per conv_id of `turns` (conv_id, turn, role, text), after `damage`: gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    Rows go by turn (null first), ties by role, then by the text's SHA-256; equal rows stand side by side. A row is
    blank without a visible character, a duplicate if its role and text came earlier, truncated if its last visible
    character is none of `.!?`; the first that fits counts. An empty role has no initial and cannot be kept. A null
    conv_id is a conversation of its own; repeated rows are duplicates; other columns are ignored; a conversation that
    has lost all rows has zeros, an empty audit and the empty text's hash. Only the last step, the digest of a repaired
    conversation, reads its texts in one task (SHA-256 has no parallel form): sorted and one by one, holding none.
    """
    spark, n = turns.sparkSession, partitions(turns)
    folder = f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}"
    rows = damage(turns).withColumn("said", F.sha2(F.col("text").cast("binary"), 256)).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "said", "tie"]
    visible = F.rtrim("text", F.lit(_SPACE))
    runs = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    runs.select(
        "conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "said",
        (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("short"),
    ).write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")

    # the first row of each text is found by its place, which no two rows share
    firsts = runs.groupBy("conv_id", "role", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("later"))
    coded = runs.join(firsts, "pos", "left").select("conv_id", F.shiftright("pos", 33).alias("part"), "pos", "turn", F.substring("role", 1, 1).alias("initial"), "blank", F.coalesce("later", F.lit(True)).alias("repeated"), "short")
    parts = coded.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_chart_parts, _PART)
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("part", F.lit(-1).cast("long"))
    found = parts.unionByName(every, allowMissingColumns=True).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_fold_parts, _FOUND)

    both = found.unionByName(runs.select("conv_id", "pos", "role", "text"), allowMissingColumns=True)
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("pos").asc_nulls_first()).mapInArrow(_digest, _OUT)
