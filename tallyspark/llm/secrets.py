"""Operator 4: secret scan with a trigram inverted index, in DataFrame functions only.

1. From each rule's regex a Boolean query over lower-case trigrams is derived: alternatives, each a set of
   trigrams that a match must contain.
2. One pass over the texts posts (trigram, text) for the trigrams that the queries use. The index is cut into
   blocks of texts by hash, so that a list, however frequent its trigram, holds a block's texts at most.
3. In each block, an alternative's posting lists are intersected, shortest first, and the alternatives of a rule
   united: these texts may match the rule.
4. Only the ids of the candidates travel back to the texts, where the rule's regex verifies them. Rules without
   mandatory trigrams scan every text.

A text goes by the hash of its doc_id and itself, so that null and repeated ids are of no matter: rows that
shared a hash would share candidates, which the regexes verify on each row's own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions

parser = re._parser  # the standard library's regex syntax trees
#: Most strings that a part of a regex may stand for while trigrams are derived.
EXACT = 64
#: Texts of a block of the index, and items of an array that are worked on at once.
BLOCK_ROWS, CHUNK_ITEMS = 4096, 512
SPANS = "array<struct<start:int,number:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that Python and Java read alike, and the length its `group` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_KINDS = ("assign", "access", "hex")
#: A maximal run shorter than the least length holds no match, so the least length may stand in the pattern;
#: not so for assign, where a match that fails still uses up its text.
RULES = (
    Rule("assign", r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)


def _literals(tree) -> list[set[str] | None]:
    """The parts of a sequence: the set of strings a part stands for, or None where that is large or open."""
    parts: list[set[str] | None] = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append({chr(arg).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            parts.append({chr(a).lower() for _, a in arg})
        elif name == "SUBPATTERN":
            parts += _literals(arg[-1])
        elif name == "BRANCH":
            each = [_whole(x) for x in arg[1]]
            parts.append(None if None in each else set().union(*each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 1:
            once = _whole(arg[2])
            parts.append(None if once is None else once | ({""} if arg[0] == 0 else set()))
        elif name == "AT":
            continue
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts += [*_literals(arg[2]), None]
        else:
            parts.append(None)
    return parts


def _whole(tree) -> set[str] | None:
    parts = _literals(tree)
    if None in parts:
        return None
    out = {"".join(x) for x in product(*parts)} if parts else {""}
    return out if len(out) <= EXACT else None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, one of whose trigram sets every match contains in lower case; empty if none is mandatory."""
    best: list[frozenset[str]] = []
    run: set[str] = {""}
    for part in [*_literals(parser.parse(pattern)), None]:
        longer = {a + b for a, b in product(run, part)} if part is not None else None
        if longer is not None and len(longer) <= EXACT:
            run = longer
            continue
        found = list({frozenset(s[i : i + 3] for i in range(len(s) - 2)): None for s in sorted(run)})
        found = [q for q in found if not any(other < q for other in found)]  # a smaller set says it already
        if all(found) and (not best or min(map(len, found)) > min(map(len, best))):
            best = found
        run = part if part is not None else {""}
    return best


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): which texts (key, text) hold which of the trigrams, letters in lower case."""
    low = texts.select("key", F.lower("text").alias("low"))
    present = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams))
    return low.select(F.explode(F.array_compact(present)).alias("trigram"), "key")


def inverted_index(texts: DataFrame, trigrams: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, lists: map of trigram to the keys of the block's texts that hold it)."""
    blocks = max(1, -(-texts.count() // block_rows))
    posted = postings(texts, trigrams).withColumn("block", F.expr(f"pmod(key, {blocks}L)")).repartition(partitions(texts), "block")
    lists = posted.groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, may: array of kinds): what the intersected postings leave possible; texts without any are left out."""
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern))}
    trigrams = sorted(set().union(*(t for query in queries.values() for t in query)))
    index = inverted_index(texts, trigrams, block_rows)
    none = F.array().cast("array<bigint>")

    def holding(needed: frozenset[str]) -> Column:
        lists = F.array(*(F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in sorted(needed)))
        ranked = F.array_sort(lists, lambda a, b: F.size(a) - F.size(b))
        return F.aggregate(F.slice(ranked, F.lit(2), F.size(ranked)), F.element_at(ranked, 1), lambda left, right: F.array_intersect(left, right))

    def possible(query: list[frozenset[str]]) -> Column:
        return reduce(F.array_union, map(holding, query))

    found = F.array(*(F.struct(F.lit(kind).alias("kind"), possible(query).alias("keys")) for kind, query in queries.items()))
    hits = index.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.keys").alias("key"))
    return hits.groupBy("key").agg(F.collect_set("kind").alias("may"))


def scan(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(state, out): what `step` (state, item) → (new state, array to append) leaves after all items, in order.

    An array that grew with each item would be copied as often; so the items go in chunks, and a text of a million
    items costs a million times a chunk.
    """
    empty = F.array().cast(out_type)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / CHUNK_ITEMS).cast("int")), lambda i: F.slice(items, i * CHUNK_ITEMS + 1, F.lit(CHUNK_ITEMS)))

    def inner(acc: Column, item: Column) -> Column:
        after, more = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        done = F.array(F.aggregate(chunk, F.struct(acc["state"].alias("state"), empty.alias("out")), inner))
        return F.element_at(F.transform(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["parts"], F.array(d["out"])).alias("parts"))), 1)

    start = F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("parts"))
    return F.aggregate(chunks, start, outer, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["parts"]).alias("out")))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule's matches, leftmost and non-overlapping, in code points, the failing ones dropped.

    The pieces between the matches, and the matches, give the places.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["piece"]
        end = begin + x["whole"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return end, F.when(x["inner"] >= rule.least, F.array(span)).otherwise(F.array().cast(SPANS))

    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), inner.alias("inner"))
    return F.when(F.size(whole) > 0, scan(rows, F.lit(0), SPANS, step)["out"]).otherwise(F.array().cast(SPANS))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row: the row of `docs`, text, spans) of every row."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.coalesce("row.text", F.lit("")).alias("text"), F.xxhash64("row.doc_id", "row.text").alias("key"))
    indexed = rows.join(candidates(rows.select("key", "text"), rules), "key", "left")
    each = []
    for number, rule in enumerate(rules):
        due = F.array_contains("may", rule.kind) if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        each.append(F.when(due, _spans(F.col("text"), rule, number)).otherwise(F.array().cast(SPANS)))
    return indexed.select("row", "text", F.array_sort(F.concat(*each)).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`doc_id, text` of `docs` with spans: array of (start, number, end, kind) by start, then rule order.

    Code points, ends exclusive; matches do not overlap within a kind but may across kinds. A null or empty
    text has none. Null doc_ids are scanned like others, and repeated rows or ids each by their own text. Other
    columns are ignored.
    """
    return _scanned(docs.select("doc_id", "text"), rules).select("row.doc_id", "text", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with each secret replaced by its kind in brackets; overlapping ones become one, of the first kind.

    Every row is redacted by its own text, with a null or repeated doc_id too; null texts stay null, and other
    columns, whatever their names, stay as they are.
    """

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        apart = s["start"] >= end
        said = F.concat(F.col("text").substr(end + 1, s["start"] - end), F.lit("["), s["kind"], F.lit("]"))
        return F.greatest(end, s["end"]), F.when(apart, F.array(said)).otherwise(F.array().cast("array<string>"))

    done = F.element_at(F.transform(F.array(scan(F.col("spans"), F.lit(0), "array<string>", step)), lambda d: F.concat(F.array_join(d["out"], ""), F.col("text").substr(d["state"] + 1, F.length("text")))), 1)
    clean = F.when(F.size("spans") > 0, done).otherwise(F.col("row.text"))
    found = _scanned(docs, rules).select("row", clean.alias("clean"))
    return found.select(*(F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
