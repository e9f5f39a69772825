"""Operator 3: quality rules as a short-circuit cascade.

The base counts come from one vectorised pass over each text. The further rules are measured on a random sample of
the documents that the base passes, drawn over the whole table and measured where it lies, for seconds spent and
share rejected; they then run in the order of rejection per cost: each rule sees only the documents that those
before it kept. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textnp import SPACE, mix64, prefix_hash, shingle_hashes, span_hash, text_chunks, word_spans

#: Documents, about, on which the rules' costs and selectivities are estimated, and readings of each cost.
SAMPLE, READINGS = 2000, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


@dataclass
class Texts:
    """A chunk of texts with the base counts of each."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    counts: dict[str, np.ndarray]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def only(self, rows: np.ndarray) -> Texts:
        """The chunk's texts at `rows`."""
        spans = [(self.offsets[r], self.offsets[r + 1]) for r in rows]
        data = np.concatenate([self.data[a:b] for a, b in spans]) if spans else self.data[:0]
        offsets = np.concatenate([[0], np.cumsum([b - a for a, b in spans])]).astype(np.int64)
        return Texts(data, offsets, *word_spans(data, offsets), {k: v[rows] for k, v in self.counts.items()})


def _equal_counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Words, their code points, symbols, repeated lines and repeated words of each text."""
    starts, ends, bounds = word_spans(data, offsets)
    rows = len(offsets) - 1
    n_words = np.diff(bounds)
    texts = Texts(data, offsets, starts, ends, bounds, {})
    prefix = prefix_hash(data)
    head = (data & 0xC0) != 0x80
    # lines with a word, equal to an earlier one
    newline = np.append(np.flatnonzero(data == 10), len(data))
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offsets, begin, "right") - 1
    stop = np.minimum(newline[np.searchsorted(newline, begin)], offsets[owner + 1])
    filled = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop, owner = begin[filled], stop[filled], owner[filled]
    lines = mix64(span_hash(prefix, begin, stop) + owner.astype(np.uint64))
    order = np.argsort(lines, kind="stable")
    lines = lines[order]
    again = np.zeros(len(lines), bool)
    again[1:] = lines[1:] == lines[:-1]
    # words in windows of five that occur twice or more in the text
    words = span_hash(prefix, starts, ends)
    word_row = np.repeat(np.arange(rows), n_words)
    repeated = np.zeros(len(words), bool)
    if len(words) >= 5:
        windows = shingle_hashes(words, 5)
        whole = np.flatnonzero(word_row[4:] == word_row[:-4])
        twice = whole[_equal_counts(mix64(windows[whole] + word_row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) > 1]
        for i in range(5):
            repeated[twice + i] = True
    texts.counts = {
        "n_words": n_words,
        "word_chars": texts.per_text(head & ~SPACE[data]),
        "n_symbols": texts.per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(owner[order][again], minlength=rows),
        "n_repeat_words": np.bincount(word_row[repeated], minlength=rows),
        "n_lines": np.bincount(owner, minlength=rows),
    }
    return texts


def _top_word_share(texts: Texts) -> np.ndarray:
    words = span_hash(prefix_hash(texts.data), texts.starts, texts.ends)
    row = np.repeat(np.arange(len(texts.offsets) - 1), np.diff(texts.bounds))
    most = np.zeros(len(texts.offsets) - 1)
    if len(words):
        np.maximum.at(most, row, _equal_counts(mix64(words + row.astype(np.uint64))))
    return most / np.maximum(texts.counts["n_words"], 1)


#: name → whether each text is rejected. Thresholds leave a wide margin to ordinary prose.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "symbols": lambda t: t.counts["n_symbols"] > 0.08 * t.counts["word_chars"],
    "repeated_lines": lambda t: 10 * t.counts["n_dup_lines"] > 4 * t.counts["n_lines"],
    "word_length": lambda t: (t.counts["word_chars"] < 2 * t.counts["n_words"]) | (t.counts["word_chars"] > 15 * t.counts["n_words"]),
    "exclamations": lambda t: 2 * t.per_text(t.data == ord("!")) > t.counts["n_words"],
    "capitals": lambda t: 10 * t.per_text(_UPPER[t.data]) > 7 * np.maximum(t.per_text(_LETTER[t.data]), 1),
    "one_word": lambda t: (t.counts["n_words"] >= 20) & (_top_word_share(t) > 0.4),
}


def base_fails(counts: dict[str, np.ndarray], min_words: int, repeat_percent: int) -> np.ndarray:
    """Which texts the base rejects."""
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])


def _measure(rules: dict[str, Callable[[Texts], np.ndarray]], min_words: int, repeat_percent: int):
    """(rule, seconds, rejected, judged) of each rule over a task's part of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, judged = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for _, offsets, data in text_chunks(batch.column(0)):
                texts = base_counts(data, offsets)
                texts = texts.only(np.flatnonzero(~base_fails(texts.counts, min_words, repeat_percent)))
                judged += len(texts.offsets) - 1
                for name, rule in rules.items():
                    readings = []
                    for _ in range(READINGS):
                        began = time.perf_counter()
                        bad = rule(texts)
                        readings.append(time.perf_counter() - began)
                    rejected[name] += int(bad.sum())
                    seconds[name] += min(readings)
        if judged:
            columns = [pa.array(list(rules)), pa.array(list(seconds.values())), pa.array(list(rejected.values())), pa.array([judged] * len(rules))]
            yield pa.RecordBatch.from_arrays(columns, names=["rule", "seconds", "rejected", "judged"])

    return run


def order_rules(docs: DataFrame, rules: dict[str, Callable[[Texts], np.ndarray]], min_words: int = 10, repeat_percent: int = 20, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejection per second on about `sample` documents; without any, as given."""
    rows = docs.count() if sample else 0
    if not rows:
        return list(rules)
    drawn = docs.select("text").sample(min(1.0, sample / rows), seed=17)
    measured = drawn.mapInArrow(_measure(rules, min_words, repeat_percent), "rule string, seconds double, rejected long, judged long")
    sums = {r.rule: r for r in measured.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}  # one row a rule
    return sorted(rules, key=lambda name: -(sums[name].rejected + 0.01) / (sums[name].seconds + 1e-9)) if sums else list(rules)


def _judge(rules: dict[str, Callable[[Texts], np.ndarray]], names: list[str], min_words: int, repeat_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_chunks(batch.column(1)):
                texts = base_counts(data, offsets)
                c = texts.counts
                failed = base_fails(c, min_words, repeat_percent)
                left = np.flatnonzero(~failed)
                reason = np.where(failed, "base", None)
                rest = texts.only(left) if failed.any() else texts
                for name in names:
                    if not len(left):
                        break
                    bad = rules[name](rest)
                    if bad.any():
                        reason[left[bad]] = name
                        keep = np.flatnonzero(~bad)
                        left, rest = left[keep], rest.only(keep)
                kept = np.zeros(len(failed), bool)
                kept[left] = True
                longs = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(failed)), *longs, pa.array(failed), pa.array(kept), pa.array(reason, pa.string())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"],
                )

    return run


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[Texts], np.ndarray]] | None = None, min_words: int = 10, repeat_percent: int = 20, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason.

    Base: fewer than `min_words` words, or over `repeat_percent` % of them in repeated 5-word windows. kept is
    false for those and for what a rule rejects; reason names the first that did (in the cascade's order). A
    null or empty text has no words and fails. Rows keep a null doc_id; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    names = order_rules(docs, rules, min_words, repeat_percent, sample)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge(rules, names, min_words, repeat_percent), schema)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """`docs` without those the rules reject, in one pass and no shuffle. A null or empty text is rejected; null and
    repeated doc_ids are of no matter, and other columns stay as they are."""
    names = order_rules(docs, RULES)
    judge = _judge(RULES, names, 10, 20)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the judge needs some id: the row's number serves
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["doc_id", "text"])
            kept = [x.column(7) for x in judge(iter([pair]))]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(run, docs.schema)
