"""Operator 8: document scoring by prediction by partial matching over byte contexts.

The pretrained model is the trie of all byte contexts up to length `order` in the training texts, with escape
method C and symbol exclusion. Since the symbols seen after a context are among those seen after its suffix,
excluded totals follow from the trie alone, and the probability of a byte is a function of the gram that it
forms with its context. So each distinct gram is worked out once and looked up by whoever holds it:

1. documents are dealt into batches by hash; each batch asks once for each of its distinct grams and words, so
   a frequent one costs a row a batch and not one a document;
2. counts are summed by gram; the grams of a three-byte context meet in one task (with order 4, 2**16 at most),
   where the orders from three up are worked out; what escapes further takes the table of orders two and less,
   which has 2**24 counts at most whatever the corpus and so may be broadcast;
3. the answers are joined back to the batches that asked, and each scores its documents.

The number of grams grows with the corpus; nothing of theirs passes the driver. Words go the same way: a
unigram baseline needs the corpus count of every word of every document. `AdaptivePpm` is the adaptive form,
for any order, which learns while it codes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions
from tallyspark.llm.textnp import LOWER_BYTE_WORDS, prefix_hash, span_hash, text_chunks, word_spans

#: Bytes that UTF-8 never uses stand for the places before a text and for its end.
START, END = 0xFE, 0xFF
#: Documents and bytes of a batch, as expected of the hash that deals them; a longer text makes its batch longer.
BATCH_DOCS, BATCH_BYTES = 4000, 32 << 20
END_TOKEN = np.uint64(0x0E0D_0E0D_0E0D_0E0D)


# the pretrained model


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte and at the end of each text, and where each text's begin. A gram is its context from
    the last byte back, then its symbol: grams of one short context follow one another in numeric order."""
    sizes = np.diff(offsets)
    begin = np.concatenate([[0], np.cumsum(sizes + order + 1)])
    wide = np.full(begin[-1], START, np.uint8)
    wide[np.arange(len(data)) + np.repeat(begin[:-1] + order - offsets[:-1], sizes)] = data
    wide[begin[1:] - 1] = END
    out = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbol = np.arange(out[-1]) + np.repeat(begin[:-1] + order - out[:-1], sizes + 1)
    code = np.zeros(len(symbol), np.int64)
    for back in (*range(1, order + 1), 0):
        code = (code << 8) | wide[symbol - back]
    return code, out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).filter(batch.column(1))
        for _, offsets, data in text_chunks(texts, 1 << 22):
            code, count = np.unique(_codes(data, offsets, 2)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(count)], names=["code", "n"])


def code_table(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's row for each two-byte context, and the table: log10 probability of each byte. The first 256
    rows serve contexts that the training texts do not have, by their last byte."""
    codes = codes.astype(np.int64)
    c1 = np.bincount((codes >> 16 << 8) | (codes & 0xFF), counts, 1 << 16).reshape(256, 256)
    c0 = c1.sum(0)
    seen0 = c0 > 0
    p_minus = np.where(seen0, 0.0, 1.0 / max(1, 256 - seen0.sum()))
    # order 0 after exclusion of what each order-1 context has seen, then order 1
    seen1 = c1 > 0
    left = np.where(seen1, 0.0, c0)
    total, kinds = left.sum(1), (left > 0).sum(1)
    p0 = _mix(left, total, kinds, p_minus[None, :])
    t1, d1 = c1.sum(1), seen1.sum(1)
    p1 = _mix(c1, t1, d1, p0)
    contexts = np.unique(codes >> 8)
    row = contexts >> 8
    index = np.arange(1 << 16) >> 8  # an unseen context falls to its last byte's row
    table = np.empty((256 + len(contexts), 256), np.float32)
    table[:256] = np.log10(p1)
    index[contexts] = 256 + np.arange(len(contexts))
    where = np.searchsorted(contexts, codes >> 8)
    for low in range(0, len(contexts), 4096):
        part = slice(low, low + 4096)
        last = row[part]
        inside = (where >= low) & (where < low + 4096)
        c2 = np.zeros((len(last), 256))
        c2[where[inside] - low, codes[inside] & 0xFF] = counts[inside]
        seen2 = c2 > 0
        left1 = np.where(seen2, 0.0, c1[last])
        p = _mix(left1, left1.sum(1), (left1 > 0).sum(1), p0[last])
        table[256 + low : 256 + low + len(last)] = np.log10(_mix(c2, c2.sum(1), seen2.sum(1), p))
    return index.astype(np.int32), table


def _mix(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Escape method C: seen symbols get their share, the others what `lower` says times the escape's."""
    whole = np.maximum(total + kinds, 1)[:, None]
    escape = np.where(total > 0, kinds, 1)[:, None] / np.where(total > 0, total + kinds, 1)[:, None]
    with np.errstate(divide="ignore"):
        return np.where(count > 0, count / whole, escape * lower)


class LowOrders:
    """Orders two and less: what a gram's probability takes from them once longer contexts have escaped."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes.astype(np.int64), counts.astype(np.float64)
        self.index, self.table = code_table(self.codes, self.counts)
        self.total = np.bincount(self.codes >> 8, self.counts, 1 << 16)
        self.kinds = np.bincount(self.codes >> 8, minlength=1 << 16)

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Of trigrams."""
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0.0)

    def excluding(self, codes: np.ndarray, count: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """log10 probability of trigrams with that count, without symbols of so much mass and so many kinds."""
        context = codes >> 8
        total, all_kinds = self.total[context], self.kinds[context]
        left, left_kinds = total - mass, all_kinds - kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(left_kinds > 0, np.log10(left_kinds / (left + left_kinds)), 0.0)
            usual = np.where(all_kinds > 0, np.log10(all_kinds / (total + all_kinds)), 0.0)
            seen = np.log10(count / (left + left_kinds))
        return np.where(count > 0, seen, self.table[self.index[context], codes & 0xFF] - usual + escape)


def gram_probabilities(codes: np.ndarray, n: np.ndarray, order: int, low: LowOrders) -> np.ndarray:
    """log10 probability of each of the sorted distinct grams, of which the training texts have n; all grams of a
    three-byte context are among them, or none."""
    symbol, trigram = codes & 0xFF, (codes >> (8 * (order - 1)) << 8) | (codes & 0xFF)
    counts, firsts = {2: low.count(trigram)}, {}
    for m in range(3, order + 1):
        _, first, where = np.unique((codes >> (8 * (order - m + 1)) << 8) | symbol, return_index=True, return_inverse=True)
        counts[m] = np.bincount(where, n)[where]
        firsts[m] = np.zeros(len(codes), bool)
        firsts[m][first] = True
    out, done = np.zeros(len(codes)), np.zeros(len(codes), bool)
    mass, gone = np.zeros(len(codes)), np.zeros(len(codes))
    for m in range(order, 2, -1):
        context = codes >> (8 * (order - m + 1))
        which = np.cumsum(np.concatenate([[False], context[1:] != context[:-1]]))
        seen = firsts[m] & (counts[m] > 0)
        kinds, total = np.bincount(which, seen)[which], np.bincount(which, n)[which]
        left, left_kinds = total - mass, kinds - gone
        hit = ~done & (counts[m] > 0)
        out[hit] += np.log10(counts[m][hit] / (left + left_kinds)[hit])
        done |= hit
        escape = ~done & (left_kinds > 0)
        out[escape] += np.log10(left_kinds[escape] / (left + left_kinds)[escape])
        # what this context has seen is excluded from its suffix's
        mass, gone = np.bincount(which, np.where(seen, counts[m - 1], 0.0))[which], kinds
    return np.where(done, out, out + low.excluding(trigram, counts[2], mass, gone))


def _learn(model, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # the last three-byte context's grams, until its end is known

        def out(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(codes):
                value = gram_probabilities(codes, n, order, model.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(codes), bool)), pa.array(codes), pa.array(value)], names=["word", "key", "value"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
            if held.shape[1]:
                context = held[0] >> (8 * (order - 2))
                end = int(np.searchsorted(context, context[-1]))
                yield from out(*held[:, :end])
                held = held[:, end:]
        yield from out(*held)

    return run


class AdaptivePpm:
    """PPM with escape method C and exclusion that learns each byte after coding it; order as given."""

    def __init__(self, order: int = 3):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(dict)

    def probability(self, context: bytes, symbol: int) -> float:
        """Of the symbol after the last `order` bytes of context."""
        out, excluded = 1.0, set()
        for n in range(min(self.order, len(context)), -1, -1):
            seen = {s: c for s, c in self.counts.get(context[len(context) - n :], {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return out * seen[symbol] / total
            out *= len(seen) / total
            excluded |= set(seen)
        return out / (256 - len(excluded))

    def learn(self, context: bytes, symbol: int) -> None:
        """Count the symbol after every suffix of the context up to the order."""
        for n in range(min(self.order, len(context)) + 1):
            row = self.counts[context[len(context) - n :]]
            row[symbol] = row.get(symbol, 0) + 1

    def score(self, text: bytes, learn: bool = True) -> float:
        """log10 probability of a text and its end."""
        padded, out = bytes([START] * self.order) + text + bytes([END]), 0.0
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            out += math.log10(self.probability(context, padded[i]))
            if learn:
                self.learn(context, padded[i])
        return out


def score_adaptive(docs: DataFrame, order: int = 3) -> DataFrame:
    """Per document: doc_id, score: the code length of the text alone, by a model that starts empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [AdaptivePpm(order).score((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


# words


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's begin, offsets, bytes) of runs of rows."""
    for first, offsets, data in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets)
        yield first, span_hash(prefix_hash(data, LOWER_BYTE_WORDS), starts, ends), bounds, offsets, data


def _batch_keys(order: int):
    """(word, key, packed): each batch's distinct words and grams, packed being the batch << 32 and their count in its
    training texts."""

    def rows(number: int, word: bool, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 50_000):
            s = slice(i, i + 50_000)
            columns = [np.full(len(keys[s]), word), keys[s], (np.int64(number) << 32) | n[s].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "key", "packed"])

    def out(number: int, held: dict[bool, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for word, parts in held.items():
            keys, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            yield from rows(number, word, keys, np.bincount(where, np.concatenate([x[1] for x in parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, {True: [], False: []}
        for batch in batches:
            numbers = batch.column(3).to_numpy()
            for here in np.unique(numbers):
                if number is not None and here != number:
                    yield from out(number, held)
                    held = {True: [], False: []}
                number = here
                texts = batch.filter(pa.array(numbers == here))
                train = texts.column(2).to_numpy(zero_copy_only=False)
                for first, found, bounds, offsets, data in _tokens(texts.column(1)):
                    learned = train[first : first + len(bounds) - 1]
                    word, where = np.unique(found, return_inverse=True)
                    n = np.bincount(where, np.repeat(learned, np.diff(bounds)), len(word))
                    held[True].append((np.append(word, END_TOKEN).view(np.int64), np.append(n, learned.sum())))
                    code, begin = _codes(data, offsets, order)
                    marked, n = np.unique((code << 1) | np.repeat(learned, np.diff(begin)), return_counts=True)
                    held[False].append((marked >> 1, n * (marked & 1)))
        if number is not None:
            yield from out(number, held)

    return run


def _score_batch(order: int):
    def sorted_answers(answers: pa.Table, word: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        mine = answers.filter(word)
        keys = mine.column("key").to_numpy()
        by_key = np.argsort(keys)
        return keys[by_key], mine.column("value").to_numpy()[by_key]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        word = answers.column("word")
        known, count = sorted_answers(answers, word)
        grams, chances = sorted_answers(answers, pc.invert(word))
        logs = np.log10(count + 0.1)
        at_end = np.searchsorted(known, END_TOKEN.view(np.int64))
        ids, n_tokens, n_known, bases, scores = docs.column("doc_id"), [], [], [], []
        for _, words, bounds, offsets, data in _tokens(docs.column("text")):
            place = np.searchsorted(known, words.view(np.int64))
            for values, out in ((logs[place], bases), ((count[place] > 0).astype(np.int64), n_known)):
                total = np.concatenate([[0], np.cumsum(values)])
                end = logs[at_end] if out is bases else int(count[at_end] > 0)
                out.append(total[bounds[1:]] - total[bounds[:-1]] + end)
            n_tokens.append(np.diff(bounds) + 1)
            code, begin = _codes(data, offsets, order)
            total = np.concatenate([[0.0], np.cumsum(chances[np.searchsorted(grams, code)])])
            scores.append(total[begin[1:]] - total[begin[:-1]])
        return pa.table(
            {
                "doc_id": ids, "held_out": pc.invert(docs.column("train")),
                "n_tokens": np.concatenate(n_tokens).astype(np.int64), "n_known": np.concatenate(n_known).astype(np.int64),
                "base": np.concatenate(bases), "score": np.concatenate(scores),
            }
        )

    return run


def score_documents(docs: DataFrame, train: str = "crc32(cast(doc_id as string)) % 10 <> 0", order: int = 4) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model and the baseline learn from the rows where the SQL condition `train` holds; where it is null the
    row is held out. Tokens of the baseline are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then an end; a
    null text counts as empty. score is the log10 probability of the text's bytes and their end under the
    pretrained model with contexts of `order` bytes, 3 to 6. Other columns are ignored. `docs` is read several times and
    must give its rows in the same partitions each time, as a table does.
    """
    if not 3 <= order <= 6:
        raise ValueError("order must be 3 to 6")
    spark, n = docs.sparkSession, partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    counted = texts.select("text", "train").mapInArrow(_count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    trigrams = counted.toArrow()
    codes, counts = trigrams.column("code").to_numpy(), trigrams.column("n").to_numpy()
    by_code = np.argsort(codes)
    low = spark.sparkContext.broadcast(LowOrders(codes[by_code], counts[by_code]))

    size = texts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    batches = max(1, -(-size.docs // BATCH_DOCS), -(-size.bytes // BATCH_BYTES))
    # by the row's number, which a table's rows have again whenever it is read: null and repeated ids are spread like others
    dealt = texts.withColumn("batch", F.expr(f"cast(pmod(xxhash64(doc_id, monotonically_increasing_id()), {batches}) as int)")).repartition(n, "batch")
    asked = dealt.sortWithinPartitions("batch").mapInArrow(_batch_keys(order), "word boolean, key long, packed long").repartition(n, "word", "key")
    # all that reads this shuffle needs all of its columns, and filters on a maximum, which can't go below it: one shuffle
    summed = asked.groupBy("word", "key").agg(F.sum(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n"), F.max("word").alias("is_word"))
    words = summed.where("is_word")
    grams = summed.where("not is_word").select("key", "n").repartition(n, F.shiftright("key", 8 * (order - 2))).sortWithinPartitions("key")
    values = words.select("word", "key", F.col("n").cast("double").alias("value")).union(grams.mapInArrow(_learn(low, order), "word boolean, key long, value double"))
    answers = asked.join(values, ["word", "key"]).select(F.shiftright("packed", 32).cast("int").alias("batch"), "word", "key", "value")
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        lambda left, right: _score_batch(order)(left, right), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count_if(F.col("n") > 0).alias("kinds"))
    rows = scored.crossJoin(F.broadcast(sums))  # one row, always
    base = F.col("base") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("kinds") + 1))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
