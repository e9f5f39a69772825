"""Operator 1: removal of repeated byte strings through a distributed suffix array.

Every 100-byte window of a text holds an anchor: the 32-byte gram with the smallest hash in it, leftmost on
ties. Equal windows have equal anchors at equal places, so only the suffixes that start at windows of
anchors seen twice can repeat. The steps:

0. whole copies collapse to their first document, so a large group of copies costs one;
1. every text yields one row per anchor: the suffix's leading token (its first three bytes, then 40 bits of a
   fingerprint of the gram), its document, and the run of windows that it serves;
2. sampled splitters range-partition the suffixes by leading token, document and place (so a frequent token is
   spread over several buckets); in each sorted bucket anchors whose token differs from both neighbours
   drop out, while the tokens at a bucket's ends stay;
3. the remaining anchors fetch their bytes, are range-partitioned in the same manner, and each bucket sorts
   the suffixes by multikey quicksort over 8-byte words: first whole contexts, so that copies collapse, then
   the windows of those contexts that share a token but differ;
4. tokens that may straddle buckets are compared across the boundaries: each bucket reports the first
   window of each class under a 128-bit hash, and all but the earliest lose;
5. removed runs are merged per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, join_uneven, numbered, partitions, repeated_ids
from tallyspark.llm.textnp import BYTE_WORDS, mix64, prefix_hash, span_hash, text_chunks

GRAM = 32
#: Window starts handled at once; positions must fit in 24 bits.
SEGMENT = 1 << 22
GROUP_ROWS = 15_000
_POS_MASK = np.uint64((1 << 24) - 1)
#: A run is packed under the anchor's offset.
_RUN = (1 << 16) - 1


def _leading(data: np.ndarray, token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes' leading tokens in suffix order: three bytes, then 40 bits for the rest of the gram."""
    head = (data[at].astype(np.uint64) << np.uint64(16)) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | data[at + 2].astype(np.uint64)
    word = (head << np.uint64(40)) | (token[at] & np.uint64((1 << 40) - 1))
    return (word ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the bytes' order


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Per anchor: token, row, first window start (in its text), anchor's offset in it, number of further windows."""
    span = width - gram + 1
    n = len(data) - width + 1
    if n <= 0:
        return None
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    token = span_hash(prefix, at, at + gram)
    low = (token & ~_POS_MASK) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        rest = span - reach
        low = np.minimum(low[:-rest], low[rest:])
    place = (low[:n] & _POS_MASK).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + width <= offsets[row + 1]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return None
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    last = np.flatnonzero(stop)
    anchor = place[first]
    return _leading(data, token, anchor), row[first], first - offsets[row[first]], anchor - first, last - first


def _bucket(token: np.ndarray, doc: np.ndarray, splitters: np.ndarray) -> pa.Array:
    """The range that a leading token falls into; one that several splitters repeat spreads over all between, by the
    document's hash (ids may lie at equal distances)."""
    low, high = np.searchsorted(splitters, token, "left"), np.searchsorted(splitters, token, "right")
    return pa.array((low + (mix64(doc) % (high - low + 1).astype(np.uint64)).astype(np.int64)).astype(np.int32))


def _emit_anchors(width: int, gram: int, splitters: list[int]):
    cuts = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, offsets, data in text_chunks(batch.column(1)):
                # a very long text is taken in segments that overlap by a window less one byte
                for base in range(0, max(1, len(data)), SEGMENT):
                    piece = data[base : base + SEGMENT + width - 1]
                    inside = np.clip(offsets - base, 0, len(piece))
                    found = _anchors(piece, inside, width, gram)
                    if found is None:
                        continue
                    token, row, start, lead, run_length = found
                    start = start + np.maximum(base - offsets[row], 0)
                    doc = ids[first + row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(((lead << 16) + run_length).astype(np.int32)), _bucket(token, doc, cuts)],
                        names=["token", "doc_id", "start", "run", "bucket"],
                    )

    return run


def _keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted bucket whose token a neighbour shares, and its first and last row."""
    held, matched = None, False  # the last row waits for the batch after it
    for batch in batches:
        if not batch.num_rows:
            continue
        first = held is None
        rows = batch if first else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = rows.column(0).to_numpy()
        keep = np.zeros(len(token), bool)
        keep[0] = matched or first
        same = token[1:] == token[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        out = rows.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        held, matched = rows.slice(len(token) - 1), bool(keep[-1])
        if out.num_rows:
            yield out
    if held is not None:
        yield held


def _cut_contexts(width: int, splitters: list[int]):
    cuts = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.large_binary())
            for row in range(batch.num_rows):
                text = texts[row].as_buffer()
                anchors = batch.column(2)[row].values
                token, start, packed = (anchors.field(i).to_numpy() for i in range(3))
                stop = start + (packed & _RUN) + width
                for i in range(0, len(token), 20_000):
                    part = slice(i, i + 20_000)
                    pieces = [text[b:e].to_pybytes() for b, e in zip(start[part].tolist(), stop[part].tolist(), strict=True)]
                    docs = np.full(len(pieces), ids[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token[part]), pa.array(docs), pa.array(start[part]), pa.array(packed[part]), pa.array(pieces, pa.binary()), _bucket(token[part], docs, cuts)],
                        names=["token", "doc_id", "start", "run", "context", "bucket"],
                    )

    return run


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian word; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def _classes(group: np.ndarray, words: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Class ids of the strings data[at:at+length] within each group, by multikey quicksort.

    Each pass orders the still tied strings by their next 8 bytes (shorter strings end with an overlapping
    word); strings that no longer tie drop out. `group` must differ for strings of different length.
    """
    out = np.arange(len(group), dtype=np.int64)
    # ties: indices of the strings still tied, ordered by class
    order = np.argsort(group, kind="stable")
    label = group[order]
    depth = 0
    while True:
        fresh = np.ones(len(order), bool)
        fresh[1:] = label[1:] != label[:-1]
        number = np.cumsum(fresh) - 1
        counts = np.bincount(number)
        tied = counts[number] > 1
        order, number = order[tied], number[tied]
        if not len(order):
            return out
        done = depth * 8 >= length[order]
        if done.any():
            ended, which = order[done], number[done]
            head = np.ones(len(ended), bool)
            head[1:] = which[1:] != which[:-1]
            out[ended] = ended[head][np.cumsum(head) - 1]
            order, number = order[~done], number[~done]
            if not len(order):
                return out
        step = np.minimum(depth * 8, length[order] - 8)
        word = words[at[order] + step]
        by = np.lexsort((word, number))
        order, number, word = order[by], number[by], word[by]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (word[1:] != word[:-1])
        label = np.cumsum(fresh)
        depth += 1


def _resolve(rows: pa.RecordBatch, width: int, edge: np.ndarray):
    """Removed intervals, and the window classes left open, of complete token groups of one bucket.

    Rows are sorted by token, document and start; edge marks rows of tokens that other buckets may share.
    """
    token = rows.column(0).to_numpy()
    doc = rows.column(1).to_numpy()
    start = rows.column(2).to_numpy().astype(np.int64)
    packed = rows.column(3).to_numpy().astype(np.int64)
    lead, run = packed >> 16, packed & _RUN
    texts = rows.column(4).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    at = ends[:-1] - ends[0]
    words = _words8(data)
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    group = np.cumsum(fresh) - 1
    # copies: equal contexts with the anchor at the same place; the first of each class stands for all
    kind = _classes(((group << 16) + lead << 16) + run, words, at, run + width)
    copy = kind != np.arange(len(kind))
    removed = [(doc[copy], start[copy], start[copy] + run[copy] + width)]
    chosen = np.flatnonzero(~copy)
    several = np.bincount(group[chosen], minlength=group[-1] + 1)[group[chosen]] > 1
    chosen = chosen[several | edge[chosen]]
    opened = None
    if len(chosen):
        many = run[chosen] + 1
        owner = np.repeat(chosen, many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        where = at[owner] + step
        # windows can only be equal if their anchors are at the same place
        kind = _classes((group[owner] << 16) + (lead[owner] - step), words, where, np.full(len(owner), width))
        again = kind != np.arange(len(kind))
        removed.append(_runs(doc[owner], start[owner] + step, owner, again, width))
        left = np.flatnonzero(~again & edge[owner])
        if len(left):
            place = where[left]
            one = span_hash(prefix_hash(data), place, place + width)
            two = span_hash(prefix_hash(data, mix64(BYTE_WORDS)), place, place + width)
            opened = (one.view(np.int64), two.view(np.int64), doc[owner[left]], (start[owner] + step)[left])
    return [np.concatenate(x) for x in zip(*removed, strict=True)], opened


def _runs(doc, begin, owner, again, width):
    """Intervals of consecutive removed windows of one anchor."""
    at = np.flatnonzero(again)
    if not len(at):
        return doc[:0], begin[:0], begin[:0]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = at[head]
    last = at[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(at) - 1]])]
    return doc[first], begin[first], begin[last] + width


_ANCHOR = "token long, doc_id long, start int, run int"
_RESULT = "doc_id long, start int, stop int, h1 long, h2 long"


def _sort_bucket(width: int):
    def pack(removed, opened) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "stop", "h1", "h2"]
        doc, begin, end = removed
        if len(doc):
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), none, none], names=names)
        if opened is not None:
            one, two, doc, begin = opened
            begin = begin.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin), pa.array(begin + np.int32(width)), pa.array(one), pa.array(two)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, first_token = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first_token = batch.column(0)[0].as_py() if first_token is None else first_token
            held.append(batch)
            size += batch.num_rows
            last = batch.column(0)[batch.num_rows - 1].as_py()
            # the last token may go on in the next batch: only what lies before it is complete
            if size >= GROUP_ROWS and held[0].column(0)[0].as_py() != last:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                stop = int(np.searchsorted(rows.column(0).to_numpy(), last))
                done = rows.slice(0, stop)
                yield from pack(*_resolve(done, width, done.column(0).to_numpy() == first_token))
                held = [rows.slice(stop)]
                size = held[0].num_rows
        if size:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            token = rows.column(0).to_numpy()
            yield from pack(*_resolve(rows, width, (token == first_token) | (token == token[-1])))

    return run


#: Documents from which the splitters are drawn: at least so many, and so many a bucket; one in THIN of their
#: tokens comes to the driver.
SAMPLE_DOCS, SAMPLE_PER_BUCKET, THIN = 1000, 8, 8


def _splitters(texts: DataFrame, n: int, width: int, gram: int) -> list[int]:
    """n - 1 quantiles of the leading tokens of a bounded sample of documents; frequent tokens come several times."""
    rows = max(1, texts.count())
    share = min(1.0, max(SAMPLE_DOCS, SAMPLE_PER_BUCKET * n) / rows)
    sample = texts.sample(share, seed=1).mapInArrow(_emit_anchors(width, gram, []), _ANCHOR + ", bucket int")
    tokens = np.sort(sample.where(F.rand(7) < 1 / THIN).select("token").toArrow().column(0).to_numpy())
    return tokens[np.arange(1, n) * len(tokens) // n].tolist() if len(tokens) else []


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """The rows in their buckets, sorted by token, document and place."""
    return rows.repartitionById(n, "bucket").drop("bucket").sortWithinPartitions("token", "doc_id", "start")


def later_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, size in bytes) of every document whose whole text a smaller doc_id has too; a text may have any share of
    the documents."""
    marked = texts.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size")).where("text is not null")
    firsts = cut(marked.groupBy("sha", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    found = join_uneven(marked, firsts, ["sha", "size"], "copies", F.col("doc_id"))
    return found.where("doc_id > first").select("doc_id", "size")


def _texts(docs: DataFrame) -> DataFrame:
    """The rows with a doc_id; all steps read them in this one form, so that Spark shuffles the texts once."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")


def repeated_spans(docs: DataFrame, width: int = 100, gram: int = GRAM) -> DataFrame:
    """(doc_id, cuts: array of (start, stop)): byte ranges of `docs` (doc_id, text) covered by a `width`-byte
    string that also starts earlier: in a smaller doc_id, or earlier in the same document. Ranges may overlap.

    Null and short texts have none; rows with a null doc_id are left out. doc_id must be unique.
    """
    n = partitions(docs)
    texts = _texts(docs)
    # whole copies collapse first: a later one repeats every window of the first, and the first alone stands for it
    copies = later_copies(texts)
    unique = texts.join(copies.select("doc_id"), "doc_id", "left_anti")
    splitters = _splitters(texts, n, width, gram)
    anchors = unique.mapInArrow(_emit_anchors(width, gram, splitters), _ANCHOR + ", bucket int")
    tied = _dealt(anchors, n).mapInArrow(_keep_repeated, _ANCHOR)
    wanted = tied.groupBy("doc_id").agg(F.collect_list(F.struct("token", "start", "run")).alias("anchors"))
    contexts = unique.join(wanted, "doc_id").mapInArrow(_cut_contexts(width, splitters), _ANCHOR + ", context binary, bucket int")
    found = _dealt(contexts, n).mapInArrow(_sort_bucket(width), _RESULT)
    # removed ranges gather by document; of a class left open at most one row a bucket gathers, and its first stays
    certain = F.col("h1").isNull()
    gathered = found.groupBy(F.when(certain, F.col("doc_id")).alias("owner"), "h1", "h2").agg(F.collect_list(F.struct("doc_id", "start", "stop")).alias("rows"))
    lost = F.when(F.col("owner").isNull(), F.slice(F.sort_array("rows"), F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    ranges = gathered.select(F.explode(lost).alias("x")).select("x.*")
    whole = copies.where(F.col("size") >= width).select("doc_id", F.lit(0).alias("start"), F.col("size").alias("stop"))
    return ranges.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        texts = batch.column(1).cast(pa.large_binary())
        total, removed, spans, digest = [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            cuts = batch.column(2)[i].as_py() or []
            runs: list[list[int]] = []
            for begin, end in sorted((x["start"], x["stop"]) for x in cuts):
                if runs and begin <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([begin, end])
            left, at = [], 0
            for begin, end in runs:
                left.append(text[at:begin])
                at = end
            left.append(text[at:])
            rest = b"".join(left)
            total.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _numbered_spans(docs: DataFrame, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text, all columns as struct `whole`) with a row number each that rises with doc_id, and their
    spans by row number: the documents' ids where these are unique, else numbers that rows of one id and text share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("whole")).where("doc_id is not null")
    if not repeated_ids(rows.select("doc_id")):
        return rows.withColumn("row", F.col("doc_id")), repeated_spans(docs, width, gram)
    each, _ = numbered(rows.select("doc_id", "text"))
    named = each.select("row", "doc_id", F.xxhash64("text").alias("_h")).distinct()
    one = cut(each.dropDuplicates(["row"]).select(F.col("row").alias("doc_id"), "text"))
    return rows.withColumn("_h", F.xxhash64("text")).join(named, ["doc_id", "_h"]).drop("_h"), repeated_spans(one, width, gram)


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 after `repeated_spans` are cut out.

    A null text counts as empty, a row with a null doc_id repeats nothing; of an empty table nothing comes
    back. Different texts under one doc_id are documents one after the other, in the order of a hash; rows that
    repeat doc_id and text are one document, and each gets its result. Other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    texts = _texts(docs)
    if repeated_ids(texts):
        rows, spans = _numbered_spans(docs.select("doc_id", "text"), width, gram)
        cuts = rows.join(spans.withColumnRenamed("doc_id", "row"), "row", "left")
    else:
        cuts = texts.join(repeated_spans(docs, width, gram), "doc_id", "left")
    done = cuts.select("doc_id", "text", "cuts").mapInArrow(_cut_out, schema)
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("cuts"))
    return done.unionByName(unnamed.mapInArrow(_cut_out, schema))


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = GRAM) -> DataFrame:
    """`docs` with `text` replaced by its kept bytes; bytes cut inside a character are dropped with it. Null texts, null
    and repeated doc_ids as in `suffix_dedup`; other columns, whatever their names, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is not None and cuts:
                    keep = np.ones(len(raw := text.encode()), bool)
                    for x in cuts:
                        keep[x["start"] : x["stop"]] = False
                    text = np.frombuffer(raw, np.uint8)[keep].tobytes().decode(errors="ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["whole", "kept"])

    rows, spans = _numbered_spans(docs, width, gram)
    whole = docs.select(F.struct("*").alias("whole")).schema["whole"].dataType.simpleString()
    cleaned = rows.join(spans.withColumnRenamed("doc_id", "row"), "row", "left").select("whole", "text", "cuts").mapInArrow(run, f"whole {whole}, kept string")
    unnamed = docs.where("doc_id is null").select(F.struct("*").alias("whole"), F.col("text").alias("kept"))
    return cleaned.unionByName(unnamed).select(*(F.col("kept").alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns))
