"""Operator 9: exact n-gram Jaccard self-join by vertical partitioning.

A document is its set of distinct word shingles, as 64-bit hashes, whose numeric order is the global n-gram
order. Sizes fall into groups such that linked sets lie in one group or in neighbours. For each group the
order is cut into D + 1 + S fragments, where linked sets of that group differ in at most D shingles: so at
least S + 1 fragments are equal in both. A fragment with its content is a far rarer key than a shingle; and as
of S + 1 shared keys the rarest is never among a document's S most frequent ones, each document may leave
those out, which hold what passages and boilerplate lines have in common. The steps:

1. equal sets collapse to their smallest document;
2. rows (fragment key, document) are dealt by key and counted in sorted buckets; keys of one document drop
   out, and of the others each document leaves out its most frequent ones;
3. the documents of a key are routed to the smallest of them (and on to the smallest that this one is routed
   to, twice), so no pairs are emitted;
4. the sets of routed documents, fetched once, meet in blocks: a route of many documents becomes block
   pairs of bounded size. Where links are to be counted that is every two blocks, as many as the links of a large
   group; where components are enough, long routes are first settled through a few of their documents, and only
   the rest meets all;
5. in a block pair, overlaps are counted fragment by fragment of the global order and summed per pair. A pair
   that meets in several routes counts in the smallest; each document's number of links and a spanning forest
   of the links leave the task;
6. connected components of the forests, and the sums of the numbers, joined back to all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import connected_components, cut, join_uneven, numbered, partitions, repeated_ids
from tallyspark.llm.textnp import BYTE_WORDS, LOWER_BYTE_WORDS, mix64, prefix_hash, shingle_hashes, span_hash, text_chunks, word_spans

#: Fragments beyond D + 1, as a share of it, and how many of them may be empty in a set.
SPARE, EMPTY = 0.35, 0.55
#: Documents in a block, and distinct shingles whose overlaps are counted at once.
BLOCK, COLUMNS = 512, 4096
#: Documents of one key up to which they are counted; beyond, a key counts as the most frequent there is.
COUNTED = 1 << 20


@lru_cache(maxsize=8)
def size_groups(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the size groups, and the most shingles in which linked sets that meet there may differ."""
    ends, low = [], 1
    while low < 1 << 40:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends), np.array([2 * e * (den - num) // (den + num) for e in ends])


def spare(differ: int) -> tuple[int, int]:
    """Spare fragments of a group, and how many may be empty in a set whose empty fragments make no keys."""
    more = max(2, math.ceil(SPARE * (differ + 1)))
    return more, int(EMPTY * more)


def _sets(column: pa.Array, size: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row with a word."""
    for first, offsets, data in text_chunks(column):
        prefix = prefix_hash(data, LOWER_BYTE_WORDS if lower else BYTE_WORDS)
        starts, ends, bounds = word_spans(data, offsets)
        words = span_hash(prefix, starts, ends)
        for row in range(len(offsets) - 1):
            if bounds[row] < bounds[row + 1]:
                yield first + row, np.unique(shingle_hashes(words[bounds[row] : bounds[row + 1]], size))


def _signature(grams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(grams.sum(dtype=np.uint64).view(np.int64)), int(mix64(grams).sum(dtype=np.uint64).view(np.int64))


def _describe(size: int, lower: bool, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, differ = size_groups(num, den)
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            marks = np.zeros((2, batch.num_rows), np.int64)
            # how many of its most frequent keys a document leaves out, in the even and the odd one of its two groups
            leaves = np.zeros((2, batch.num_rows), np.int32)
            for row, grams in _sets(batch.column(1), size, lower):
                count[row] = len(grams)
                marks[:, row] = _signature(grams)
                group = int(np.searchsorted(ends, len(grams)))
                for number in (group, group + 1):
                    more, empty = spare(int(differ[number]))
                    leaves[number % 2, row] = more - empty
            columns = [batch.column(0), *(pa.array(x) for x in (count, *marks, *leaves))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "even", "odd"])

    return run


def _fragment_keys(grams: np.ndarray, number: int, differ: int) -> tuple[np.ndarray, bool]:
    """Keys of the filled fragments; with those of the empty ones, and true, if these are too many."""
    more, allowed = spare(differ)
    pieces = differ + 1 + more
    place = ((grams >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    filled = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    content = np.add.reduceat(mix64(grams), filled)
    salt = np.uint64(number * 1_000_003 + 1) * np.uint64(0x9E3779B1)
    keys = mix64(content ^ mix64(place[filled] + salt))
    many = pieces - len(filled) > allowed
    if many:
        empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), place[filled])
        keys = np.concatenate([keys, mix64(mix64(empty + salt) + np.uint64(1))])
    return keys, many


def _emit_keys(size: int, lower: bool, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, differ = size_groups(num, den)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            seen: set[tuple[int, int]] = set()
            keys, owners, held = [], [], 0
            for row, grams in _sets(batch.column(1), size, lower):
                group = int(np.searchsorted(ends, len(grams)))
                if not differ[group + 1] or (mark := _signature(grams)) in seen:
                    continue  # only an equal set can be linked, or this one has come already
                seen.add(mark)
                for number in (group, group + 1):
                    if differ[number]:
                        found, many = _fragment_keys(grams, number, int(differ[number]))
                        keys.append(found)
                        # the document, which of its groups, and whether it leaves no key out
                        owners.append(np.full(len(found), ids[row] * 4 + number % 2 * 2 + many))
                        held += len(keys[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "owner"])
                    keys, owners, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "owner"])

    return run


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, owner, n) of the keys with two rows or more in a bucket sorted by key; n is their number of rows."""
    held = np.zeros((2, 0), np.int64)  # the last key's rows, until its end is known
    frequent = None  # a key with more rows than are counted

    def out(keys: np.ndarray, owners: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (keep := n > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(owners[keep]), pa.array(n[keep])], names=["key", "owner", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owners = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
        if frequent is not None:
            more = keys == frequent
            yield from out(keys[more], owners[more], np.full(int(more.sum()), COUNTED + 1))
            keys, owners = keys[~more], owners[~more]
            if not len(keys):
                held = np.zeros((2, 0), np.int64)
                continue
            frequent = None
        end = int(np.searchsorted(keys, keys[-1]))
        held = np.stack([keys[end:], owners[end:]])
        fresh = np.ones(end, bool)
        fresh[1:] = keys[1:end] != keys[: end - 1] if end else True
        which = np.cumsum(fresh) - 1
        yield from out(keys[:end], owners[:end], np.bincount(which)[which] if end else which)
        if held.shape[1] > COUNTED:
            frequent = held[0, 0]
            yield from out(*held, np.full(held.shape[1], COUNTED + 1))
            held = np.zeros((2, 0), np.int64)
    yield from out(*held, np.full(held.shape[1], held.shape[1]))


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, hub) for each key of two documents or more in a bucket sorted by key and document."""
    key, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[0] = keys[0] != key
        first = np.flatnonzero(fresh)
        hubs = np.concatenate([[0 if hub is None else hub], docs[first]])[np.cumsum(fresh)]
        member = ~fresh & (docs != hubs)
        key, hub = keys[-1], hubs[-1]
        if member.any():
            owners = np.unique(hubs[member])
            pairs = np.unique(np.stack([np.concatenate([docs[member], owners]), np.concatenate([hubs[member], owners])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["rep", "hub"])


def _fetch(size: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blobs = [], []

            def out() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(blobs, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["rep", "copies", "hubs", "grams"])

            for row, grams in _sets(batch.column(1), size, lower):
                rows.append(row)
                blobs.append(grams.tobytes())
                if len(rows) >= 2000:
                    yield out()
                    rows, blobs = [], []
            if rows:
                yield out()

    return run


def partial_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all pairs: those of each fragment of the global order are counted apart and summed."""
    sizes = np.array([len(s) for s in sets])
    total = np.zeros((len(sets), len(sets)), np.float32)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return total
    column = np.unique(column, return_inverse=True)[1]
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        present = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        present[owner[part], column[part] - low] = 1
        total += present @ present.T
    return total


def _links(group: tuple[int, int, int], held: list[tuple[int, int, int, np.ndarray, np.ndarray]], num: int, den: int) -> np.ndarray:
    """Which documents of a block pair are linked, without the links that another group of theirs counts."""
    sets = [x[4] for x in held]
    sizes = np.array([len(s) for s in sets])
    inter = partial_overlaps(sets).astype(np.int64)
    linked = den * inter >= num * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(linked, False)
    # a pair meets in each of its common routes, and within one again wherever its common block goes
    hub, one, two = group
    if one != two:
        block = np.array([x[1] for x in held])
        linked &= block[:, None] != block[None, :]
    linked &= partial_overlaps([x[3][x[3] < hub] for x in held]) == 0
    return linked


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's documents."""
    todo, edges = set(range(len(ids))), []
    while todo:
        stack = [todo.pop()]
        while stack:
            at = stack.pop()
            for near in np.flatnonzero(linked[at]).tolist():
                if near in todo:
                    todo.discard(near)
                    edges.append((int(ids[at]), int(ids[near])))
                    stack.append(near)
    return edges


def _link_blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        group = None
        edges: list[tuple[int, int]] = []
        counts: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                linked = _links(group, held, num, den)
                ids = np.array([x[0] for x in held])
                edges.extend(_forest(ids, linked))
                number = linked @ np.array([x[2] for x in held])
                some = np.flatnonzero(number)
                counts.extend(zip(ids[some].tolist(), number[some].tolist()))

        for batch in batches:
            hubs, ones, twos, reps, blocks, copies = (batch.column(i).to_numpy() for i in range(6))
            routes, blobs = batch.column(6), batch.column(7)
            for row in range(batch.num_rows):
                here = (hubs[row], ones[row], twos[row])
                if here != group:
                    close()
                    held, group = [], here
                held.append((reps[row], blocks[row], copies[row], routes[row].values.to_numpy(), np.frombuffer(blobs[row].as_buffer(), np.uint64)))
            if len(edges) + len(counts) > 5000:
                yield _link_batch(edges, counts)
                edges, counts = [], []
        close()
        if edges:
            yield _link_batch(edges, counts)

    return run


def _link_batch(edges: list[tuple[int, int]], counts: list[tuple[int, int]]) -> pa.RecordBatch:
    """Links a < b, and below them (a, null, links): how many links of document a were found."""
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    node, links = np.array(counts, np.int64).reshape(-1, 2).T
    columns = [
        pa.array(np.concatenate([np.minimum(a, b), node])),
        pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(node), pa.int64())]),
        pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(links)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "links"])


def _settle(num: int, den: int):
    """Whether each row's set (grams) is linked with its route's present hub (first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, bool)
            for row in range(batch.num_rows):
                mine, first = (np.frombuffer(batch.column(i)[row].as_buffer(), np.uint64) for i in (2, 3))
                inter = len(np.intersect1d(mine, first, assume_unique=True))
                out[row] = den * inter >= num * (len(mine) + len(first) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["rep", "hub", "linked"])

    return run


#: Blocks from which a route is long: below, its block pairs cost less than the passes that settle it. Rounds in which
#: long routes are settled, and sets up to this many bytes that are broadcast as a hub's.
LONG_BLOCKS, SETTLE_ROUNDS, BROADCAST_SET = 16, 4, 16_384


def _settled(routes: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For components of long routes: routes (rep, hub, settled), and the links (a, b) found.

    In each round the smallest open document of a route is compared with all others of it; those linked with it
    are settled. Settled documents of one component need not be compared with each other; those of different
    components are, and what stays open is compared with every document of the route.
    """
    state, links = routes.withColumn("settled", F.lit(False)), None
    for _ in range(SETTLE_ROUNDS):
        firsts = state.groupBy("hub").agg(F.min(F.when(~F.col("settled"), F.col("rep"))).alias("first"), F.count(F.lit(1)).alias("members")).where("first is not null")
        if firsts.isEmpty():
            break
        first_sets = cut(firsts.join(sets.select(F.col("rep").alias("first"), F.col("grams").alias("first_grams")), "first").select("hub", "first", "first_grams", "members"))
        held = join_uneven(state.select("rep", "hub").join(sets.select("rep", "grams"), "rep"), first_sets, ["hub"], "members", F.col("rep"), F.octet_length("first_grams") <= BROADCAST_SET)
        judged = held.where("first is not null").select("rep", "hub", "grams", "first_grams").mapInArrow(_settle(num, den), "rep long, hub long, linked boolean")
        state = cut(state.join(judged.where("linked"), ["rep", "hub"], "left").select("rep", "hub", (F.col("settled") | F.coalesce("linked", F.lit(False))).alias("settled"), F.coalesce("linked", F.lit(False)).alias("now")))
        found = join_uneven(state.where("now"), first_sets.select("hub", "first", "members"), ["hub"], "members", F.col("rep")).select(F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")).where("a < b")
        links = found if links is None else links.union(found)
        state = state.drop("now")
    return state, links


def _components(texts: DataFrame, size: int, num: int, den: int, lower: bool, count_links: bool) -> DataFrame:
    """`jaccard_components` of texts (doc_id, text) with unique, non-null doc_ids."""
    n = partitions(texts)
    described = cut(texts.mapInArrow(_describe(size, lower, num, den), "doc_id long, n_shingles long, s1 long, s2 long, even int, odd int"))
    filled = described.where("n_shingles > 0")
    equal = filled.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    grouped = join_uneven(filled, equal, ["n_shingles", "s1", "s2"], "copies", F.col("doc_id"))
    empty = described.where("n_shingles = 0").withColumn("rep", F.col("doc_id")).withColumn("copies", F.lit(1).cast("long"))
    known = cut(grouped.unionByName(empty).select("doc_id", "n_shingles", "rep", "copies", "even", "odd"))

    keys = texts.mapInArrow(_emit_keys(size, lower, num, den), "key long, owner long")
    counted = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_count_keys, "key long, owner long, n long")
    # equal sets come once, as their smallest document
    split = counted.select("key", F.shiftright("owner", 2).alias("doc_id"), F.col("owner").bitwiseAND(F.lit(3)).alias("mark"), "n")
    owned = split.join(known, "doc_id").select("key", "rep", "mark", "n", F.when(F.col("mark") % 2 == 1, 0).when(F.col("mark") == 0, F.col("even")).otherwise(F.col("odd")).alias("leaves")).distinct()
    order = Window.partitionBy("rep", "mark").orderBy(F.desc("n"), F.desc("key"))
    rare = owned.withColumn("rank", F.row_number().over(order)).where("rank > leaves").select("key", "rep")
    routed = rare.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(_route, "rep long, hub long")
    routes = cut(routed.distinct())
    for _ in range(2):
        onward = routes.groupBy("rep").agg(F.min("hub").alias("to")).withColumnRenamed("rep", "hub")
        hubs = routes.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).join(onward, "hub", "left")
        routes = cut(join_uneven(routes, hubs, ["hub"], "members", F.col("rep")).select("rep", F.coalesce("to", "hub").alias("hub")).distinct())
    many = routes.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    placed = join_uneven(routes, many, ["hub"], "members", F.col("rep")).where("members > 1")
    listed = placed.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("hub").alias("hubs")).join(known.select("doc_id", "copies"), "doc_id")
    sets = texts.join(listed, "doc_id").select("doc_id", "text", "copies", "hubs").mapInArrow(_fetch(size, lower), "rep long, copies long, hubs array<long>, grams binary")
    # only components are wanted: most documents of a long route hang together through one of them. Documents of one
    # side are not compared with each other; side -1 is for those that are compared with all
    sided, direct = placed.withColumn("side", F.lit(-1).cast("long")), None
    if not count_links:
        is_long = F.col("members") > BLOCK * LONG_BLOCKS
        long = cut(placed.where(is_long).select("rep", "hub"))
        if not long.isEmpty():
            # their sets are fetched once for all rounds
            state, direct = _settled(long, cut(sets.join(long.select("rep").distinct(), "rep", "left_semi")), num, den)
            # documents settled by different first ones are of one side if links already join these
            direct = cut(direct)
            known_sides = connected_components(direct).withColumnRenamed("node", "rep")
            split = state.join(known_sides, "rep", "left").select("rep", "hub", F.when(F.col("settled"), F.coalesce("component", "rep")).otherwise(-1).alias("side"))
            sided = placed.where(~is_long).withColumn("side", F.lit(-1).cast("long")).unionByName(placed.where(is_long).join(split, ["rep", "hub"]))
    # documents of a route are numbered by hash into blocks, side by side, and every two blocks that are not of one settled side meet in one group
    per_side = sided.groupBy("hub", "side").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sides = Window.partitionBy("hub").orderBy("side")
    placed_sides = cut(per_side.select("hub", "side", "n", "blocks", (F.sum("blocks").over(sides) - F.col("blocks")).cast("int").alias("from"), F.sum("blocks").over(Window.partitionBy("hub")).cast("int").alias("all")))
    sized = join_uneven(sided.select("rep", "hub", "side"), placed_sides, ["hub", "side"], "n", F.col("rep"))
    at = F.col("from") + F.pmod(F.xxhash64("rep", "hub"), F.col("blocks").cast("long")).cast("int")
    own = F.when(F.col("side") >= 0, F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    meets = F.array_except(F.sequence(F.lit(0), F.col("all") - 1), own)
    meeting = sized.select("rep", "hub", at.alias("block"), meets.alias("meets")).withColumn("other", F.explode("meets")).select(
        "rep", "hub", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    met = meeting.join(sets, "rep").repartition(n, "hub", "one", "two").sortWithinPartitions("hub", "one", "two").select("hub", "one", "two", "rep", "block", "copies", "hubs", "grams")
    found = cut(met.mapInArrow(_link_blocks(num, den), "a long, b long, links long"))
    links = found.where("b is not null").select("a", "b")
    components = connected_components(links if direct is None else links.unionByName(direct))
    degrees = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_rep = known.where("rep = doc_id").select("rep", "copies").join(components.withColumnRenamed("node", "rep"), "rep", "left").join(degrees, "rep", "left").where("component is not null or links is not null")
    joined = join_uneven(known, of_rep.withColumnRenamed("copies", "weight"), ["rep"], "weight", F.col("doc_id"))
    number = F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if count_links else F.lit(None).cast("long")
    return joined.select("doc_id", "n_shingles", "rep", F.coalesce("component", "rep").alias("component_id"), number.alias("n_links"))


def _of_rows(rows: DataFrame, size: int, num: int, den: int, lower: bool, count_links: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (doc_id, text) whose doc_ids repeat: each row with its number, the numbers' doc_ids, and `_components` of
    the numbers: different texts under one doc_id are different documents."""
    each, names = numbered(rows)
    each = cut(each)
    return each, names, _components(each.select(F.col("row").alias("doc_id"), "text").dropDuplicates(["doc_id"]), size, num, den, lower, count_links)


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, lower: bool = True, count_links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, rep, component_id, n_links, for links with den * overlap >= num * union.

    Words are [^\\x20\\x09-\\x0D]+ (A-Z lower-cased if `lower`), shingles `size` consecutive words, or the
    whole sequence where there are fewer; a text that is null or has no words has no shingles and is linked
    with nothing. rep is the smallest document with an equal set, component_id the smallest document that
    links reach, n_links the number of other documents linked with this one, equal sets included; without
    `count_links` it is null, and long groups of near copies are joined through few of their documents. Different
    texts under one doc_id are different documents of that name; rows that repeat doc_id and text are one, and each
    gets its result. A row with a null doc_id has n_shingles, is linked with nothing and has null rep and
    component_id. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id is not null")
    if repeated_ids(rows):
        each, names, found = _of_rows(rows, size, num, den, lower, count_links)
        to = lambda c: names.select(F.col("row").alias(c), F.col("doc_id").alias(f"_{c}"))
        out = each.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("_doc_id")).join(found, "doc_id").join(to("rep"), "rep").join(to("component_id"), "component_id")
        out = out.select(F.col("_doc_id").alias("doc_id"), "n_shingles", F.col("_rep").alias("rep"), F.col("_component_id").alias("component_id"), "n_links")
    else:
        out = _components(named, size, num, den, lower, count_links)
    none = F.lit(None).cast("long")
    nameless = rows.where("doc_id is null").mapInArrow(_describe(size, lower, num, den), "doc_id long, n_shingles long, s1 long, s2 long, even int, odd int")
    return out.unionByName(nameless.select("doc_id", "n_shingles", none.alias("rep"), none.alias("component_id"), F.lit(0 if count_links else None).cast("long").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one document of each component left, the smallest; rows with a null doc_id stay. Different texts
    under one doc_id are different documents: each is kept or dropped by itself, and the rows that repeat both doc_id and
    text together. Other columns stay as they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not repeated_ids(rows):
        gone = jaccard_components(docs, size, num, den, count_links=False).where("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    each, _, found = _of_rows(rows, size, num, den, True, False)
    texts = each.select("row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")).distinct()
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("row")).join(texts, "row").select("_id", "_text")
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_text"]), "left_anti").select(docs.columns)
