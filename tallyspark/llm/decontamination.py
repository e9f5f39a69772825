"""Operator 5: benchmark decontamination through a positional inverted index, in DataFrame functions only.

1. One pass counts, in the training texts, the terms that benchmark items use.
2. Each distinct window of an item (10 consecutive words) picks its two rarest terms; a window with a term that no
   text has cannot occur. The index stores the training postings (term, text, place) of all picked terms; postings
   of other terms would never be read.
3. Lists are offset-adjusted, the term's place in the text less its place in the item, and intersect by grouping
   on (text, item, shift): an exact phrase needs two of its picked terms at one shift (a one-word window: its only
   one). With `slop`, a posting stands for all shifts within it.
4. Each text verifies its shifts against its own words: runs of equal words of a window's length are phrase
   matches; with `slop`, a window whose words each stand within that distance of their places is a proximity
   match.

A text goes by the hash of its doc_id and itself, so that null and repeated ids are of no matter: rows that
shared a hash would share candidates, which each verifies on its own words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, fold

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark data up to this many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words(folded: Column) -> Column:
    """Words of a text already folded; the last entry may be an empty string, a null text gives null."""
    return F.split(F.regexp_replace(folded, "^" + SEPARATOR, ""), SEPARATOR)


def exact_words(text: str) -> Column:
    """The contract's words: A-Z lower-cased, no empty ones; none for a null text."""
    found = F.split(fold(F.coalesce(F.col(text), F.lit(""))), SEPARATOR)
    return F.filter(found, lambda w: w != "")


def _small(df: DataFrame, size: Column) -> bool:
    """Whether rows of `size` bytes each may be broadcast."""
    return df.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, item_words, width) of every item with a word; repeated items count once."""
    items = benchmark.where("item_id is not null").select("item_id", exact_words("text").alias("item_words")).where("size(item_words) > 0").distinct()
    return items.withColumn("width", F.least(F.lit(size), F.size("item_words")))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, width, start, words) of every distinct window of an item, at its first place."""
    cut_up = F.transform(F.expr("sequence(0, size(item_words) - width)"), lambda i: F.struct(i.alias("start"), F.slice("item_words", i + 1, F.col("width")).alias("words")))
    each = items.select("item_id", "width", F.explode(cut_up).alias("w"))
    return each.groupBy("item_id", "width", F.col("w.words").alias("words")).agg(F.min("w.start").alias("start"))


def _places(texts: DataFrame) -> DataFrame:
    """(key, pos, term) of every word."""
    return texts.select("key", F.posexplode(words(fold("text"))).alias("pos", "term"))


def term_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n) of the vocabulary's terms that occur; a large vocabulary meets counts, not words."""
    if _small(vocabulary, F.octet_length("term")):
        return _places(texts).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return _places(texts).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term")


def picked_terms(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, item_id, place, width): the two rarest terms of each window in which every term occurs somewhere."""
    places = windows.select("item_id", "width", "start", F.posexplode("words").alias("off", "term"))
    counts = term_counts(texts, places.select("term").distinct())
    ranked = (
        places.join(counts, "term", "left")
        .groupBy("item_id", "width", "start")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.sort_array(F.collect_list(F.struct("n", (F.col("start") + F.col("off")).alias("place"), "term"))).alias("terms"))
        .where("least > 0")
    )
    return ranked.select("item_id", "width", F.explode(F.slice("terms", 1, 2)).alias("t")).select("t.term", "item_id", "t.place", "width").distinct()


def positional_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos): the stored postings of `terms` (term) in `texts` (key, text)."""
    kept = F.broadcast(terms) if _small(terms, F.octet_length("term")) else terms
    return cut(_places(texts).join(kept, "term").select("term", "key", "pos"))


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, slop: int) -> DataFrame:
    """(row: the row of `docs`, n_words, found: array of (item_id, runs, near)) of every row."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.text").alias("text"), F.xxhash64("row.doc_id", "row.text").alias("key"))
    texts = rows.select("key", "text")
    items = cut(_items(benchmark, size))
    picked = cut(picked_terms(benchmark_windows(items), texts))
    index = positional_index(texts, picked.select("term").distinct())
    posted = index.join(F.broadcast(picked) if _small(picked, F.octet_length("term")) else picked, "term")
    if slop:
        posted = posted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    shifts = posted.groupBy("key", "item_id", (F.col("pos") - F.col("place")).alias("shift")).agg(F.count_distinct("place").alias("n"), F.min("width").alias("width"))
    found = shifts.where("n >= least(2, width)").groupBy("key", "item_id").agg(F.collect_list("shift").alias("shifts"))
    texts_of = F.broadcast(items) if _small(items, F.octet_length(F.array_join("item_words", " "))) else items
    candidates = found.join(texts_of, "item_id").groupBy("key").agg(F.collect_list(F.struct("item_id", "shifts", "item_words", "width")).alias("candidates"))
    joined = rows.join(candidates, "key", "left")
    # one struct binds the words, so that they are split once and not for each candidate
    bound = F.array(F.struct(exact_words("text").alias("w"), F.coalesce("candidates", F.array()).alias("c")))
    return joined.select("row", F.transform(bound, lambda b: F.struct(F.size(b.w).cast("long").alias("n_words"), F.transform(b.c, lambda c: _matches(b.w, c, slop)).alias("found")))[0].alias("v")).select("row", "v.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near_items.

    A document word is hit inside any occurrence of a benchmark window; an item of fewer words than `size`,
    but not none, is one window. items lists the items with occurring windows, sorted as strings.
    n_near_items counts items with a proximity match (those with a phrase match included): a window placed on
    the text so that each of its words stands within `slop` words of its place (equal words may share one); with
    slop 0 they are the same. Null texts have no words. Rows with a null or repeated doc_id are judged each by
    their own text; items with a null item_id are left out, repeated ones count once. Other columns are ignored.
    """
    found = _judged(docs.select("doc_id", "text"), benchmark, size, slop)
    hit = found.select("row.doc_id", "n_words", F.expr("filter(found, f -> size(f.runs) > 0)").alias("hit"), F.expr("array_distinct(transform(filter(found, f -> f.near), f -> f.item_id))").alias("near"))
    runs = F.array_sort(F.flatten(F.transform("hit", lambda f: f["runs"])))

    def cover(state: Column, r: Column) -> Column:
        begin = F.greatest(state["end"], r["from"])
        return F.struct(F.greatest(state["end"], r["to"]).alias("end"), (state["n"] + F.greatest(F.lit(0), r["to"] - begin)).alias("n"))

    covered = F.aggregate(runs, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)["n"]
    names = F.expr("array_sort(array_distinct(transform(hit, f -> cast(f.item_id as string))))")
    return hit.select(
        "doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"), names.alias("items"), F.size("near").cast("long").alias("n_near_items"),
    )


def _runs(flags: Column, width: Column) -> Column:
    """[from, to) of the maximal runs of true flags, `width` or longer; an array binds the flags."""

    def found(f: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(f) - 1)
        begins = F.filter(places, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i - 1), F.lit(False)))
        ends = F.filter(places, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i + 1), F.lit(False)))
        runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to")))
        return F.filter(runs, lambda r: r["to"] - r["from"] >= width)

    return F.element_at(F.transform(F.array(flags), found), 1)


def _matches(text_words: Column, c: Column, slop: int) -> Column:
    """The runs of text words inside a candidate item's windows, and whether one occurs within the slop."""

    def equal(shift: Column, within: int) -> Column:
        same = lambda w, i: reduce(or_, (F.coalesce(F.get(text_words, i + shift + by) == w, F.lit(False)) for by in range(-within, within + 1)))
        return F.transform(c["item_words"], same)

    moved = lambda shift: F.transform(_runs(equal(shift, 0), c["width"]), lambda r: F.struct((r["from"] + shift).alias("from"), (r["to"] + shift).alias("to")))
    runs = F.flatten(F.transform(c["shifts"], moved))
    near = F.exists(c["shifts"], lambda shift: F.size(_runs(equal(shift, slop), c["width"])) > 0) if slop else F.size(runs) > 0
    return F.struct(c["item_id"].alias("item_id"), runs.alias("runs"), near.alias("near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """`docs` without the rows in which a benchmark window occurs; null and repeated doc_ids, null texts and other
    columns are as in `decontaminate`: every row by its own text."""
    clean = _judged(docs, benchmark, size, 0).where(~F.exists("found", lambda f: F.size(f["runs"]) > 0))
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))
