"""Operator 6: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The labelled training rows (a bounded sample of them) fall by hash into three parts: the first teaches a
lexicon of words and of word beginnings by their log-odds, the second trains the trees on features that use
it, the third calibrates their output. So no part sees its own labels twice. Features are densities: lexicon
words, words beginning like toxic ones, their neighbourhood of second-person pronouns, capitals, punctuation,
and words that read as lexicon words only after common disguises are undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut
from tallyspark.llm.textnp import LOWER_BYTE_WORDS, SPACE, prefix_hash, span_hash, text_chunks, word_spans

#: At most about so many labelled rows teach the model; all rows below that.
MAX_LABELLED = 30_000
#: Most entries of each lexicon, and the least documents that an entry must be in.
LEXICON, MIN_DOCS = 2000, 4
#: Bytes that a word's beginning has.
STEMS = (4, 6)
#: Second-person pronouns of the four languages.
PRONOUNS = ("you", "your", "yours", "u", "ur", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "ihr", "euch", "usted", "ti", "tú", "vosotros")
#: Disguises of letters.
DISGUISES = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"}
NEAR = 5

_LETTERS = np.ones(256, bool)  # separators: ASCII that is no letter or digit
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PLAIN = np.arange(256, dtype=np.uint8)
for _dressed, _bare in DISGUISES.items():
    _PLAIN[ord(_dressed)] = ord(_bare)
_DISGUISE = _PLAIN != np.arange(256)
_CLASSES = {name: np.zeros(256, bool) for name in ("upper", "letter", "exclaim", "question", "marks", "digit")}
_CLASSES["upper"][65:91] = True
_CLASSES["letter"][[*range(65, 91), *range(97, 123)]] = True
_CLASSES["exclaim"][ord("!")] = _CLASSES["question"][ord("?")] = True
_CLASSES["marks"][[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CLASSES["digit"][48:58] = True
FEATURES = [
    "word_hits", "word_share", "word_weight", *(f"stem{n}_share" for n in STEMS), *(f"stem{n}_weight" for n in STEMS), "any_hit", "near_you", "you_share",
    "upper_share", "exclaim_rate", "question_rate", "mark_rate", "digit_rate", "disguised_share", "disguised_hits", "mean_word", "log_words",
]


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data, LOWER_BYTE_WORDS), starts, ends)


def _pronouns() -> np.ndarray:
    data = np.frombuffer(" ".join(PRONOUNS).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(_hash(data, starts, ends))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entry, toxic, n): documents of a batch that hold each word (kind 0) or beginning (kind: its bytes)."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for first, offsets, data in text_chunks(batch.column(0)):
            starts, ends, bounds = word_spans(data, offsets, _LETTERS)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            prefix = prefix_hash(data, LOWER_BYTE_WORDS)
            for kind in (0, *STEMS):
                keep = np.flatnonzero(ends - starts > kind) if kind else slice(None)
                entry = span_hash(prefix, starts[keep], starts[keep] + kind) if kind else span_hash(prefix, starts, ends)
                pairs = np.unique(np.stack([entry, row[keep].astype(np.uint64)]), axis=1)
                labels = toxic[first + pairs[1].astype(np.int64)]
                for label in (0, 1):
                    word, n = np.unique(pairs[0][labels == label], return_counts=True)
                    if len(word):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), kind, np.int32)), pa.array(word.view(np.int64)), pa.array(np.full(len(word), label, np.int32)), pa.array(n)], names=["kind", "entry", "toxic", "n"])


def learn_lexicon(labelled: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind → sorted entry hashes and their log-odds: the LEXICON entries that most tell toxic documents; `labelled` has text, toxic."""
    totals = labelled.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in totals}
    bad, good = size.get(1, 0), size.get(0, 0)
    counts = (
        labelled.select("text", F.col("toxic").cast("int")).mapInArrow(_entries, "kind int, entry long, toxic int, n long")
        .groupBy("kind", "entry").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    strength = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strong = counts.where(F.col("bad") >= MIN_DOCS).select("kind", "entry", odds.alias("odds"), strength.alias("strength")).where("odds > 1 and strength > 2.5")
    out = {}
    for kind in (0, *STEMS):
        rows = strong.where(F.col("kind") == kind).orderBy(F.desc("strength"), "entry").limit(LEXICON).select("entry", "odds").toArrow()
        entry, weight = rows.column("entry").to_numpy().view(np.uint64), rows.column("odds").to_numpy()
        order = np.argsort(entry)
        out[kind] = entry[order], weight[order]
    return out


def _weights(lexicon: tuple[np.ndarray, np.ndarray], entry: np.ndarray) -> np.ndarray:
    known, weight = lexicon
    if not len(known):
        return np.zeros(len(entry))
    at = np.minimum(np.searchsorted(known, entry), len(known) - 1)
    return np.where(known[at] == entry, weight[at], 0.0)


def _describe(lexicon: dict[int, tuple[np.ndarray, np.ndarray]]):
    pronouns = _pronouns()

    def chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        starts, ends, bounds = word_spans(data, offsets, _LETTERS)
        row = np.repeat(np.arange(rows), np.diff(bounds))
        prefix = prefix_hash(data, LOWER_BYTE_WORDS)
        words = span_hash(prefix, starts, ends)
        n = np.maximum(np.diff(bounds), 1)

        def per_row(values: np.ndarray) -> np.ndarray:
            return np.bincount(row, values, rows)

        weight = _weights(lexicon[0], words)
        hit = weight > 0
        stems = []
        for size in STEMS:
            longer = ends - starts > size
            w = np.zeros(len(words))
            w[longer] = _weights(lexicon[size], span_hash(prefix, starts[longer], starts[longer] + size))
            stems.append(w)
        stem_hit = np.logical_or.reduce([w > 0 for w in stems])
        you = np.isin(words, pronouns)
        close = np.zeros(len(words), bool)
        for shift in range(1, NEAR + 1):
            if len(words) > shift:
                same = row[shift:] == row[:-shift]
                close[shift:] |= you[:-shift] & same
                close[:-shift] |= you[shift:] & same
        total = {name: np.concatenate([[0], np.cumsum(flags[data])]) for name, flags in _CLASSES.items()}
        share = {name: t[offsets[1:]] - t[offsets[:-1]] for name, t in total.items()}
        size = np.maximum(np.diff(offsets), 1)
        # words by white space, disguises undone, that are lexicon words only then
        begins, stops, edges = word_spans(data, offsets, SPACE)
        dressed = np.concatenate([[0], np.cumsum(_DISGUISE[data])])
        odd = dressed[stops] > dressed[begins]
        begins, stops = begins[odd], stops[odd]
        owner = np.repeat(np.arange(rows), np.diff(edges))[odd]
        bare = _hash(_PLAIN[data], begins, stops)
        unmasked = _weights(lexicon[0], bare) * (_weights(lexicon[0], span_hash(prefix, begins, stops)) == 0)
        columns = [
            per_row(hit), per_row(hit) / n, per_row(weight) / n, *(per_row(w > 0) / n for w in stems), *(per_row(w) / n for w in stems), np.minimum(per_row(hit | stem_hit), 1),
            per_row((hit | stem_hit) & close) / n, per_row(you) / n, share["upper"] / np.maximum(share["letter"], 1), share["exclaim"] / size, share["question"] / size,
            share["marks"] / size, share["digit"] / size, np.bincount(owner, minlength=rows) / n, np.bincount(owner, unmasked > 0, rows), per_row(ends - starts) / n, np.log1p(np.diff(bounds)),
        ]
        return np.stack(columns, axis=1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_chunks(batch.column(1)):
                values = chunk(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(values)), pa.array(list(values), pa.list_(pa.float64()))], names=["doc_id", "features"])

    return run


def features(docs: DataFrame, lexicon: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, features): the FEATURES of each text as an array; those of a null or empty text are zeros."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_describe(lexicon), "doc_id long, features array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, train: str = "crc32(cast(doc_id as string)) % 3 <> 1", max_labelled: int = MAX_LABELLED, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (calibrated probability of toxic = 1), predicted.

    Labels come only from rows where the SQL condition `train` holds, at most about `max_labelled` of them (a
    sample by hash; all if there are no more). Without rows of both classes in each part every score is the
    share of toxic rows, 0 without any. Null and empty texts are scored by their zero features; null labels
    are left out, of repeated ones the largest counts. A row with a null doc_id counts as not held out.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    sampled = rows.where(draw < share * (1 << 20)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(10)))
    # bounded by max_labelled, so it may be broadcast
    known, docs = F.broadcast(sampled), docs.select("doc_id", "text")
    lexicon = learn_lexicon(docs.join(known, "doc_id").where("part < 5").select("text", "toxic"))
    held_out = F.coalesce(~F.expr(train), F.lit(False)).alias("held_out")
    described = cut(features(docs, lexicon))
    labelled = cut(described.join(known, "doc_id").select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "part"))
    counts = {(r["fit"], r["label"]): r["n"] for r in labelled.where("part >= 5").groupBy((F.col("part") < 8).alias("fit"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 4:
        rate = sampled.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return described.select("doc_id", held_out, F.lit(float(rate)).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"))
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=5, maxBins=32).fit(labelled.where("part between 5 and 7").coalesce(4))
    trees.setRawPredictionCol("raw").setProbabilityCol("p").setPredictionCol("tree")

    def margin(frame: DataFrame) -> DataFrame:
        return trees.transform(frame).withColumn("margin", vector_to_array("p")[1])

    calibrated = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margin(labelled.where("part >= 8")).select("margin", "label"))
    scored = calibrated.transform(margin(described.select("doc_id", array_to_vector("features").alias("features"))))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
