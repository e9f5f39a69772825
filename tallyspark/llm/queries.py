"""The registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import chat_tree, conversation_repair, decontamination, jaccard_join, lm_scoring, merkle, packing, quality_rules, secrets, suffix_dedup, token_counts, toxicity, url_filter
from tallyspark.llm.common import cut, table
from tallyspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query under its function's name."""
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that also start earlier, removed."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by byte tokens into sequences of five permitted lengths."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("reason")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside occurrences of 10-word benchmark windows, and the items near by one word."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=1)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """The digest of conversations formatted through the prefix tree and read back from its layout, and of that layout."""
    paths = cut(chat_tree.conversation_paths(turns))
    back = chat_tree.read_back(paths, chat_tree.build_tree(paths))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = back.select(
        "leaf", "n", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "positions", "attended", "layout_sha256",
    )
    return chat_tree.conversations_of(paths, cut(digests))


@query
def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role)").withColumn("text", F.lit(text))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(turns.unionByName(extra))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram baseline and PPM code length of every document."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, and each document's number of links, of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public word-level BPE vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what its leaf, tampered or not, folds to along its proof."""
    proved = merkle.manifest(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    folded = proved.withColumn("folded_root", merkle.climbed(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
