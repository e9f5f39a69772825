"""What users and runs do to the tables: matches, the receipts' states and the audit trail change together.

Each action is a pure function: tables and a command in, a dictionary of changed tables and new audit rows out.
Audit rows: org, actor, action, entity_type, entity_id (text), detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.config import Config, MatchingConfig
from tallyspark.functions.money import number_text
from tallyspark.functions.tables import SYSTEM_CATEGORIES
from tallyspark.functions.text import let, normalize_merchant
from tallyspark.operators import runs
from tallyspark.operators.assign import duplicate_edges
from tallyspark.session import cut, stored
from tallyspark.operators.lists import IN_PROGRESS
from tallyspark.operators.reads import OFFERED

SYSTEM = "System"


def audit_rows(rows: DataFrame, action: Column | str, entity_type: str, entity: Column, detail: Column | None = None, actor: str = SYSTEM) -> DataFrame:
    """An audit row for each of `rows` (org, …)."""
    said = F.lit(None).cast("string") if detail is None else detail
    what = F.lit(action) if isinstance(action, str) else action
    return rows.select("org", F.lit(actor).alias("actor"), what.alias("action"), F.lit(entity_type).alias("entity_type"), entity.cast("string").alias("entity_id"), said.alias("detail"))


def match_key() -> Column:
    """A pair's name in the trail."""
    return F.concat_ws(":", F.col("r_id").cast("string"), F.col("t_id").cast("string"))


def set_status(receipts: DataFrame, changes: DataFrame) -> DataFrame:
    """`receipts` with the states of `changes` (org, id, status), one row a receipt."""
    new = changes.select("org", "id", F.col("status").alias("_new"))
    return receipts.join(new, ["org", "id"], "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def _states(pairs: DataFrame, status: Column | str) -> DataFrame:
    return pairs.select("org", F.col("r_id").alias("id"), (F.lit(status) if isinstance(status, str) else status).alias("status")).distinct()


def confirm(matches: DataFrame, receipts: DataFrame, chosen: DataFrame, actor: str) -> dict[str, DataFrame]:
    """The chosen pairs (org, r_id, t_id) confirmed: rivals go, their receipts are completed."""
    mine = matches.join(chosen.select("org", "r_id", "t_id").distinct(), ["org", "r_id", "t_id"], "left_semi")
    detail = F.concat(F.lit("receipt "), F.col("r_id").cast("string"), F.lit(" ↔ transaction "), F.col("t_id").cast("string"), F.lit(" at "), number_text(F.col("score")), F.lit("%"))
    return {"matches": runs.confirm(matches, mine), "receipts": set_status(receipts, _states(mine, "completed")), "audit": audit_rows(mine, "match.confirmed", "match", match_key(), detail, actor)}


def reject(matches: DataFrame, receipts: DataFrame, chosen: DataFrame, actor: str) -> dict[str, DataFrame]:
    """The chosen pairs as tombstones; a receipt with another offer needs review, else it is completed."""
    mine = matches.join(chosen.select("org", "r_id", "t_id").distinct(), ["org", "r_id", "t_id"], "left_semi")
    after = runs.reject(matches, mine)
    other = after.where(F.col("status").isin(*OFFERED)).select("org", "r_id", F.lit(True).alias("_more")).distinct()
    states = mine.select("org", "r_id").distinct().join(other, ["org", "r_id"], "left")
    return {"matches": after, "receipts": set_status(receipts, _states(states, F.when(F.col("_more"), "needs_review").otherwise("completed"))), "audit": audit_rows(mine, "match.rejected", "match", match_key(), None, actor)}


def match_by_hand(matches: DataFrame, receipts: DataFrame, scored: DataFrame, actor: str) -> dict[str, DataFrame]:
    """Pairs chosen by hand and scored (org, r_id, t_id, score), confirmed; a pair already there keeps its score."""
    known = matches.select("org", "r_id", "t_id", F.col("score").alias("_old"))
    pairs = scored.select("org", "r_id", "t_id", F.col("score").alias("_seen")).distinct().join(known, ["org", "r_id", "t_id"], "left").withColumn("score", F.coalesce("_old", "_seen"))
    detail = F.concat(F.lit("manually matched at "), number_text(F.col("_seen")), F.lit("%"))
    return {"matches": runs.match_by_hand(matches, pairs), "receipts": set_status(receipts, _states(pairs, "completed")), "audit": audit_rows(pairs, "match.manual", "match", match_key(), detail, actor)}


def unlink(matches: DataFrame, receipts: DataFrame, chosen: DataFrame, actor: str) -> dict[str, DataFrame]:
    """The chosen pairs gone, their receipts completed."""
    mine = matches.join(chosen.select("org", "r_id", "t_id").distinct(), ["org", "r_id", "t_id"], "left_semi")
    return {"matches": runs.unlink(matches, mine), "receipts": set_status(receipts, _states(mine, "completed")), "audit": audit_rows(mine, "match.unlinked", "match", match_key(), None, actor)}


def matching_run(receipts: DataFrame, transactions: DataFrame, matches: DataFrame, config: Config = MatchingConfig(), similarity=None, provider=None) -> dict[str, DataFrame]:
    """A run over all unlocked receipts: matches, receipts (best pairs: completed or needs_review, without pair:
    unmatched), audit of the best pairs, and stats by organization: receipts and transactions considered, pairs scored
    (of any class, before the assignment), pairs kept, semantic (receipts whose undecided names were asked for), best
    pairs by class (auto, review, possible), and receipts left unmatched."""
    considered = runs.unlocked(receipts, transactions, matches)
    scored = runs.score_run(*considered, config, similarity, provider)
    proposals = stored(runs.assign_run(scored, matches))
    locked = matches.where("status in ('confirmed', 'auto')").select("org", F.col("r_id").alias("id")).distinct()
    run = receipts.where("not is_duplicate").join(locked, ["org", "id"], "left_anti").select("org", "id")
    best = proposals.where("status <> 'alternate'")
    ended = run.join(best.select("org", F.col("r_id").alias("id"), F.when(F.col("status") == "auto", "completed").otherwise("needs_review").alias("status")), ["org", "id"], "left").na.fill("unmatched", ["status"])
    detail = F.concat(number_text(F.col("score")), F.lit("% via "), F.col("method"))
    audit = audit_rows(best, F.concat(F.lit("match."), "status"), "receipt", F.col("r_id"), detail)
    counts = ended.groupBy("org").agg(F.count(F.lit(1)).alias("receipts"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("unmatched", "unmatched"),)))
    of_best = [F.count_if((F.col("status") != "alternate") & (F.col("classification") == c)).alias(c) for c in ("auto", "review", "possible")]
    kept = proposals.groupBy("org").agg(F.count(F.lit(1)).alias("pairs"), *of_best)
    lines = considered[1].groupBy("org").agg(F.count(F.lit(1)).alias("transactions"))
    tried = scored.groupBy("org", "r_id").agg(F.count(F.lit(1)).alias("n"), F.max("escalated").alias("asked")).groupBy("org").agg(F.sum("n").alias("scored"), F.count_if("asked").alias("semantic"))
    stats = counts.join(lines, "org", "left").join(tried, "org", "left").join(kept, "org", "left").na.fill(0)
    stats = stats.select("org", "receipts", "transactions", "scored", "pairs", "semantic", "auto", "review", "possible", "unmatched")
    return {"matches": runs.write_back(matches, proposals, run), "receipts": set_status(receipts, ended), "audit": audit, "stats": stats, "proposals": proposals}


def processed_status(status: Column, overall: Column) -> Column:
    """The state of a receipt after processing: the run's, else by how sure its fields are."""
    return F.coalesce(status, F.when(overall < 0.6, "needs_review").otherwise("completed"))


def mark_failed(receipts: DataFrame, failed: DataFrame) -> DataFrame:
    """Receipts whose job used up its attempts (org, id) fail, if still in progress, with the code."""
    hit = receipts.join(failed.select("org", "id", F.lit(True).alias("_f")).distinct(), ["org", "id"], "left")
    stuck = F.coalesce(F.col("_f"), F.lit(False)) & F.col("status").isin(*IN_PROGRESS)
    return hit.withColumn("failure_code", F.when(stuck, "processing_failed")).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status"))).drop("_f")


def upsert_merchants(merchants: DataFrame, seen: DataFrame) -> DataFrame:
    """`merchants` (org, merchant_id, name, normalized) and those of `seen` (org, name, normalized) that are new, each
    under the first of its names; ids are hashes of organization and key."""
    new = seen.where("normalized <> ''").groupBy("org", "normalized").agg(F.min("name").alias("name")).join(merchants.select("org", "normalized"), ["org", "normalized"], "left_anti")
    named = new.withColumn("merchant_id", F.concat(F.lit("mch_"), F.substring(F.sha2(F.concat_ws("|", F.col("org").cast("string"), "normalized"), 256), 1, 16)))
    return merchants.select("org", "merchant_id", "name", "normalized").unionByName(named.select("org", "merchant_id", "name", "normalized"))


def with_category_named(rows: DataFrame, categories: DataFrame, suggested: Column) -> DataFrame:
    """Adds `category` where the organization has one of the suggested name; a small dimension, met by organization, so
    that the suggestion is made only where the category is read."""
    names = categories.groupBy("org").agg(F.collect_set("name").alias("_names"))
    known = let(suggested, lambda s: F.when(F.array_contains("_names", s), s))
    found = rows.join(names, "org", "left")
    return found.withColumn("category", F.coalesce(known, "category") if "category" in rows.columns else known).drop("_names")


def provision(orgs: DataFrame) -> dict[str, DataFrame]:
    """For new organizations (org, user_id): their owner, free subscription and default categories."""
    names = orgs.sparkSession.createDataFrame(SYSTEM_CATEGORIES, "name string, color string")
    return {
        "memberships": orgs.select("user_id", "org", F.lit("owner").alias("role")),
        "subscriptions": orgs.select("org", F.lit("free").alias("plan"), F.lit(50).cast("long").alias("quota"), F.lit(None).cast("timestamp_ntz").alias("period_end")),
        "categories": orgs.select("org").crossJoin(F.broadcast(names)).withColumn("is_system", F.lit(True)),  # nine rows
    }


def delete_receipts(tables: dict[str, DataFrame], ids: DataFrame, actor: str) -> dict[str, DataFrame]:
    """The tables without the receipts (org, id) and what hangs on them, their stored files (org, file), and the trail."""
    owned = tables["receipts"].join(ids.select("org", "id").distinct(), ["org", "id"], "left_semi")
    out = runs.delete_receipts(tables, owned.select("org", "id"))
    return out | {"files": owned.select("org", "file") if "file" in owned.columns else owned.select("org", "id"), "audit": audit_rows(owned, "receipt.deleted", "receipt", F.col("id"), None, actor)}


#: Fields of a receipt that are edited by hand.
FIELDS = ("merchant", "date", "total", "subtotal", "tax", "currency", "invoice", "payment")


def edit_receipts(receipts: DataFrame, edits: DataFrame, actor: str, fields: tuple[str, ...] = FIELDS, transactions: DataFrame | None = None, matches: DataFrame | None = None, config: Config = MatchingConfig(), similarity=None) -> dict[str, DataFrame]:
    """Receipts after edits by hand, as the product has them: receipts, audit, rematch (org, id), and with `transactions`
    and `matches` the matches after a run over those.

    An edit (org, id; one a receipt) has some of the fields and category, null where untouched, `cleared`, the names of
    fields that are emptied, `is_duplicate`, and `rematch`. A merchant is given as it is read: its key is rebuilt, and
    merchant_raw kept where there is one. A flag that is lowered takes duplicate_of along and is told in the trail.
    Receipts of which a field was touched have edited_by_user; where the edit says nothing of the flag they are compared
    with the earlier receipts of their organization again, and they are matched again unless rematch is false.
    """
    given = [f for f in fields if f in edits.columns and f in receipts.columns]
    flags = [c for c in ("category", "is_duplicate", "rematch", "cleared") if c in edits.columns]
    emptied = F.coalesce(F.col("_cleared"), F.array().cast("array<string>")) if "cleared" in flags else F.array().cast("array<string>")
    new = edits.select("org", "id", *(F.col(f).alias(f"_{f}") for f in (*given, *flags)), F.lit(True).alias("_hit"))
    known = [f for f in fields if f in receipts.columns]
    clears = {f: F.array_contains(emptied, f) for f in known}
    touched = F.array_compact(F.array(*(F.when(clears[f] | (F.col(f"_{f}").isNotNull() if f in given else F.lit(False)), F.lit(f)) for f in known)))
    out = receipts.join(new, ["org", "id"], "left").withColumn("_touched", touched)
    raw = F.col("_merchant") if "merchant" in given else F.lit(None).cast("string")
    values = {f: F.when(clears[f], F.lit(None)).otherwise(F.coalesce(f"_{f}", f) if f in given else F.col(f)) for f in known}
    if "merchant" in known:
        key = F.nullif(normalize_merchant(raw), F.lit(""))
        values["merchant"] = F.when(clears["merchant"], F.lit(None)).when(raw.isNotNull(), key).otherwise(F.col("merchant"))
        if "merchant_raw" in receipts.columns:
            values["merchant_raw"] = F.when(clears["merchant"], F.lit(None)).otherwise(F.coalesce(raw, "merchant_raw"))
    if "category" in flags:
        values["category"] = F.coalesce("_category", "category")
    if "is_duplicate" in flags:
        values["is_duplicate"] = F.coalesce("_is_duplicate", "is_duplicate")
        if "duplicate_of" in receipts.columns:
            values["duplicate_of"] = F.when(~F.coalesce("_is_duplicate", F.lit(True)), F.lit(None)).otherwise(F.col("duplicate_of"))
    said = F.col("_is_duplicate") if "is_duplicate" in flags else F.lit(None).cast("boolean")
    wanted = F.coalesce("_rematch", F.lit(True)) if "rematch" in flags else F.lit(True)
    out = out.withColumns(values | {"edited_by_user": F.size("_touched") > 0, "_said": said, "_again": wanted})
    keep = [*receipts.columns, *(["edited_by_user"] if "edited_by_user" not in receipts.columns else [])]
    out = cut(out.select(*keep, "_touched", "_said", "_again", F.coalesce("_hit", F.lit(False)).alias("_hit")))
    changed = out.where("_hit and edited_by_user")
    detail = F.concat(F.lit("edited "), F.array_join("_touched", ", "))
    audit = audit_rows(changed, "receipt.edited", "receipt", F.col("id"), detail, actor).unionByName(audit_rows(out.where("_hit and not _said"), "receipt.duplicate_cleared", "receipt", F.col("id"), None, actor))

    compared = ("checksum", "merchant", "date", "total", "invoice", "created_at")
    if {"is_duplicate", "duplicate_of", *compared} <= set(receipts.columns):
        open_ = changed.where("_said is null").select("org", "id")
        candidates = out.where("not is_duplicate or (edited_by_user and _said is null)").select("org", "id", *compared)
        first = Window.partitionBy("org", "id").orderBy("rule", "original")
        plain = out.where("not is_duplicate").select("org", F.col("id").alias("original"))
        edges = duplicate_edges(candidates, config).join(open_, ["org", "id"], "left_semi").join(plain, ["org", "original"], "left_semi")
        found = edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("org", "id", F.col("original").alias("_original"))
        out = out.join(found, ["org", "id"], "left").withColumn("is_duplicate", F.col("is_duplicate") | F.col("_original").isNotNull()).withColumn("duplicate_of", F.coalesce("_original", "duplicate_of"))
    again = changed.where("_again").select("org", "id")
    edited = out.select(keep)
    done = {"receipts": edited, "audit": audit, "rematch": again}
    if transactions is not None and matches is not None:
        run = matching_run(edited.join(again, ["org", "id"], "left_semi"), transactions, matches, config, similarity)
        states = run["receipts"].where("not is_duplicate").select("org", "id", F.col("status").alias("_ended"))
        done["receipts"] = edited.join(states, ["org", "id"], "left").withColumn("status", F.coalesce("_ended", "status")).select(keep)
        done |= {"matches": run["matches"], "audit": audit.unionByName(run["audit"])}
    return done
