"""Which of several texts about one thing is the current one, and whether any is worth showing: rules over bounded candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import content_tokens, tokens
from memlake.functions.vector import cosine
from memlake.operators.gates import has_cue
from memlake.operators.rank import boosted

#: Bounds of the supersession rule (fixed values): near duplicates by cosine alone; by cosine with a cue; shared words and their share; the
#: factor of the older text; seconds within which two texts are one act of writing.
NEAR, NEAR_WITH_CUE, SHARED_WORDS, SHARED_PART, PENALTY, ONE_ACT = 0.85, 0.82, 3, 0.35, 0.80, 1.0
#: Least best score of a reranker for a bundle whose evidence lies within the band of doubt (fixed value).
SURE = 0.9


def superseded(pool: DataFrame, near: float = NEAR, near_with_cue: float = NEAR_WITH_CUE) -> DataFrame:
    """(query_id, id) of the candidates that a newer or correcting one of the same pool replaces.

    pool(query_id, id, kind, summary, created_at, embedding, cosine). Two memories with vectors and times are about one thing if their
    cosine is at least `near`, or exactly one holds a cue and their cosine is at least `near_with_cue` or their words agree. The older is
    replaced; within a second of each other the one without the cue, if just one has it. Below `near_with_cue` the newer must hold the
    cue and be no farther from the query. The pairs are those of a bounded pool; a candidate is listed once however many replace it.
    """
    c = pool.where("kind = 'memory' AND embedding is not null AND created_at is not null").select("query_id", "id", "created_at", "embedding", "cosine", has_cue(F.col("summary")).alias("cue"), content_tokens(F.coalesce("summary", F.lit(""))).alias("words"))
    one, other = (c.select("query_id", *(F.col(x).alias(f"{side}_{x}") for x in c.columns if x != "query_id")) for side in "xy")
    pairs = one.join(other, "query_id").where("x_id < y_id AND (x_cue <> y_cue OR size(x_embedding) = size(y_embedding))").withColumn("like", cosine(F.col("x_embedding"), F.col("y_embedding")))
    shared = F.size(F.array_intersect("x_words", "y_words"))
    least = F.least(F.size("x_words"), F.size("y_words"))
    alike = (shared >= SHARED_WORDS) & (shared / least >= SHARED_PART)
    related = (F.col("like") >= near) | ((F.col("x_cue") != F.col("y_cue")) & ((F.col("like") >= near_with_cue) | F.coalesce(alike, F.lit(False))))
    gap = F.timestamp_diff("MICROSECOND", F.col("y_created_at"), F.col("x_created_at")) / 1e6
    x_older = F.when(F.abs(gap) < ONE_ACT, F.when(F.col("x_cue") != F.col("y_cue"), F.col("y_cue"))).otherwise(gap < 0)
    judged = pairs.where(related).withColumn("x_older", x_older).where("x_older is not null")
    new_cue = F.when(F.col("x_older"), F.col("y_cue")).otherwise(F.col("x_cue"))
    closer = F.when(F.col("x_older"), F.col("y_cosine") >= F.col("x_cosine")).otherwise(F.col("x_cosine") >= F.col("y_cosine"))
    sure = judged.where((F.col("like") >= near_with_cue) | (new_cue & F.coalesce(closer, F.lit(False))))
    return sure.select("query_id", F.when(F.col("x_older"), F.col("x_id")).otherwise(F.col("y_id")).alias("id")).distinct()


def supersession_penalty(pool: DataFrame, **bounds) -> DataFrame:
    """pool with score times PENALTY for replaced candidates, once, and the mark `superseded_hint`."""
    found = superseded(pool, **bounds).withColumn("superseded_hint", F.lit(True))
    marked = pool.join(found, ["query_id", "id"], "left").withColumn("superseded_hint", F.coalesce("superseded_hint", F.lit(False)))
    return marked.withColumn("score", F.col("score") * F.when(F.col("superseded_hint"), PENALTY).otherwise(1.0))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct words that a text has: a scorer that needs no model."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(pool: DataFrame, raw: Column, floor: float = 0.3, cap: int = 8) -> DataFrame:
    """pool(query_id, id, usefulness, trust, superseded_hint) with raw, score and position: the raw score raised or lowered by usefulness,
    then by trust and supersession.

    usefulness is held in 0.5..1.5 and left out for replaced candidates, trust in 0..1; both count 1 where null. Candidates below the
    raw floor go only where another of their query reaches it; then the first `cap` stay (0: all). Ties go to the smaller id.
    """
    held = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(1.0))))
    factor = F.when(F.col("superseded_hint"), 1.0).otherwise(held(F.col("usefulness"), 0.5, 1.5))
    scored = pool.withColumn("raw", raw)
    scored = scored.withColumn("score", boosted(F.col("raw"), factor) * held(F.col("trust"), 0.0, 1.0) * F.when(F.col("superseded_hint"), PENALTY).otherwise(1.0))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("best_raw", best).where((F.col("raw") >= floor) | (F.col("best_raw") < floor))
    placed = kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return placed.where(F.col("position") <= cap) if cap > 0 else placed


def arbitrate(reranked: DataFrame, evidence: DataFrame, least: float, sure: float = SURE, scorer: bool = True) -> DataFrame:
    """reranked(query_id, kind, best_raw, ...) without the queries that are better left unanswered.

    evidence(query_id, top) is each query's best absolute evidence, negative where there is none. A query whose bundle holds memories
    only and whose evidence lies in 0..least is in doubt: it stays only if its best raw score is at least `sure`, and not at all without
    a scorer. least <= 0 turns the rule off.
    """
    only = reranked.groupBy("query_id").agg(F.min((F.col("kind") == "memory").cast("int")).alias("only"), F.max("best_raw").alias("best"))
    in_doubt = (F.lit(least) > 0) & (F.col("only") == 1) & (F.col("top") >= 0) & (F.col("top") < least)
    weak = only.join(evidence, "query_id").where(in_doubt & (F.coalesce(F.col("best") < sure, F.lit(True)) if scorer else F.lit(True)))
    return reranked.join(weak.select("query_id"), "query_id", "left_anti")
