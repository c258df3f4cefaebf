"""Citations bound to what was delivered, and the cases for evaluation that come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("helped", "noop", "harmed")  # what a citation may say (fixed values)


def exposure_citations(citations: DataFrame, delivered: DataFrame, memories: DataFrame) -> DataFrame:
    """(event_id, exposure_id, memory_id, outcome, revision, status) of citations(event_id, hlc, exposure_id, memory_id, outcome).

    delivered(event_id, memory_id, shown) says which revision of which memory each delivery showed, memories(memory_id, invalidated_at,
    superseded_by) what lives. status is the first that holds: `outcome` not one of OUTCOMES (null is noop), `undelivered` in this
    exposure, `unbound` without a revision, `gone` when the memory is unknown, invalidated or merged; then the first citation of a
    memory in an exposure is `accepted`, a later one a `repeat` of its outcome or in `conflict` with it. A delivery listed twice is one.
    """
    shown = delivered.groupBy(F.col("event_id").alias("exposure_id"), "memory_id").agg(F.max("shown").alias("revision"), F.lit(True).alias("__sent"))
    alive = memories.where("invalidated_at is null AND superseded_by is null").select("memory_id", F.lit(True).alias("__alive"))
    c = citations.withColumn("outcome", F.coalesce("outcome", F.lit("noop"))).join(shown, ["exposure_id", "memory_id"], "left").join(alive, "memory_id", "left")
    wrong = F.when(~F.col("outcome").isin(*OUTCOMES), "outcome").when(F.col("__sent").isNull(), "undelivered").when(F.coalesce("revision", F.lit("")) == "", "unbound").when(F.col("__alive").isNull(), "gone")
    c = c.withColumn("wrong", wrong)
    first = F.first("outcome").over(Window.partitionBy("exposure_id", "memory_id", "wrong").orderBy("hlc", "event_id"))
    nth = F.row_number().over(Window.partitionBy("exposure_id", "memory_id", "wrong").orderBy("hlc", "event_id"))
    status = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(nth == 1, "accepted").when(F.col("outcome") == first, "repeat").otherwise("conflict")
    return c.withColumn("status", status).select("event_id", "exposure_id", "memory_id", "outcome", F.when(F.col("status") == "accepted", F.col("revision")).alias("revision"), "status")


def current_claims(revisions: DataFrame) -> DataFrame:
    """(memory_id, claim): the last revision of revisions(memory_id, event_id, text, place) whose text differs from the one before."""
    changed = revisions.withColumn("before", F.lag("text").over(Window.partitionBy("memory_id").orderBy("place"))).where("before is null OR before <> text")
    return changed.groupBy("memory_id").agg(F.max_by("event_id", "place").alias("claim"))


def personal_eval(exposures: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """(query, relevant, family, ts) of the latest delivery of each query of exposures(event_id, run_id, ts, query, task_id, memory_id, shown).

    relevant are the memories, sorted, that citations(run_id, exposure_id, memory_id, revision) of that delivery relied on, at the revision
    that it showed and that is still the memory's claim (claims; a memory without any has its baseline). Where there are none the list is
    empty: noise, not a case. Blank queries are left out; of equal times the greater event_id counts.
    """
    asked = exposures.where("trim(query) <> ''")
    last = asked.groupBy("query").agg(F.max(F.struct("ts", "event_id", "run_id", F.trim(F.coalesce("task_id", F.lit(""))).alias("family"))).alias("l")).select("query", "l.*")
    sent = asked.select("event_id", "memory_id", "shown").distinct()
    relied = citations.where("revision is not null").select("run_id", F.col("exposure_id").alias("event_id"), "memory_id", "revision").distinct()
    now = F.coalesce("claim", F.concat(F.lit("baseline:"), F.col("memory_id").cast("string")))
    good = relied.join(sent, ["event_id", "memory_id"]).where("revision = shown").join(claims, "memory_id", "left").where(F.col("revision") == now).select("run_id", "event_id", "memory_id").distinct()
    relevant = good.groupBy("run_id", "event_id").agg(F.array_sort(F.collect_set("memory_id")).alias("relevant"))  # of one delivery
    empty = F.array().cast(f"array<{dict(citations.dtypes)['memory_id']}>")
    return last.join(relevant, ["run_id", "event_id"], "left").select("query", F.coalesce("relevant", empty).alias("relevant"), "family", "ts")
