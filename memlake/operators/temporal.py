"""Bitemporal, session and event-fold operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(now: Column) -> Column:
    """Neither invalidated nor superseded, and valid at now; open ends are null, the interval is half-open."""
    return F.col("invalidated_at").isNull() & F.col("superseded_by").isNull() & F.coalesce(F.col("valid_from") <= now, F.lit(True)) & F.coalesce(F.col("valid_to") > now, F.lit(True))


def as_of(t: Column) -> Column:
    """What was believed at t; superseded_by is left out on purpose."""
    return (F.col("created_at") <= t) & F.coalesce(F.col("invalidated_at") > t, F.lit(True)) & F.coalesce(F.col("valid_from") <= t, F.lit(True)) & F.coalesce(F.col("valid_to") > t, F.lit(True))


def belief_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows learned and retired between two snapshots, by keys."""
    learned = after.join(before, keys, "left_anti").withColumn("change", F.lit("learned"))
    return learned.unionByName(before.join(after, keys, "left_anti").withColumn("change", F.lit("retired")))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def drift(sessions: DataFrame, threshold: float = 0.35, sustained: int = 3) -> DataFrame:
    """(session, drift_at): the first turn of a run of `sustained` turns below threshold in sessions(session, turn, similarity); the first turn never counts."""
    w = Window.partitionBy("session").orderBy("turn")
    s = sessions.withColumn("n", F.row_number().over(w))
    low = s.where((F.col("n") > 1) & (F.col("similarity") < threshold)).withColumn("island", F.col("n") - F.row_number().over(w))
    runs = low.groupBy("session", "island").agg(F.min("turn").alias("at"), F.count(F.lit(1)).alias("long")).where(F.col("long") >= sustained)
    return runs.groupBy("session").agg(F.min("at").alias("drift_at"))


def confidence(outcomes: DataFrame, start: float = 0.5) -> DataFrame:
    """(memory_id, confidence): c moves 0.05 of the way to each target in order of outcomes(memory_id, seq, target), held in 0.1..0.99."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "target")))
    fold = F.aggregate(ordered, F.lit(start), lambda c, x: F.greatest(F.lit(0.1), F.least(F.lit(0.99), c + (x["target"] - c) * 0.05)))
    return outcomes.groupBy("memory_id").agg(fold.alias("confidence"))


def followed(rows: DataFrame, earlier: DataFrame, keys: list[str], span: int, at: str = "at") -> DataFrame:
    """Rows of `rows` with a row of `earlier` of the same keys at the same time or at most `span` before; `at` is a whole number, rows with a null key or time have none.

    Time is cut into stretches of `span`: a row needs the first earlier row of its own stretch and the last of the one before, so a row meets
    one row of aggregates and pairs are never formed, however many rows a key has.
    """
    begin = F.col(at) - F.pmod(F.col(at), F.lit(span))
    ends = earlier.where(F.col(at).isNotNull()).groupBy(*keys, begin.alias("__begin")).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    after = ends.select(*keys, (F.col("__begin") + span).alias("__begin"), F.lit(None).cast("long").alias("__first"), "__last")
    near = ends.withColumn("__last", F.lit(None).cast("long")).unionByName(after).groupBy(*keys, "__begin").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    found = rows.withColumn("__begin", begin).join(near, [*keys, "__begin"])
    hit = F.coalesce(F.col("__first") <= F.col(at), F.lit(False)) | F.coalesce(F.col("__last") >= F.col(at) - span, F.lit(False))
    return found.where(hit).select(*rows.columns)


def spans(events: DataFrame, opened: str, closed: str) -> DataFrame:
    """(key, opened_at, closed_at): each closing event with the last opening one since the closing before it."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    e = events.where(F.col("kind").isin(opened, closed)).withColumn("before", F.lag(F.struct("kind", "ts")).over(w))
    return e.where((F.col("kind") == closed) & (F.col("before.kind") == opened)).select("key", F.col("before.ts").alias("opened_at"), F.col("ts").alias("closed_at"))


def winners(superseded: DataFrame) -> DataFrame:
    """(loser, survivor, conflict): of several survivors of superseded(loser, survivor, clock) the one with the highest clock; conflict tells of others."""
    return superseded.groupBy("loser").agg(F.max_by("survivor", F.struct("clock", "survivor")).alias("survivor"), (F.count_distinct("survivor") > 1).alias("conflict"))
