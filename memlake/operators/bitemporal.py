"""What was known at one time about another: revisions on two time axes."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.projection import streamed

BEGINNING = "0001-01-01 00:00:00"


def with_baseline(memories: DataFrame, revisions: DataFrame) -> DataFrame:
    """revisions(memory_id, event_id, text, known_at, effective_at, place) and, for each memory that has any, its first text as place -1.

    The baseline is known since the memory was created and effective since valid_from, or ever.
    """
    base = memories.join(revisions.select("memory_id").distinct(), "memory_id", "left_semi").select(
        "memory_id", F.concat(F.lit("baseline:"), F.col("memory_id").cast("string")).alias("event_id"), "text", F.col("created_at").alias("known_at"), F.coalesce("valid_from", F.lit(BEGINNING).cast("timestamp_ntz")).alias("effective_at"), F.lit(-1).cast("long").alias("place")
    )
    return base.unionByName(revisions.select("memory_id", F.col("event_id").cast("string").alias("event_id"), "text", "known_at", "effective_at", F.col("place").cast("long").alias("place")))


class Frontier:
    """The revisions of a memory known so far that some time still sees.

    A revision hides those before it that take effect no earlier, so the rest ascend on both axes and one search answers a question.
    """

    def __init__(self, memory_id):
        self.id, self.since, self.seen = memory_id, [], []

    def apply(self, e: dict):
        if e["ask"] is not None:
            at = bisect_right(self.since, e["effective"])
            return self.seen[at - 1] if at else (None, None)
        while self.since and self.since[-1] >= e["effective"]:
            self.since.pop()
            self.seen.pop()
        self.since.append(e["effective"])
        self.seen.append((e["revision"], e["text"]))
        return None


def as_known(memories: DataFrame, revisions: DataFrame, asks: DataFrame) -> DataFrame:
    """(ask, memory_id, revision, text) for asks(ask, memory_id, known_at, valid_at): the memory's text in effect at valid_at as it was known
    at known_at.

    memories(memory_id, text, created_at, invalidated_at, valid_from, valid_to), times without zone. Of the revisions known by known_at
    and in effect by valid_at the one known last counts (ties: the higher place); without one the memory's own text. A memory created
    after known_at, invalidated by then, or not valid at valid_at gives no row; both intervals hold their start and not their end, open
    ends are null. Asks about unknown memories or with null times give none. Asks and revisions of a memory are read once in order of
    time, so their pairs are never formed.
    """
    live = (F.col("created_at") <= F.col("known_at")) & F.coalesce(F.col("invalidated_at") > F.col("known_at"), F.lit(True)) & F.coalesce(F.col("valid_from") <= F.col("valid_at"), F.lit(True)) & F.coalesce(F.col("valid_to") > F.col("valid_at"), F.lit(True))
    held = memories.select("memory_id", F.col("text").alias("own"), "created_at", "invalidated_at", "valid_from", "valid_to")
    asked = asks.where("ask is not null AND known_at is not null AND valid_at is not null").join(held, "memory_id").where(live).select("ask", "memory_id", "known_at", "valid_at", "own")
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit(BEGINNING).cast("timestamp_ntz"), c)
    null = lambda t: F.lit(None).cast(t)
    known = with_baseline(memories, revisions).select("memory_id", micros(F.col("known_at")).alias("known"), F.lit(0).alias("turn"), "place", micros(F.col("effective_at")).alias("effective"), F.col("event_id").alias("revision"), "text", null("string").alias("ask"))
    turn = asked.select("memory_id", micros(F.col("known_at")).alias("known"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("place"), micros(F.col("valid_at")).alias("effective"), null("string").alias("revision"), F.col("own").alias("text"), F.col("ask").cast("string").alias("ask"))

    def answer(state, e, found):
        if e["ask"] is None:
            return []
        revision, text = found
        return [{"ask": e["ask"], "memory_id": str(e["memory_id"]), "revision": revision, "text": e["text"] if revision is None else text}]

    line = known.unionByName(turn)
    return streamed(line, "memory_id", Frontier, "ask string, memory_id string, revision string, text string", each=answer, order=("known", "turn", "place"))
