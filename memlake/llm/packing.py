"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Pieces are packed by their length alone, so the plan is made from the histogram of lengths (at most
`capacity` rows, whatever the corpus): bins are filled greedily from the longest length down, then
the smallest document of a bin is replaced with the two unpacked ones that fill its expanded gap
most tightly, and the pattern is repeated while its lengths last. Pieces then find their place by
their number within their length. No step gathers documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.workers import task
from memlake.session import ship, written

CAPACITY = 2048
PIECES = "part int, doc_id long, piece int, start long, length long, nth long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: ids (little-endian unsigned 32-bit), and nth, its number among the pieces of its length in this part.

    A null text is empty and gives the end id alone; a null doc_id stays null; repeated rows are packed each. Only documents over
    capacity are cut, so that all pieces but the first are full. Other columns of docs are ignored.
    """
    ship(docs.sparkSession)

    @task("chunks")
    def run(batches):
        from pyspark import TaskContext

        from memlake.llm.chunk_bpe import shared

        enc, part, met = shared(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                out: list[tuple] = []
                for doc, raw in zip(rows.column(0).to_pylist(), enc.encode([t or "" for t in rows.column(1).to_pylist()])):
                    ids = np.frombuffer(raw, enc.type).astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    size, at_id, k = n if n <= capacity else (n % capacity or capacity), 0, 0
                    while at_id < n:
                        out.append((part, doc, k, at_id, size, met[size], ids[4 * at_id : 4 * (at_id + size)]))
                        met[size] += 1
                        at_id, k, size = at_id + size, k + 1, capacity
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("part", "doc_id", "piece", "start", "length", "nth", "ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan_best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as (((length, how many), ...), repeats), from a histogram of lengths in 1..capacity."""
    left = {k: v for k, v in histogram.items() if v > 0}
    sizes = sorted(left)
    plan = []

    def largest(limit: int, used: Counter) -> int:
        k = bisect_right(sizes, limit) - 1
        while k >= 0 and left[sizes[k]] <= used[sizes[k]]:
            k -= 1
        return sizes[k] if k >= 0 else 0

    while sizes:
        used: Counter = Counter()
        gap = capacity
        while (s := largest(gap, used)) > 0:
            many = min(gap // s, left[s] - used[s])
            used[s] += many
            gap -= many * s
        if gap and sum(used.values()) > 1:
            small = min(used)
            room = gap + small
            free = np.array([s for s in sizes if s < room and left[s] > used[s]])
            if len(free):
                mate = np.searchsorted(free, room - free, side="right") - 1
                ok = mate >= 0
                pair = np.where(ok, free + free[mate], 0)
                twin = ok & (free[mate] == free)
                for k in np.flatnonzero(twin):  # the same length twice needs two of it
                    if left[int(free[k])] - used[int(free[k])] < 2:
                        pair[k] = free[k] + free[k - 1] if k else 0
                best = int(pair.argmax())
                if pair[best] > small:
                    a = int(free[best])
                    used[small] -= 1
                    used[a] += 1
                    used[int(pair[best]) - a] += 1
                    used = +used
        times = min(left[s] // n for s, n in used.items())
        plan.append((tuple(sorted(used.items(), reverse=True)), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
    return plan


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (part, length, nth and any other columns) with sequence_id and offset.

    pieces must read the same rows each time (a written table). Full pieces are sequences of their own, with negative ids.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < capacity)
    counts = short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots, sequence, seen = [], 0, Counter()
    for pattern, times in plan_best_two_fit(histogram, capacity):
        at = 0
        for length, many in pattern:
            slots.append((length, seen[length], seen[length] + many * times, many, sequence, at))
            seen[length] += many * times
            at += many * length
        sequence += times
    slot = spark.createDataFrame(slots, "s_length long, s_from long, s_to long, s_many long, s_sequence long, s_at long")
    before = counts.select(
        F.col("part").alias("b_part"), F.col("length").alias("b_length"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("b_before"),
    )
    keep = pieces.columns
    nth = F.col("nth") + F.col("b_before")
    inner = (nth - F.col("s_from"))
    packed = (
        short.join(before, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length")))
        .join(F.broadcast(slot), (F.col("length") == F.col("s_length")) & (nth >= F.col("s_from")) & (nth < F.col("s_to")))  # slots depend on capacity alone
        .select(*keep, (F.col("s_sequence") + F.floor(inner / F.col("s_many"))).cast("long").alias("sequence_id"), (F.col("s_at") + (inner % F.col("s_many")) * F.col("length")).cast("long").alias("offset"))
    )
    full = pieces.where(F.col("length") == capacity).select(
        *keep, (-(F.col("part").cast("long") * (1 << 36) + F.col("nth")) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packed pieces of docs with their ids: doc_id, piece, start, length, ids, sequence_id, offset. See tokenize_pieces for nulls and repeated rows; an empty table gives no rows."""
    pieces = written(tokenize_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return assign(pieces, capacity).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
