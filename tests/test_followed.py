"""Rows that follow another of their key within a span, and the query that rests on it."""

import random

from pyspark.sql import functions as F

from memlake.operators import temporal
from memlake.plans import relational


def test_followed_is_the_same_as_all_pairs(spark):
    rng = random.Random(5)
    late = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 60)])) for i in range(400)]
    early = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 60, 3)])) for _ in range(8)] + [("c", 1)]
    got = temporal.followed(spark.createDataFrame(late, "id long, k string, at long"), spark.createDataFrame(early, "k string, at long"), ["k"], 10)
    want = {i for i, k, t in late if k and t is not None and any(k == x and s is not None and 0 <= t - s <= 10 for x, s in early)}
    found = [r["id"] for r in got.collect()]
    assert got.columns == ["id", "k", "at"] and sorted(found) == sorted(want) and 0 < len(want) < 200


def test_one_memory_with_many_rows_forms_no_pairs(spark, tmp_path):
    at = F.expr("timestampadd(SECOND, CAST(id * 7 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    e = spark.range(3000).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    df = relational.QUERIES["regret_within_2h"](spark, str(tmp_path))
    assert df.count() == 2000
    assert "timestampdiff" not in next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)  # its condition is no range over all pairs of a memory
