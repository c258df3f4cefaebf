"""A logistic policy of when to speak, fitted by full-batch gradient rounds that stay near a prior."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.graph import connected_components
from memlake.session import written

FEATURES = ("score", "loop_mode", "is_failure_pattern", "novelty", "repeat_count", "recovery", "evidence")
#: The policy before any example and the fit's settings (fixed values).
PRIOR_WEIGHTS, PRIOR_BIAS = (20.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0), -9.0
EPOCHS, RATE, PULL, LEAST = 400, 0.05, 0.01, 40
ON_DRIVER = 20_000  # distinct examples up to which the rounds run on the driver: below 2 MB


def labelled_examples(injections: DataFrame, citations: DataFrame) -> DataFrame:
    """injections(memory_id, ts, ...) with `useful`: whether the memory was cited at that time or later; citations(memory_id, cited_at).

    Only the last citation of a memory counts, so the join is of one row a memory. Null ids and times are not useful.
    """
    last = citations.groupBy("memory_id").agg(F.max("cited_at").alias("__last"))
    return injections.join(last, "memory_id", "left").withColumn("useful", F.coalesce(F.col("__last") >= F.col("ts"), F.lit(False))).drop("__last")


def fit(examples: DataFrame, epochs: int = EPOCHS, on_driver: int = ON_DRIVER) -> dict:
    """{weights, bias, trained_on} of examples(FEATURES..., useful): the prior for fewer than LEAST examples or a single label.

    Equal examples are counted first. Then each round is one aggregate of eight sums, by Spark over a written table or, for at most
    on_driver distinct examples, on the driver; both sum the same terms. Null features count 0, null labels are left out.
    """
    rows = examples.where("useful is not null").select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES), F.col("useful").cast("double").alias("y"))
    kept = written(rows.groupBy(*FEATURES, "y").agg(F.count(F.lit(1)).alias("n")), "examples")
    total, yes, distinct = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0.0)), F.count(F.lit(1))).first()
    w, b = np.array(PRIOR_WEIGHTS), PRIOR_BIAS
    out = {"weights": w.tolist(), "bias": b, "trained_on": 0}
    if total < LEAST or yes in (0, total):
        return out
    if distinct <= on_driver:
        t = kept.toPandas()
        x, y, n = t[list(FEATURES)].to_numpy(float), t["y"].to_numpy(float), t["n"].to_numpy(float)

        def sums(w, b):
            e = (1 / (1 + np.exp(-(x @ w + b))) - y) * n
            return np.append(e @ x, e.sum())
    else:

        def sums(w, b):
            z = sum(F.col(c) * float(k) for c, k in zip(FEATURES, w)) + float(b)
            e = (1 / (1 + F.exp(-z)) - F.col("y")) * F.col("n")
            return np.array(kept.agg(*(F.sum(e * F.col(c)) for c in FEATURES), F.sum(e)).first(), float)

    for _ in range(epochs):
        g = sums(w, b) / total
        w = w - RATE * (g[:-1] + PULL * (w - np.array(PRIOR_WEIGHTS)))
        b = b - RATE * (g[-1] + PULL * (b - PRIOR_BIAS))
    if not (np.isfinite(w).all() and math.isfinite(b)):
        return out
    return {"weights": w.tolist(), "bias": float(b), "trained_on": int(total)}


def probability(policy: dict):
    """The fitted policy as a column over FEATURES."""
    z = sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * k for c, k in zip(FEATURES, policy["weights"])) + policy["bias"]
    return 1 / (1 + F.exp(-z))


def grouped_holdout(cases: DataFrame, every: int = 5) -> DataFrame:
    """(case_id, part, holdout) of cases(case_id, keys array<string>): cases that share a key, also by way of others, are on one side.

    Parts are numbered by their smallest case; each `every`-th from the first is held out. Null keys link nothing. The numbers come from
    ranges and their counts, one number a range on the driver, so no task sees all parts.
    """
    ids = cases.select(F.col("case_id").cast("long").alias("case_id")).where("case_id is not null").distinct()
    first = cases.where("case_id is not null").select(F.col("case_id").cast("long").alias("case_id"), F.explode("keys").alias("key")).where("key is not null")
    hub = first.groupBy("key").agg(F.min("case_id").alias("hub"))
    linked = written(connected_components(first.join(hub, "key").select(F.col("case_id").alias("a"), F.col("hub").alias("b"))), "cases")
    parts = ids.join(linked.withColumnRenamed("id", "case_id"), "case_id", "left").select("case_id", F.coalesce("component", "case_id").alias("part"))
    parts = written(parts, "parts")
    ranged = written(parts.select("part").distinct().repartitionByRange("part").sortWithinPartitions("part").select("part", F.spark_partition_id().alias("range")), "ranges")
    counts, begins, n = sorted(map(tuple, ranged.groupBy("range").count().collect())), {}, 0
    for r, c in counts:
        begins[r], n = n, n + c
    base = F.element_at(F.create_map(*(F.lit(x) for pair in begins.items() for x in pair)), F.col("range")) if begins else F.lit(0)
    number = ranged.withColumn("number", base + F.row_number().over(Window.partitionBy("range").orderBy("part")) - 1)
    return parts.join(number.select("part", "number"), "part").select("case_id", "part", (F.col("number") % every == 0).alias("holdout"))
