"""Retrieval and ranking operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import tokens
from memlake.functions.vector import cosine

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf, dl) of exact terms; dl counts a document's terms."""
    t = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, query: list[str], id: str = "doc_id", text: str = "text", prefix: bool = False) -> DataFrame:
    """(id, score): BM25 of the query's terms over docs. The scan keeps only the terms asked for; nothing but per-term counts is gathered.

    With prefix, a term also matches the words it begins, as one term.
    """
    asked = sorted(set(query))
    t = docs.select(F.col(id).alias("id"), tokens(F.col(text)).alias("t"))
    hit = (lambda w, q: F.startswith(w, F.lit(q))) if prefix else (lambda w, q: w == q)

    def tf(q):
        return F.size(F.filter("t", lambda w: hit(w, q)))

    counts = t.select("id", F.size("t").alias("dl"), *(tf(q).alias(f"tf{k}") for k, q in enumerate(asked)))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(asked))))
    joined = counts.where(" OR ".join(f"tf{k} > 0" for k in range(len(asked)))).crossJoin(F.broadcast(stats))  # one row
    score = sum(
        F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)) * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        for k in range(len(asked))
    )
    return joined.select("id", score.alias("score"))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cosine) of the k nearest, ties by id: one scan and a bounded heap a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id).alias("id"), F.round(cosine(F.col(column), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score) by reciprocal-rank fusion of bounded lists(id, score), normalised by the best; ties by id."""
    ranked = [d.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r")) for d in lists]
    every = ranked[0]
    for d in ranked[1:]:
        every = every.unionByName(d)
    fused = every.groupBy("id").agg(F.sum(1.0 / (k + F.col("r"))).alias("raw"))
    return fused.crossJoin(fused.agg(F.max("raw").alias("most"))).select("id", (F.col("raw") / F.col("most")).alias("score"))


def union_max(lists: list[DataFrame]) -> DataFrame:
    """(id, score): the largest score of each id."""
    every = lists[0].select("id", "score")
    for d in lists[1:]:
        every = every.unionByName(d.select("id", "score"))
    return every.groupBy("id").agg(F.max("score").alias("score"))


def normalise(df: DataFrame, by: str | None = None, raw: str = "raw") -> DataFrame:
    """df with relevance: raw by the largest of its kind (or of all), in 0..1. The largest is joined back, so no kind is one task."""
    key = [by] if by else []
    most = df.groupBy(*key).agg(F.max(raw).alias("__most"))
    joined = df.join(F.broadcast(most) if not by else most, key) if by else df.crossJoin(F.broadcast(most))
    value = F.when(F.col("__most") <= 1e-9, F.when(F.col(raw) > 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(raw) / F.col("__most"))))
    return joined.withColumn("relevance", value).drop("__most")


def freshness(age_days: Column, half_life: float = 30.0) -> Column:
    return F.coalesce(F.exp(-math.log(2) * age_days / half_life), F.lit(0.5))


def usefulness_multiplier(score: Column, uses: Column) -> Column:
    """Score a use, in -1..1, as a factor in 0.5..1.5 that comes in fully with three uses."""
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / F.greatest(uses, F.lit(1))))
    return 1 + (ratio * 0.5) * F.least(uses / 3.0, F.lit(1.0))


def boosted(raw: Column, factor: Column) -> Column:
    return F.when(factor <= 1, raw * factor).otherwise(F.least(raw * factor, raw + 0.10))


def mmr(candidates: DataFrame, lam: float = 0.7) -> DataFrame:
    """candidates(query_id, id, kind, score, embedding) with position, by maximal marginal relevance: greedy, per query on its bounded list.

    Overlap is the cosine, at least 0, half across kinds; ties go to the smaller id.
    """
    from memlake.session import ship

    ship(candidates.sparkSession)

    def pick(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["embedding"].tolist(), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        kind = pdf["kind"].to_numpy()
        alike = np.maximum(v @ v.T, 0) * np.where(kind[:, None] == kind[None, :], 1.0, 0.5)
        left, over, out = list(range(len(pdf))), np.zeros(len(pdf)), []
        while left:
            best = max(left, key=lambda i: (round(lam * pdf["score"][i] - (1 - lam) * over[i], 9), -i))
            left.remove(best)
            out.append(best)
            over = np.maximum(over, alike[best])
        got = pdf.iloc[out].copy()
        got["position"] = range(len(out))
        return got[["query_id", "id", "kind", "score", "position"]]

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, kind string, score double, position long")


def pack_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """(query_id, ids, used): rows in rank order, each taken if it still fits. A fold over a bounded sorted list (rank, id, cost)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "cost")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"].cast("long")))).otherwise(acc["ids"]).alias("ids"))

    return ranked.groupBy("query_id").agg(F.aggregate(items, zero, step).alias("p")).select("query_id", "p.ids", "p.used")
