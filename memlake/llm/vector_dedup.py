"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale each; the product of two tiles is exact integer
arithmetic, and the norms of the quantisation residues bound how far it can be from the cosine. Only
pairs that the bound leaves possible are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tiles import tile_links
from memlake.operators.graph import connected_components
from memlake.session import written


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the coded vector, norm of the residue) of unit vectors, rounded up where they bound."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    slack = 1 + 1e-12
    return codes, scale, np.linalg.norm(coded, axis=1) * slack, np.linalg.norm(unit - coded, axis=1) * slack + 1e-15


def close_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (i < j in a, for b None) with cosine >= threshold."""
    def ready(v):
        v = v.astype(np.float64)
        norm = np.linalg.norm(v, axis=1)
        return v, norm, *quantise(v / norm[:, None])

    va, na, qa, sa, ca, ea = ready(a)
    vb, nb, qb, sb, cb, eb = (va, na, qa, sa, ca, ea) if b is None else ready(b)
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds every sum of int8 products
    right = qb.astype(exact).T
    out_i, out_j = [], []
    for at in range(0, len(va), chunk):
        rows = slice(at, at + chunk)
        estimate = (qa[rows].astype(exact) @ right).astype(np.float64) * sa[rows, None] * sb
        bound = ca[rows, None] * eb + ea[rows, None] * cb + ea[rows, None] * eb + 1e-9
        i, j = np.nonzero(estimate + bound >= threshold)
        i += at
        if b is None:
            keep = i < j
            i, j = i[keep], j[keep]
        sure = np.einsum("ij,ij->i", va[i], vb[j]) / (na[i] * nb[j]) >= threshold
        out_i.append(i[sure])
        out_j.append(j[sure])
    return np.concatenate(out_i), np.concatenate(out_j)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Only vectors of equal labels are compared. Null vectors, zero ones, those with a null or non-finite component, rows with a
    null label or vec_id and vectors of different lengths link with nothing. Equal vectors are one class, compared once, and link
    with each other; a repeated vec_id gives a row each time. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    classes = written(rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many")), "vector-classes")

    def compare(key, a, b):
        dim = key[1]
        return close_pairs(a.flatten().to_numpy().reshape(-1, dim), None if b is None else b.flatten().to_numpy().reshape(-1, dim), threshold)

    parts = written(tile_links(classes.select("label", F.size("embedding").alias("dim"), "id", "many", F.col("embedding").alias("payload")), ["label", "dim"], compare, tile_rows), "vector-links")
    component = connected_components(parts, "id", "root")
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    found = classes.join(links, "id", "left").join(component, "id", "left").select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = rows.where(good).join(found, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))).select("vec_id", "n_links", "component_id")
    single = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
