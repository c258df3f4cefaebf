"""A kept vector index: rows in the cells of a coarse quantiser, as a Parquet table partitioned by cell.

Centres are fitted by spherical k-means on at most SAMPLE rows; every row is then assigned, so the sample decides the layout and not what
is found. Each cell keeps its radius, the largest angle between a member and the centre. A search reads the nearest cells only and scores
their rows exactly; with `exact`, it goes on to every cell whose radius allows a better row than the worst found, so nothing is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import partitions, ship

SAMPLE = 20_000  # rows that reach the driver to fit the centres
MOST_CELLS = 4_096  # centres and radii are held by the driver and sent to the tasks of a build
_SLACK = 1e-6  # of angles: radii are rounded up, bounds down


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centres(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centres of unit rows; an empty centre moves to the row farthest from its own."""
    rnd = np.random.default_rng(seed)
    c = rows[rnd.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        like = rows @ c.T
        own = like.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            total[empty] = rows[np.argsort(like[np.arange(len(rows)), own])[: len(empty)]]
        c = _unit(total)
    return c


def build(spark: SparkSession, path: str, vectors: DataFrame, id: str = "vec_id", column: str = "embedding", cells: int | None = None) -> None:
    """Writes the index of vectors at path, in place of one that is there. cells: about the square root of the rows unless given.

    Vectors that are null, zero, hold null or non-finite parts or have another length than the first fitted are in no cell: their cosine
    with anything is nothing. Rows with a null id are left out; repeated ids stay apart.
    """
    ship(spark)
    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    sound = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    n = sound.count()
    taken = sound.select("v").sample(min(1.0, 1.2 * SAMPLE / n), 7).limit(SAMPLE).toPandas() if n else pd.DataFrame({"v": []})
    width = len(taken["v"].iloc[0]) if len(taken) else 0
    fitted = _unit(np.array([v for v in taken["v"] if len(v) == width], float).reshape(-1, width)) if width else np.zeros((0, 0))
    k = min(len(fitted), MOST_CELLS, cells or max(1, round(n**0.5)))
    c = centres(fitted, k) if k else fitted
    sent = spark.sparkContext.broadcast(c)  # at most MOST_CELLS vectors

    def assign(frames):
        for f in frames:
            f = f[[len(v) == width for v in f["v"]]]
            if len(f):
                x = _unit(np.array(f["v"].tolist(), float))
                like = np.clip(x @ sent.value.T, -1, 1)
                own = like.argmax(1)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "angle": np.arccos(like[np.arange(len(f)), own]), "cell": own.astype(np.int32)})

    placed = sound.mapInPandas(assign, "id long, v array<double>, angle double, cell int")
    placed.repartition(partitions(spark), "cell", F.pmod("id", F.lit(max(1, partitions(spark) // max(1, k))))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    radii = spark.read.schema("angle double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
    known = spark.createDataFrame([(j, c[j].tolist()) for j in range(k)], "cell int, centre array<double>")
    radii.join(known, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, query: list[float], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """(id, cosine) of the k nearest by exact cosine among the `probes` nearest cells, ties by id; with `exact`, among all rows.

    The cells are read by folder, the others not at all. A zero query or an empty index gives no rows.
    """
    cells = spark.read.schema("cell int, radius double, rows long, centre array<double>").parquet(f"{path}/cells").toPandas()  # at most MOST_CELLS rows
    q = _unit(np.array(query, float))
    if not len(cells) or not q.any():
        return spark.createDataFrame([], "id long, cosine double")
    angle = np.arccos(np.clip(np.stack(cells["centre"].to_list()) @ q, -1, 1))
    best = np.cos(np.clip(angle - cells["radius"].to_numpy() - _SLACK, 0, np.pi))  # no row of the cell is nearer
    order = np.argsort(angle, kind="stable")
    names = cells["cell"].to_numpy()
    near = names[order[:probes]].tolist()
    if exact and probes < len(cells):
        found = _scored(spark, path, q, near).orderBy(F.desc("cosine"), "id").limit(k).agg(F.count(F.lit(1)), F.min("cosine")).first()
        floor = found[1] - _SLACK if found[0] == k else -2.0
        near += [int(names[j]) for j in order[probes:] if best[j] >= floor]
    return _scored(spark, path, q, near).orderBy(F.desc("cosine"), "id").limit(k)


def _scored(spark: SparkSession, path: str, q: np.ndarray, cells: list[int]) -> DataFrame:
    """(id, cosine) of the rows of some cells, in double precision; rounded, so that ties are ties."""
    asked = F.array(*(F.lit(float(x)) for x in q))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    rows = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/rows").where(F.col("cell").isin(cells))
    return rows.select("id", F.round(add(F.zip_with("v", asked, lambda x, y: x * y)) / F.sqrt(add(F.transform("v", lambda x: x * x))), 6).alias("cosine"))
