"""Self-joins within a key by tiles, for groups of any size.

The rows of a key are dealt by a hash over as many tiles as they need; each pair of tiles is one row of
work, so a hot key spreads over the cluster. A pair of tiles returns, for each row that has a link, its
number of links and the smallest id of its links' component there: results grow with the rows, not
with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.workers import task
from memlake.session import ship


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of 0..n-1 under links i-j."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def link_parts(ids: np.ndarray, many: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(id, links, root) of the ends of the links between places i and j: number of `many` linked and the smallest id of the component here."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    links = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
    low = ids[order][roots(len(ids), place[i], place[j])][place]
    on = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[on], pa.int64()), pa.array(links[on].astype(np.int64)), pa.array(low[on], pa.int64())], ["id", "links", "root"])


def tile_links(rows: DataFrame, keys: list[str], compare: Callable, tile_rows: int = 2048) -> DataFrame:
    """(id, links, root) parts from rows(keys..., id, many, payload), ids distinct within a key.

    compare(key values, payload arrays a, payload arrays b or None for a itself) gives the linked index arrays (i, j), i < j within a
    tile. links counts `many` of the other ends; the parts of an id add up, and (id, root) are edges of its components.
    """
    ship(rows.sparkSession)
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles")).withColumnsRenamed({k: f"_{k}" for k in keys})
    at = rows.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    packed = at.groupBy(*keys, "tiles", "tile").agg(F.collect_list(F.struct("id", "many", "payload")).alias("left_items"))
    alone = packed.where("tiles = 1").select(*keys, "left_items", F.col("left_items").alias("right_items"), F.lit(True).alias("same")).where(F.size("left_items") > 1)
    split = packed.where("tiles > 1")
    left = split.select(*keys, "tile", "left_items", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"))
    right = split.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("tile").alias("_tile"), F.col("left_items").alias("right_items"))
    on = F.col("other") == F.col("_tile")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    work = left.join(right, on).select(*keys, "left_items", "right_items", (F.col("tile") == F.col("other")).alias("same")).unionByName(alone)
    width = len(keys)

    @task("tiles")
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                key = [b.column(c)[k].as_py() for c in range(width)]
                same = b.column(width + 2)[k].as_py()
                a = b.column(width)[k].values
                z = a if same else b.column(width + 1)[k].values
                i, j = compare(key, a.field("payload"), None if same else z.field("payload"))
                if not len(i):
                    continue
                ids, many = a.field("id").to_numpy(zero_copy_only=False), a.field("many").to_numpy(zero_copy_only=False)
                if not same:
                    j = j + len(ids)
                    ids, many = np.concatenate([ids, z.field("id").to_numpy(zero_copy_only=False)]), np.concatenate([many, z.field("many").to_numpy(zero_copy_only=False)])
                yield link_parts(ids, many, i, j)

    return work.mapInArrow(run, "id long, links long, root long")
