"""Strongly connected components, and clusters of texts close enough to tell one thing but not the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.graph import connected_components
from memlake.session import partitions, ship, written

TILE, CHUNK, SLICE = 2048, 256, 65_536  # rows of a tile, of a tile compared at once, and pairs that are looked at at once


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest node among those that each node of directed edges(src, dst) reaches and is reached by.

    Each turn labels every node with the first node, in an order drawn anew, that reaches it, forward and by jumping along such labels.
    The nodes that reach their label back within the same label are a component and leave, with all edges between different labels,
    which no component crosses. All labels settle a component at once, and the drawn order splits long chains as it goes, so turns grow
    with the logarithm of a chain. Every step is a written table. Null ends are dropped; a self loop names its node; repeated edges are one.
    """
    raw = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    nodes = written(raw.select(F.col("src").alias("id")).unionByName(raw.select(F.col("dst").alias("id"))).distinct(), "nodes")
    left = written(raw.where("src <> dst").distinct(), "arcs")
    named = lambda label, end, name: label.select(F.col("id").alias(end), F.col("label").alias(name))
    found = None
    for turn in range(max_rounds):
        met = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))  # the rest lie on no cycle
        alone = written(nodes.join(met, "id", "left_anti").select("id", F.col("id").alias("component")), "alone")
        found = alone if found is None else found.unionByName(alone)
        nodes = written(nodes.join(met, "id", "left_semi"), "nodes")
        if nodes.isEmpty():
            return found
        left = written(left.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "arcs")
        label = written(nodes.select("id", F.struct(F.xxhash64("id", F.lit(turn)).alias("drawn"), F.col("id").alias("of")).alias("label")), "labels")
        while True:
            came = left.join(named(label, "src", "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
            low = label.join(came, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
            far = low.select(F.col("id").alias("of"), F.col("label").alias("far"))
            after = written(low.withColumn("of", F.col("label.of")).join(far, "of", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
            label = after.select("id", "label")
            if after.where("old <> label").isEmpty():
                break
        inner = written(left.join(named(label, "src", "a"), "src").join(named(label, "dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a.of").alias("of")), "arcs")
        back = front = written(label.where("id = label.of").select("id", F.col("id").alias("of")), "back")
        while True:
            front = written(inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "of").distinct().join(back.select("id"), "id", "left_anti"), "back")
            if front.isEmpty():
                break
            back = back.unionByName(front)
        here = written(back.join(back.groupBy("of").agg(F.min("id").alias("component")), "of").select("id", "component"), "component")
        found = found.unionByName(here)
        nodes = written(nodes.join(here.select("id"), "id", "left_anti"), "nodes")
        gone = here.select("id")
        left = written(inner.select("src", "dst").join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"), "arcs")
    raise RuntimeError("components have not settled")


def tiled(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(same, left_items, right_items): each pair of tiles of rows(id, vector, columns, keys) with equal keys and lengths, lists of structs.

    The rows of a key are dealt by a hash over as many tiles as they need, and a pair of tiles is a row of work, so a task holds two tiles
    and a large key spreads over all tasks. Null keys match nothing, nor do null ids or vectors; empty vectors are left out.
    """
    ship(rows.sparkSession)
    sound = rows.dropna(subset=[*keys, "id", "vector"]).where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())).select("id", F.col("vector").cast("array<double>").alias("vector"), *columns, *keys, F.size("vector").alias("_width"))
    by = [*keys, "_width"]
    many = sound.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_tiles"))
    packed = sound.join(many, by).withColumn("_tile", F.pmod(F.xxhash64("id"), "_tiles").cast("int")).groupBy(*by, "_tiles", "_tile").agg(F.collect_list(F.struct("id", "vector", *columns)).alias("right_items"))
    packed = written(packed, "tiles")
    left = packed.select(*by, F.col("_tile").alias("_first"), F.col("right_items").alias("left_items"), F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("_tile"))
    work = left.join(packed.drop("_tiles"), [*by, "_tile"]).select((F.col("_first") == F.col("_tile")).alias("same"), "left_items", "right_items")
    return work.repartition(4 * partitions(rows.sparkSession), F.rand(7))  # pairs of tiles take long for their size


def _close(left: pa.StructArray, right: pa.StructArray, same: bool, low: float, high: float):
    """Places (i, j) of pairs whose cosine is not below low nor above high, i < j within a tile, and their cosines: products of tiles propose, sums in the order of the parts decide."""
    width = len(left.field("vector")[0])
    a = left.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    b = right.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def norms(x):
        total = np.zeros(len(x))
        for k in range(width):
            total = total + x[:, k] * x[:, k]
        return np.sqrt(total)

    with np.errstate(all="ignore"):
        na, nb, ta, tb = norms(a), norms(b), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        for at in range(0, len(a), CHUNK):
            like = (a[at : at + CHUNK] @ tb) / (na[at : at + CHUNK, None] * nb)
            i, j = np.nonzero(~((like < low - 1e-9) | (like > high + 1e-9)))
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), SLICE):
                x, y = i[s : s + SLICE], j[s : s + SLICE]
                total = np.zeros(len(x))
                for k in range(width):
                    total = total + ta[k, x] * tb[k, y]
                both = na[x] * nb[y]
                exact = np.where(both == 0, 0.0, total / both)
                on = ~((exact < low) | (exact > high))
                yield x[on], y[on], exact[on]


def close_pairs(rows: DataFrame, keys: list[str], low: float, high: float = float("inf")) -> DataFrame:
    """(x, y, cosine) of all pairs of rows(id, vector, keys) with equal keys and lengths and low <= cosine <= high, each once, in no order.

    Every pair is compared, by products of tiles in double precision; no more than two tiles are in a task at once. A zero vector's cosine is 0.
    """
    work = tiled(rows, keys, [])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, left, right = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values
                for i, j, like in _close(left, right, same, low, high):
                    yield pa.RecordBatch.from_arrays([left.field("id").take(pa.array(i)), right.field("id").take(pa.array(j)), pa.array(like)], ["x", "y", "cosine"])

    return work.mapInArrow(run, f"x {kind}, y {kind}, cosine double")


def _sound(rows: DataFrame) -> DataFrame:
    """rows whose vector is finite and not zero."""
    return rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))


def band_pairs(rows: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(a, b, cosine) with a < b of rows(id, vector, keys) with equal keys and low <= cosine <= high.

    Null keys match nothing; null, zero and non-finite vectors pair with nothing, nor do vectors of different lengths. Of repeated ids the
    largest cosine counts.
    """
    pairs = close_pairs(_sound(rows.select("id", "vector", *keys)), keys, low, high).where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("cosine"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of 0..n-1 that each reaches over links i-j."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def tagged_links(rows: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(a, b) that join the rows(id, vector, tags, keys) which pairs in the band with a common tag join, at most a row for each row of a pair of tiles."""
    work = tiled(_sound(rows.select("id", "vector", F.filter("tags", lambda t: t.isNotNull()).alias("tags"), *keys)), keys, ["tags"])
    kind = rows.schema["id"].dataType.simpleString()

    def sharing(left, right):
        """For places (i, j): whether their tags meet."""
        n, m = left.field("tags").value_lengths().to_numpy(), right.field("tags").value_lengths().to_numpy()
        codes = pa.concat_arrays([left.field("tags").flatten(), right.field("tags").flatten()]).dictionary_encode()
        code, top = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary) + 1
        sides = [(n, np.cumsum(n) - n), (m, n.sum() + np.cumsum(m) - m)]

        def of(places, side):
            size, start = side[0][places], side[1][places]
            pair = np.repeat(np.arange(len(places)), size)
            return pair * top + code[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]

        def test(i, j):
            on = np.zeros(len(i), bool)
            on[np.intersect1d(of(i, sides[0]), of(j, sides[1])) // top] = True
            return on

        return test

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, left, right = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(2)[k].values
                meet, shift = sharing(left, right), 0 if same else len(left)
                low_ = np.arange(len(left) + (0 if same else len(right)))
                for i, j, _ in _close(left, right, same, low, high):
                    on = meet(i, j)
                    every = np.arange(len(low_))
                    low_ = _roots(len(low_), np.concatenate([every, i[on]]), np.concatenate([low_, j[on] + shift]))
                ids = left.field("id") if same else pa.concat_arrays([left.field("id"), right.field("id")])
                moved = np.flatnonzero(low_ != np.arange(len(low_)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(low_[moved]))], ["a", "b"])

    return work.mapInArrow(run, f"a {kind}, b {kind}").where("a <> b")


def distil_clusters(rows: DataFrame, keys: list[str], low: float = 0.75, high: float = 0.85, least: int = 3) -> DataFrame:
    """(id, cluster, shared) of rows(id, vector, tags, keys): clusters linked by pairs in the band that share a tag, of at least `least` rows
    that all share one; shared are the tags of all of them, sorted. cluster is its smallest id.

    Links chain, so a cluster's rows need not share what each pair shares: such a cluster is left out whole. Null tags are none.
    """
    tagged = written(rows.withColumn("tags", F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).where(F.size("tags") > 0), "tagged")
    tags = tagged.select("id", "tags")
    parts = written(connected_components(written(tagged_links(tagged, keys, low, high), "links")), "parts")
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    held = parts.join(size, "component").join(tags, "id")
    common = held.select("component", "n", F.explode("tags").alias("tag")).groupBy("component", "n", "tag").agg(F.count(F.lit(1)).alias("have")).where("have = n")  # a tag of all, not of each pair
    shared = common.groupBy("component").agg(F.array_sort(F.collect_list("tag")).alias("shared"))
    return held.join(shared, "component").select("id", F.col("component").alias("cluster"), "shared")
