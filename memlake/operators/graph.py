"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that each node of an edge reaches. Edges have no direction; null ends are dropped.

    Smallest labels go to the neighbours and then jump to their own label's label, so chains halve each round. Every round is a
    written table: nothing is gathered on the driver, and a lost executor costs one round.
    """
    ab = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = written(ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"), F.lit(True).alias("moved")), "labels")
    for _ in range(max_rounds):
        if labels.where("moved").isEmpty():
            break
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("far"))
        labels = written(
            low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("new"), "old").select("id", F.col("new").alias("component"), (F.col("new") != F.col("old")).alias("moved")),
            "labels",
        )
    else:
        raise RuntimeError("components have not settled")
    return labels.select("id", "component")


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int | None = 12) -> DataFrame:
    """(id, hop) of nodes reached from seeds(id) over undirected edges(src, dst) in at most `hops` steps.

    cap keeps the first nodes by (hop, id), which the original leaves to chance.
    """
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))).where("x <> y").distinct()
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        front = both.join(front.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        seen = seen.unionByName(front)
    reached = seen.where("hop > 0")
    return reached.orderBy("hop", "id").limit(cap) if cap else reached


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node of edges(src, dst)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def insert_edges(edges: DataFrame) -> DataFrame:
    """Edges unique by (src, dst, type) without self loops; the earliest created_at stays."""
    return edges.where("src <> dst").groupBy("src", "dst", "type").agg(F.min("created_at").alias("created_at"))


def shared_entity_edges(entities: DataFrame, least: int = 2, fan_out: int = 8, most_in_bucket: int = 32) -> DataFrame:
    """(src, dst, shared): pairs src < dst of entities(id, entity) that share at least `least` entities; each src keeps its first fan_out by (shared desc, dst).

    Entities of more than most_in_bucket ids link nothing, as in the original: such an entity tells nothing, and its pairs would grow with the square.
    """
    e = entities.select("id", "entity").distinct()
    rare = e.join(e.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most_in_bucket)), "entity")
    pairs = rare.alias("x").join(rare.alias("y"), (F.col("x.entity") == F.col("y.entity")) & (F.col("x.id") < F.col("y.id")))
    shared = pairs.groupBy(F.col("x.id").alias("src"), F.col("y.id").alias("dst")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("shared"), "dst"))
    return shared.withColumn("r", rank).where(F.col("r") <= fan_out).drop("r")


def distances(edges: DataFrame, seeds: DataFrame, most: int = 16) -> DataFrame:
    """(id, depth, via): fewest steps along directed edges(src, dst) from seeds(id) and the smallest node before it on such a way.

    The edges are written once and each frontier is written too, so a round costs one join of the frontier; it ends when a frontier
    is empty or after `most` steps. Null ends are dropped.
    """
    steps = written(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "steps")
    front = seeds.where("id is not null").select(F.col("id").cast("long").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via")).distinct()
    seen = front = written(front, "front")
    for depth in range(1, most + 1):
        out = steps.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        front = written(out.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, source: int, target: int, most: int = 16) -> list[int] | None:
    """The nodes of one shortest way from source to target, the smallest before each; None without one within `most` steps.

    At most `most` rows reach the driver.
    """
    spark = edges.sparkSession
    known = distances(edges, spark.createDataFrame([(source,)], "id long"), most)
    path = [target]
    while path[-1] != source:
        row = known.where(F.col("id") == path[-1]).select("via").first()
        if row is None:
            return None
        path.append(row[0])
    return path[::-1]


def merge_clusters(rows: DataFrame, keys: list[str], order: list[str], threshold: float, name: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, survivor): rows that a survivor of equal keys absorbs, its cosine with them being at least the threshold.

    Each bucket's first row by (order, id) survives and takes the near ones; the rest go on to the next turn. Equal keys mean equal
    text, so a second turn is rare. A turn compares each row with one survivor, never all with all, and every row is looked at.
    Null keys form no bucket; null or zero vectors are near nothing.
    """
    from memlake.functions.vector import cosine

    left = rows.select(F.col(name).alias("id"), F.col(vector).alias("vector"), F.struct(*order, F.col(name)).alias("place"), *keys).dropna(subset=["id", *keys])
    found = None
    while True:
        first = left.groupBy(*keys).agg(F.min(F.struct("place", "id", "vector")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.col("f.id").alias("survivor"), F.col("f.vector").alias("v"))
        judged = written(left.join(first, keys).where("id <> survivor").withColumn("near", F.coalesce(cosine(F.col("vector"), F.col("v")) >= threshold, F.lit(False))), "merge")
        absorbed = judged.where("near").select("id", "survivor")
        found = absorbed if found is None else found.unionByName(absorbed)
        left = judged.where("not near").select("id", "vector", "place", *keys)
        if left.isEmpty():
            return found
