"""Operators on small made rows."""

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.vector import cosine
from memlake.operators import graph, rank, temporal


def test_components_chain_and_nulls(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 60: 50}
    assert graph.connected_components(e.where("a > 1000")).count() == 0


def test_bfs_cap_and_order(spark):
    e = spark.createDataFrame([(1, k) for k in range(2, 30)], "src long, dst long")
    assert [r["id"] for r in graph.bfs(e, spark.createDataFrame([(1,)], "id long")).orderBy("hop", "id").collect()] == list(range(2, 14))


def test_edges_insert(spark):
    e = spark.createDataFrame([(1, 2, "t", 5), (1, 2, "t", 3), (4, 4, "t", 1)], "src long, dst long, type string, created_at long")
    assert [tuple(r) for r in graph.insert_edges(e).collect()] == [(1, 2, "t", 3)]


def test_rrf_ties_break_on_id(spark):
    one = spark.createDataFrame([(2, 1.0), (1, 1.0)], "id long, score double")
    got = {r["id"]: r["score"] for r in rank.rrf([one]).collect()}
    assert got[1] == 1.0 and got[2] < 1.0


def test_normalise_zero_and_all(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (3, "b", 2.0), (4, "b", 1.0)], "id long, kind string, raw double")
    assert {r["id"]: r["relevance"] for r in rank.normalise(df, "kind").collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.5}


def test_cosine_guards(spark):
    df = spark.sql("SELECT array(1.0, 0.0) a, array(0.0, 0.0) z, array(1.0) s")
    r = df.select(cosine(F.col("a"), F.col("a")).alias("one"), cosine(F.col("a"), F.col("z")).alias("zero"), cosine(F.col("a"), F.col("s")).alias("short")).first()
    assert tuple(r) == (1.0, 0.0, 0.0)


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 10, 60), (1, 2, 11, 50), (1, 3, 12, 40)], "query_id long, rank int, id long, cost long")
    r = rank.pack_budget(df, 100).first()
    assert r["ids"] == [10, 12] and r["used"] == 100


def test_mmr_prefers_the_unlike(spark):
    df = spark.createDataFrame([(0, 1, "a", 1.0, [1.0, 0.0]), (0, 2, "a", 0.95, [1.0, 0.0]), (0, 3, "a", 0.8, [0.0, 1.0])], "query_id long, id long, kind string, score double, embedding array<double>")
    assert [r["id"] for r in rank.mmr(df).orderBy("position").collect()] == [1, 3, 2]


def test_drift_needs_three_turns(spark):
    s = [(1, k, v) for k, v in enumerate([1.0, 0.1, 0.2, 0.9, 0.1, 0.1, 0.1])] + [(2, k, v) for k, v in enumerate([0.1, 0.1, 0.1])]
    got = temporal.drift(spark.createDataFrame(s, "session long, turn long, similarity double")).collect()
    assert [(r["session"], r["drift_at"]) for r in got] == [(1, 4)]


def test_spans_take_the_last_opening(spark):
    e = spark.createDataFrame([("r", 1, 1, "in"), ("r", 2, 2, "in"), ("r", 3, 3, "out"), ("r", 4, 4, "out")], "key string, id long, ts long, kind string")
    assert [tuple(r) for r in temporal.spans(e, "in", "out").collect()] == [("r", 2, 3)]


def test_winner_and_conflict(spark):
    s = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 5, "a")], "loser long, survivor long, clock string")
    assert {tuple(r) for r in temporal.winners(s).collect()} == {(1, 6, True), (2, 5, False)}


def test_live_interval_is_half_open(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL, NULL, NULL, NULL), (2, NULL, NULL, 5, 10), (3, NULL, NULL, 10, 10), (4, 1, NULL, NULL, NULL) AS t(id, invalidated_at, superseded_by, valid_from, valid_to)")
    assert [r["id"] for r in df.where(temporal.live(F.lit(10))).collect()] == [1]
    assert [r["id"] for r in df.where(temporal.live(F.lit(9))).collect()] == [1, 2]


def test_text_helpers(spark):
    df = spark.sql("SELECT '  A  b!!' t, '[tags: b, A, b] x' g, '' e")
    r = df.select(T.normalise_memory(F.col("t")), T.tags(F.col("g")), T.estimate_tokens(F.col("e"))).first()
    assert tuple(r) == ("a b", ["a", "b"], 0)
