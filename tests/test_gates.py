"""Gates on made rows: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import gates as G


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], " ,".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())).select(column).first()[0]


def test_cues_are_whole_words(spark):
    said = {"it is known": False, "(Switched  from tabs)": True, "as-of 2024": True, "NOW": True, "": False, None: False}
    assert {t: one(spark, G.has_cue(F.col("t")), t=t) for t in said} == said


def test_times_with_offsets(spark):
    read = lambda t: one(spark, G.rfc3339_millis(F.col("t")), t=t)
    assert read("1970-01-01T02:30:00.5+02:30") == 500 and read("1970-01-01T00:00:00Z") == 0 and read("1969-12-31T23:00:00-01:00") == 0
    assert read("yesterday") is None and read("2024-13-01T00:00:00Z") is None and read(None) is None


def test_windows():
    assert G.window_days("7d") == 7 and G.window_days("all") is None
    with pytest.raises(ValueError):
        G.window_days("soon")


def test_weights_sum_to_one():
    assert all(abs(sum(G.task_weights(k).values()) - 1) < 1e-12 for k in ("feature", *G.TASK_FACTORS))


def test_strip_tags_keeps_a_bare_tag(spark):
    strip = lambda t: one(spark, G.strip_tags(F.col("t")), t=t)
    assert strip("[tags: a] body\nmore") == "body\nmore" and strip("[tags: a] ") == "[tags: a] " and strip("plain") == "plain" and strip(None) is None


def test_abstention_empties_the_list(spark):
    rows = spark.createDataFrame([(0.9, None), (0.2, 0.3)], "score double, cosine double")
    assert G.abstain(rows, 0.5, 0.35).count() == 2 and G.abstain(rows, 0.95, 0.0).count() == 0 and G.abstain(rows, 0.5, 0.5).count() == 0
    assert G.abstain(rows.where("score > 5"), 0.0, 0.0).count() == 0


def test_quality_gate(spark):
    lessons = spark.createDataFrame([(1, "x", "short", False), (2, "x", "use this for now please", False), (3, "x", "use this for now please", True), (4, "x", " a known lesson ", None), (5, "y", "a known lesson", None), (6, "x", None, None)], "id int, kind string, text string, lasting boolean")
    stored = spark.createDataFrame([("x", "a known lesson"), ("x", "a known lesson")], "kind string, text string")
    got = {r["id"]: r["verdict"] for r in G.quality_gate(lessons, stored, ["kind"]).collect()}
    assert got == {1: "too_short", 2: "transient", 3: "keep", 4: "duplicate", 5: "keep", 6: "too_short"}


def test_recall_gate_asks_for_clear_evidence(spark):
    rows = spark.createDataFrame([("sure", 1.0, ["migrate", "cach"]), ("half", 1.0, ["migrat", "other"]), ("none", 1.0, ["other"]), ("zero", 0.0, ["migrat", "cache"])], "q string, score double, words array<string>")
    got = {r["q"]: (r["eligible"], r["coverage"], r["passes"]) for r in G.recall_gate(rows, "q", ["migrat", "cache"]).collect()}
    assert got == {"sure": (1, 1.0, True), "half": (1, 0.5, False), "none": (0, 0.0, False), "zero": (0, 0.0, False)}


def test_survivors_and_ties(spark):
    rows = spark.createDataFrame([(1, 10, -5.0, 3), (1, 11, 1.0, 2), (1, 12, 1.0, 2), (2, 20, 0.0, None)], "c int, id int, score double, ts int")
    assert {tuple(r) for r in G.survivors(rows, "c").collect()} == {(1, 11), (2, 20)}


def test_metrics_against_gold(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "q int, id string, rank int")
    gold = spark.createDataFrame([(1, "c"), (1, "b"), (1, "b"), (3, "z")], "q int, id string")
    assert {tuple(r) for r in G.retrieval_metrics(ranked, gold, "q").collect()} == {(1, 0.5, 1, 1.0, 1, 0.5), (3, 0.0, 0, 0.0, 0, 0.0)}
    assert {tuple(r) for r in G.stale_hits(ranked, gold, "q", 2).collect()} == {(1, 1), (2, 0)}


def test_floor_percentile(spark):
    rows = spark.createDataFrame([("a", float(k % 20)) for k in range(100)] + [("b", 1.0), ("b", None)], "g string, v double")
    assert {tuple(r) for r in G.percentile_by_floor(rows, "g", "v", 0.95).collect()} == {("a", 19.0), ("b", 1.0)}


def test_term_weights_look_for_the_term_before_the_pattern(spark):
    import math

    rows = spark.createDataFrame([("Cache hit",), ("precache",), (None,), ("the CACHES",), ("x_cache",), ("",)], "text string")
    found = G.term_weights(rows, ["cache", "a.b"])
    assert "Contains(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [round(w, 9) for w in found.first()] == [round(math.log(7 / 3), 9), round(math.log(7), 9)]
