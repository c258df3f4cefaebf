"""Supersession, arbitration, components, distil clusters and the policy against brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import arbitration as A
from memlake.operators import communities as C
from memlake.operators import policy as P

POOL = "query_id long, id long, kind string, summary string, created_at timestamp_ntz, embedding array<double>, cosine double, score double"
T0 = datetime(2024, 1, 1)


def replaced(spark, rows):
    pool = spark.createDataFrame([(q, i, k, s, None if t is None else T0 + timedelta(seconds=t), v, c, 1.0) for q, i, k, s, t, v, c in rows], POOL)
    got = A.supersession_penalty(pool).collect()
    assert len(got) == len(rows)
    return {(r["query_id"], r["id"]) for r in got if r["superseded_hint"] and r["score"] == 0.8}


def test_the_newer_of_near_duplicates_wins(spark):
    v, w = [1.0, 0.0], [0.9, math.sqrt(1 - 0.81)]
    rows = [(1, 1, "memory", "port is 80", 0, v, 0.5), (1, 2, "memory", "port is 81", 100, w, 0.4), (1, 3, "memory", "port is 82", 200, v, 0.3)]
    assert replaced(spark, rows) == {(1, 1), (1, 2)}
    assert replaced(spark, [(1, *rows[0][1:]), (2, *rows[1][1:])]) == set()  # other pools don't meet
    assert replaced(spark, [rows[0], (1, 2, "file", "port is 81", 100, w, 0.4), (1, 3, "memory", "x", None, v, 0.3), (1, 4, "memory", "x", 9, None, 0.3)]) == set()


def test_equal_times_need_one_cue(spark):
    v = [1.0, 0.0]
    assert replaced(spark, [(1, 1, "memory", "port is 80", 0, v, 0.5), (1, 2, "memory", "port is 81", 0, v, 0.4)]) == set()
    assert replaced(spark, [(1, 1, "memory", "port is now 80", 0, v, 0.5), (1, 2, "memory", "port is 81", 0.5, v, 0.4)]) == {(1, 2)}
    assert replaced(spark, [(1, 1, "memory", "port is now 80", 0, v, 0.5), (1, 2, "memory", "port is now 81", 0.5, v, 0.4)]) == set()
    assert replaced(spark, [(1, 1, "memory", "port is now 80", 0, v, 0.5), (1, 2, "memory", "port is 81", 1.0, v, 0.4)]) == {(1, 1)}


def test_far_rewrites_need_a_closer_replacement_with_the_cue(spark):
    v, far = [1.0, 0.0], [0.5, math.sqrt(0.75)]
    old, new = "deploy service cluster through jenkins pipeline", "deploy service cluster switched from jenkins pipeline"
    assert replaced(spark, [(1, 1, "memory", old, 0, v, 0.4), (1, 2, "memory", new, 90, far, 0.4)]) == {(1, 1)}
    assert replaced(spark, [(1, 1, "memory", old, 0, v, 0.5), (1, 2, "memory", new, 90, far, 0.4)]) == set()
    assert replaced(spark, [(1, 1, "memory", new, 0, v, 0.4), (1, 2, "memory", old, 90, far, 0.5)]) == set()
    assert replaced(spark, [(1, 1, "memory", old, 0, v, 0.4), (1, 2, "memory", "lunch switched from noon", 90, far, 0.5)]) == set()


def test_rerank_and_arbitration(spark):
    ddl = "query_id long, id long, kind string, raw_in double, usefulness double, trust double, superseded_hint boolean"
    rows = [(1, 1, "memory", 0.9, 1.5, None, False), (1, 2, "memory", 0.95, None, None, True), (1, 3, "memory", 0.2, None, None, False), (2, 4, "memory", 0.2, 0.5, None, False), (2, 5, "memory", 0.1, 9.0, 2.0, False), (3, 6, "file", 0.1, None, None, False), (4, 7, "memory", 0.91, None, 0.5, False)]
    out = A.rerank(spark.createDataFrame(rows, ddl), F.col("raw_in"), floor=0.3, cap=2)
    assert {(r["query_id"], r["position"]): (r["id"], round(r["score"], 6)) for r in out.collect()} == {(1, 1): (1, 1.0), (1, 2): (2, 0.76), (2, 1): (5, 0.15), (2, 2): (4, 0.1), (3, 1): (6, 0.1), (4, 1): (7, 0.455)}
    evidence = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5)], "query_id long, top double")
    left = lambda e, least, **k: {r[0] for r in A.arbitrate(out, e, least, **k).select("query_id").collect()}
    assert left(evidence, 0.6) == {1, 3, 4}  # 2 is unsure, 3 holds a file
    assert left(evidence, 0.6, scorer=False) == {3}
    assert left(evidence, 0.5) == left(evidence, 0.0) == {1, 2, 3, 4}  # at the bound, and turned off
    assert left(evidence.withColumn("top", F.lit(-1.0)), 0.6) == {1, 2, 3, 4}


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in reach[n]:
                    reach[n].add(b)
                    todo.append(b)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("case", ["chain", "ring and hub", "random", "empty"])
def test_strong_components(spark, case):
    rnd = random.Random(4)
    edges = {
        "chain": [(k, k + 1) for k in range(24)],
        "ring and hub": [(1000 + k, 1000 + (k + 1) % 9) for k in range(9)] + [(100, 101), (101, 100), (1005, 100)] + [(0, k) for k in range(1, 40)] + [(k, 0) for k in range(1, 40, 2)] + [(7, 7), (99, 99)],
        "random": [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)],
        "empty": [],
    }[case]
    got = C.strong_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == brute_components(edges)


def test_band_pairs_and_distil_clusters(spark):
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(12, 8))
    rows = [(k, (middle[k % 12] + 0.45 * rnd.normal(size=8)).tolist(), [f"t{k % 2}", f"u{k % 7}"] if k % 11 else None, "ab"[k % 12 // 6]) for k in range(400)]
    rows += [(900, None, ["t0"], "a"), (901, [0.0] * 8, ["t0"], "a"), (902, [1.0] * 3, ["t0"], "a"), (903, rows[0][1], ["t0"], None), (904, [float("nan")] * 8, ["t0"], "a")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, tags array<string>, scope string")
    got = {(r["a"], r["b"]) for r in C.band_pairs(df.select("id", "vector", "scope"), ["scope"], 0.75, 0.85).collect()}
    like = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    sound = rows[:400]
    want = {(a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and a[3] == b[3] and 0.75 <= like(a[1], b[1]) <= 0.85}
    assert got == want and want
    top = {x[0]: x[0] for x in sound}
    find = lambda x: x if top[x] == x else find(top[x])
    tags = {x[0]: set(x[2] or ()) for x in sound}
    linked = set()
    for a, b in sorted(want):
        if tags[a] & tags[b]:
            linked |= {a, b}
            top[max(find(a), find(b))] = min(find(a), find(b))
    clusters = {}
    for x in linked:
        clusters.setdefault(find(x), set()).add(x)
    expect = {(x, c, tuple(sorted(set.intersection(*(tags[m] for m in ms))))) for c, ms in clusters.items() for x in ms if len(ms) >= 3 and set.intersection(*(tags[m] for m in ms))}
    assert {(r["id"], r["cluster"], tuple(r["shared"])) for r in C.distil_clusters(df, ["scope"]).collect()} == expect and expect


def test_the_fit_equals_numpy(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.random((300, 7)), 2)
    y = (x[:, 0] + 0.3 * rnd.normal(size=300) > 0.5).astype(float)
    df = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in P.FEATURES) + ", useful boolean")
    prior = np.array(P.PRIOR_WEIGHTS)

    def numpy_fit(epochs):
        w, b = prior, P.PRIOR_BIAS
        for _ in range(epochs):
            e = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.05 * (x.T @ e / 300 + 0.01 * (w - prior)), b - 0.05 * (e.mean() + 0.01 * (b - P.PRIOR_BIAS))
        return np.append(w, b)

    got = P.fit(df)
    assert np.allclose(np.append(got["weights"], got["bias"]), numpy_fit(400), atol=1e-9) and got["trained_on"] == 300
    wide = P.fit(df, epochs=12, on_driver=0)  # the rounds as aggregates
    assert np.allclose(np.append(wide["weights"], wide["bias"]), numpy_fit(12), atol=1e-9)
    assert P.fit(df.limit(39))["trained_on"] == 0 and P.fit(df.withColumn("useful", F.lit(True)))["weights"] == list(P.PRIOR_WEIGHTS)


def test_examples_are_useful_when_cited_at_or_after(spark):
    given = spark.createDataFrame([("m", 5), ("m", 6), ("m", 7), ("n", 1), (None, 1), ("m", None)], "memory_id string, ts long")
    cited = spark.createDataFrame([("m", 2), ("m", 6), (None, 9)], "memory_id string, cited_at long")
    assert sorted(map(tuple, P.labelled_examples(given, cited).collect()), key=str) == sorted([("m", 5, True), ("m", 6, True), ("m", 7, False), ("n", 1, False), (None, 1, False), ("m", None, False)], key=str)


def test_holdout_keeps_linked_cases_together(spark):
    rnd = random.Random(3)
    cases = [(k, [f"q{rnd.randrange(60)}", f"m{rnd.randrange(200)}"] if k % 9 else [None]) for k in range(120)] + [(500, [])]
    got = {r["case_id"]: (r["part"], r["holdout"]) for r in P.grouped_holdout(spark.createDataFrame(cases, "case_id long, keys array<string>")).collect()}
    top = {k: k for k, _ in cases}
    find = lambda x: x if top[x] == x else find(top[x])
    owner = {}
    for k, keys in cases:
        for x in filter(None, keys):
            if x in owner:
                a, b = find(owner[x]), find(k)
                top[max(a, b)] = min(a, b)
            owner.setdefault(x, k)
    order = {c: n for n, c in enumerate(sorted({find(k) for k, _ in cases}))}
    assert got == {k: (find(k), order[find(k)] % 5 == 0) for k, _ in cases}


def test_close_pairs_by_tiles_lose_none(spark, monkeypatch):
    """Keys of several tiles, with every pair of a key compared once: no row is written once a cell."""
    monkeypatch.setattr(C, "TILE", 40)
    rnd = np.random.default_rng(8)
    v = rnd.normal(size=(260, 6)).astype(np.float32)
    rows = [(k, v[k].tolist(), "ab"[k % 4 // 3]) for k in range(260)] + [(300, None, "a"), (301, [0.0] * 6, "a"), (302, [1.0] * 2, "a"), (303, v[0].tolist(), None), (304, [], "a")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, scope string")
    work = C.tiled(df, ["scope"], [])
    assert work.count() > 2 and max(r["n"] for r in work.selectExpr("size(left_items) AS n").collect()) < 100
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {(a, b) for a in range(260) for b in range(a + 1, 260) if rows[a][2] == rows[b][2] and u[a] @ u[b] >= 0.6}
    got = [(min(r["x"], r["y"]), max(r["x"], r["y"])) for r in C.close_pairs(df, ["scope"], 0.6).collect()]
    assert len(got) == len(want) and set(got) == want
