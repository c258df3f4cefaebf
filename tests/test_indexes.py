"""Two time axes and the vector index against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from memlake.operators import bitemporal, vector_index

DAY = datetime(2024, 1, 1)


def when(k):
    return None if k is None else DAY + timedelta(hours=k)


def brute(memories, revisions, asks):
    out = {}
    for ask, m, known, valid in asks:
        if ask is None or known is None or valid is None:
            continue
        for x, text, created, gone, start, end in memories:
            if x != m or created > known or (gone is not None and gone <= known) or (start is not None and start > valid) or (end is not None and end <= valid):
                continue
            rows = [(k, p, e, t) for y, e, t, k, f, p in revisions if y == m and k <= known and f <= valid]
            if any(y == m for y, *_ in revisions) and created <= known and (start is None or start <= valid):
                rows.append((created, -1, f"baseline:{m}", text))
            best = max(rows, default=(0, 0, None, text))
            out[str(ask)] = (str(m), best[2], best[3])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_texts_as_they_were_known(spark, seed):
    rnd = random.Random(seed)
    maybe = lambda n: rnd.choice([None, rnd.randrange(n)])
    memories = [(m, f"own {m}", rnd.randrange(6), maybe(30), maybe(20), maybe(30)) for m in range(12)]
    revisions = [(rnd.randrange(9), f"e{k}", f"rev {k}", rnd.randrange(25), rnd.randrange(25), k) for k in range(60)]
    asks = [(a, rnd.randrange(14), rnd.randrange(28), rnd.randrange(28)) for a in range(300)] + [(999, 1, None, 3), (None, 1, 3, 3), (998, 1, 3, None)]
    t = "timestamp_ntz"
    got = bitemporal.as_known(
        spark.createDataFrame([(m, x, *map(when, r)) for m, x, *r in memories], f"memory_id long, text string, created_at {t}, invalidated_at {t}, valid_from {t}, valid_to {t}"),
        spark.createDataFrame([(m, e, x, when(k), when(f), p) for m, e, x, k, f, p in revisions], f"memory_id long, event_id string, text string, known_at {t}, effective_at {t}, place long"),
        spark.createDataFrame([(a, m, when(k), when(v)) for a, m, k, v in asks], f"ask long, memory_id long, known_at {t}, valid_at {t}"),
    )
    assert {r["ask"]: (r["memory_id"], r["revision"], r["text"]) for r in got.collect()} == brute(memories, revisions, asks)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def exact(rows, q, k):
    out = []
    for i, v in rows:
        if i is not None and v and len(v) == len(q) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out.append((round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6), i))
    return sorted(out, key=lambda r: (-r[0], r[1]))[:k]


@pytest.fixture(scope="module")
def clouds(spark, tmp_path_factory):
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(30, 16))
    rows = [(k, (middle[k % 30] + 0.35 * rnd.normal(size=16)).tolist()) for k in range(3000)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 5), (3004, [None] * 16), (None, [1.0] * 16), (5, rows[5][1])]
    path = str(tmp_path_factory.mktemp("vectors"))
    vector_index.build(spark, path, vectors(spark, rows))
    return rows, path


def test_recall_of_pruned_probes(spark, clouds):
    rows, path = clouds
    hit = total = 0
    for q in (0, 7, 1234, 2999):
        want = {i for _, i in exact(rows, rows[q][1], 80)}
        got = vector_index.search(spark, path, rows[q][1], 80, probes=10)
        hit, total = hit + len(want & {r["id"] for r in got.collect()}), total + len(want)
    assert hit / total >= 0.95


def test_exact_search_misses_nothing(spark, clouds):
    rows, path = clouds
    rnd = np.random.default_rng(9)
    for q in (rows[11][1], rnd.normal(size=16).tolist(), (-np.array(rows[0][1])).tolist()):
        got = vector_index.search(spark, path, q, 50, probes=2, exact=True)
        found = [(r["cosine"], r["id"]) for r in got.collect()]
        assert [i for _, i in found] == [i for _, i in exact(rows, q, 50)] and np.allclose([c for c, _ in found], [c for c, _ in exact(rows, q, 50)], atol=2e-6)


def test_only_probed_cells_are_read(spark, clouds):
    rows, path = clouds
    df = vector_index.search(spark, path, rows[0][1], 80, probes=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = vector_index._scored(spark, path, np.array(rows[0][1]), [3, 4]).selectExpr("input_file_name() AS f").distinct().collect()
    assert {r["f"].split("/cell=")[1].split("/")[0] for r in read} == {"3", "4"}


def test_an_index_of_nothing(spark, tmp_path):
    vector_index.build(spark, str(tmp_path / "v"), vectors(spark, [(1, None), (2, [0.0, 0.0])]))
    assert vector_index.search(spark, str(tmp_path / "v"), [1.0, 0.0], 5).count() == 0
