"""Queries that once gave less than the whole result."""

from collections import Counter, defaultdict
from itertools import combinations

import __spark_entry__ as entry


def test_shared_entities_of_all_clicks(spark, tmp_path):
    rows = [(5000 + k, 1 + k % 3, "click", f'{{"k": {k // 3}}}') for k in range(12)] + [(9000, 7, "view", '{"k": 0}'), (9001, 7, "view", '{"k": 1}'), (9002, 8, "click", '{"k": 0}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    held = defaultdict(set)
    for _, user, kind, props in rows:
        if kind == "click":
            held[props].add(user)
    want = Counter(p for users in held.values() for p in combinations(sorted(users), 2))
    got = entry.queries()["shared_entities_all"](spark, str(tmp_path)).collect()
    assert {(x["src"], x["dst"]): x["shared"] for x in got} == {p: n for p, n in want.items() if n >= 2} and len(got) == 3


def test_document_frequency_of_every_term(spark, tmp_path):
    spark.createDataFrame([(1, "rare often often"), (2, "often"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["document_frequency_all"](spark, str(tmp_path)).collect()
    assert {(x["term"], x["df"], x["cf"]) for x in got} == {("rare", 1, 1), ("often", 2, 3)}
