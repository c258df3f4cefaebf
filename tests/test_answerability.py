"""Questions for a value and texts that hold it, another one, or none."""

import pytest

from memlake.operators import answerability as A

PRESENT, MISSING, OTHER = "value_present", "missing_value", "unrecognized"
CASES = [
    ("What password does the Orchid gateway need?", "The gateway password is `hunter-2`.", PRESENT),
    ("Which magic port is open?", "port 80", OTHER),
    ("What is the gateway password?", "The gateway password is `hunter-2`.", PRESENT),
    ("What is the gateway password?", "The listener password is `hunter-2`.", MISSING),
    ("What is the password?", "The password is required; password = ab1", PRESENT),
    ("What is the password?", "password is unknown", MISSING),
    ("What is the password?", "password: set.", MISSING),
    ("What password is required?", "No password is required here.", PRESENT),
    ("What is the password?", "For example password = ab1, so the port is 80", MISSING),
    ("What is the encryption key?", "Clave de cifrado = zz9", PRESENT),
    ("¿Cuál es la contraseña?", "La contraseña es abc", PRESENT),
    ("Which Orchid version?", "orchid version v2.1", PRESENT),
    ("which orchid version?", "orchid version v2.1", OTHER),
    ("What is the SQLite version?", "We do not use SQLite version 3.45.", MISSING),
    ("What is the SQLite version?", "We do not use Redis, SQLite version 3.45.", PRESENT),
    ("What is the database timeout?", "Gateway timeout is 30 seconds. The database stores state.", MISSING),
    ("What is the database timeout?", "repo:fact - [tags: a] [b]  The database timeout is 1.5 minutes", PRESENT),
    ("How long are logs kept?", "Logs are kept, by rule, for 12 hours", PRESENT),
    ("How long are logs kept?", "Backups are kept for 12 hours", MISSING),
    ("How many replicas are there?", "4 production replicas", PRESENT),
    ("What are the port and the password?", "port 80, password = x", OTHER),
    ("What is the password policy?", "password = x", OTHER),
    ("What port should we use?", "port 80", OTHER),
    ("Why is the port 80?", "port 80", OTHER),
    ("What is `cache.max`?", "cache.max = 20", PRESENT),
    ("What is `cache.max`?", "cache.min = 20; x.cache.max: 3", MISSING),
    ("What is `cache.max`?", "cache.max = unknown", MISSING),
    ("What does `cache.max` do?", "cache.max = 20", OTHER),
    ("What is `cache.max` or `cache.min`?", "cache.max = 20", OTHER),
    ("What is the `server` port?", "the server's port: 8080", OTHER),
    ("What is the server port?", "the server's port:\n8080", PRESENT),
    ("What is the memory limit?", "memory limit 512 MiB", PRESENT),
    ("What is the retry count?", "5 retries", PRESENT),
    ("What is the port?", None, MISSING),
    ("What is the port?", "", MISSING),
    (None, "port 80", OTHER),
    ("", "port 80", OTHER),
]


def test_evidence_of_each_case(spark):
    rows = spark.createDataFrame([(k, q, t) for k, (q, t, _) in enumerate(CASES)], "id long, question string, text string")
    got = {r["id"]: r["evidence"] for r in A.evidence(rows).collect()}
    assert [(k, got[k]) for k in range(len(CASES))] == [(k, want) for k, (_, _, want) in enumerate(CASES)]


def test_long_texts_repeats_clashes_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "What is the port?", "[a]" * 20_000 + "port 1 " * 20_000 + "; x", "old")] * 2 + [(2, "What is the port?", "no port 1 " * 20_000, "old")], "id long, question string, text string, evidence string")
    assert sorted((r["id"], r["evidence"]) for r in A.evidence(rows).collect()) == [(1, PRESENT), (1, PRESENT), (2, MISSING)]
    assert A.evidence(rows.limit(0)).count() == 0


def test_guard_drops_rows_without_the_value(spark):
    q = "What is the port?"
    rows = [("a", q, "port 80", 5, 0.5), ("a", q, "some text", 7, 0.9), ("b", q, "some text", 3, 0.4), ("c", "Why?", "some text", 3, 0.4), ("c", None, None, 4, -1.0), ("d", q, "port 1", None, None)]
    got = A.guarded(spark.createDataFrame(rows, "bundle string, question string, text string, tokens int, score double")).orderBy("bundle")
    assert [tuple(r) for r in got.collect()] == [("a", 1, 1, 5, 0.5, False), ("b", 0, 1, 0, 0.0, True), ("c", 2, 0, 7, 0.4, False), ("d", 1, 0, 0, 0.0, False)]


@pytest.mark.parametrize("name", sorted(A.ATTRIBUTES))
def test_attributes_have_two_patterns(name):
    assert all(A.ATTRIBUTES[name])


def test_pairs_that_repeat_are_judged_once(spark, monkeypatch):
    seen, judged = [], A._judged
    monkeypatch.setattr(A, "_judged", lambda rows, *names: seen.append(rows) or judged(rows, *names))
    rows = spark.createDataFrame([(k, *(("What is the port?", "port 80"), ("What is the port?", None), (None, "port 80"))[k % 3]) for k in range(600)], "id long, question string, text string")
    for size in (A.SMALL, 0):  # sent to all tasks, and joined
        monkeypatch.setattr(A, "SMALL", size)
        got = {r["id"]: r["evidence"] for r in A.evidence(rows).collect()}
        assert got == {k: (PRESENT, MISSING, OTHER)[k % 3] for k in range(600)}
    assert [r.count() for r in seen] == [3, 3]
