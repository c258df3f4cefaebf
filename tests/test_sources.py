"""Sources, streams and graph walks on made rows."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import graph
from memlake.sources import files, traces
from memlake.streaming import projection


def event(k, kind="memory.accepted", ts="2024-01-01T00:00:00Z", **payload):
    return {"event_id": f"e{k}", "run_id": "r1", "ts": ts, "kind": kind, "schema_version": 1, "payload": json.dumps(payload), "origin": "a", "hlc": f"{1000 + k:013d}.{0:010d}.a"}


def trace(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


def test_trace_read(spark, tmp_path):
    a = trace(tmp_path / "a.jsonl", [event(1), event(2)], '{"event_id": "e9", "run')
    b = trace(tmp_path / "b.jsonl", [event(2), event(3)])
    c = trace(tmp_path / "c.jsonl", [])
    assert sorted(r.event_id for r in traces.read_traces(spark, [a, b, c]).collect()) == ["e1", "e2", "e3"]


@pytest.mark.parametrize("middle", ['{"event_id": "e9", "run\n', '{"run_id": "r"}\n', "oops}\n"])
def test_broken_line(spark, tmp_path, middle):
    p = tmp_path / "a.jsonl"
    p.write_text(middle + json.dumps(event(1)) + "\n")
    with pytest.raises(traces.BrokenTrace):
        traces.read_traces(spark, str(p))


def test_batches(spark, tmp_path):
    rows = [event(1, text="password=abc"), event(2, "run.failed"), event(3, "memory.superseded", memory_id="x", survivor_id="y"), event(4, "memory.superseded", memory_id="x", survivor_id="y")]
    events = traces.read_traces(spark, trace(tmp_path / "a.jsonl", rows))
    out = traces.export_batch(events, "")
    assert "abc" not in "".join(r.payload for r in out.collect())
    assert sorted(r.event_id for r in traces.import_batch(events.where("event_id = 'e1'"), events).collect()) == ["e3"]
    assert traces.export_batch(events, events.first().hlc[:0] + f"{1004:013d}.{0:010d}.a").count() == 0


def test_packs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"memories": [{"scope": "repo", "kind": "fact", "text": "t"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"scope": "user", "kind": "fact", "text": "u", "confidence": 0.5}]))
    assert sorted((r.scope, r.text, r.confidence) for r in traces.read_pack(spark, str(tmp_path)).collect()) == [("repo", "t", None), ("user", "u", 0.5)]


def test_clocks(spark):
    row = spark.sql("select '0000000000007.0000000002.n.1' h, 'x' bad, '01ARYZ6S41TSV4RRFFQ69G5FAV' u").select(traces.parse_hlc(F.col("h")).alias("h"), traces.parse_hlc(F.col("bad")).alias("b"), traces.ulid_millis(F.col("u")).alias("u"), traces.ulid_millis(F.col("bad")).alias("v")).first()
    assert tuple(row.h) == (7, 2, "n.1") and row.b is None and row.u == 1469918176385 and row.v is None


def test_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.bin": b"a\x00b", ".env": b"k", "id_rsa": b"k", "sub/go.mod": b"module m\n", "sub/empty.md": b"", ".git/c.py": b"x", "big.md": b"x" * 5000, "odd.txt": b"\xff\xfe"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_tree(spark, str(tmp_path), 4999).collect()}
    assert sorted(got) == ["a.py", "go.mod", "odd.txt"]  # the reader skips files of no bytes
    assert got["a.py"].language == "python" and got["a.py"].manifest is None and json.loads(got["go.mod"].manifest) == ["module m", ""]


def test_stream_applies_once(spark, tmp_path):
    src, log, ck = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    src.mkdir()
    trace(src / "a.json", [event(1), event(2), event(1)])
    for more in ([], [event(3)]):
        if more:
            trace(src / "b.json", more)
        assert projection.apply_batches(projection.event_stream(spark, str(src)), log, ck).awaitTermination(60)
    assert sorted(r.event_id for r in projection.read_log(spark, log).collect()) == ["e1", "e2", "e3"]


def test_batch_forms_of_streams(spark):
    rows = spark.createDataFrame([("k", f"2024-01-01 00:00:{s:02d}") for s in range(3)] + [("j", "2024-01-01 00:00:00"), (None, None)], "memory_id string, at string").select("memory_id", F.to_timestamp("at").alias("ts"))
    assert [(r.memory_id, r.n) for r in projection.rate_limited(rows, "memory_id", most=2).collect()] == [("k", 3)]
    later = rows.select("memory_id", (F.col("ts") + F.expr("interval 119 minutes 59 seconds")).alias("ts"))
    assert projection.regrets(rows.where("memory_id = 'j'"), later).count() == 1
    assert projection.regrets(rows.where("memory_id = 'j'"), rows.select("memory_id", (F.col("ts") + F.expr("interval 3 hours")).alias("ts"))).count() == 0


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (5, 5), (None, 1)], "src long, dst long")
    assert graph.shortest_path(edges, 1, 5) == [1, 2, 4, 5]
    assert graph.shortest_path(edges, 5, 1) is None and graph.shortest_path(edges, 1, 5, 2) is None and graph.shortest_path(edges, 4, 4) == [4]


def test_merge_clusters(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.0, 1.0]), (4, "a", [0.0, 2.0]), (5, "b", [1.0, 0.0]), (6, None, [1.0, 0.0]), (7, "a", None), (8, "a", [0.0, 0.0]), (None, "a", [1.0, 0.0])]
    data = spark.createDataFrame(rows, "id long, claim string, embedding array<double>")
    assert sorted(tuple(r) for r in graph.merge_clusters(data, ["claim"], [], 0.9).collect()) == [(2, 1), (4, 3)]
    assert graph.merge_clusters(data.limit(0), ["claim"], [], 0.9).count() == 0


def test_stems_and_luhn(spark):
    words = {"retries": "retr", "retry": "retr", "days": "days", "policy": "polic", "testing": "test", "sing": "sing", "boxes": "boxe", "key": "key"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.light_stem(F.col("w"))).collect()}
    assert got == words
    checks = {"4111111111111111": True, "4111111111111112": False, "": False, "12a": False, "0": True}
    assert {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in checks], "d string").select("d", T.luhn(F.col("d"))).collect()} == checks


def test_task_class_and_content(spark):
    tasks = {"Fix the docs": "debug", "tell me why it is slow": "investigation", "why": "feature", "Clean up, then document": "refactor", "write a GUIDE": "docs", "": "feature", None: None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in tasks], "t string").select("t", T.task_class(F.col("t"))).collect()}
    assert got == tasks
    row = spark.createDataFrame([("What is the retry policy during retries?", "", None)], "a string, b string, c string").select(*(T.content_tokens(F.col(c)) for c in "abc")).first()
    assert tuple(row) == (["retr", "polic"], [], None)
