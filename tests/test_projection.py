"""The projection of the event log against a replay that goes through all tables event by event."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import projection as P

LOG = "event_id string, run_id string, ts string, kind string, hlc string, payload string"


def at(k):
    return f"2026-01-{1 + k // 1440:02d}T{k // 60 % 24:02d}:{k % 60:02d}:00Z"


class Replay:
    """All tables as dictionaries; one event after the other."""

    def __init__(self, log):
        self.log = sorted({e[0]: (e[4], e[0], e[1], e[2], e[3], json.loads(e[5] or "{}")) for e in log}.values())
        self.memories, self.revisions, self.cites, self.proposals, self.runs, self.edges, self.episodes, self.conflicts, self.sync = {}, {}, {}, {}, {}, {}, {}, {}, {}
        for hlc, event, run, ts, kind, p in self.log:
            getattr(self, "on_" + kind.replace(".", "_"), lambda *a: None)(hlc, event, run, ts, p)

    def claim(self, m):
        claim, before = f"baseline:{m}", None
        for r in self.revisions.get(m, []):
            if before is None or r["text"] != before:
                claim = r["event_id"]
            before = r["text"]
        return claim

    def shown(self, run, m, exposure=None):
        """None: never delivered or without names; '': unclear; else the revision."""
        got = set()
        for _, event, r, _, kind, p in self.log:
            if kind == "context.injected" and r == run and m in p.get("memory_ids", []) and (exposure is None or event == exposure):
                got.add(p["memory_revisions"].get(m) or "" if "memory_revisions" in p else None)
        if exposure is not None:
            return (next(iter(got)) or "") if got else ""
        return None if got <= {None} else next(iter(got)) if len(got) == 1 else ""

    def outcome(self, m, delta, target, ts, useful):
        r = self.memories.get(m)
        if r:
            r["use_count"] += 1
            r["usefulness_score"] += delta
            r["last_used_at"] = ts
            r["confidence"] = min(0.99, max(0.1, r["confidence"] + 0.05 * (target - r["confidence"])))
            if useful:
                r["last_useful_at"] = ts

    def on_memory_accepted(self, hlc, event, run, ts, p):
        m = p.get("memory_id")
        if m is None or not self.interval(p):
            return
        text = p.get("text", "")
        self.memories[m] = {
            "scope": p.get("scope", "global_user"), "kind": p.get("kind", "fact"), "text": text, "normalized_text": p.get("normalized_text", text), "confidence": p.get("confidence", 1.0), "source_event_id": event, "created_at": ts,
            "use_count": 0, "usefulness_score": p.get("initial_usefulness", 0.0), "last_used_at": None, "last_useful_at": None, "valid_from": p.get("valid_from"), "valid_to": p.get("valid_to"), "invalidated_at": None, "invalidated_reason": None, "superseded_by": None,
        }
        if p.get("proposal_id") in self.proposals:
            self.proposals[p["proposal_id"]] |= {"status": "accepted", "decided_at": ts}

    @staticmethod
    def interval(p):
        return not (p.get("valid_from") and p.get("valid_to") and p["valid_from"] >= p["valid_to"])

    def on_memory_proposed(self, hlc, event, run, ts, p):
        if p.get("proposal_id") and self.interval(p):
            self.proposals[p["proposal_id"]] = {"text": p.get("text", ""), "status": "pending", "decided_at": None, "decided_reason": None}

    def on_memory_rejected(self, hlc, event, run, ts, p):
        if p.get("proposal_id") in self.proposals:
            self.proposals[p["proposal_id"]] |= {"status": "rejected", "decided_at": ts, "decided_reason": p.get("reason")}

    def on_memory_invalidated(self, hlc, event, run, ts, p):
        r = self.memories.get(p.get("memory_id"))
        if r and not (p.get("reason") == "forgotten" and (r["invalidated_at"] or r["superseded_by"])):
            r |= {"invalidated_at": ts, "invalidated_reason": p.get("reason")}

    def on_memory_restored(self, hlc, event, run, ts, p):
        r = self.memories.get(p.get("memory_id"))
        if r and not r["superseded_by"] and r["invalidated_at"] and r["invalidated_reason"] in ("forgotten", "cite_harmed"):
            r |= {"invalidated_at": None, "invalidated_reason": None}

    def on_conflict_resolved(self, hlc, event, run, ts, p):
        if not {"conflict_id", "new_memory_id", "existing_memory_id", "resolution", "scope", "kind", "detected_at"} <= set(p) or p["new_memory_id"] == p["existing_memory_id"]:
            return
        pair = p["new_memory_id"], p["existing_memory_id"]
        c = self.conflicts.setdefault(p["conflict_id"], {"pair": pair, "similarity": p.get("similarity", 0.0), "detected_at": p["detected_at"]})
        if c["pair"] != pair:
            return
        loser = {"kept_new": pair[1], "kept_existing": pair[0]}.get(p["resolution"])
        r = self.memories.get(loser)
        if r:
            r["invalidated_at"] = r["invalidated_at"] or ts
            if r["invalidated_reason"] in (None, "forgotten"):
                r["invalidated_reason"] = f"conflict {p['conflict_id']} resolved as {p['resolution']}"
        c |= {"resolved_at": ts, "resolution": p["resolution"]}

    def on_memory_cited(self, hlc, event, run, ts, p):
        m = p.get("memory_id")
        if m is None:
            return
        shown, named = self.shown(run, m, p.get("exposure_id")), p.get("revision_event_id")
        if shown == "" or (named and shown and named != shown):
            return
        evidence = named or shown
        if evidence is None and not self.claim(m).startswith("baseline:") or evidence is not None and evidence != self.claim(m):
            return
        self.cites[run, m, p.get("turn", 0)] = (ts, p.get("rationale"), p.get("query"))
        if p.get("outcome") == "helped":
            self.outcome(m, 1.0, 1.0, ts, True)
        if p.get("outcome") == "harmed":
            self.outcome(m, -1.0, 0.0, ts, False)
            if m in self.memories and not self.memories[m]["invalidated_at"]:
                self.memories[m] |= {"invalidated_at": ts, "invalidated_reason": "cite_harmed"}

    def on_retrieval_regret(self, hlc, event, run, ts, p):
        if p.get("source") == "manual":
            self.outcome(p.get("memory_id"), -1.0, 0.0, ts, False)

    def on_memory_aged(self, hlc, event, run, ts, p):
        r = self.memories.get(p.get("memory_id"), {})
        r.update({k: p[k] for k in ("created_at", "last_useful_at") if p.get(k)} if r else {})

    def on_memory_temporal(self, hlc, event, run, ts, p):
        r = self.memories.get(p.get("memory_id"), {})
        r.update({k: p[k] for k in ("valid_from", "valid_to") if p.get(k)} if r else {})

    def on_memory_superseded(self, hlc, event, run, ts, p):
        m, s = p.get("memory_id"), p.get("survivor_id")
        if not m or not s:
            return
        key = lambda h, q: q.get("source_hlc") or h
        before = self.memories.get(m, {}).get("superseded_by")
        if before and before != s:
            self.sync.setdefault((m, *sorted((before, s))), ts)
            if key(hlc, p) < max(key(h, q) for h, _, _, _, k, q in self.log if k == "memory.superseded" and q.get("memory_id") == m and q.get("survivor_id") == before):
                return
        if m in self.memories:
            self.memories[m]["superseded_by"] = s
        if s in self.memories:
            self.memories[s]["use_count"] += p.get("use_count_delta", 0)
            self.memories[s]["usefulness_score"] += p.get("score_delta", 0.0)
        for (r, x, t), v in list(self.cites.items()):
            if x == m:
                self.cites.setdefault((r, s, t), (v[0], v[1], None))
                del self.cites[r, m, t]
        if m != s:
            self.edges.setdefault((s, m, "supersedes"), ts)

    def on_memory_edge(self, hlc, event, run, ts, p):
        if p.get("src_id") and p.get("dst_id") and p.get("edge_type") and p["src_id"] != p["dst_id"]:
            self.edges.setdefault((p["src_id"], p["dst_id"], p["edge_type"]), ts)

    def on_memory_corrected(self, hlc, event, run, ts, p):
        m, text = p.get("memory_id"), p.get("text")
        r = self.memories.get(m)
        if not r or r["invalidated_at"] or (text is None and p.get("kind") is None) or (text is not None and not text.strip()):
            return
        keep = lambda: {k: r[k] for k in ("text", "kind", "confidence", "use_count", "usefulness_score")}
        rows = self.revisions.setdefault(m, [])
        if not rows:
            rows.append({"event_id": f"baseline:{m}", "known_at": r["created_at"], "effective_at": r["valid_from"] or "0001-01-01T00:00:00Z", **keep()})
        rows[-1] |= {k: r[k] for k in ("confidence", "use_count", "usefulness_score")}
        if text is not None and text != r["text"]:
            r |= {"confidence": 1.0, "use_count": 0, "usefulness_score": 0.0, "last_used_at": None, "last_useful_at": None}
            self.cites = {k: v for k, v in self.cites.items() if k[1] != m}
        r |= {"text": text if text is not None else r["text"], "kind": p.get("kind") or r["kind"]}
        r["normalized_text"] = " ".join(r["text"].strip().rstrip(".!?;:").split()).lower()
        rows.append({"event_id": event, "known_at": ts, "effective_at": p.get("effective_at") or ts, **keep()})

    def on_run_started(self, hlc, event, run, ts, p):
        self.runs.setdefault(run, [p.get("project_id", "unknown"), ts, None, None, 0.0])

    def end(self, kind, hlc, event, run, ts, p):
        if run in self.runs:
            self.runs[run][2:] = [ts, kind, p.get("total_cost_usd", 0.0)]
        if kind == "run.aborted" or (kind == "run.failed" and p.get("category") == "Gate"):
            return
        failed = kind == "run.failed"
        strong, weak, target = (-1.0, -0.1, 0.0) if failed else (0.0, 0.0, 1.0)
        for m in sorted({m for _, _, r, _, k, q in self.log if k == "context.injected" and r == run for m in q.get("memory_ids", []) if m}):
            shown = self.shown(run, m)
            spoken = [(h, e, q) for h, e, r, _, k, q in self.log if k == "memory.cited" and r == run and q.get("memory_id") == m]
            if shown == "":
                continue
            if shown is not None and shown != self.claim(m):
                was = any((h, e) < (hlc, event) and q.get("revision_event_id") in (None, shown) for h, e, q in spoken)
                for r in self.revisions.get(m, []):
                    if r["event_id"] == shown:
                        r["use_count"] += 1
                        r["usefulness_score"] += strong if was else weak
                        if was:
                            r["confidence"] = min(0.99, max(0.1, r["confidence"] + 0.05 * (target - r["confidence"])))
                continue
            last = spoken[-1][2].get("outcome") if spoken else None
            if last == "harmed" or (last == "helped" and not failed) or m not in self.memories:
                continue
            cited = any(k[0] == run and k[1] == m for k in self.cites)
            prior = sum(k[0] != run and k[1] == m for k in self.cites)
            r = self.memories[m]
            r["use_count"] += 1
            r["usefulness_score"] += (strong / (1 + prior / 3) if failed else strong) if cited else weak
            r["last_used_at"] = ts
            if cited and failed:
                r["confidence"] = min(0.99, max(0.1, r["confidence"] - 0.05 * r["confidence"]))

    def on_run_finished(self, *a):
        self.end("run.finished", *a)

    def on_run_failed(self, *a):
        self.end("run.failed", *a)

    def on_run_aborted(self, *a):
        self.end("run.aborted", *a)

    def on_work_episode(self, hlc, event, run, ts, p):
        key = p.get("repo_root"), p.get("identity", "")
        for e in self.episodes.values():
            if e["key"] == key and e["next"] is None:
                e["next"] = event
        self.episodes[event] = {"key": key, "next": None}
        for m in p.get("memory_ids", []):
            if m:
                self.edges.setdefault((event, m, "lesson_from"), ts)


def made_log(seed, n=260, memories=7, runs=9):
    rnd = random.Random(seed)
    ids, log, corrections = [f"m{k}" for k in range(memories)], [], []
    for k in range(n):
        kind = rnd.choice(
            ["memory.accepted", "memory.corrected", "memory.cited", "memory.cited", "memory.cited", "context.injected", "context.injected", "run.started", "run.finished", "run.failed", "run.failed", "run.aborted", "memory.invalidated", "memory.restored", "conflict.resolved",
             "retrieval.regret", "memory.aged", "memory.temporal", "memory.superseded", "memory.edge", "work.episode", "memory.proposed", "memory.rejected", "stage.entered"]
        )
        m, run = rnd.choice(ids), f"r{rnd.randrange(runs)}"
        maybe = lambda d: {a: b for a, b in d.items() if rnd.random() < 0.6}
        p = {"memory_id": m}
        if kind == "memory.accepted":
            p |= maybe({"scope": "repo", "kind": "command", "text": f"text {rnd.randrange(3)}", "confidence": 0.5, "initial_usefulness": 0.25, "proposal_id": f"p{rnd.randrange(4)}", "valid_from": at(rnd.randrange(90)), "valid_to": at(rnd.randrange(60, 200))})
        elif kind == "memory.corrected":
            p |= maybe({"text": f"text {rnd.randrange(3)}!", "kind": "preference", "effective_at": at(rnd.randrange(200))})
            corrections.append(f"e{k:04d}")
        elif kind == "memory.cited":
            p |= maybe({"turn": rnd.randrange(3), "rationale": f"why {k}", "query": f"q{k}", "outcome": rnd.choice(["helped", "harmed", "noop"])})
            if rnd.random() < 0.2:
                p["revision_event_id"] = rnd.choice([f"baseline:{m}", *corrections[-3:]])
            if rnd.random() < 0.2:
                p["exposure_id"] = f"e{rnd.randrange(k + 1):04d}"
        elif kind == "context.injected":
            shown = rnd.sample(ids, rnd.randint(1, 3))
            p = {"memory_ids": shown}
            if rnd.random() < 0.7:
                p["memory_revisions"] = {x: rnd.choice([f"baseline:{x}", f"baseline:{x}", *corrections[-2:], ""]) for x in shown if rnd.random() < 0.95}
        elif kind in ("run.finished", "run.failed", "run.aborted"):
            p = maybe({"total_cost_usd": 0.5, "category": rnd.choice(["Gate", "Tool"])})
        elif kind == "memory.invalidated":
            p |= maybe({"reason": rnd.choice(["forgotten", "stale"])})
        elif kind == "conflict.resolved":
            a, b = rnd.sample(ids, 2)
            p = {"conflict_id": f"c{rnd.randrange(5)}", "new_memory_id": a, "existing_memory_id": b, "resolution": rnd.choice(["kept_new", "kept_existing", "kept_both"]), "scope": "repo", "kind": "fact", "detected_at": at(k)}
        elif kind == "retrieval.regret":
            p |= maybe({"source": "manual"})
        elif kind == "memory.aged":
            p |= maybe({"created_at": at(3), "last_useful_at": at(4)})
        elif kind == "memory.temporal":
            p |= maybe({"valid_from": at(1), "valid_to": at(190)})
        elif kind == "memory.superseded":
            p |= {"survivor_id": rnd.choice(ids)} | maybe({"use_count_delta": 2, "score_delta": 0.5, "source_hlc": f"{rnd.randrange(n):06d}"})
        elif kind == "memory.edge":
            p = {"src_id": m, "dst_id": rnd.choice(ids), "edge_type": "related"}
        elif kind == "work.episode":
            p = {"repo_root": rnd.choice("ab"), "memory_ids": [m, ""]} | maybe({"identity": "i"})
        elif kind in ("memory.proposed", "memory.rejected"):
            p = {"proposal_id": f"p{rnd.randrange(4)}"} | maybe({"text": "offer", "reason": "no"})
        if rnd.random() < 0.03:
            p = {}
        log.append((f"e{k:04d}", run, at(k), kind, f"{k // 2:06d}", json.dumps(p)))
    return log


def close(x):
    return round(x, 9) if isinstance(x, float) else x


def rows(df, *keys):
    out = {}
    for r in df.collect():
        r = {k: close(v) for k, v in r.asDict().items()}
        out[tuple(r.pop(k) for k in keys) if len(keys) > 1 else r.pop(keys[0])] = r
    return out


def compare(spark, log):
    want = Replay(log)
    got = {k: v for k, v in P.project(spark.createDataFrame(log, LOG)).items()}
    assert rows(got["memories"], "memory_id") == {m: {k: close(v) for k, v in r.items()} for m, r in want.memories.items()}
    assert {(r["memory_id"], r["event_id"]): (r["place"], r["text"], r["kind"], r["known_at"], r["effective_at"], close(r["confidence"]), r["use_count"], close(r["usefulness_score"])) for r in got["revisions"].collect()} == {
        (m, r["event_id"]): (n, r["text"], r["kind"], r["known_at"], r["effective_at"], close(r["confidence"]), r["use_count"], close(r["usefulness_score"])) for m, of in want.revisions.items() for n, r in enumerate(of)
    }
    assert {(r["run_id"], r["memory_id"], r["turn"]): (r["cited_at"], r["rationale"], r["query"]) for r in got["citations"].collect()} == want.cites
    assert {k: (v["text"], v["status"], v["decided_at"], v["decided_reason"]) for k, v in rows(got["proposals"], "proposal_id").items()} == {k: (v["text"], v["status"], v["decided_at"], v["decided_reason"]) for k, v in want.proposals.items()}
    assert {k: [v["project_id"], v["started_at"], v["ended_at"], v["terminal_kind"], v["total_cost_usd"]] for k, v in rows(got["runs"], "run_id").items()} == want.runs
    assert {k: v["created_at"] for k, v in rows(got["edges"], "src", "dst", "type").items()} == want.edges
    assert {k: v["superseded_by"] for k, v in rows(got["episodes"], "event_id").items()} == {k: v["next"] for k, v in want.episodes.items()}
    assert {k: (v["new_memory_id"], v["existing_memory_id"], v["similarity"], v["detected_at"], v["resolved_at"], v["resolution"]) for k, v in rows(got["conflicts"], "conflict_id").items()} == {k: (*c["pair"], c["similarity"], c["detected_at"], c["resolved_at"], c["resolution"]) for k, c in want.conflicts.items()}
    assert {k: v["detected_at"] for k, v in rows(got["sync_conflicts"], "member", "survivor_a", "survivor_b").items()} == want.sync
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_projection_equals_the_replay(spark, seed):
    log = made_log(seed)
    shuffled = log + random.Random(seed).sample(log, 30)  # copies, and in no order
    random.Random(seed).shuffle(shuffled)
    compare(spark, shuffled)


def test_an_empty_log_gives_empty_tables(spark):
    assert all(t.count() == 0 for t in P.project(spark.createDataFrame([], LOG)).values())


def test_empty_payloads_change_nothing(spark):
    kinds = {e[3] for e in made_log(1)}
    log = [(f"e{k}", "r", at(k), kind, f"{k:03d}", p) for k, (kind, p) in enumerate((k, p) for k in sorted(kinds) for p in ("{}", None))]
    got = P.project(spark.createDataFrame(log, LOG))
    assert {k for k, t in got.items() if t.count()} == {"runs", "episodes"}


def test_failures_weigh_less_with_earlier_citations(spark):
    log = [("a", "r", at(0), "memory.accepted", "000", json.dumps({"memory_id": "m", "text": "t"}))]
    for k in range(3):
        log.append((f"c{k}", f"before{k}", at(1 + k), "memory.cited", f"00{1 + k}", json.dumps({"memory_id": "m"})))
    log += [("i", "r", at(5), "context.injected", "005", json.dumps({"memory_ids": ["m"]})), ("c", "r", at(6), "memory.cited", "006", json.dumps({"memory_id": "m"})), ("f", "r", at(7), "run.failed", "007", "{}")]
    row = compare(spark, log)["memories"].first()
    assert (row["use_count"], row["usefulness_score"], row["confidence"]) == (1, -0.5, 0.95)


def test_unstamped_deliveries_get_the_claim_of_their_time(spark):
    text = lambda t: json.dumps({"memory_id": "m", "text": t})
    log = [("a", "r", at(0), "memory.accepted", "000", text("one")), ("d0", "r", at(1), "context.injected", "001", json.dumps({"memory_ids": ["m", "n"]})), ("x", "r", at(2), "memory.corrected", "002", text("two")),
           ("y", "r", at(3), "memory.corrected", "003", text("two")), ("d1", "r", at(4), "context.injected", "004", json.dumps({"memory_ids": ["m"]})), ("d2", "r", at(4), "context.injected", "004", json.dumps({"memory_ids": ["m"], "memory_revisions": {}}))]
    df = spark.createDataFrame(log, LOG)
    got = {r[0]: r[1] for r in P.bind_exposures(P.parsed(df), P.project(df)["revisions"]).collect()}
    assert got == {"d0": {"m": "baseline:m", "n": "baseline:n"}, "d1": {"m": "x"}}


def test_a_stream_equals_the_replay(spark, tmp_path):
    """Events that come late by less than the bound, in several files, with copies."""
    single = {"memory.accepted", "memory.corrected", "memory.invalidated", "memory.restored", "memory.aged", "memory.temporal", "retrieval.regret", "conflict.resolved", "memory.cited"}
    log = [e for e in made_log(5, 500) if e[3] in single]
    order = sorted(range(len(log)), key=lambda k: k + random.Random(k).randint(0, 25))
    for part in range(4):
        spark.createDataFrame([log[k] for k in order[part * len(order) // 4 : (part + 1) * len(order) // 4 + 5]], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    parsed = stream.select("event_id", "run_id", "ts", "kind", "hlc", F.from_json("payload", P.PAYLOAD).alias("p"), F.to_timestamp("ts").alias("at"))
    touches = P.direct_touches(parsed.drop("at")).withColumn("at", F.to_timestamp("ts"))
    last = {}

    def keep(df, n):
        for r in df.collect():
            last[r["memory_id"]] = (n, r["replay"], r["row"], r["revisions"])

    P.memory_stream(touches, "3 hours").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    want = P.streamed(P.direct_touches(P.parsed(spark.createDataFrame(log, LOG))), "memory_id", P.Memory, "memory_id string, row string, revisions string", last=lambda s: [{"memory_id": s.id, "row": json.dumps(s.row), "revisions": json.dumps(list(s.revisions.values()))}])
    assert {m: (json.loads(v[2]), json.loads(v[3])) for m, v in last.items()} == {r["memory_id"]: (json.loads(r["row"]), json.loads(r["revisions"])) for r in want.collect()}
    assert not any(v[1] for v in last.values()) and len({v[0] for v in last.values()}) >= 1


def test_memories_that_no_run_end_or_merge_reaches_are_folded_once(spark, monkeypatch):
    """With both kinds in one log, the tables are those of the replay."""
    folds, streamed = [], P.streamed
    monkeypatch.setattr(P, "streamed", lambda touches, key, *more, **named: folds.append(touches) or streamed(touches, key, *more, **named))
    plain = [e for e in made_log(5, 400) if e[3] in ("memory.accepted", "memory.corrected", "memory.invalidated", "memory.restored", "memory.aged", "memory.temporal", "retrieval.regret", "memory.cited")]
    get = lambda tables: sorted(str(r.asDict(True)) for name in ("memories", "revisions", "citations") for r in tables[name].collect())
    alone = get(P.project(spark.createDataFrame(plain, LOG)))
    assert [f.columns[0] for f in folds] == ["memory_id", "proposal_id"] and alone
    text = lambda **p: json.dumps(p)
    other = [("z1", "rz", at(1), "memory.accepted", "900", text(memory_id="other", text="one")), ("z2", "rz", at(2), "context.injected", "901", text(memory_ids=["other"])), ("z3", "rz", at(3), "run.failed", "902", text(category="x"))]
    folds.clear()
    both = P.project(spark.createDataFrame(plain + other, LOG))
    assert [r[0] for r in folds[1].select("memory_id").distinct().collect()] == ["other"]
    row = both["memories"].where("memory_id = 'other'").first()
    assert (row["use_count"], row["usefulness_score"]) == (1, -0.1)
    assert sorted(str(r.asDict(True)) for name in ("memories", "revisions", "citations") for r in both[name].where("memory_id <> 'other'").collect()) == alone
