"""The memory tables as a fold of the event log.

`project` replays a log(event_id, run_id, ts, kind, hlc, payload) into tables: memories, revisions, citations, proposals, runs, edges,
episodes, conflicts and sync_conflicts. Events take effect in the order of (hlc, event_id), so a late event needs no more than to be in the
log: a replay gives the same tables in whatever order events came. Copies of an event count once; unknown kinds are ignored.

What one memory goes through is a state machine, `Memory`, over the events that touch it. Spark deals the touches by memory, sorts them
by clock and streams them through it, so a task holds one memory's state and never a group. What several rows decide together (which
citations a memory had when a run failed, what a merged memory hands on) is joined and counted by Spark between two such folds: the
first says which events took effect, the second adds up what follows from them. The same machine folds a stream: `memory_stream`.

An event that the rules refuse (a correction of a memory that is gone, an empty interval of validity, a conflict with other parties than
before) changes nothing. Deliveries name the revision they showed (`memory_revisions`, see `bind_exposures`); one that names none shows
nothing in particular, so that only a memory that was never corrected is credited for it.
"""

from __future__ import annotations

import copy
import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import partitions, ship, written

#: What an outcome does (fixed values): usefulness of a cited memory and of one that was only delivered, the step of confidence and its
#: bounds, and how many earlier citations halve a failure's weight.
CITED, PASSENGER, ALPHA, LOWEST, HIGHEST, EARLIER = 1.0, 0.1, 0.05, 0.1, 0.99, 3.0
#: Reasons of an invalidation that can be taken back (fixed values).
FORGOTTEN = ("forgotten", "forgotten/archived", "forgotten_archived")
RESTORABLE = (*FORGOTTEN, "cite_harmed")

PAYLOAD = (
    "memory_id string, survivor_id string, scope string, kind string, text string, normalized_text string, confidence double, initial_usefulness double, valid_from string, valid_to string,"
    "proposal_id string, outcome string, turn long, rationale string, query string, exposure_id string, revision_event_id string, source string, created_at string, last_useful_at string,"
    "reason string, source_hlc string, use_count_delta long, score_delta double, src_id string, dst_id string, edge_type string, effective_at string, conflict_id string, new_memory_id string,"
    "existing_memory_id string, resolution string, similarity double, detected_at string, category string, total_cost_usd double, memory_ids array<string>, memory_revisions map<string,string>,"
    "repo_root string, identity string, task string, summary string, project_id string, model string, proposed_confidence double"
)
MEMORY = (
    "memory_id string, scope string, kind string, text string, normalized_text string, confidence double, source_event_id string, created_at string, use_count long, usefulness_score double,"
    "last_used_at string, last_useful_at string, valid_from string, valid_to string, invalidated_at string, invalidated_reason string, superseded_by string"
)
REVISION = "memory_id:string, event_id:string, text:string, kind:string, known_at:string, known_hlc:string, effective_at:string, confidence:double, use_count:long, usefulness_score:double, place:int"
#: What is left of a memory in the end, beside its id: its row, whether there is one, and its revisions as JSON.
STATE = MEMORY.split(", ", 1)[1] + ", known boolean, revisions string"
NOTE = "memory_id string, event_id string, hlc string, ok boolean, wipe long, revision string, rival string, wiped boolean"
PROPOSAL = "proposal_id string, run_id string, scope string, kind string, text string, rationale string, proposed_confidence double, status string, valid_from string, valid_to string, decided_at string, decided_reason string"
#: Fields of a payload that a memory's touches are judged by; the others stay with the events.
JUDGED = (
    "scope", "kind", "text", "normalized_text", "confidence", "initial_usefulness", "valid_from", "valid_to", "outcome", "revision_event_id", "exposure_id", "reason", "created_at", "last_useful_at", "survivor_id",
    "use_count_delta", "score_delta", "effective_at", "conflict_id", "resolution",
)
#: Fields of an event that touches a memory, beside the payload's.
TOUCH = ("memory_id", "hlc", "event_id", "what", "ts", "run_id", "rank", "pair_best", "shown", "cited", "was_cited", "prior", "last_outcome", "p")


def names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(",")]


def instant(text: str | None) -> datetime | None:
    """An RFC 3339 time, null for anything else."""
    try:
        at = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def valid(p: dict) -> bool:
    """Whether the interval of a payload is one: its ends parse and the start is before the end."""
    start, end = instant(p["valid_from"]), instant(p["valid_to"])
    if (p["valid_from"] is not None and start is None) or (p["valid_to"] is not None and end is None):
        return False
    return start is None or end is None or start < end


def folded_text(text: str) -> str:
    return " ".join(text.strip().rstrip(".!?;:").split()).lower()


class Memory:
    """One memory's rows while its touches are applied in the order of their clocks."""

    def __init__(self, memory_id: str):
        self.id, self.row, self.revisions = memory_id, None, {}
        self.claim, self.last_text = f"baseline:{memory_id}", None  # the revision that outcomes are credited to; the text of the last revision
        self.wipes, self.best = 0, ""

    def apply(self, e: dict) -> dict:
        """A note of what the touch did, with the claim and the number of citation wipes before it."""
        note = {"memory_id": self.id, "event_id": e["event_id"], "hlc": e["hlc"], "ok": False, "wipe": self.wipes, "revision": self.claim, "rival": None}
        note["ok"] = bool(getattr(self, "_" + e["what"])(e, e["p"] or {}, note))
        note["wiped"] = self.wipes > note["wipe"]
        return note

    def _accepted(self, e, p, note):
        if not valid(p):
            return False
        text = p["text"] if p["text"] is not None else ""
        self.row = dict.fromkeys(names(MEMORY)) | {
            "memory_id": self.id, "scope": _or(p["scope"], "global_user"), "kind": _or(p["kind"], "fact"), "text": text, "normalized_text": _or(p["normalized_text"], text), "confidence": _or(p["confidence"], 1.0),
            "source_event_id": e["event_id"], "created_at": e["ts"], "use_count": 0, "usefulness_score": float(np.float32(p["initial_usefulness"] or 0.0)), "valid_from": p["valid_from"], "valid_to": p["valid_to"],
        }
        return True

    def _cited(self, e, p, note):
        shown, named = e["shown"], p["revision_event_id"]
        if shown == "" or (named and shown and named != shown):
            return False
        evidence = named or shown
        if (evidence and evidence != self.claim) or (not evidence and not self.claim.startswith("baseline:")):
            return False
        if p["outcome"] == "helped":
            self._outcome(CITED, 1.0, e["ts"], True)
        elif p["outcome"] == "harmed":
            self._outcome(-CITED, 0.0, e["ts"], False)
            if self.row and self.row["invalidated_at"] is None:
                self.row |= {"invalidated_at": e["ts"], "invalidated_reason": "cite_harmed"}
        return True

    def _regret(self, e, p, note):
        self._outcome(-CITED, 0.0, e["ts"], False)
        return True

    def _outcome(self, delta: float, target: float, ts: str, useful: bool) -> None:
        r = self.row
        if r:
            r |= {"use_count": r["use_count"] + 1, "usefulness_score": r["usefulness_score"] + delta, "last_used_at": ts, "confidence": _nudged(r["confidence"], target)}
            if useful:
                r["last_useful_at"] = ts

    def _ended(self, e, p, note):
        """The end of a run that was shown this memory."""
        failed = e["rank"] == "run.failed"
        strong, weak, target = (-CITED, -PASSENGER, 0.0) if failed else (0.0, 0.0, 1.0)
        if e["shown"] == "":
            return False
        if e["shown"] and e["shown"] != self.claim:  # the run saw an older text: its outcome stays there
            r = self.revisions.get(e["shown"])
            if r:
                r["use_count"] += 1
                r["usefulness_score"] += strong if e["was_cited"] else weak
                if e["was_cited"]:
                    r["confidence"] = _nudged(r["confidence"], target)
            return False
        if e["last_outcome"] == "harmed" or (e["last_outcome"] == "helped" and not failed) or not self.row:
            return False
        r, cited = self.row, bool(e["cited"])
        delta = (strong / (1.0 + (e["prior"] or 0) / EARLIER) if failed else strong) if cited else weak
        r |= {"use_count": r["use_count"] + 1, "usefulness_score": r["usefulness_score"] + delta, "last_used_at": e["ts"]}
        if cited and failed:
            r["confidence"] = _nudged(r["confidence"], target)
        return True

    def _invalidated(self, e, p, note):
        if not self.row or (p["reason"] in FORGOTTEN and (self.row["invalidated_at"] is not None or self.row["superseded_by"] is not None)):
            return False
        self.row |= {"invalidated_at": e["ts"], "invalidated_reason": p["reason"]}
        return True

    def _restored(self, e, p, note):
        if not self.row or self.row["superseded_by"] is not None or self.row["invalidated_at"] is None or self.row["invalidated_reason"] not in RESTORABLE:
            return False
        self.row |= {"invalidated_at": None, "invalidated_reason": None}
        return True

    def _lost(self, e, p, note):
        """The losing side of a conflict: can't be restored any more."""
        if not self.row:
            return False
        why = self.row["invalidated_reason"]
        self.row |= {"invalidated_at": _or(self.row["invalidated_at"], e["ts"]), "invalidated_reason": f"conflict {p['conflict_id']} resolved as {p['resolution']}" if why is None or why in FORGOTTEN else why}
        return True

    def _aged(self, e, p, note):
        if self.row:
            self.row |= {k: p[k] for k in ("created_at", "last_useful_at") if p[k] is not None}
        return True

    def _temporal(self, e, p, note):
        if self.row:
            self.row |= {k: p[k] for k in ("valid_from", "valid_to") if p[k] is not None}
        return True

    def _superseded(self, e, p, note):
        before = self.row and self.row["superseded_by"]
        if before is not None and before != p["survivor_id"]:
            note["rival"] = before
            if e["rank"] < self.best:
                return False
        if self.row:
            self.row["superseded_by"], self.best = p["survivor_id"], e["pair_best"]
        self.wipes += 1  # its citations move on
        return True

    def _gained(self, e, p, note):
        """What a merged memory hands on to this one."""
        if self.row:
            self.row |= {"use_count": self.row["use_count"] + (p["use_count_delta"] or 0), "usefulness_score": self.row["usefulness_score"] + (p["score_delta"] or 0.0)}
        return True

    def _corrected(self, e, p, note):
        r, text, kind = self.row, p["text"], p["kind"]
        effective = _or(p["effective_at"], e["ts"])
        if not r or r["invalidated_at"] is not None or (text is None and kind is None) or (text is not None and not text.strip()) or instant(effective) is None:
            return False
        base = f"baseline:{self.id}"
        if base not in self.revisions:
            self.revisions[base] = self._revision(base, "", r["created_at"], _or(r["valid_from"], "0001-01-01T00:00:00Z"))
            self.last_text = r["text"]
        last = next(reversed(self.revisions.values()))
        last |= {k: r[k] for k in ("confidence", "use_count", "usefulness_score")}
        if text is not None and text != r["text"]:
            r |= {"confidence": 1.0, "use_count": 0, "usefulness_score": 0.0, "last_used_at": None, "last_useful_at": None}
            self.wipes += 1
        text = _or(text, r["text"])
        r |= {"text": text, "normalized_text": folded_text(text), "kind": _or(kind, r["kind"])}
        self.revisions[e["event_id"]] = self._revision(e["event_id"], e["hlc"], e["ts"], effective)
        if text != self.last_text:
            self.claim = e["event_id"]
        self.last_text = text
        return True

    def _revision(self, event_id: str, hlc: str, known_at: str, effective_at: str) -> dict:
        r = self.row
        return {"memory_id": self.id, "event_id": event_id, "known_at": known_at, "known_hlc": hlc, "effective_at": effective_at, "place": len(self.revisions), **{k: r[k] for k in ("text", "kind", "confidence", "use_count", "usefulness_score")}}


def _state(s: Memory) -> dict:
    return (s.row or {}) | {"memory_id": s.id, "known": s.row is not None, "revisions": json.dumps(list(s.revisions.values()))}


class Proposal:
    """One proposal: proposed, then accepted or rejected; proposing again starts anew."""

    def __init__(self, proposal_id: str):
        self.id, self.row = proposal_id, None

    def apply(self, e: dict) -> None:
        p = e["p"]
        if e["what"] == "proposed":
            if valid(p):
                self.row = dict.fromkeys(names(PROPOSAL)) | {
                    "proposal_id": self.id, "run_id": e["run_id"], "scope": _or(p["scope"], "run"), "kind": _or(p["kind"], "fact"), "text": _or(p["text"], ""), "rationale": _or(p["rationale"], ""),
                    "proposed_confidence": _or(p["proposed_confidence"], 0.5), "status": "pending", "valid_from": p["valid_from"], "valid_to": p["valid_to"],
                }
        elif self.row and (e["what"] == "rejected" or valid(p)):
            self.row |= {"status": e["what"], "decided_at": e["ts"]}
            if e["what"] == "rejected":
                self.row["decided_reason"] = p["reason"]


def _or(value, default):
    return default if value is None else value


def _nudged(confidence: float, target: float) -> float:
    return min(HIGHEST, max(LOWEST, confidence + ALPHA * (target - confidence)))


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """Rows of a batch, read column by column; a column or a struct's field without values costs nothing a row."""

    def dicts(names_: list[str], columns: list[pa.Array]) -> list[dict]:
        blank, full = dict.fromkeys(names_), [k for k, c in enumerate(columns) if c.null_count < len(c)]
        values = [structs(columns[k]) if pa.types.is_struct(columns[k].type) else columns[k].to_pylist() for k in full]
        given = [names_[k] for k in full]
        return [blank | dict(zip(given, v)) for v in zip(*values)] if full else [dict(blank) for _ in range(batch.num_rows)]

    def structs(c: pa.StructArray) -> list[dict | None]:
        return [d if there else None for d, there in zip(dicts([f.name for f in c.type], c.flatten()), c.is_valid().to_pylist())]

    return dicts(batch.schema.names, batch.columns)


def streamed(touches: DataFrame, key: str, machine: Callable, schema: str, each: Callable | None = None, last: Callable | None = None, order: tuple = ("hlc", "event_id")) -> DataFrame:
    """Touches dealt by key, sorted by `order` and applied to one machine a key; rows of `each` touch and of the `last` state, null where they lack a field.

    A task reads its touches as they come and holds one state. A very frequent key is one task's stream, in time but not in memory.
    """
    spark = touches.sparkSession
    ship(spark)
    fields = names(schema)
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def emit():
            rows = pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in out], arrow.field(f).type) for f in fields], schema=arrow)
            out.clear()
            return rows

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for e in _rows(batch.slice(at, 500)):
                    if state is None or state.id != e[key]:
                        if state is not None and last:
                            out += last(state)
                        state = machine(e[key])
                    found = state.apply(e)
                    if each:
                        out += each(state, e, found)
                if len(out) > 1000:
                    yield emit()
        if state is not None and last:
            out += last(state)
        if out:
            yield emit()

    dealt = touches.repartition(partitions(spark), key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, schema)


def parsed(log: DataFrame) -> DataFrame:
    """The log with its payload's fields as `p`; copies of an event are one."""
    rows = log.select("event_id", "run_id", "ts", "kind", F.coalesce("hlc", F.lit("")).alias("hlc"), "payload").dropDuplicates(["event_id"])
    return rows.withColumn("p", F.from_json("payload", PAYLOAD)).drop("payload")


def _touch(df: DataFrame, what, memory_id="p.memory_id", **more) -> DataFrame:
    """df as touches; fields not given are null."""
    kinds = {"rank": "string", "pair_best": "string", "shown": "string", "cited": "boolean", "was_cited": "boolean", "prior": "long", "last_outcome": "string"}
    extra = [more.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]
    return df.select(F.col(memory_id).alias("memory_id"), "hlc", "event_id", what.alias("what") if not isinstance(what, str) else F.lit(what).alias("what"), "ts", "run_id", *extra, F.when(F.col("p").isNotNull(), F.struct(*(F.col(f"p.{c}").alias(c) for c in JUDGED))).alias("p")).where("memory_id is not null")


def direct_touches(events: DataFrame) -> DataFrame:
    """Touches of the events that concern one memory each, from parsed events; stateless, for batches and streams."""
    simple = {"memory.accepted": "accepted", "memory.invalidated": "invalidated", "memory.restored": "restored", "memory.aged": "aged", "memory.temporal": "temporal", "memory.corrected": "corrected", "memory.cited": "cited"}
    what = F.element_at(F.create_map(*(F.lit(x) for pair in simple.items() for x in pair)), F.col("kind"))
    named = _touch(events.where(F.col("kind").isin(*simple)), what)
    regret = _touch(events.where("kind = 'retrieval.regret' AND p.source = 'manual'"), "regret")
    loser = F.when(F.col("p.resolution") == "kept_new", F.col("p.existing_memory_id")).when(F.col("p.resolution") == "kept_existing", F.col("p.new_memory_id"))
    lost = _touch(events.where("kind = 'conflict.resolved'").withColumn("loser", loser), "lost", "loser")
    return named.unionByName(regret).unionByName(lost)


def _conflicts(events: DataFrame) -> DataFrame:
    """Resolutions that name their parties as the conflict's first one did."""
    said = events.where("kind = 'conflict.resolved' AND p.conflict_id is not null AND p.new_memory_id <> p.existing_memory_id AND p.resolution IN ('kept_new', 'kept_existing', 'kept_both') AND p.scope is not null AND p.kind is not null AND p.detected_at is not null")
    terms = F.struct(F.col("p.new_memory_id").alias("a"), F.col("p.existing_memory_id").alias("b"), *(F.col(f"p.{c}").alias(c) for c in ("scope", "kind", "similarity", "detected_at")))
    first = said.groupBy(F.col("p.conflict_id").alias("c")).agg(F.min_by(terms, F.struct("hlc", "event_id")).alias("f"))
    return said.join(first, said["p.conflict_id"] == first["c"]).where("p.new_memory_id = f.a AND p.existing_memory_id = f.b")


def deliveries(events: DataFrame) -> DataFrame:
    """(event_id, run_id, memory_id, hlc, shown): each memory of each delivery; shown is its revision, '' where the delivery names none for it, null where it has no names at all."""
    injected = events.where("kind = 'context.injected'").select("event_id", "run_id", "hlc", F.explode(F.array_distinct("p.memory_ids")).alias("memory_id"), F.col("p.memory_revisions").alias("r")).where("memory_id <> ''")
    shown = F.when(F.col("r").isNotNull(), F.coalesce(F.element_at("r", F.col("memory_id")), F.lit("")))
    return injected.select("event_id", "run_id", "memory_id", "hlc", shown.alias("shown"))


def _with_shown(touches: DataFrame, delivered: DataFrame) -> DataFrame:
    """Citations and run ends with the revision that their delivery showed; '' where deliveries disagree or name none."""
    if delivered.isEmpty():
        return touches.withColumn("shown", F.when(F.col("p.exposure_id").isNotNull(), F.lit(""))).select(*TOUCH)
    by_run = delivered.groupBy("run_id", "memory_id").agg(F.min("shown").alias("low"), F.max("shown").alias("high"), F.count("shown").alias("n"), F.count(F.lit(1)).alias("all")).select(
        "run_id", "memory_id", F.when(F.col("n") == 0, F.lit(None)).when((F.col("n") < F.col("all")) | (F.col("low") != F.col("high")), "").otherwise(F.col("low")).alias("of_run")
    )
    exact = delivered.select(F.col("event_id").alias("x"), F.col("run_id").alias("xr"), F.col("memory_id").alias("xm"), F.coalesce("shown", F.lit("")).alias("of_delivery"))
    t = touches.join(by_run, ["run_id", "memory_id"], "left")
    t = t.join(exact, (F.col("p.exposure_id") == F.col("x")) & (F.col("run_id") == F.col("xr")) & (F.col("memory_id") == F.col("xm")), "left")
    return t.withColumn("shown", F.when(F.col("p.exposure_id").isNotNull(), F.coalesce("of_delivery", F.lit(""))).otherwise(F.col("of_run"))).select(*TOUCH)


def _citations(notes: DataFrame, events: DataFrame, moves: DataFrame, max_depth: int = 64) -> DataFrame:
    """(memory_id, wipe, run_id, turn, hlc, event_id, cited_at, rationale, query, own) of all citations with the memory they stand at.

    A merge moves the citations of its member to the survivor, which may be merged later: the loop takes as many rounds as merges follow
    each other; without moves they are not written. moves(member, wipe, survivor, to_wipe, hlc, event_id).
    """
    cited = events.where("kind = 'memory.cited'").select(F.col("event_id").alias("e"), F.col("p.memory_id").alias("m"), "run_id", "ts", "p")
    taken = notes.where("ok").join(cited, (F.col("event_id") == F.col("e")) & (F.col("memory_id") == F.col("m")))
    own = taken.select("memory_id", "wipe", "run_id", F.coalesce("p.turn", F.lit(0)).alias("turn"), "hlc", "event_id", F.col("ts").alias("cited_at"), F.col("p.rationale").alias("rationale"), F.col("p.query").alias("query"), F.lit(True).alias("own"))
    if moves.isEmpty():
        return own
    own = written(own, "citations")
    every, before = own, None
    for _ in range(max_depth):
        row = F.struct("cited_at", "rationale", "query")
        at = F.struct("hlc", "event_id")
        stood = every.groupBy("memory_id", "wipe", "run_id", "turn").agg(F.max_by(F.when(F.col("own"), row), F.when(F.col("own"), at)).alias("mine"), F.min_by(row, at).alias("got"))
        moved = stood.join(moves, (F.col("memory_id") == F.col("member")) & (stood["wipe"] == moves["from_wipe"])).select(
            F.col("survivor").alias("memory_id"), F.col("to_wipe").alias("wipe"), "run_id", "turn", "hlc", "event_id", F.coalesce("mine.cited_at", "got.cited_at").alias("cited_at"), F.when(F.col("mine").isNotNull(), F.col("mine.rationale")).otherwise(F.col("got.rationale")).alias("rationale"), F.lit(None).cast("string").alias("query"), F.lit(False).alias("own")
        )
        moved = written(moved, "moved")
        now = moved.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*moved.columns).cast("decimal(38,0)"))).first()
        every = own.unionByName(moved)
        if now == before or not now[0]:
            return every
        before = now
    raise RuntimeError("merges follow each other too far")


def project(log: DataFrame) -> dict[str, DataFrame]:
    """All tables of a log(event_id, run_id, ts, kind, hlc, payload), by name. ts is RFC 3339 text, payload JSON text.

    An empty log gives empty tables; a null payload, a payload without the ids it needs and unknown kinds change nothing.
    """
    events = written(parsed(log), "events")
    agreed = written(_conflicts(events).select(*events.columns, "f"), "conflicts")
    delivered = written(deliveries(events), "deliveries")
    pair_best = F.max(F.coalesce(F.when(F.col("p.source_hlc") != "", F.col("p.source_hlc")), F.col("hlc"))).over(Window.partitionBy("p.memory_id", "p.survivor_id"))
    merges = events.where("kind = 'memory.superseded' AND p.memory_id is not null AND p.survivor_id is not null").withColumn("best", pair_best)
    merged = _touch(merges.withColumn("r", F.coalesce(F.when(F.col("p.source_hlc") != "", F.col("p.source_hlc")), F.col("hlc"))), "superseded", rank=F.col("r"), pair_best=F.col("best"))
    direct = direct_touches(events.where("kind <> 'conflict.resolved'").unionByName(agreed.drop("f")))
    ends = events.where("kind = 'run.finished' OR (kind = 'run.failed' AND coalesce(p.category, '') <> 'Gate')")
    reached = ends.join(delivered.select("run_id", "memory_id").distinct(), "run_id")
    ended = _touch(reached, "ended", "memory_id", rank=F.col("kind"))
    touches = written(_with_shown(direct.unionByName(merged).unionByName(ended), delivered), "touches")
    once = written(streamed(touches, "memory_id", Memory, f"{NOTE}, last boolean, {STATE}", each=lambda s, e, note: [note], last=lambda s: [{"last": True, **_state(s)}]), "notes")
    notes = once.where("last is null").select(*names(NOTE))

    # what merges hand on: the citations of a member stand at its survivor from then on, until that one's are wiped
    effective = notes.where("ok").join(merges.select(F.col("event_id").alias("e"), "ts", "p"), F.col("event_id") == F.col("e")).select("event_id", "hlc", "ts", F.col("memory_id").alias("member"), F.col("wipe").alias("from_wipe"), F.col("p.survivor_id").alias("survivor"), "p")
    place = effective.select(F.col("survivor").alias("memory_id"), "hlc", "event_id", F.lit(None).cast("long").alias("wipe"), F.col("member"))
    wiped = notes.where("wiped")
    line = place.unionByName(wiped.select("memory_id", "hlc", "event_id", (F.col("wipe") + 1).alias("wipe"), F.lit(None).cast("string").alias("member")))
    seen = F.last("wipe", ignorenulls=True).over(Window.partitionBy("memory_id").orderBy("hlc", "event_id"))
    to = line.withColumn("to_wipe", F.coalesce(seen, F.lit(0))).where("member is not null").select("event_id", "member", "to_wipe")
    moves = written(effective.join(to, ["event_id", "member"]).where("member <> survivor"), "moves")
    cites = _citations(notes, events, moves.select("member", "from_wipe", "survivor", "to_wipe", "hlc", "event_id"))
    # only memories that a run's end or a merge reached come out otherwise than in the first fold
    again = written(touches.where("what = 'ended'").select("memory_id").unionByName(effective.select(F.col("survivor").alias("memory_id"))).distinct(), "again")
    refold = not again.isEmpty()
    cites = written(cites, "all-citations") if refold else cites

    # what a run's end finds: citations of the memory by this run and by others at that time
    first = cites.groupBy("memory_id", "wipe", "run_id", "turn").agg(F.min(F.struct("hlc", "event_id")).alias("at")).select("memory_id", "wipe", "run_id", "at.hlc", "at.event_id", F.lit(1).alias("one"), F.lit(None).cast("string").alias("end"))
    finished = touches.where("what = 'ended'").select("memory_id", "run_id", "event_id").join(notes.select("memory_id", "event_id", "wipe", "hlc"), ["memory_id", "event_id"])
    order = lambda *by: Window.partitionBy(*by).orderBy("hlc", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = first.unionByName(finished.select("memory_id", "wipe", "run_id", "hlc", "event_id", F.lit(0).alias("one"), F.col("event_id").alias("end"))).withColumn("n", F.sum("one").over(order("memory_id", "wipe"))).withColumn("mine", F.sum("one").over(order("memory_id", "wipe", "run_id")))
    counted = counted.where("end is not null").select("memory_id", F.col("end").alias("event_id"), (F.col("mine") > 0).alias("__cited"), (F.col("n") - F.col("mine")).alias("__prior"))
    spoken = touches.where("what = 'cited'").select("run_id", "memory_id", F.struct("hlc", "event_id").alias("at"), F.col("p.outcome").alias("outcome"), F.col("p.revision_event_id").alias("named"))
    outcome = spoken.groupBy("run_id", "memory_id").agg(F.max_by("outcome", "at").alias("__outcome"))
    old = touches.where("what = 'ended'").select("run_id", "memory_id", F.col("event_id").alias("end"), F.struct("hlc", "event_id").alias("until"), "shown").join(spoken, ["run_id", "memory_id"]).where("at < until AND (named is null OR named = shown)").select("memory_id", F.col("end").alias("event_id"), F.lit(True).alias("__was")).distinct()
    told = touches.where("what = 'ended'").join(counted, ["memory_id", "event_id"], "left").join(outcome, ["run_id", "memory_id"], "left").join(old, ["memory_id", "event_id"], "left")
    told = told.withColumn("cited", F.col("__cited")).withColumn("prior", F.col("__prior")).withColumn("last_outcome", F.col("__outcome")).withColumn("was_cited", F.coalesce("__was", F.lit(False))).select(*TOUCH)
    gained = _touch(effective.withColumn("run_id", F.lit(None).cast("string")), "gained", "survivor")
    states = once.where("last").select("memory_id", *names(STATE))
    if refold:
        whole = touches.where("what <> 'ended'").unionByName(told).unionByName(gained.select(*TOUCH)).join(again, "memory_id", "left_semi").select(*TOUCH)
        folded = streamed(whole, "memory_id", Memory, f"memory_id string, {STATE}", last=lambda s: [_state(s)])
        states = written(states.join(again, "memory_id", "left_anti").unionByName(folded), "states")
    states = states.withColumn("memory_id", F.when(F.col("known"), F.col("memory_id"))).withColumn("revisions", F.from_json("revisions", f"array<struct<{REVISION}>>"))
    row = F.struct("cited_at", "rationale", "query")
    at = F.struct("hlc", "event_id")
    stand = cites.groupBy("memory_id", "wipe", "run_id", "turn").agg(F.max_by(F.when(F.col("own"), row), F.when(F.col("own"), at)).alias("mine"), F.min_by(row, at).alias("got")).join(wiped.select("memory_id", "wipe"), ["memory_id", "wipe"], "left_anti")
    value = F.when(F.col("mine").isNotNull(), F.col("mine")).otherwise(F.col("got"))
    citations = stand.select("memory_id", "run_id", "turn", value["cited_at"].alias("cited_at"), value["rationale"].alias("rationale"), value["query"].alias("query"))

    offered = events.where("p.proposal_id is not null AND kind IN ('memory.proposed', 'memory.rejected', 'memory.accepted') AND (kind <> 'memory.accepted' OR p.memory_id is not null)").select(F.col("p.proposal_id").alias("proposal_id"), "hlc", "event_id", F.substring_index("kind", ".", -1).alias("what"), "ts", "run_id", "p")
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), kind.alias("type"), F.struct("hlc", "event_id", "ts").alias("at"))
    edges = edge(events.where("kind = 'memory.edge'"), F.col("p.src_id"), F.col("p.dst_id"), F.col("p.edge_type"))
    edges = edges.unionByName(edge(effective, F.col("survivor"), F.col("member"), F.lit("supersedes")))
    episodes = events.where("kind = 'work.episode'")
    edges = edges.unionByName(edge(episodes.withColumn("m", F.explode("p.memory_ids")).where("m <> ''"), F.col("event_id"), F.col("m"), F.lit("lesson_from")))
    started = events.where("kind = 'run.started'").groupBy("run_id").agg(F.min_by(F.struct("ts", "hlc", "event_id", "p"), F.struct("hlc", "event_id")).alias("s"))
    over = events.where("kind IN ('run.finished', 'run.failed', 'run.aborted')").select("run_id", "hlc", "event_id", "ts", "kind", F.coalesce("p.total_cost_usd", F.lit(0.0)).alias("cost")).join(started.select("run_id", F.struct("s.hlc", "s.event_id").alias("b")), "run_id").where(F.struct("hlc", "event_id") > F.col("b"))
    over = over.groupBy("run_id").agg(F.max_by(F.struct("ts", "kind", "cost"), F.struct("hlc", "event_id")).alias("t"))
    line = Window.partitionBy("p.repo_root", F.coalesce("p.identity", F.lit(""))).orderBy("hlc", "event_id")
    rivals = notes.where("rival is not null").join(merges.select("event_id", "ts", F.col("p.survivor_id").alias("survivor")), "event_id")
    resolved = agreed.groupBy(F.col("p.conflict_id").alias("conflict_id"), "f").agg(F.max_by(F.struct("ts", F.col("p.resolution").alias("resolution")), F.struct("hlc", "event_id")).alias("l"))
    return {
        "memories": states.where("memory_id is not null").select(*names(MEMORY)),
        "revisions": states.select(F.explode("revisions").alias("r")).select("r.*"),
        "citations": citations,
        "proposals": streamed(offered, "proposal_id", Proposal, PROPOSAL, last=lambda s: [s.row] if s.row else []),
        "runs": started.join(over, "run_id", "left").select("run_id", F.coalesce("s.p.project_id", F.lit("unknown")).alias("project_id"), F.coalesce("s.p.task", F.lit("")).alias("task"), F.col("s.p.model").alias("model"), F.col("s.ts").alias("started_at"), F.col("t.ts").alias("ended_at"), F.col("t.kind").alias("terminal_kind"), F.coalesce("t.cost", F.lit(0.0)).alias("total_cost_usd")),
        "edges": edges.where("src <> dst AND type is not null").groupBy("src", "dst", "type").agg(F.min("at").alias("at")).select("src", "dst", "type", F.col("at.ts").alias("created_at")),
        "episodes": episodes.select("event_id", F.col("p.repo_root").alias("repo_root"), F.coalesce("p.identity", F.lit("")).alias("identity"), F.col("p.task").alias("task"), F.col("p.summary").alias("summary"), F.col("ts").alias("created_at"), F.lead("event_id").over(line).alias("superseded_by")),
        "conflicts": resolved.select("conflict_id", F.col("f.a").alias("new_memory_id"), F.col("f.b").alias("existing_memory_id"), F.col("f.scope").alias("scope"), F.col("f.kind").alias("kind"), F.coalesce("f.similarity", F.lit(0.0)).alias("similarity"), F.col("f.detected_at").alias("detected_at"), F.col("l.ts").alias("resolved_at"), F.col("l.resolution").alias("resolution")),
        "sync_conflicts": rivals.select(F.col("memory_id").alias("member"), F.least("rival", "survivor").alias("survivor_a"), F.greatest("rival", "survivor").alias("survivor_b"), F.struct("hlc", "event_id", "ts").alias("at")).groupBy("member", "survivor_a", "survivor_b").agg(F.min("at").alias("at")).select("member", "survivor_a", "survivor_b", F.col("at.ts").alias("detected_at")),
    }


def memory_stream(touches: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The current row of each memory that a micro-batch touches, from a stream of touches with a time column `at`.

    State is the memory as of the watermark and its younger touches, which are applied in the order of their clocks each time, so events
    that are late by less than `lateness` come out as in a replay; copies count once. One behind what is settled, a late copy too, leaves
    the state as it is and is reported by `replay`: such a key wants `project` over the log. Outcomes of runs and what merges hand on need
    rows of other keys and come with `project` only.
    """
    ship(touches.sparkSession)

    def step(key, frames, state):
        settled, waiting, until = pickle.loads(state.get[0]) if state.exists else (Memory(key[0]), {}, ("", ""))
        replay = False
        for frame in frames:
            for e in map(json.loads, frame["e"]):
                clock = e["hlc"], e["event_id"]
                if clock <= until:
                    replay = True
                else:
                    waiting[clock] = e
        mark = state.getCurrentWatermarkMs()
        for clock in sorted(waiting):
            if waiting[clock]["at_ms"] >= mark:
                break  # what is younger by clock waits with it
            settled.apply(waiting.pop(clock))
            until = clock
        now = copy.deepcopy(settled)
        for clock in sorted(waiting):
            now.apply(waiting[clock])
        state.update((pickle.dumps((settled, waiting, until)),))
        yield pd.DataFrame([{"memory_id": key[0], "replay": replay, "row": json.dumps(now.row), "revisions": json.dumps(list(now.revisions.values()))}])

    packed = touches.withWatermark("at", lateness).select("memory_id", "at", F.to_json(F.struct(*(c for c in TOUCH if c in touches.columns), (F.unix_micros("at") / 1000).cast("long").alias("at_ms")), {"ignoreNullFields": "false"}).alias("e"))
    return packed.groupBy("memory_id").applyInPandasWithState(step, "memory_id string, replay boolean, row string, revisions string", "memory binary", "update", "NoTimeout")


def bind_exposures(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """(event_id, memory_revisions): for deliveries of parsed events that name no revisions, what was current when they were made.

    revisions(memory_id, event_id, text, known_hlc, place) are those of a projection. A revision that repeats the text before it is no
    claim of its own; a delivery at the same clock as a revision comes before it. An as-of join by a sorted union, not by pairs.
    """
    changed = revisions.withColumn("before", F.lag("text").over(Window.partitionBy("memory_id").orderBy("place"))).where("before is null OR before <> text")
    asked = deliveries(events).where("shown is null").select("memory_id", "hlc", F.lit(0).alias("turn"), F.col("event_id").alias("delivery"), F.lit(None).cast("string").alias("claim"))
    line = asked.unionByName(changed.select("memory_id", F.col("known_hlc").alias("hlc"), F.lit(1).alias("turn"), F.lit(None).cast("string").alias("delivery"), F.col("event_id").alias("claim")))
    held = F.last("claim", ignorenulls=True).over(Window.partitionBy("memory_id").orderBy("hlc", "turn"))
    bound = line.withColumn("held", held).where("delivery is not null").select(F.col("delivery").alias("event_id"), F.struct("memory_id", F.coalesce("held", F.concat(F.lit("baseline:"), "memory_id"))).alias("entry"))
    return bound.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("memory_revisions"))  # of one delivery
