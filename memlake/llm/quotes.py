"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is its number of leading > signs; neighbouring lines of one level are a passage. Quoted passages and the own lines,
paragraphs and bodies of all messages are normalised and hashed; a passage links to the latest earlier message of its
conversation that has its hash as own text, or the hashes of its lines as a run of own lines (blank lines don't count). A message answers the message its first shallowest linked passage comes from, or
else the one before it; conversations are laid out depth first along the answers, by turn among answers to one message.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import ship, written

_lead = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_wrote = re.compile(r"^(on .{0,200} wrote:|[-_ ]*original message[-_ ]*)$", re.I)


def normalise(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


def key(text: str) -> int:
    """63-bit hash of a normalised passage."""
    return int.from_bytes(hashlib.blake2b(normalise(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message; lines that only announce a quote are dropped before one."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _lead.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not last and own and _wrote.match(own[-1].strip()):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(p).strip()) for n, p in passages if normalise("\n".join(p))]


def own_keys(own: str) -> set[int]:
    """Hashes of a message's own body and paragraphs."""
    return {key(u) for u in {own, *own.split("\n\n")} if normalise(u)}


def line_keys(text: str) -> list[int]:
    """Hashes of the lines with words, in order."""
    return [key(u) for u in text.split("\n") if normalise(u)]


MESSAGE = "conv_id long, turn long, role string, row long, body string, asked array<struct<place:int,level:int,h:bigint,lines:array<bigint>>>, held array<long>, lines array<long>"


def parsed(messages: DataFrame) -> DataFrame:
    ship(messages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                body, asked, held, lines, row = [], [], [], [], []
                for t in part.column(3).to_pylist():
                    own, passages = parse(t)
                    body.append(own)
                    asked.append([{"place": n, "level": level, "h": key(p), "lines": line_keys(p)} for n, (level, p) in enumerate(passages)])
                    held.append(sorted(own_keys(own)))
                    lines.append(line_keys(own))
                    row.append(at)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(row, pa.int64()), pa.array(body, pa.string()), pa.array(asked, pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("h", pa.int64()), ("lines", pa.list_(pa.int64()))]))), pa.array(held, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.int64()))],
                    ["conv_id", "turn", "role", "row", "body", "asked", "held", "lines"],
                )

    return written(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, MESSAGE), "messages")


def link(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, body (without quotes), n_quotes, n_linked, answers (turn it answers or null), position in reply order from 0, depth.

    Messages with a null conv_id stand alone, in no order; a null turn comes first; rows of one turn keep the order of role and body. A
    null text is empty. Conversations, but not the hashes of passages, are put together in one task each. Other columns are ignored.
    """
    rows = parsed(messages)
    asked = rows.select("conv_id", "turn", "row", F.explode("asked").alias("q")).select("conv_id", "turn", "row", "q.*").where("conv_id is not null")
    held = asked.select("conv_id", "h").distinct().join(rows.select("conv_id", F.col("turn").alias("o_turn"), F.explode(F.concat("held", "lines")).alias("h")).distinct(), ["conv_id", "h"])
    whole = asked.join(held, ["conv_id", "h"]).where("o_turn < turn").select("row", "place", "level", "o_turn")
    sought = asked.where(F.size("lines") > 1).select("conv_id", "turn", "row", "place", "level", F.size("lines").alias("size"), F.posexplode("lines").alias("nth", "h"))
    lines = rows.select("conv_id", F.col("turn").alias("o_turn"), F.col("row").alias("o_row"), F.posexplode("lines").alias("at", "h"))
    shared = sought.join(lines, ["conv_id", "h"]).where("o_turn < turn")
    runs = shared.groupBy("row", "place", "level", "size", "o_row", "o_turn", (F.col("at") - F.col("nth")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = size")
    linked = whole.unionByName(runs.select("row", "place", "level", "o_turn")).groupBy("row", "place", "level").agg(F.max("o_turn").alias("o_turn"))
    by_row = linked.groupBy("row").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", "place", "o_turn")).alias("first"))
    full = rows.join(by_row, "row", "left").select(
        "conv_id", "turn", "role", "body", F.size("asked").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("first.o_turn").alias("answers")
    )
    names = ["conv_id", "turn", "role", "body", "n_quotes", "n_linked", "answers", "position", "depth"]

    def lay(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["body"]))
        place: dict = {}
        for k, r in enumerate(got):
            place.setdefault(r["turn"], k)
        after: list[list[int]] = [[] for _ in got]
        for k, r in enumerate(got[1:], 1):
            after[place[r["answers"]] if r["answers"] is not None else k - 1].append(k)
        todo, n = [(0, 0)] if got else [], 0
        while todo:
            k, depth = todo.pop()
            got[k]["position"], got[k]["depth"] = n, depth
            n += 1
            todo += [(x, depth + 1) for x in reversed(after[k])]
        return pa.table({c: pa.array([r[c] for r in got], pa.string() if c in ("role", "body") else pa.int64()) for c in names})

    lone = full.where("conv_id is null").select(*names[:7], F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("depth"))
    return lone.unionByName(full.where("conv_id is not null").groupBy("conv_id").applyInArrow(lay, "conv_id long, turn long, role string, body string, n_quotes long, n_linked long, answers long, position long, depth long"))


def formatted(linked: DataFrame) -> DataFrame:
    """conv_id, n_messages, chat: the bodies in reply order under their roles."""
    parts = F.array_sort(F.collect_list(F.struct("position", F.coalesce("role", F.lit("user")).alias("role"), "body")))
    chat = F.array_join(F.transform(parts, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["body"])), "\n")
    return linked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), chat.alias("chat"))
