"""Queries of the event log's projection and of revisions on two time axes, over the driver's events.

Each event becomes one of a log about memory k of its props: a purchase accepts or extends it, a signup corrects it, a click cites it, a view
restores, ages or regrets it, and an error forgets it (or is of a kind that nothing handles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import bitemporal, exposures, projection
from memlake.session import table

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_WHAT = """CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'memory.accepted' ELSE 'memory.temporal' END
WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'memory.corrected' ELSE 'memory.aged' END WHEN 'click' THEN 'memory.cited'
WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'memory.restored' WHEN 1 THEN 'retrieval.regret' ELSE 'memory.aged' END
ELSE CASE WHEN event_id % 4 = 0 THEN 'memory.invalidated' ELSE 'stage.entered' END END"""
_OUTCOME = "CASE event_id % 7 WHEN 0 THEN 'harmed' WHEN 1 THEN 'helped' WHEN 2 THEN 'helped' ELSE 'noop' END"


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """The driver's events as a log of the projection."""
    e = table(spark, d, "events").selectExpr("event_id", "user_id", f"{_K} AS k", f"{_WHAT} AS kind", f"{_OUTCOME} AS outcome")
    stamp = F.concat(F.lit("2024-01-01T00:00:00."), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit("Z"))
    text = F.concat(F.lit("t"), (F.col("event_id") % 6).cast("string"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("memory_id"), text.alias("text"), F.col("outcome"), F.when(F.col("kind") == "memory.invalidated", "forgotten").alias("reason"), F.lit("manual").alias("source"), stamp.alias("last_useful_at"),
        F.when(F.col("kind") == "memory.temporal", stamp).alias("valid_from"), (F.col("event_id") % 3).alias("turn"),
    ))
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), stamp.alias("ts"), "kind", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("hlc"), payload.alias("payload"))


def projection_fold(spark: SparkSession, d: str) -> DataFrame:
    """The memories after a replay of the whole log, with how many revisions and citations each has."""
    t = projection.project(log_of(spark, d))
    revisions = t["revisions"].groupBy("memory_id").agg(F.count(F.lit(1)).alias("revisions"))
    cites = t["citations"].groupBy("memory_id").agg(F.count(F.lit(1)).alias("citations"))
    many = t["memories"].join(revisions, "memory_id", "left").join(cites, "memory_id", "left")
    return many.select("memory_id", "text", F.round("confidence", 6).alias("confidence"), "use_count", F.round("usefulness_score", 6).alias("usefulness_score"), "invalidated_reason", F.coalesce("revisions", F.lit(0)).alias("revisions"), F.coalesce("citations", F.lit(0)).alias("citations"), "last_useful_at", "valid_from")


def memory_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every revision with the evidence it retired with."""
    r = projection.project(log_of(spark, d))["revisions"]
    return r.select("memory_id", "event_id", "place", "text", F.round("confidence", 6).alias("confidence"), "use_count", F.round("usefulness_score", 6).alias("usefulness_score"))


def _known_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events").selectExpr("event_id", "event_type", "ts", f"{_K} * 10 + user_id % 10 AS memory_id")
    day = lambda c, n: F.expr(f"timestampadd(DAY, CAST({n} AS INT), {c})")
    accepted = e.where("event_type = 'purchase'").groupBy("memory_id").agg(F.min("ts").alias("created_at"), F.max("event_id").alias("last"))
    memories = accepted.select("memory_id", F.concat(F.lit("first "), F.col("memory_id").cast("string")).alias("text"), "created_at", F.when(F.col("memory_id") % 5 == 0, day("created_at", "memory_id % 40")).alias("invalidated_at"), F.when(F.col("memory_id") % 3 == 0, day("created_at", "memory_id % 9 - 4")).alias("valid_from"), F.when(F.col("memory_id") % 4 == 0, day("created_at", "memory_id % 60")).alias("valid_to"))
    revisions = e.where("event_type = 'signup'").select("memory_id", F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("rev "), F.col("event_id").cast("string")).alias("text"), F.col("ts").alias("known_at"), day("ts", "event_id % 41 - 20").alias("effective_at"), F.col("event_id").alias("place"))
    asks = e.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("ask"), "memory_id", F.col("ts").alias("known_at"), day("ts", "event_id % 31 - 15").alias("valid_at"))
    return memories, revisions, asks


def memory_as_known(spark: SparkSession, d: str) -> DataFrame:
    """For each view and click: its memory's text in effect some days off, as it was known then."""
    return bitemporal.as_known(*_known_tables(spark, d))


_DAY = "concat('d', user_id, '-', date_format(ts, 'yyyyMMdd'))"


def _exposed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries of what a user viewed in a day, and clicks as citations of them."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", F.expr(_DAY).alias("exposure_id"), F.expr(f"{_K} % 20").alias("memory_id"), F.col("user_id").alias("run_id"))
    sent = e.where("event_type = 'view'").groupBy(F.col("exposure_id").alias("event_id"), "run_id", "memory_id").agg(F.max("ts").alias("ts")).withColumn("shown", F.expr("CASE memory_id % 5 WHEN 0 THEN '' ELSE concat('v', memory_id % 3) END"))
    cited = e.where("event_type = 'click'").withColumn("outcome", F.expr("CASE event_id % 5 WHEN 0 THEN 'helped' WHEN 1 THEN 'harmed' WHEN 2 THEN 'noop' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'maybe' END"))
    return sent, cited.withColumn("hlc", F.lpad(F.col("event_id").cast("string"), 12, "0"))


def exposure_citations(spark: SparkSession, d: str) -> DataFrame:
    """Each click as a citation of what its user was shown that day: whether it counts, and why not."""
    sent, cited = _exposed(spark, d)
    memories = spark.range(20).select(F.col("id").alias("memory_id"), F.when(F.col("id") == 3, "then").alias("invalidated_at"), F.when(F.col("id") == 4, "m1").alias("superseded_by")).join(table(spark, d, "events").selectExpr(f"{_K} % 20 AS memory_id").distinct(), "memory_id")
    return exposures.exposure_citations(cited.select("event_id", "hlc", "exposure_id", "memory_id", "outcome"), sent, memories)


def personal_eval(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases: the last day on which each kind of question was asked, with the memories relied on then."""
    sent, cited = _exposed(spark, d)
    asked = sent.withColumn("query", F.concat(F.lit("about "), (F.col("run_id") % 40).cast("string"))).withColumn("task_id", F.lit(None).cast("string")).withColumn("ts", F.substring_index("event_id", "-", -1))
    claims = sent.select("memory_id").distinct().withColumn("claim", F.expr("concat('v', memory_id % 2)"))
    relied = cited.where("event_id % 5 <> 4").select("run_id", "exposure_id", "memory_id", F.expr("concat('v', memory_id % 3)").alias("revision"))
    out = exposures.personal_eval(asked, relied, claims)
    return out.select("query", F.array_join(F.transform("relevant", lambda m: m.cast("string")), ",").alias("relevant"), "ts")


_FOLD = f"""
WITH RECURSIVE e AS (SELECT {_K} AS k, event_id, {_WHAT} AS what, {_OUTCOME} AS outcome, 'r' || user_id AS run, event_id % 3 AS turn, 't' || (event_id % 6) AS txt, '2024-01-01T00:00:00.' || lpad(CAST(event_id AS VARCHAR), 9, '0') || 'Z' AS stamp FROM events),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e),
f AS (SELECT DISTINCT k, 0::BIGINT AS n, -1::BIGINT AS event_id, false AS live, NULL::VARCHAR AS txt, 1.0::DOUBLE AS conf, 0::BIGINT AS uses, 0.0::DOUBLE AS score, NULL::VARCHAR AS reason, NULL::VARCHAR AS useful, NULL::VARCHAR AS since, 'base' AS claim, NULL::VARCHAR AS before, 0::BIGINT AS revs, false AS ok, false AS fixed, false AS first, NULL::VARCHAR AS old, 0.0::DOUBLE AS oconf, 0::BIGINT AS ouses, 0.0::DOUBLE AS oscore, 0::BIGINT AS wipes FROM e
UNION ALL
SELECT f.k, s.n, s.event_id,
CASE s.what WHEN 'memory.accepted' THEN true ELSE f.live END,
CASE WHEN s.what = 'memory.accepted' OR (s.what = 'memory.corrected' AND f.live AND f.reason IS NULL) THEN s.txt ELSE f.txt END,
CASE WHEN s.what = 'memory.accepted' OR (s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> f.txt) THEN 1.0
WHEN f.live AND ((s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome = 'harmed') OR s.what = 'retrieval.regret') THEN greatest(0.1, least(0.99, f.conf + 0.05 * (0 - f.conf)))
WHEN f.live AND s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome = 'helped' THEN greatest(0.1, least(0.99, f.conf + 0.05 * (1 - f.conf))) ELSE f.conf END,
CASE WHEN s.what = 'memory.accepted' OR (s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> f.txt) THEN 0
WHEN f.live AND ((s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome <> 'noop') OR s.what = 'retrieval.regret') THEN f.uses + 1 ELSE f.uses END,
CASE WHEN s.what = 'memory.accepted' OR (s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> f.txt) THEN 0
WHEN f.live AND ((s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome = 'harmed') OR s.what = 'retrieval.regret') THEN f.score - 1
WHEN f.live AND s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome = 'helped' THEN f.score + 1 ELSE f.score END,
CASE WHEN s.what IN ('memory.accepted', 'memory.restored') THEN NULL WHEN s.what = 'memory.invalidated' AND f.live AND f.reason IS NULL THEN 'forgotten'
WHEN s.what = 'memory.cited' AND f.live AND f.claim = 'base' AND s.outcome = 'harmed' AND f.reason IS NULL THEN 'cite_harmed' ELSE f.reason END,
CASE WHEN s.what = 'memory.accepted' OR (s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> f.txt) THEN NULL WHEN f.live AND (s.what = 'memory.aged' OR (s.what = 'memory.cited' AND f.claim = 'base' AND s.outcome = 'helped')) THEN s.stamp ELSE f.useful END,
CASE WHEN s.what = 'memory.accepted' THEN NULL WHEN s.what = 'memory.temporal' AND f.live THEN s.stamp ELSE f.since END,
CASE WHEN s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> COALESCE(f.before, f.txt) THEN 'e' || s.event_id ELSE f.claim END,
CASE WHEN s.what = 'memory.corrected' AND f.live AND f.reason IS NULL THEN s.txt ELSE f.before END,
CASE WHEN s.what = 'memory.corrected' AND f.live AND f.reason IS NULL THEN f.revs + CASE WHEN f.before IS NULL THEN 2 ELSE 1 END ELSE f.revs END,
s.what = 'memory.cited' AND f.claim = 'base', s.what = 'memory.corrected' AND f.live AND f.reason IS NULL, s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND f.before IS NULL,
f.txt, f.conf, f.uses, f.score, f.wipes + CASE WHEN s.what = 'memory.corrected' AND f.live AND f.reason IS NULL AND s.txt <> f.txt THEN 1 ELSE 0 END
FROM f JOIN s ON s.k = f.k AND s.n = f.n + 1),
z AS (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY n DESC) = 1),
c AS (SELECT f.k, COUNT(DISTINCT (s.run, s.turn)) AS cites FROM f JOIN s ON s.k = f.k AND s.n = f.n JOIN z ON z.k = f.k WHERE f.ok AND f.wipes = z.wipes GROUP BY f.k)
"""
_REVISED = """, r AS (SELECT k, event_id, txt, old, revs, first, n, oconf, ouses, oscore, conf, uses, score FROM f WHERE fixed),
v AS (SELECT k, -1 AS n, 'baseline:m' || k AS event_id, old AS txt FROM r WHERE first UNION ALL SELECT k, n, CAST(event_id AS VARCHAR), txt FROM r),
p AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY k ORDER BY n) - 1)::INTEGER AS place, LEAD(n) OVER (PARTITION BY k ORDER BY n) AS next FROM v)
SELECT 'm' || p.k AS memory_id, p.event_id, p.place, p.txt AS text, ROUND(COALESCE(x.oconf, y.conf), 6) AS confidence, COALESCE(x.ouses, y.uses)::BIGINT AS use_count, ROUND(COALESCE(x.oscore, y.score), 6) AS usefulness_score
FROM p LEFT JOIN r x ON x.k = p.k AND x.n = p.next LEFT JOIN r y ON y.k = p.k AND y.n = p.n"""
ORACLE: dict[str, str] = {
    "projection_fold": _FOLD + "SELECT 'm' || z.k AS memory_id, txt AS text, ROUND(conf, 6) AS confidence, uses AS use_count, ROUND(score, 6) AS usefulness_score, reason AS invalidated_reason, revs AS revisions, COALESCE(cites, 0) AS citations, useful AS last_useful_at, since AS valid_from FROM z LEFT JOIN c ON c.k = z.k WHERE live",
    "memory_revisions": _FOLD + _REVISED,
    "memory_as_known": f"""
WITH e AS (SELECT event_id, event_type, ts, {_K} * 10 + user_id % 10 AS memory_id FROM events),
a AS (SELECT memory_id, MIN(ts) AS created_at FROM e WHERE event_type = 'purchase' GROUP BY memory_id),
m AS (SELECT memory_id, 'first ' || memory_id AS text, created_at, CASE WHEN memory_id % 5 = 0 THEN created_at + INTERVAL 1 DAY * (memory_id % 40)::INT END AS invalidated_at, CASE WHEN memory_id % 3 = 0 THEN created_at + INTERVAL 1 DAY * (memory_id % 9 - 4)::INT END AS valid_from, CASE WHEN memory_id % 4 = 0 THEN created_at + INTERVAL 1 DAY * (memory_id % 60)::INT END AS valid_to FROM a),
r AS (SELECT memory_id, CAST(event_id AS VARCHAR) AS event_id, 'rev ' || event_id AS text, ts AS known_at, ts + INTERVAL 1 DAY * (event_id % 41 - 20)::INT AS effective_at, event_id AS place FROM e WHERE event_type = 'signup'),
b AS (SELECT * FROM r UNION ALL SELECT memory_id, 'baseline:' || memory_id, text, created_at, COALESCE(valid_from, TIMESTAMP '0001-01-01 00:00:00'), -1 FROM m WHERE memory_id IN (SELECT memory_id FROM r)),
q AS (SELECT event_id AS ask, memory_id, ts AS known_at, ts + INTERVAL 1 DAY * (event_id % 31 - 15)::INT AS valid_at FROM e WHERE event_type IN ('view', 'click')),
l AS (SELECT q.ask, q.memory_id, q.known_at, q.valid_at, m.text FROM q JOIN m USING (memory_id) WHERE m.created_at <= q.known_at AND COALESCE(m.invalidated_at > q.known_at, true) AND COALESCE(m.valid_from <= q.valid_at, true) AND COALESCE(m.valid_to > q.valid_at, true)),
x AS (SELECT l.ask, l.memory_id, l.text AS own, arg_max(b.event_id, (b.known_at, b.place)) AS revision, arg_max(b.text, (b.known_at, b.place)) AS text FROM l LEFT JOIN b ON b.memory_id = l.memory_id AND b.known_at <= l.known_at AND b.effective_at <= l.valid_at GROUP BY l.ask, l.memory_id, l.text)
SELECT CAST(ask AS VARCHAR) AS ask, CAST(memory_id AS VARCHAR) AS memory_id, revision, CASE WHEN revision IS NULL THEN own ELSE text END AS text FROM x""",
}
_SENT = f"""e AS (SELECT event_id, event_type, ts, 'd' || user_id || '-' || strftime(ts, '%Y%m%d') AS exposure_id, {_K} % 20 AS memory_id, user_id AS run_id FROM events),
s AS (SELECT exposure_id, run_id, memory_id, CASE memory_id % 5 WHEN 0 THEN '' ELSE 'v' || (memory_id % 3) END AS shown FROM e WHERE event_type = 'view' GROUP BY ALL)"""
ORACLE["exposure_citations"] = f"""
WITH {_SENT}, c AS (SELECT e.*, COALESCE(CASE event_id % 5 WHEN 0 THEN 'helped' WHEN 1 THEN 'harmed' WHEN 2 THEN 'noop' WHEN 3 THEN NULL ELSE 'maybe' END, 'noop') AS outcome, s.shown FROM e LEFT JOIN s USING (exposure_id, memory_id) WHERE event_type = 'click'),
w AS (SELECT *, CASE WHEN outcome = 'maybe' THEN 'outcome' WHEN shown IS NULL THEN 'undelivered' WHEN shown = '' THEN 'unbound' WHEN memory_id IN (3, 4) THEN 'gone' END AS wrong FROM c),
n AS (SELECT *, ROW_NUMBER() OVER l AS n, first_value(outcome) OVER l AS was FROM w WINDOW l AS (PARTITION BY exposure_id, memory_id, wrong ORDER BY event_id)),
t AS (SELECT *, CASE WHEN wrong IS NOT NULL THEN wrong WHEN n = 1 THEN 'accepted' WHEN outcome = was THEN 'repeat' ELSE 'conflict' END AS status FROM n)
SELECT event_id, exposure_id, memory_id, outcome, CASE WHEN status = 'accepted' THEN shown END AS revision, status FROM t"""
ORACLE["personal_eval"] = f"""
WITH {_SENT}, a AS (SELECT *, 'about ' || (run_id % 40) AS query, split_part(exposure_id, '-', 2) AS ts FROM s),
l AS (SELECT query, ts, exposure_id, run_id FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY ts DESC, exposure_id DESC) = 1),
r AS (SELECT DISTINCT run_id, exposure_id, memory_id, 'v' || (memory_id % 3) AS revision FROM e WHERE event_type = 'click' AND event_id % 5 <> 4),
g AS (SELECT r.run_id, r.exposure_id, string_agg(r.memory_id::VARCHAR, ',' ORDER BY r.memory_id) AS relevant FROM r JOIN s ON s.exposure_id = r.exposure_id AND s.memory_id = r.memory_id AND s.shown = r.revision WHERE r.revision = 'v' || (r.memory_id % 2) GROUP BY ALL)
SELECT l.query, COALESCE(g.relevant, '') AS relevant, l.ts FROM l LEFT JOIN g USING (run_id, exposure_id)"""
QUERIES = {f.__name__: f for f in (projection_fold, memory_revisions, memory_as_known, exposure_citations, personal_eval)}
