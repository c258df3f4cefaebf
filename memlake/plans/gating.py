"""Gates, weights, choices and measures on the driver's tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import gates as G
from memlake.plans.knowledge import _CLASS
from memlake.plans.knowledge import ORACLE as KNOWLEDGE
from memlake.session import table

TERMS = ["thatin", "ononst", "hehely"]
GATE_TERMS = ["thnd", "erwhe"]


def _r(c, name):
    return F.round(c, 6).alias(name)


def _key():
    return F.get_json_object("props", "$.k").cast("long")


def supersession_cues(spark, d) -> DataFrame:
    said = F.concat_ws(" ", F.col("text"), F.element_at(F.array(F.lit("(Switched from tabs)"), F.lit("it is known"), F.lit("as-of 2024")), (F.col("turn") % 3 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", G.has_cue(said).alias("cue"))


def task_reweight(spark, d) -> DataFrame:
    """The weights of each turn's task class, joined to the turns from a row a class."""
    kinds = [(k, *(round(w, 6) for w in G.task_weights(k).values())) for k in ("feature", *G.TASK_FACTORS)]
    weights = spark.createDataFrame(kinds, "task string, relevance double, freshness double, confidence double, scope double")
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.task_class(F.concat_ws(" why ", "role", "text")).alias("task"))
    return turns.join(F.broadcast(weights), "task").select("conv_id", "turn", *weights.columns)  # five rows


def usefulness_decay(spark, d) -> DataFrame:
    seen = F.datediff(F.lit("2024-02-15").cast("date"), F.col("last").cast("date")).cast("double")
    last = table(spark, d, "events").where("event_type = 'click'").groupBy(_key().alias("memory_id")).agg(F.max("ts").alias("last"))
    return last.select("memory_id", _r(G.decay(seen, 45.0), "decay"))


def conflict_resolution(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _r(G.resolution_score(F.col("n_chars") / 1000.0, (F.col("doc_id") % 365).cast("double")), "resolution"))


def query_routing(spark, d) -> DataFrame:
    cited = table(spark, d, "events").where("event_type = 'click'").groupBy("user_id", _key().alias("memory_id")).agg(F.count(F.lit(1)).alias("cites"), F.max("ts").alias("last"))
    age = F.datediff(F.lit("2024-02-15").cast("date"), F.col("last").cast("date"))
    routes = cited.select("user_id", "memory_id", G.route_strength(F.lit(0.9), F.col("cites"), age).alias("w"))
    total = routes.groupBy("user_id").agg(F.sum("w").alias("all"))
    return routes.join(total, "user_id").select("user_id", "memory_id", _r(G.routing_gain(F.col("w"), F.col("all")), "gain"))


def tags_stripped(spark, d) -> DataFrame:
    tagged = table(spark, d, "documents").select("doc_id", F.concat(F.lit("[tags: a, "), "lang", F.lit("]  "), "source").alias("t"), F.concat(F.lit("[tags: "), "lang", F.lit("]")).alias("bare"))
    return tagged.select("doc_id", G.strip_tags(F.col("t")).alias("plain"), G.strip_tags(F.col("bare")).alias("bare"))


def clock_offsets(spark, d) -> DataFrame:
    at = table(spark, d, "events").select("event_id", G.rfc3339(F.col("ts")).alias("said"))
    return at.select("event_id", "said", G.rfc3339_millis(F.col("said")).alias("utc"), G.rfc3339_millis(F.regexp_replace("said", "Z$", "+02:30")).alias("east"))


def window_counts(spark, d) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    e = table(spark, d, "events")
    inside = lambda n: F.lit(True) if n is None else F.col("ts") >= now - F.expr(f"INTERVAL {n} DAYS")
    return e.groupBy("event_type").agg(*(F.count_if(inside(G.window_days(w))).alias(f"in_{w}") for w in ("7d", "14d", "all")))


def evidence_coverage(spark, d) -> DataFrame:
    found = G.weighted_coverage(table(spark, d, "documents").select("doc_id", "text"), TERMS)
    return found.where("coverage > 0").select("doc_id", _r(F.col("coverage"), "coverage"))


def _anchored(spark, d) -> DataFrame:
    return G.anchor_similarity(table(spark, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("turn"), "embedding"), "session", "turn")


def anchor_similarity(spark, d) -> DataFrame:
    return _anchored(spark, d).select("session", "turn", _r(F.col("similarity"), "similarity"))


def semantic_floor(spark, d) -> DataFrame:
    near = _anchored(spark, d).select(F.col("turn").alias("doc_id"), _r(F.col("similarity"), "cosine"))
    return G.semantic_floor(table(spark, d, "documents").select("doc_id").join(near, "doc_id", "left"), 0.1)


def evidence_abstention(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'view'").select("event_id", F.col("value").alias("score"), (F.col("value") / 1000).alias("cosine"))
    return G.abstain(e, 50.0, 0.2).select("event_id").unionByName(G.abstain(e, 50.0, 5.0).select("event_id"))


def mounts(spark, d) -> DataFrame:
    scope = F.element_at(F.create_map(*(F.lit(x) for x in ("src1", "project", "src2", "repository", "src3", "user"))), F.col("source"))
    return G.on_mounts(table(spark, d, "documents").select("doc_id", F.coalesce(scope, F.lit("org")).alias("scope")), {"repo"})


def proposals_page(spark, d) -> DataFrame:
    return G.listed(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 25, 3, {"n_chars": 200}, lang="en", source=None)


def lesson_gate(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    stored = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    lessons = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "text", F.lit(False).alias("lasting"))
    return G.quality_gate(lessons, stored, ["lang"], 10, 2000).select("doc_id", "verdict")


def recall_gate(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", (1.0 / (1 + F.col("turn"))).alias("score"), G.words_of(F.coalesce("text", F.lit(""))).alias("words"))
    out = G.recall_gate(rows, "conv_id", GATE_TERMS)
    return out.select("conv_id", "eligible", _r(F.col("coverage"), "coverage"), _r(F.col("entropy"), "entropy"), _r(F.col("uncertainty"), "uncertainty"), "passes")


def cluster_survivors(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(_key().alias("cluster"), F.col("event_id").alias("id"), F.col("value").alias("score"), "ts")
    return G.survivors(e, "cluster")


def recent_sessions(spark, d) -> DataFrame:
    return G.recent_sessions(table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts"), "session", "ts", 15)


def _ranked(spark, d, kind) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", _key().alias("id"), "value")


def _by_value(spark, d) -> DataFrame:
    best = _ranked(spark, d, "view").groupBy("user_id", "id").agg(F.max("value").alias("value"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "id")))


def retrieval_metrics(spark, d) -> DataFrame:
    out = G.retrieval_metrics(_by_value(spark, d), _ranked(spark, d, "click"), "user_id")
    return out.select("user_id", *(_r(F.col(c), c) if c.startswith("re") else c for c in out.columns[1:]))


def stale_hits(spark, d) -> DataFrame:
    return G.stale_hits(_by_value(spark, d), _ranked(spark, d, "error"), "user_id", 4)


def floor_percentile(spark, d) -> DataFrame:
    return G.percentile_by_floor(table(spark, d, "events"), "event_type", "value", 0.95)


def turn_jaccard(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("b", before).where("b is not null").select("conv_id", "turn", _r(G.jaccard(F.col("t"), F.col("b")), "jaccard"))


def rebuild_guard(spark, d) -> DataFrame:
    return G.lost_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def stage_durations(spark, d) -> DataFrame:
    out = G.stage_durations(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "runs", _r(F.col("total"), "total"), _r(F.col("mean"), "mean"), "longest")


def payload_ids(spark, d) -> DataFrame:
    made = F.concat(F.lit('{"memory_ids": ['), F.get_json_object("props", "$.k"), F.lit(", "), F.col("user_id"), F.lit("]}"))
    return table(spark, d, "events").select(F.explode(G.json_ids(made)).alias("memory_id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


def regrets_between(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error' AND ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts <= TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    return e.agg(F.count(F.lit(1)).alias("regrets"))


QUERIES = {
    f.__name__: f
    for f in (
        supersession_cues, task_reweight, usefulness_decay, conflict_resolution, query_routing, tags_stripped, clock_offsets, window_counts, evidence_coverage, anchor_similarity, semantic_floor,
        evidence_abstention, mounts, proposals_page, lesson_gate, recall_gate, cluster_survivors, recent_sessions, retrieval_metrics, stale_hits, floor_percentile, turn_jaccard, rebuild_guard,
        stage_durations, payload_ids, regrets_between,
    )
}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_TOK = "list_filter(string_split_regex(lower(COALESCE(text, '')), '[^a-z0-9_]+'), lambda t: length(t) >= 2)"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_ANCHOR = (
    "SELECT e.label AS session, e.vec_id AS turn, ROUND(greatest(-1, least(1, " + _DOT("e.embedding", "f.anchor") + " / (sqrt(" + _DOT("e.embedding", "e.embedding") + ") * sqrt(" + _DOT("f.anchor", "f.anchor") + ")))), 6) AS similarity "
    "FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label) f ON e.label = f.label"
)
_IDF = ", ".join(f"greatest(0, ln((COUNT(*) + 1.0) / (SUM(regexp_matches(lower(text), '(^|[^a-z0-9_]){t}')::INT) + 1))) AS w{k}" for k, t in enumerate(TERMS))
_HITS = " + ".join(f"contains(lower(text), '{t}')::INT * w{k}" for k, t in enumerate(TERMS))
_RANKED = f"v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS r FROM (SELECT user_id, {_K} AS id, MAX(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) t)"
_OTHER = lambda kind: f"SELECT DISTINCT user_id, {_K} AS id FROM events WHERE event_type = '{kind}'"
_GATE = [f"(list_contains(w, '{t}') OR list_contains(w, '{t}e') OR len(list_filter(w, lambda x: x || 'e' = '{t}')) > 0)::INT" for t in GATE_TERMS]
_NORMAL = "' ' || trim(regexp_replace(lower(concat_ws(' ', text, ['(Switched from tabs)', 'it is known', 'as-of 2024'][turn % 3 + 1])), '[^a-z0-9]+', ' ', 'g')) || ' '"
ORACLE = {
    "supersession_cues": f"SELECT conv_id, turn, regexp_matches({_NORMAL}, ' ({'|'.join(G.CUES)}) ') AS cue FROM conversations",
    "task_reweight": f"WITH c AS (SELECT conv_id, turn, {_CLASS} AS task FROM (SELECT conv_id, turn, lower(concat_ws(' why ', role, text)) AS t FROM conversations) x), w AS (SELECT task, ROUND(r / s, 6) AS relevance, ROUND(f / s, 6) AS freshness, ROUND(c / s, 6) AS confidence, ROUND(o / s, 6) AS scope FROM (SELECT *, r + f + c + o AS s FROM (SELECT task, 0.5::DOUBLE * CASE task WHEN 'investigation' THEN 1.4 ELSE 1 END AS r, "
    "0.2::DOUBLE * CASE task WHEN 'debug' THEN 1.6 ELSE 1 END AS f, 0.2::DOUBLE * CASE task WHEN 'docs' THEN 1.15 ELSE 1 END AS c, 0.1::DOUBLE * CASE task WHEN 'refactor' THEN 1.6 ELSE 1 END AS o FROM (VALUES ('feature'), ('debug'), ('refactor'), ('investigation'), ('docs')) AS t(task)) x) y) SELECT conv_id, turn, task, relevance, freshness, confidence, scope FROM c JOIN w USING (task)",
    "usefulness_decay": f"SELECT memory_id, ROUND(exp(-ln(2) / 45 * greatest(0, date_diff('day', CAST(last AS DATE), DATE '2024-02-15'))), 6) AS decay FROM (SELECT {_K} AS memory_id, MAX(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1) t",
    "conflict_resolution": "SELECT doc_id, ROUND(least(1, n_chars / 1000.0::DOUBLE) * exp(-ln(2) / 30 * (doc_id % 365)), 6) AS resolution FROM documents",
    "query_routing": f"SELECT user_id, memory_id, ROUND(least(0.25 * w / SUM(w) OVER (PARTITION BY user_id), 0.10::DOUBLE), 6) AS gain FROM (SELECT user_id, {_K} AS memory_id, 0.9::DOUBLE * ln(1 + COUNT(*)) / sqrt(1 + date_diff('day', CAST(MAX(ts) AS DATE), DATE '2024-02-15')) AS w FROM events WHERE event_type = 'click' GROUP BY 1, 2) t",
    "tags_stripped": "SELECT doc_id, source AS plain, '[tags: ' || lang || ']' AS bare FROM documents",
    "clock_offsets": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS said, epoch_us(ts) // 1000 AS utc, epoch_us(ts) // 1000 - 9000000 AS east FROM events",
    "window_counts": "SELECT event_type, COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24 00:00:00') AS in_7d, COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17 00:00:00') AS in_14d, COUNT(*) AS in_all FROM events GROUP BY 1",
    "evidence_coverage": f"WITH f AS (SELECT {_IDF} FROM documents) SELECT * FROM (SELECT doc_id, ROUND(({_HITS}) / (w0 + w1 + w2), 6) AS coverage FROM documents, f WHERE w0 + w1 + w2 > 1e-7) t WHERE coverage > 0",
    "anchor_similarity": _ANCHOR,
    "semantic_floor": f"SELECT d.doc_id, a.similarity AS cosine FROM documents d LEFT JOIN ({_ANCHOR}) a ON d.doc_id = a.turn WHERE a.similarity IS NULL OR a.similarity >= 0.1",
    "evidence_abstention": "SELECT event_id FROM events, (SELECT MAX(value) AS best FROM events WHERE event_type = 'view') m WHERE event_type = 'view' AND best >= 50 AND best / 1000 >= 0.1",
    "mounts": "SELECT doc_id, CASE source WHEN 'src1' THEN 'project' ELSE 'repository' END AS scope FROM documents WHERE source IN ('src1', 'src2')",
    "proposals_page": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200 ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 3",
    "lesson_gate": "SELECT doc_id, CASE WHEN length(t) < 10 THEN 'too_short' WHEN length(t) > 2000 THEN 'too_long' WHEN regexp_matches(lower(t), '" + "|".join(G.TRANSIENT) + "') THEN 'transient' "
    "WHEN EXISTS (SELECT 1 FROM documents s WHERE s.lang = l.lang AND trim(s.text) = l.t AND s.doc_id IN (SELECT doc_id FROM labels)) THEN 'duplicate' ELSE 'keep' END AS verdict FROM (SELECT doc_id, lang, trim(COALESCE(text, '')) AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) l",
    "recall_gate": f"WITH c AS (SELECT conv_id, turn, string_split(terms, ' ') AS w FROM ({KNOWLEDGE['content_terms']}) q), h AS (SELECT conv_id, 1.0::DOUBLE / (1 + turn) AS s, {', '.join(f'{g} AS h{k}' for k, g in enumerate(_GATE))} FROM c), "
    "e AS (SELECT *, (h0 + h1) / 2.0::DOUBLE AS cover FROM h), g AS (SELECT conv_id, COUNT(*) FILTER (WHERE cover >= 0.5) AS eligible, SUM(s) FILTER (WHERE cover >= 0.5) AS total, SUM(s * ln(s)) FILTER (WHERE cover >= 0.5) AS slog, SUM(s * cover) FILTER (WHERE cover >= 0.5) AS support, "
    "(COALESCE(MAX(h0), 0) + COALESCE(MAX(h1), 0)) / 2.0::DOUBLE AS coverage FROM e GROUP BY conv_id), "
    "n AS (SELECT *, CASE WHEN eligible > 1 THEN greatest(0, least(1, (ln(total) - slog / total) / ln(eligible))) ELSE 0.0::DOUBLE END AS entropy FROM g), u AS (SELECT *, entropy * (1 - COALESCE(support / total, 0)) AS doubt FROM n) "
    "SELECT conv_id, eligible, ROUND(coverage, 6) AS coverage, ROUND(entropy, 6) AS entropy, ROUND(doubt, 6) AS uncertainty, eligible > 0 AND doubt <= 0.35 AND coverage >= 0.6 AS passes FROM u",
    "cluster_survivors": f"SELECT cluster, arg_max(id, o) AS survivor FROM (SELECT cluster, id, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY (greatest(score, 0) + 1) * (1 - r * 1.0::DOUBLE / n), -r) AS o FROM (SELECT {_K} AS cluster, event_id AS id, value AS score, "
    f"ROW_NUMBER() OVER (PARTITION BY {_K} ORDER BY ts DESC, event_id) - 1 AS r, COUNT(*) OVER (PARTITION BY {_K}) AS n FROM events) t) u GROUP BY cluster",
    "recent_sessions": "SELECT * FROM (SELECT user_id AS session, MIN(ts) AS started, COUNT(*) AS queries FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) t WHERE queries > 1",
    "retrieval_metrics": f"WITH {_RANKED}, g AS ({_OTHER('click')}) SELECT g.user_id, ROUND(COUNT(*) FILTER (WHERE r <= 2) * 1.0::DOUBLE / COUNT(*), 6) AS recall_at_2, CAST(COALESCE(MIN(r), 9) <= 2 AS INT) AS hit_at_2, "
    "ROUND(COUNT(*) FILTER (WHERE r <= 4) * 1.0::DOUBLE / COUNT(*), 6) AS recall_at_4, CAST(COALESCE(MIN(r), 9) <= 4 AS INT) AS hit_at_4, ROUND(COALESCE(1.0::DOUBLE / MIN(r), 0), 6) AS reciprocal_rank FROM g LEFT JOIN v ON g.user_id = v.user_id AND g.id = v.id GROUP BY g.user_id",
    "stale_hits": f"WITH {_RANKED}, s AS ({_OTHER('error')}) SELECT v.user_id, MAX((s.id IS NOT NULL)::INT) AS stale_hit FROM v LEFT JOIN s ON v.user_id = s.user_id AND v.id = s.id WHERE v.r <= 4 GROUP BY v.user_id",
    "floor_percentile": "SELECT event_type, list_sort(list(value))[least(CAST(floor(0.95::DOUBLE * COUNT(*)) AS BIGINT), COUNT(*) - 1) + 1] AS percentile FROM events GROUP BY event_type",
    "turn_jaccard": f"SELECT conv_id, turn, ROUND(CASE WHEN len(list_distinct(list_concat(t, b))) > 0 THEN len(list_intersect(list_distinct(t), list_distinct(b))) * 1.0::DOUBLE / len(list_distinct(list_concat(t, b))) ELSE 0 END, 6) AS jaccard FROM (SELECT conv_id, turn, t, LAG(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {_TOK} AS t FROM conversations) x) y WHERE b IS NOT NULL",
    "rebuild_guard": "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels",
    "stage_durations": "SELECT event_type, COUNT(*) AS runs, ROUND(SUM(value), 6) AS total, ROUND(AVG(value), 6) AS mean, MAX(value) AS longest FROM events GROUP BY 1",
    "payload_ids": f"SELECT memory_id, COUNT(*) AS n FROM (SELECT unnest([{_K}, user_id]) AS memory_id FROM events) t GROUP BY 1",
    "regrets_between": "SELECT COUNT(*) AS regrets FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'",
}
