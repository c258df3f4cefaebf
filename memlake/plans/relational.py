"""Analytics, joins, set and temporal queries over the event log and the memory tables, as SQL.

The model on the driver's tables: documents are memories (source: scope, lang: kind), events the log (user_id: run, k in props: memory;
view: served, click: cited, purchase: accepted, error: failed or regretted, signup: superseded), conversations the sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.operators import temporal
from memlake.plans.sqlpair import dialect, spark_query
from memlake.session import table

CITED = "SELECT user_id AS run_id, $K<<props>> AS memory_id, ts, value, event_id FROM events WHERE event_type = 'click'"
MEM = "SELECT doc_id AS memory_id, source AS scope, lang AS kind, text, n_chars, doc_id % 97 AS use_count, (doc_id % 41) - 20 AS score, doc_id % 365 AS age_days FROM documents"
WEIGHT = "CASE kind WHEN 'en' THEN 500 WHEN 'fr' THEN 1500 WHEN 'de' THEN 400 WHEN 'es' THEN 300 ELSE 200 END"

SQL: dict[str, str] = {
    # sources, filters
    "events_causal_order": "SELECT event_id, user_id, $L<<ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)>> AS seq FROM events",
    "trace_dedup": "SELECT event_id, MIN(ts) AS first_ts, $L<<COUNT(*)>> AS copies FROM (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts FROM events WHERE event_id % 3 = 0) t GROUP BY event_id",
    "sync_export_since": "SELECT event_id, event_type, user_id, value FROM events WHERE event_id > 5000 AND event_type IN ('click', 'purchase')",
    "sync_import_new": "SELECT e.event_id, e.event_type FROM events e LEFT JOIN (SELECT event_id AS seen FROM events WHERE event_id % 2 = 0) s ON e.event_id = s.seen WHERE s.seen IS NULL",
    "pack_export_tally": "SELECT lang AS kind, source AS scope, $L<<COUNT(*)>> AS n, $L<<SUM(CASE WHEN $MATCHES<<text||[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+>> THEN 1 ELSE 0 END)>> AS with_email FROM documents GROUP BY lang, source",
    "pack_import_merge": "SELECT MIN(doc_id) AS doc_id, $L<<COUNT(*)>> AS merged FROM documents GROUP BY lang, LOWER($REPL<<TRIM(text)||[ \\t\\n\\r]+|| >>)",
    "proposal_routing": "SELECT event_id, CASE WHEN value >= 200 THEN 'accept' WHEN value >= 70 THEN 'propose' ELSE 'reject' END AS route FROM events WHERE event_type = 'purchase'",
    "repo_files": "SELECT page_id, $L<<LENGTH(html)>> AS size, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN $HAS<<url||/fr/>> THEN 'fr' WHEN $HAS<<url||/de/>> THEN 'de' WHEN $HAS<<url||/es/>> THEN 'es' ELSE 'en' END AS language FROM pages",
    "secret_path_filter": "SELECT page_id FROM pages WHERE NOT $MATCHES<<LOWER(url)||([.]env|[.]pem|[.]key|id_rsa)>>",
    "telemetry_trim": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' OR event_type = 'purchase'",
    "list_memories_page": "SELECT doc_id, source, lang FROM documents WHERE LOWER(source) = 'src3' ORDER BY doc_id DESC LIMIT 20 OFFSET 5",
    "active_predicate": "SELECT lang AS kind, $L<<COUNT(*)>> AS active FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 GROUP BY lang",
    "live_window": "SELECT memory_id FROM (SELECT doc_id AS memory_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 30 END AS valid_from, CASE WHEN doc_id % 5 = 0 THEN doc_id % 40 END AS valid_to FROM documents WHERE doc_id % 11 <> 0) m WHERE COALESCE(valid_from <= 15, TRUE) AND COALESCE(valid_to > 15, TRUE)",
    "prune_candidates": f"SELECT memory_id, $R<<score * 1.0 / use_count>> AS ratio FROM ({MEM}) m WHERE use_count >= 3 AND score * 1.0 / use_count <= -0.2",
    "forget_candidates": f"SELECT memory_id FROM ({MEM}) m WHERE kind NOT IN ('de') AND use_count > 0 AND (use_count < 10 OR score < 0) AND score * 1.0 / use_count <= -0.1 AND age_days > 90",
    "scope_alias": "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'repo' ELSE source END AS label FROM documents",
    # joins
    "silent_passengers": f"SELECT DISTINCT v.user_id AS run_id, v.memory_id FROM (SELECT user_id, $K<<props>> AS memory_id FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT DISTINCT run_id, memory_id FROM ({CITED}) c) c ON v.user_id = c.run_id AND v.memory_id = c.memory_id WHERE c.run_id IS NULL",
    "co_citation": f"SELECT a.memory_id AS a, b.memory_id AS b, $L<<COUNT(DISTINCT a.run_id)>> AS runs FROM (SELECT DISTINCT run_id, memory_id FROM ({CITED}) x) a JOIN (SELECT DISTINCT run_id, memory_id FROM ({CITED}) y) b ON a.run_id = b.run_id AND a.memory_id < b.memory_id GROUP BY a.memory_id, b.memory_id HAVING COUNT(DISTINCT a.run_id) >= 2",
    "cited_with_run_start": f"SELECT c.run_id, c.memory_id, c.event_id FROM ({CITED}) c LEFT JOIN (SELECT user_id, MIN(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY user_id) r ON c.run_id = r.user_id WHERE r.started_at >= TIMESTAMP '2024-01-02 00:00:00' OR (r.started_at IS NULL AND c.ts >= TIMESTAMP '2024-01-02 00:00:00')",
    "two_left_joins": "SELECT e.event_id, n.lang AS new_kind, o.lang AS old_kind FROM (SELECT event_id, $K<<props>> AS new_id, event_id % 150 AS old_id FROM events WHERE event_type = 'signup') e LEFT JOIN documents n ON e.new_id = n.doc_id LEFT JOIN documents o ON e.old_id = o.doc_id",
    "exists_after": f"SELECT v.event_id, COALESCE(c.last_cited >= v.ts, FALSE) AS useful FROM (SELECT event_id, ts, $K<<props>> AS memory_id FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT memory_id, MAX(ts) AS last_cited FROM ({CITED}) x GROUP BY memory_id) c ON v.memory_id = c.memory_id",
    "interval_join_roi": f"SELECT s.user_id, $L<<COUNT(c.event_id)>> AS cited FROM (SELECT user_id, MIN(ts) AS lo, MAX(ts) AS hi FROM events WHERE event_type = 'view' GROUP BY user_id) s JOIN ({CITED}) c ON s.user_id = c.run_id AND c.ts BETWEEN s.lo AND s.hi GROUP BY s.user_id",
    "benchmark_containment": "SELECT b.item_id, $L<<COUNT(d.doc_id)>> AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id",
    "paired_modes": "SELECT a.user_id, a.m AS off_value, b.m AS on_value, $R<<b.m - a.m>> AS gain FROM (SELECT user_id, $R<<AVG(value)>> AS m FROM events WHERE event_type = 'view' GROUP BY user_id) a JOIN (SELECT user_id, $R<<AVG(value)>> AS m FROM events WHERE event_type = 'click' GROUP BY user_id) b ON a.user_id = b.user_id",
    "skill_staleness": "SELECT p.user_id AS proposal, MAX(CASE WHEN d.doc_id IS NULL OR d.doc_id % 11 = 0 THEN 1 ELSE 0 END) = 1 AS stale FROM (SELECT DISTINCT user_id, $K<<props>> AS memory_id FROM events WHERE event_type = 'purchase') p LEFT JOIN documents d ON p.memory_id = d.doc_id GROUP BY p.user_id",
    # aggregation
    "insights_retrieval": "SELECT $L<<COUNT(*)>> AS served, $L<<SUM(CASE WHEN value >= 50 THEN 1 ELSE 0 END)>> AS with_hit, $R<<SUM(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) / COUNT(*)>> AS hit_rate, $R<<AVG(value)>> AS avg_top FROM events WHERE event_type = 'view'",
    "insights_proposals": "SELECT status, $L<<COUNT(*)>> AS n FROM (SELECT CASE WHEN value >= 200 THEN 'accepted' WHEN value >= 70 THEN 'pending' ELSE 'rejected' END AS status FROM events WHERE event_type = 'purchase') t GROUP BY status",
    "insights_corpus": "SELECT source AS scope, lang AS kind, $L<<COUNT(*)>> AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))",
    "insights_harvest": "SELECT CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS origin, $L<<COUNT(*)>> AS n, $R<<COUNT(*) * 1.0 / COUNT(DISTINCT user_id)>> AS per_run FROM events GROUP BY 1",
    "usefulness_trend": f"SELECT $L<<SUM(score)>> AS total, $R<<AVG(CASE WHEN use_count > 0 THEN score * 1.0 / use_count END)>> AS mean_ratio FROM ({MEM}) m",
    "citation_rate": "SELECT $R<<COUNT(DISTINCT CASE WHEN event_type = 'click' THEN $K<<props>> END) * 1.0 / COUNT(DISTINCT CASE WHEN event_type = 'view' THEN $K<<props>> END)>> AS rate FROM events",
    "token_economy": "SELECT $R<<AVG(value)>> AS avg_tokens, $R<<SUM(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) / COUNT(*)>> AS skip_rate FROM events WHERE event_type IN ('view', 'click')",
    "roi_report": f"SELECT kind, $L<<COUNT(*)>> AS citations, $L<<COUNT(*) * MAX({WEIGHT})>> AS saved_tokens, $R<<COUNT(*) * MAX({WEIGHT}) * 3.0 / 1000000>> AS usd FROM ({CITED}) c JOIN ({MEM}) m ON c.memory_id = m.memory_id GROUP BY kind",
    "per_memory_roi": f"SELECT memory_id, n, $L<<n * {WEIGHT}>> AS saved FROM (SELECT c.memory_id, m.kind, $L<<COUNT(*)>> AS n FROM ({CITED}) c JOIN ({MEM}) m ON c.memory_id = m.memory_id GROUP BY c.memory_id, m.kind ORDER BY 3 DESC, 1 LIMIT 25) t ORDER BY saved DESC, memory_id",
    "regret_flagged": "SELECT r.memory_id, r.n FROM (SELECT $K<<props>> AS memory_id, $L<<COUNT(*)>> AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING COUNT(*) >= 5) r JOIN documents d ON r.memory_id = d.doc_id WHERE d.doc_id % 11 <> 0",
    "invalidations_by_reason": "SELECT CASE WHEN value < 10 THEN 'duplicate' WHEN value < 100 THEN 'stale' ELSE 'other' END AS reason, $L<<COUNT(*)>> AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "trust_audit": "SELECT source AS origin, $L<<COUNT(*)>> AS total, $L<<COUNT(l.doc_id)>> AS vetted, $L<<COUNT(*) - COUNT(l.doc_id)>> AS unvetted FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source",
    "write_bursts": "SELECT $L<<FLOOR($SEC<<ts>> / 3600.0)>> AS hour, $L<<COUNT(*)>> AS n FROM events GROUP BY 1 HAVING COUNT(*) >= 20",
    "route_build": f"SELECT run_id, memory_id, $L<<COUNT(*)>> AS cites, MAX(ts) AS last_cited FROM ({CITED}) c GROUP BY run_id, memory_id",
    "skill_candidates": f"SELECT memory_id, $L<<COUNT(DISTINCT run_id)>> AS runs FROM ({CITED}) c WHERE memory_id % 11 <> 0 GROUP BY memory_id HAVING COUNT(DISTINCT run_id) >= 3",
    "surface_acceptance": f"SELECT v.event_type AS surface, $L<<COUNT(*)>> AS injected, $L<<SUM(CASE WHEN c.last_cited >= v.ts THEN 1 ELSE 0 END)>> AS cited FROM (SELECT event_type, ts, $K<<props>> AS memory_id FROM events WHERE event_type IN ('view', 'signup')) v LEFT JOIN (SELECT memory_id, MAX(ts) AS last_cited FROM ({CITED}) x GROUP BY memory_id) c ON v.memory_id = c.memory_id GROUP BY v.event_type",
    "retune_trigger": "SELECT $L<<SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)>> AS regrets, $L<<SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)>> AS served, $R<<SUM(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) / NULLIF(SUM(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 0)>> AS regret_rate FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'",
    "session_bounds": "SELECT user_id, $L<<COUNT(*)>> AS n, $R<<SUM(value)>> AS tokens, MIN(ts) AS lo, MAX(ts) AS hi FROM events WHERE event_type = 'view' GROUP BY user_id",
    "citations_in_window": f"SELECT m.kind, $L<<COUNT(*)>> AS n FROM ({CITED}) c JOIN ({MEM}) m ON c.memory_id = m.memory_id WHERE c.ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY m.kind",
    "run_lifecycle": "SELECT user_id AS run_id, MIN(CASE WHEN event_type = 'signup' THEN ts END) AS started_at, MAX(CASE WHEN event_type IN ('purchase', 'error') THEN ts END) AS ended_at, $R<<SUM(value)>> AS cost FROM events GROUP BY user_id",
    "mode_summary": "SELECT event_type AS mode, $L<<COUNT(*)>> AS n, $R<<AVG(value)>> AS mean_value, $R<<MAX(value)>> AS max_value, $R<<SUM(value) / COUNT(DISTINCT user_id)>> AS per_run FROM events GROUP BY event_type",
    "outcome_counters": "SELECT event_type AS outcome, $L<<COUNT(*)>> AS n FROM events GROUP BY event_type",
    "cost_meter": "SELECT event_id, user_id, $R<<SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)>> AS spent FROM events WHERE event_type = 'purchase'",
    "rank_metrics": "SELECT user_id, $L<<MIN(r)>> AS first_gold, $R<<1.0 / MIN(r)>> AS mrr, $L<<MAX(CASE WHEN r <= 3 THEN 1 ELSE 0 END)>> AS recall_at_3 FROM (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, event_type FROM events) t WHERE event_type = 'click' GROUP BY user_id",
    "percentiles": "SELECT event_type, MAX(CASE WHEN k = CAST(ROUND(0.5 * (n - 1)) AS BIGINT) THEN value END) AS p50, MAX(CASE WHEN k = CAST(ROUND(0.95 * (n - 1)) AS BIGINT) THEN value END) AS p95 FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type",
    "policy_probability": "SELECT event_id, $R<<1.0 / (1.0 + EXP(-(20.0 * (value / 500.0) + 2.0 * (event_id % 2) - 9.0)))>> AS p FROM events WHERE event_type = 'view'",
    "policy_accuracy": "SELECT $R<<AVG(CAST(CASE WHEN (value >= 225) = (event_id % 2 = 0) THEN 1 ELSE 0 END AS DOUBLE))>> AS accuracy FROM events WHERE event_type = 'view'",
    "holdout_split": "SELECT item_id, (ROW_NUMBER() OVER (ORDER BY item_id) - 1) % 5 = 0 AS holdout FROM benchmark",
    "tune_grid": "WITH s AS (SELECT f.x AS floor_, SUM(CASE WHEN event_type = 'click' AND value >= f.x * 200 THEN 1.0 ELSE 0.0 END) / SUM(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS quality, AVG(CASE WHEN value >= f.x * 200 THEN 1.0 ELSE 0.0 END) AS share FROM events CROSS JOIN (VALUES (0.1), (0.2), (0.3), (0.4)) AS f(x) GROUP BY f.x) SELECT floor_, w.x AS weight, $R<<quality - w.x * share>> AS objective FROM s CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) AS w(x)",
    # ranking and temporal
    "top_useful": f"SELECT memory_id, $R<<score * 1.0 / use_count>> AS ratio, use_count FROM ({MEM}) m WHERE use_count > 0 ORDER BY ratio DESC, use_count DESC, memory_id LIMIT 30",
    "old_runs": "SELECT user_id FROM (SELECT user_id, MAX(ts) AS last_ts, ROW_NUMBER() OVER (ORDER BY MAX(ts) DESC, user_id) AS r FROM events GROUP BY user_id) t WHERE r > 20 AND last_ts < TIMESTAMP '2024-01-30 00:00:00'",
    "nth_run_cutoff": "SELECT MIN(started) AS cutoff FROM (SELECT user_id, MIN(ts) AS started FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 10) t",
    "stage_spans": "SELECT key_ AS run_id, prev_ts AS opened_at, ts AS closed_at FROM (SELECT user_id AS key_, ts, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts FROM events WHERE event_type IN ('view', 'purchase')) t WHERE event_type = 'purchase' AND prev_type = 'view'",
    "revision_collapse": "SELECT memory_id, $L<<COUNT(*)>> AS revisions FROM (SELECT $K<<props>> AS memory_id, event_type, LAG(event_type) OVER (PARTITION BY $K<<props>> ORDER BY ts, event_id) AS before_ FROM events) t WHERE before_ IS NULL OR before_ <> event_type GROUP BY memory_id",
    "bitemporal_revision": "SELECT memory_id, event_id AS revision, value FROM (SELECT $K<<props>> AS memory_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY $K<<props>> ORDER BY event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') t WHERE r = 1",
    "scd2": "SELECT memory_id, event_id, ts AS known_from, LEAD(ts) OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS known_to FROM (SELECT $K<<props>> AS memory_id, event_id, ts FROM events WHERE event_type = 'purchase') t",
    "as_of_snapshot": "SELECT doc_id FROM documents WHERE doc_id % 400 <= 200 AND COALESCE(CASE WHEN doc_id % 11 = 0 THEN doc_id % 300 END > 200, TRUE)",
    "belief_delta_sets": "SELECT k, SUM(side) AS side FROM (SELECT DISTINCT user_id * 1000 + $K<<props>> AS k, 1 AS side FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' UNION ALL SELECT DISTINCT user_id * 1000 + $K<<props>> AS k, 2 AS side FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00') t GROUP BY k HAVING SUM(side) <> 3".replace("SUM(side) AS side", "$L<<SUM(side)>> AS side"),
    "citation_upsert": "SELECT run_id, memory_id, value FROM (SELECT user_id AS run_id, $K<<props>> AS memory_id, value, ROW_NUMBER() OVER (PARTITION BY user_id, $K<<props>> ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click') t WHERE r = 1",
    "proposal_state": "SELECT memory_id, status FROM (SELECT $K<<props>> AS memory_id, event_type AS status, ROW_NUMBER() OVER (PARTITION BY $K<<props>> ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'error', 'signup')) t WHERE r = 1",
    "replay_usefulness": "SELECT memory_id, $R<<SUM(delta)>> AS usefulness FROM (SELECT $K<<props>> AS memory_id, CASE WHEN event_type = 'click' AND value >= 100 THEN 1.0 WHEN event_type = 'error' THEN -1.0 WHEN event_type = 'view' AND value < 1 THEN -0.1 ELSE 0.0 END AS delta FROM events) t GROUP BY memory_id",
    "rate_limit": "SELECT user_id, minute_, n FROM (SELECT user_id, $L<<($SEC<<ts>> - $SEC<<ts>> % 3600) / 3600>> AS minute_, $L<<COUNT(*)>> AS n FROM events GROUP BY 1, 2) t WHERE n > 2",
    "regret_within_2h": f"SELECT DISTINCT c.event_id, c.memory_id FROM ({CITED}) c JOIN (SELECT user_id, $K<<props>> AS memory_id, ts FROM events WHERE event_type = 'view' AND value < 5) d ON c.memory_id = d.memory_id AND $SEC<<c.ts>> - $SEC<<d.ts>> BETWEEN 0 AND 7200",
    "session_dedupe": "SELECT user_id, memory_id, MIN(event_id) AS first_event FROM (SELECT user_id, $K<<props>> AS memory_id, event_id FROM events WHERE event_type = 'view') t GROUP BY user_id, memory_id",
    "proposal_gc": "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'expired' WHEN value >= 400 THEN 'accepted' ELSE 'pending' END AS status FROM events WHERE event_type = 'purchase'",
    "corpus_revision": "SELECT MAX(event_id) AS revision, $L<<COUNT(*)>> AS changes FROM events WHERE event_type IN ('purchase', 'signup', 'error')",
    # relational checks on the star tables
    "pricing_summary": "SELECT l_returnflag, l_linestatus, $R<<SUM(l_quantity)>> AS qty, $R<<AVG(l_discount)>> AS disc, $L<<COUNT(*)>> AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "nation_revenue": "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}


def regret_within_2h(spark: SparkSession, d: str) -> DataFrame:
    """The SQL of this name joins all pairs of a memory before it looks at their times."""
    k, sec = dialect("$K<<props>>", 0), dialect("$SEC<<ts>>", 0)
    e = table(spark, d, "events")
    cited = e.where("event_type = 'click'").selectExpr("event_id", f"{k} AS memory_id", f"{sec} AS at")
    dropped = e.where("event_type = 'view' AND value < 5").selectExpr(f"{k} AS memory_id", f"{sec} AS at")
    return temporal.followed(cited, dropped, ["memory_id"], 7200).select("event_id", "memory_id").distinct()


QUERIES = {**{k: spark_query(v) for k, v in SQL.items()}, "regret_within_2h": regret_within_2h}
