"""Queries of supersession, components, distil clusters and the policy's data, on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import arbitration, communities, policy
from memlake.operators.gates import CUES
from memlake.session import table

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_NOTE = "CASE doc_id % 4 WHEN 0 THEN ' no longer' WHEN 1 THEN ' replaced by' ELSE '' END"
NEAR, CUED = 0.30, 0.20  # the given vectors are far apart: with the rule's own bounds the result is empty
LOW, HIGH = 0.30, 0.45


def supersession_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Pools of the texts whose vectors have one label and fall into one group of 25; every third text ends with a cue."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.substring("text", 1, 300), F.expr(_NOTE)).alias("summary"), F.expr("timestampadd(HOUR, CAST(doc_id % 50 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 250 * 100 + label").alias("query_id"), "embedding", (F.col("vec_id") % 7 / 7.0).alias("cosine"), (F.col("vec_id") % 11 / 10.0).alias("score"))
    pool = e.join(docs, "id").withColumn("kind", F.when(F.col("id") % 9 == 0, "file").otherwise("memory"))
    out = arbitration.supersession_penalty(pool, near=NEAR, near_with_cue=CUED)
    return out.select("query_id", "id", "superseded_hint", F.round("score", 6).alias("score"))


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    """Of the arcs from users to the numbers that events name, as one kind of node."""
    e = table(spark, d, "events").where("event_type = 'purchase' AND user_id < 120").select(F.expr("user_id % 120").alias("src"), F.expr(f"({_K} * 7 + user_id) % 120").alias("dst"), "event_id")
    return communities.strong_components(e.where("src % 5 <> 0 AND dst % 3 <> 1 AND src < dst + 40").select("src", "dst"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(v.alias("id"), F.col("embedding").alias("vector"), "label", F.array(tag("a", v % 2), tag("b", v % 3), F.lit("all")).alias("tags"))


def distil_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = communities.distil_clusters(_tagged(spark, d), ["label"], LOW, HIGH)
    return out.select("id", "cluster", F.array_join("shared", ",").alias("shared"))


def band_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a label with a cosine in the band."""
    pairs = communities.band_pairs(_tagged(spark, d).select("id", "vector", "label"), ["label"], LOW, HIGH)
    return pairs.select("a", "b", F.round("cosine", 5).alias("cosine"))


def labelled_examples(spark: SparkSession, d: str) -> DataFrame:
    """Each view of a memory and whether a click came later or at once."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", F.expr(f"{_K} * 200 + user_id").alias("memory_id"))
    out = policy.labelled_examples(e.where("event_type = 'view'").select("event_id", "memory_id", "ts"), e.where("event_type = 'click'").select("memory_id", F.col("ts").alias("cited_at")))
    return out.select("event_id", "useful")


def grouped_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Signups that share a user and hour, or a number and day, are of one part."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    keys = F.array(F.expr("concat('u', user_id, ' ', date_format(ts, 'yyyyMMdd HH'))"), F.expr(f"concat('k', {_K} % 100, ' ', date_format(ts, 'yyyyMMdd'))"))
    return policy.grouped_holdout(e.select(F.col("event_id").alias("case_id"), keys.alias("keys")))


def policy_fit(spark: SparkSession, d: str) -> DataFrame:
    """The policy fitted on the labelled views; features are drawn from each event's own columns."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "value", F.expr(f"{_K} * 200 + user_id").alias("memory_id"), F.expr(_K).alias("k"))
    n = lambda text: F.expr(text).cast("double")
    seen = e.where("event_type = 'view'").select("memory_id", "ts", n("least(1, floor(value / 10) / 20)").alias("score"), n("event_id % 2").alias("loop_mode"), n("k % 3 = 0").alias("is_failure_pattern"), n("k % 10 / 10").alias("novelty"), n("k % 6 / 5").alias("repeat_count"), n("event_id % 5 / 4").alias("recovery"), n("event_id % 3 / 2").alias("evidence"))
    got = policy.fit(policy.labelled_examples(seen, e.where("event_type = 'click'").select("memory_id", F.col("ts").alias("cited_at"))), epochs=12)
    rows = [*zip(policy.FEATURES, got["weights"]), ("bias", got["bias"]), ("trained_on", float(got["trained_on"]))]
    return spark.createDataFrame([(a, round(b, 6)) for a, b in rows], "name string, value double")


_COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"
_PAIRS = f"v AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings), b AS (SELECT x.id AS a, y.id AS b, {_COS.format(a='x.e', b='y.e')} AS cosine FROM v x JOIN v y ON x.label = y.label AND x.id < y.id)"
_STEM = "CASE " + " ".join(f"WHEN regexp_matches(term, '^.{{4,}}{s}$') THEN left(term, length(term) - {len(s)})" for s in T.SUFFIXES) + " ELSE term END"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_CUE = " OR ".join(f"contains(t, ' {c} ')" for c in CUES)
_REACH = "z AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, far) AS (SELECT a, b FROM z UNION SELECT r.id, z.b FROM r JOIN z ON r.far = z.a)"
ORACLE: dict[str, str] = {
    "supersession_penalty": f"""
WITH c AS (SELECT e.vec_id AS id, e.vec_id // 250 * 100 + e.label AS query_id, e.embedding AS e, e.vec_id % 7 / 7.0 AS cosine, e.vec_id % 11 / 10.0 AS score, substring(d.text, 1, 300) || {_NOTE} AS summary, d.doc_id % 50 AS hour, e.vec_id % 9 = 0 AS file FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
u AS (SELECT id, unnest(list_filter(string_split_regex(lower(summary), '[^a-z0-9_]+'), lambda t: length(t) >= 2)) AS term FROM c),
s AS (SELECT id, {_STEM} AS s FROM u WHERE NOT list_contains({_STOP}, term)),
w AS (SELECT id, list(DISTINCT CASE WHEN length(s) >= 5 AND regexp_matches(s, '[^aeiou][yi]$') THEN left(s, length(s) - 1) ELSE s END) AS words FROM s GROUP BY id),
k AS (SELECT *, {_CUE} AS cue FROM (SELECT c.*, ' ' || trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, COALESCE(words, []) AS words FROM c LEFT JOIN w USING (id) WHERE NOT file) x),
p AS (SELECT x.query_id, x.id AS x, y.id AS y, x.cue AS xc, y.cue AS yc, x.hour AS xh, y.hour AS yh, x.cosine AS xq, y.cosine AS yq, {_COS.format(a='x.e', b='y.e')} AS sim, len(list_intersect(x.words, y.words)) AS shared, least(len(x.words), len(y.words)) AS small FROM k x JOIN k y ON x.query_id = y.query_id AND x.id < y.id),
q AS (SELECT *, CASE WHEN xh = yh THEN CASE WHEN xc <> yc THEN yc END ELSE xh < yh END AS xo FROM p WHERE sim >= {NEAR} OR (xc <> yc AND (sim >= {CUED} OR (shared >= 3 AND shared / small >= 0.35)))),
g AS (SELECT DISTINCT query_id, CASE WHEN xo THEN x ELSE y END AS id FROM q WHERE xo IS NOT NULL AND (sim >= {CUED} OR (CASE WHEN xo THEN yc AND yq >= xq ELSE xc AND xq >= yq END)))
SELECT c.query_id, c.id, g.id IS NOT NULL AS superseded_hint, ROUND(c.score * CASE WHEN g.id IS NOT NULL THEN 0.8 ELSE 1 END, 6)::DOUBLE AS score FROM c LEFT JOIN g ON g.query_id = c.query_id AND g.id = c.id""",
    "strong_components": f"""
WITH RECURSIVE e AS (SELECT DISTINCT user_id % 120 AS a, ({_K} * 7 + user_id) % 120 AS b FROM events WHERE event_type = 'purchase' AND user_id < 120), l AS (SELECT * FROM e WHERE a % 5 <> 0 AND b % 3 <> 1 AND a < b + 40),
r(id, far) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a), n AS (SELECT a AS id FROM l UNION SELECT b FROM l)
SELECT n.id, least(n.id, COALESCE(MIN(x.far), n.id)) AS component FROM n LEFT JOIN (SELECT r.id, r.far FROM r JOIN r z ON z.id = r.far AND z.far = r.id) x ON x.id = n.id GROUP BY n.id""",
    "band_pairs": f"WITH {_PAIRS} SELECT a, b, ROUND(cosine, 5) AS cosine FROM b WHERE cosine BETWEEN {LOW} AND {HIGH}",
    "distil_clusters": f"""
WITH RECURSIVE {_PAIRS}, l AS (SELECT a, b FROM b WHERE cosine BETWEEN {LOW} AND {HIGH}), {_REACH},
c AS (SELECT id, MIN(far) AS cluster FROM r GROUP BY id), t AS (SELECT id, cluster, unnest(['a' || (id % 2), 'b' || (id % 3), 'all']) AS tag FROM c),
n AS (SELECT cluster, COUNT(*) AS n FROM c GROUP BY cluster HAVING COUNT(*) >= 3),
h AS (SELECT t.cluster, t.tag FROM t JOIN n USING (cluster) GROUP BY t.cluster, t.tag, n.n HAVING COUNT(*) = n.n),
s AS (SELECT cluster, string_agg(tag, ',' ORDER BY tag) AS shared FROM h GROUP BY cluster) SELECT c.id, c.cluster, s.shared FROM c JOIN s USING (cluster)""",
    "labelled_examples": f"WITH e AS (SELECT event_id, event_type, ts, {_K} * 200 + user_id AS m FROM events), c AS (SELECT m, MAX(ts) AS last FROM e WHERE event_type = 'click' GROUP BY m) SELECT event_id, COALESCE(last >= ts, false) AS useful FROM e LEFT JOIN c USING (m) WHERE event_type = 'view'",
    "grouped_holdout": f"""
WITH RECURSIVE s AS (SELECT event_id AS id, unnest(['u' || user_id || ' ' || strftime(ts, '%Y%m%d %H'), 'k' || ({_K} % 100) || ' ' || strftime(ts, '%Y%m%d')]) AS key FROM events WHERE event_type = 'signup'),
h AS (SELECT key, MIN(id) AS hub FROM s GROUP BY key), l AS (SELECT DISTINCT id AS a, hub AS b FROM s JOIN h USING (key) WHERE id <> hub), {_REACH},
p AS (SELECT s.id AS case_id, least(s.id, COALESCE(MIN(r.far), s.id)) AS part FROM (SELECT DISTINCT id FROM s) s LEFT JOIN r ON r.id = s.id GROUP BY s.id)
SELECT case_id, part, (DENSE_RANK() OVER (ORDER BY part) - 1) % 5 = 0 AS holdout FROM p""",
}
_X = ["least(1, floor(value / 10) / 20)", "event_id % 2", "(k % 3 = 0)::INT", "k % 10 / 10", "k % 6 / 5", "event_id % 5 / 4", "event_id % 3 / 2"]
_Z = " + ".join(f"w{j} * x{j}" for j in range(7)) + " + b"
_ROUNDS = ", ".join(f"r{n + 1} AS (SELECT {', '.join(f'w{j} - {policy.RATE} * (g{j} / n + {policy.PULL} * (w{j} - {policy.PRIOR_WEIGHTS[j]})) AS w{j}' for j in range(7))}, b - {policy.RATE} * (gb / n + {policy.PULL} * (b - ({policy.PRIOR_BIAS}))) AS b FROM (SELECT {', '.join(f'any_value(w{j}) AS w{j}, SUM(err * x{j}) AS g{j}' for j in range(7))}, any_value(b) AS b, SUM(err) AS gb, COUNT(*) AS n FROM (SELECT *, 1 / (1 + exp(-({_Z}))) - y AS err FROM x CROSS JOIN r{n}) t) u)" for n in range(12))
ORACLE["policy_fit"] = (
    f"WITH e AS (SELECT *, {_K} AS k FROM events), c AS (SELECT k * 200 + user_id AS m, MAX(ts) AS last FROM e WHERE event_type = 'click' GROUP BY 1), x AS (SELECT {', '.join(f'({f})::DOUBLE AS x{j}' for j, f in enumerate(_X))}, COALESCE(last >= ts, false)::INT::DOUBLE AS y FROM e LEFT JOIN c ON c.m = k * 200 + user_id WHERE event_type = 'view'), "
    f"r0 AS (SELECT {', '.join(f'{w}::DOUBLE AS w{j}' for j, w in enumerate(policy.PRIOR_WEIGHTS))}, ({policy.PRIOR_BIAS})::DOUBLE AS b), {_ROUNDS} "
    + " UNION ALL ".join([*(f"SELECT '{f}' AS name, ROUND(w{j}, 6) AS value FROM r12" for j, f in enumerate(policy.FEATURES)), "SELECT 'bias', ROUND(b, 6) FROM r12", "SELECT 'trained_on', COUNT(*)::DOUBLE FROM x"])
)
QUERIES = {f.__name__: f for f in (supersession_penalty, strong_components, band_pairs, distil_clusters, labelled_examples, grouped_holdout, policy_fit)}
