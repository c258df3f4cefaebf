"""Queries of facts and of what they answer, over texts made of the driver's parts and suppliers, with SQL that parses the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import answerability as B
from memlake.operators import facts as A
from memlake.session import partitions, table

_UNIT = "concat('unit', p_size)"
_ENV = "CASE p_partkey % 3 WHEN 0 THEN 'production ' WHEN 1 THEN 'staging ' ELSE '' END"
_TEXT = f"""concat('The ', {_UNIT}, ' ', {_ENV}, 'gateway port is ', 7000 + p_partkey % 2, '. ', {_UNIT}, ' timeout: ', CASE WHEN p_partkey % 2 = 0 THEN '90 seconds' ELSE '1.5 minutes' END, '; ', {_UNIT}, ' replicas ', p_partkey % 7, '. ',
{_UNIT}, ' memory limit = ', p_partkey % 4, ' MB, perhaps. ', {_UNIT}, ' cache.', p_partkey % 5, ' = x', CASE WHEN p_partkey % 11 = 0 THEN ' for example' ELSE '' END)"""
_QUERY = "concat('What is the Unit', s_suppkey % 50, CASE s_suppkey % 3 WHEN 0 THEN '''s production' WHEN 1 THEN ' staging' ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN ' gateway port and version?' ELSE ' timeout, replicas?' END)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts made of a part's key and size: few bytes a row that take long to read, so they are dealt over all tasks first."""
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(partitions(spark), "p_partkey")
    return parts.select(F.col("p_partkey").alias("id"), F.expr(_TEXT).alias("text"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return A.facts(_texts(spark, d)).select("id", "ordinal", "subject", "attribute", "value", "environment", F.md5("evidence").alias("evidence_md5"))


def fact_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's question, answered by the facts of all parts' texts."""
    asked = A.requests(table(spark, d, "supplier").select("s_suppkey").repartition(partitions(spark), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.expr(_QUERY).alias("query")))
    out = A.assess(asked, A.facts(_texts(spark, d)), listed=False)
    names = lambda c: F.array_join(c, ",")
    return out.select("id", "status", names(F.transform("supported", lambda s: F.concat(s["attribute"], F.lit("="), s["value"], F.lit("/"), s["sources"]))).alias("supported"), names(F.col("missing")).alias("missing"), names(F.col("conflicting")).alias("conflicting"))


#: Questions by a supplier's key and texts by a part's, with both kinds of each rule among them.
_QUESTIONS = (
    "What is the gateway password?", "¿Cuál es la contraseña?", "Which Orchid version is required?", "How many replicas run in production?", "How long are logs kept?", "What is the server port?", "What is the database timeout?",
    "What is `cache.max_entries`?", "What should the port be?", "What are the port and the password?", "What version control system do we use?", "Tell me the memory limit", "What is the encryption key?", "Why does the test hang?",
)
_SAID = (
    "The gateway password is ab-12. Server port 80", "No password is required, the contraseña es unknown", "[tags: a, b] orchid version v1.2.3; not the server port 81", "Production runs 4 replicas and the memory limit = 512 MiB",
    "Logs are retained, by rule, for 12 days. Gateway timeout is 30 seconds, the database stores state", "repo:fact - The database timeout is 1.5 minutes. cache.max_entries = 200", "For example the encryption key = zz9. cache.max_entries: unknown",
    "La contraseña es abc.9; clave de cifrado: k/1", "Never use server port 82. We keep backups 7 weeks", "cache.min_entries = 3, x.cache.max_entries = 4, the password: set. password=real1",
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each line item as a question of its supplier and a text of its part."""
    pick = lambda words, key: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    said = F.concat(pick(_SAID, F.col("l_partkey")), F.lit(". "), pick(_SAID, F.floor(F.col("l_partkey") / len(_SAID))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", pick(_QUESTIONS, F.col("l_suppkey")).alias("question"), said.alias("text"))


def answerability(spark: SparkSession, d: str) -> DataFrame:
    return B.evidence(_pairs(spark, d)).select("l_orderkey", "l_linenumber", "evidence")


def fact_guard(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a bundle: rows without the asked value are dropped."""
    rows = _pairs(spark, d).withColumns({"tokens": F.col("l_quantity").cast("long"), "score": F.col("l_extendedprice").cast("double")})
    return B.guarded(rows, "l_orderkey").withColumn("top_score", F.round("top_score", 2))


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _fold(c: str) -> str:
    return f"translate(lower({c}), 'áéíóúüñ', 'aeiouun')"


def _literal(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _or(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


_PLAIN_WORDS = f"string_split_regex(%s, '\\s+'), lambda x: x <> '' AND NOT list_contains({_listed(B.PLAIN)}, x)"
_EVIDENCE = rf"""
q0 AS (SELECT unnest(range({len(_QUESTIONS)})) AS n, unnest({_listed(_QUESTIONS)}) AS question),
q1 AS (SELECT *, regexp_replace({_fold('question')}, '^[¿ \t\n]+', '') AS q, list_transform(list_filter(string_split_regex(question, '\s+'), lambda x: regexp_matches(x, '^\p{{Lu}}')), lambda x: {_fold('x')}) AS names FROM q0),
q2 AS (SELECT *, {_or(f"starts_with(q, {_literal(w)})" for w in B.STARTS)} AND NOT list_has_any(string_split_regex(q, '\s+'), {_listed(B.ADVICE)}) AS direct, length(q) - length(replace(q, '`', '')) AS ticks, {_or(f"starts_with(q, {_literal(w)})" for w in B.KEY_STARTS)} AS for_key, split_part(q, '`', 2) AS key FROM q1),
ka(kind, form, value) AS (VALUES {', '.join(f"('{k}', {_literal(a)}, {_literal(v)})" for k, (a, v) in B.ATTRIBUTES.items())}),
q3 AS (SELECT n, q2.q, names, kind, form, COUNT(*) OVER (PARTITION BY n) AS many FROM q2 JOIN ka ON regexp_matches(q, form)),
q4 AS (SELECT n, kind FROM q3 WHERE many = 1 AND len(list_filter({_PLAIN_WORDS % r"regexp_extract(q, '^([\s\S]*?)(?:' || form || ')', 1)"} AND NOT list_contains(names, x))) = 0
  AND NOT {_or(rf"starts_with(ltrim(regexp_extract(q, '^[\s\S]*?(?:' || form || ')([\s\S]*)$', 1)), '{w}')" for w in B.OTHER_THING)}),
asked AS (SELECT q2.n, q, key, CASE WHEN NOT direct OR ticks > 0 AND (ticks <> 2 OR NOT for_key) THEN NULL WHEN ticks = 2 AND regexp_matches(key, '^[a-z0-9_.-]+$') AND regexp_matches(key, '[._]') THEN 'key' ELSE q4.kind END AS kind FROM q2 LEFT JOIN q4 USING (n)),
s0 AS (SELECT unnest(range({len(_SAID)})) AS n, unnest({_listed(_SAID)}) AS said),
s1 AS (SELECT a.n AS a, b.n AS b, regexp_replace(regexp_replace(regexp_replace({_fold("a.said || '. ' || b.said")}, '^[^ ]*:[^ ]* - ', ''), '^(\[[^\]]*\]\s*)+', ''), '\.(\s)', ';\1', 'g') AS body FROM s0 a, s0 b),
f AS (SELECT kind, value FROM ka UNION ALL SELECT 'key', {_literal(B.KEY_VALUE)} UNION ALL SELECT 'none', {_literal(B.NONE_NEEDED)}),
s2 AS (SELECT a, b, kind, value, string_split_regex(regexp_replace(body, '(?:' || value || ')', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS p FROM s1, f),
s3 AS (SELECT a, b, kind, value, unnest(string_split_regex(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, ';,' || chr(10), '   ') ELSE x END), ''), '[;,\n]')) AS c FROM s2),
s4 AS (SELECT * FROM s3 WHERE regexp_matches(c, value) AND NOT regexp_matches(c, '{'|'.join(B.UNSTATED)}') AND (kind = 'none' OR NOT regexp_matches(c, {_literal(B.NEGATED)}))),
g AS (SELECT a, b, CASE kind WHEN 'none' THEN 'password' ELSE kind END AS kind, c, kind = 'none' OR kind NOT IN ('key', 'password', 'encryption_key') AS free, CASE WHEN kind = 'key' THEN regexp_extract_all(c, value, 1) END AS ks, CASE WHEN kind IN ('password', 'encryption_key') THEN regexp_extract_all(c, value, 1) WHEN kind = 'key' THEN regexp_extract_all(c, value, 2) END AS vs FROM s4),
h AS (SELECT n, a, b, bool_or((free OR len(list_filter(list_zip(COALESCE(ks, vs), vs), lambda z: (ks IS NULL OR z[1] = key) AND NOT list_contains({_listed(B.NO_VALUE)}, regexp_replace(z[2], '\.+$', '')))) > 0)
  AND {' AND '.join(f"(NOT regexp_matches(q, {_literal(c)}) OR regexp_matches(c, {_literal(c)}))" for c in B.COMPONENTS)}) AS present FROM g JOIN asked USING (kind) GROUP BY ALL),
e AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN asked.kind IS NULL THEN 'unrecognized' WHEN COALESCE(present, FALSE) THEN 'value_present' ELSE 'missing_value' END AS evidence
  FROM lineitem JOIN asked ON asked.n = l_suppkey % {len(_QUESTIONS)} LEFT JOIN h ON h.n = asked.n AND h.a = l_partkey % {len(_SAID)} AND h.b = (l_partkey // {len(_SAID)}) % {len(_SAID)})"""
_FACTS = f"""
t AS (SELECT p_partkey AS id, {_TEXT} AS text FROM part),
l AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(text, '\\n', chr(10) || chr(1), 'g'), '\\.(\\s|\\z)', '.' || chr(1) || '\\1', 'g'), chr(1)), lambda s: NOT contains(s, ',')) AS l FROM t WHERE NOT regexp_matches({_fold('text')}, '{'|'.join(A.EXAMPLES)}')),
c AS (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM l),
u AS (SELECT id, k, string_split(regexp_replace(s, ';', ';' || chr(1), 'g'), chr(1)) AS s FROM c),
e AS (SELECT id, k * 1000 + generate_subscripts(s, 1) AS n, trim(unnest(s)) AS evidence FROM u),
b AS (SELECT id, n, evidence, trim(regexp_replace(evidence, '[.,;]+$', '')) AS body FROM e WHERE NOT regexp_matches({_fold('evidence')}, '{'|'.join(A.PROVISIONAL)}')),
m AS ({' UNION ALL '.join(f"SELECT id, n, evidence, {o} AS o, '{name}' AS kind, regexp_extract(body, {_literal(A.clause_pattern(name))}, 1) AS subject, regexp_extract(body, {_literal(A.clause_pattern(name))}, 2) AS word, regexp_extract(body, {_literal(A.clause_pattern(name))}, 3) AS value FROM b WHERE regexp_matches(body, {_literal(A.clause_pattern(name))})" for o, name in enumerate(A.ATTRIBUTES))}),
w AS (SELECT *, list_filter(list_transform(string_split_regex({_fold('subject')}, '\\s+'), lambda x: regexp_replace(x, '''s$', '')), lambda x: x <> '' AND NOT list_contains({_listed(A.ARTICLES)}, x)) AS words FROM m WHERE NOT list_contains({_listed(A.NO_VALUE)}, {_fold('value')}) AND (kind <> 'port' OR value::INT <= 65535)),
x AS (SELECT *, list_filter(words, lambda x: list_contains({_listed(A.ENVIRONMENTS)}, x)) AS env, list_filter(words, lambda x: NOT list_contains({_listed(A.ENVIRONMENTS)}, x)) AS rest FROM w),
g AS (SELECT * FROM x WHERE len(env) <= 1 AND len(rest) BETWEEN 1 AND 8 AND len(list_filter(rest, lambda x: NOT regexp_matches(x, '^[\\p{{L}}\\p{{N}}_-]{{1,48}}$') OR list_contains({_listed(A.NO_SUBJECT)}, x))) = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY id, n ORDER BY o) = 1),
f AS (SELECT id, (ROW_NUMBER() OVER (PARTITION BY id ORDER BY n) - 1)::INTEGER AS ordinal, array_to_string(rest, ' ') AS subject, CASE kind WHEN 'literal' THEN {_fold('word')} ELSE kind END AS attribute, CASE WHEN kind IN ('password', 'encryption_key', 'literal') THEN value ELSE regexp_replace({_fold('value')}, '\\s+', ' ', 'g') END AS value, env[1] AS environment, evidence FROM g)"""
ORACLE: dict[str, str] = {
    "facts": f"WITH {_FACTS} SELECT id, ordinal, subject, attribute, value, environment, md5(evidence) AS evidence_md5 FROM f",
    "fact_assessment": f"""WITH {_FACTS},
a AS (SELECT s_suppkey AS id, 'unit' || (s_suppkey % 50) || CASE WHEN s_suppkey % 2 = 0 THEN ' gateway' ELSE '' END AS subject, CASE s_suppkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' END AS environment, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['port', 'version'] ELSE ['timeout', 'replicas'] END) AS attribute, unnest([0, 1]) AS n FROM supplier),
k AS (SELECT a.id, a.n, a.attribute, COUNT(DISTINCT CASE WHEN f.attribute = 'timeout' THEN (split_part(f.value, ' ', 1)::DOUBLE * CASE WHEN f.value LIKE '%min%' THEN 60 ELSE 1 END)::VARCHAR ELSE f.value END) AS keys, MIN(f.value) AS value, COUNT(DISTINCT f.id) AS sources FROM a LEFT JOIN f ON f.subject = a.subject AND f.environment IS NOT DISTINCT FROM a.environment AND f.attribute = a.attribute GROUP BY ALL),
r AS (SELECT id, COALESCE(string_agg(attribute || '=' || value || '/' || sources, ',' ORDER BY n) FILTER (WHERE keys = 1), '') AS supported, COALESCE(string_agg(attribute, ',' ORDER BY n) FILTER (WHERE keys = 0), '') AS missing, COALESCE(string_agg(attribute, ',' ORDER BY n) FILTER (WHERE keys > 1), '') AS conflicting FROM k GROUP BY id)
SELECT id, CASE WHEN conflicting <> '' THEN 'conflicting' WHEN supported = '' THEN 'missing' WHEN missing = '' THEN 'supported' ELSE 'partial' END AS status, supported, missing, conflicting FROM r""",
    "answerability": f"WITH {_EVIDENCE} SELECT l_orderkey, l_linenumber, evidence FROM e",
    "fact_guard": f"""WITH {_EVIDENCE} SELECT l_orderkey AS bundle, COUNT(*) FILTER (WHERE evidence <> 'missing_value') AS kept, COUNT(*) FILTER (WHERE evidence = 'missing_value') AS excluded, COALESCE(SUM(l_quantity::BIGINT) FILTER (WHERE evidence <> 'missing_value'), 0)::BIGINT AS used_tokens,
ROUND(COALESCE(MAX(l_extendedprice::DOUBLE) FILTER (WHERE evidence <> 'missing_value'), 0.0), 2) AS top_score, COUNT(*) FILTER (WHERE evidence <> 'missing_value') = 0 AS skipped FROM e GROUP BY l_orderkey""",
}
QUERIES = {f.__name__: f for f in (facts, fact_assessment, answerability, fact_guard)}
