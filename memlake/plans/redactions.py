"""Redaction of texts for export, with SQL that finds, orders and cuts the same spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import redaction as R
from memlake.session import table


def redact_export(spark: SparkSession, d: str) -> DataFrame:
    """Every document as it would leave: without secrets, e-mails, ssn, phones and cards that pass Luhn; each third as key=value text."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('api_key="0123456789ab" ssn 123-45-6789 '), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    out = R.redact_texts(docs, personal=True)
    return out.select("doc_id", F.size("finds").alias("finds"), F.array_join(F.transform("finds", lambda f: f["kind"]), ",").alias("kinds"), F.md5("redacted").alias("redacted_md5"))


def redact_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation as one JSON payload, redacted leaf by leaf."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(F.concat_ws(" ", "text", F.lit("call 415-555-0132")).alias("said")).alias("body"), F.array("role").alias("roles"))).alias("payload"))
    out = c.select("conv_id", "turn", R.redact_json(F.col("payload"), personal=True).alias("p"))
    return out.select("conv_id", "turn", F.md5(F.get_json_object("p", "$.body.said")).alias("said_md5"), F.get_json_object("p", "$.roles[0]").alias("role"))


_LUHN = "list_sum(list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE CASE WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END END)) % 10 = 0"


def _spans(source: str) -> str:
    """CTEs from source(id, text) to cut(id, text, kept): all finds, then the earliest and longest that don't overlap."""
    patterns = [*((k, p, False) for k, p in R.FORMS.items()), *((k, R.assignment(*a), True) for k, a in R.ASSIGNED.items()), *((k, p, False) for k, p in R.PERSONAL.items())]
    parts = []
    for order, (kind, pattern, value) in enumerate(patterns):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT id, text, {order} AS o, '{kind}' AS kind, {f"'{p}'" if value else 'NULL'} AS p, regexp_extract_all(text, '{p}') AS ms FROM {source}")
    step = "lambda a, x: {'m': x.m, 'e': instr(substring(text, a.e), x.m) + a.e - 1 + length(x.m), 's': list_append(a.s, instr(substring(text, a.e), x.m) + a.e - 1)}"
    first = "list_prepend({'m': '', 'e': 1::BIGINT, 's': []::BIGINT[]}, list_transform(ms, lambda m: {'m': m, 'e': 1::BIGINT, 's': []::BIGINT[]}))"
    held = "COALESCE(NULLIF(regexp_extract(m, p, 1), ''), NULLIF(regexp_extract(m, p, 2), ''), regexp_extract(m, p, 3))"
    quoted = "CASE WHEN regexp_extract(m, p, 3) = '' THEN 1 ELSE 0 END"
    return f"""ms AS ({' UNION ALL '.join(parts)}),
pos AS (SELECT id, o, kind, p, ms, (list_reduce({first}, {step})).s AS s FROM ms WHERE len(ms) > 0),
f AS (SELECT id, o, kind, p, unnest(ms) AS m, unnest(s) AS s FROM pos),
v AS (SELECT id, o, kind, CASE WHEN p IS NULL THEN s ELSE s + length(m) - length({held}) - {quoted} END AS s, CASE WHEN p IS NULL THEN length(m) ELSE length({held}) END AS n FROM f WHERE kind <> 'credit_card' OR (length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN})),
l AS (SELECT id, list({{'s': s, 'e': s + n, 'k': kind, 'kept': []::STRUCT(s BIGINT, e BIGINT, k VARCHAR)[]}} ORDER BY s, n DESC, o) AS l FROM v GROUP BY id),
k AS (SELECT id, (list_reduce(list_prepend({{'s': 0::BIGINT, 'e': 1::BIGINT, 'k': '', 'kept': []::STRUCT(s BIGINT, e BIGINT, k VARCHAR)[]}}, l), lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'k': x.k, 'kept': list_append(a.kept, {{'s': x.s, 'e': x.e, 'k': x.k}})}} ELSE a END)).kept AS kept FROM l),
cut AS (SELECT d.id, d.text, COALESCE(k.kept, []) AS kept FROM {source} d LEFT JOIN k ON k.id = d.id)"""


_CUT = "CASE WHEN len(kept) = 0 THEN text ELSE substring(text, 1, kept[1].s - 1) || list_aggregate(list_transform(kept, lambda x, i: '[REDACTED:' || x.k || ']' || substring(text, x.e, CASE WHEN i = len(kept) THEN length(text) + 1 ELSE kept[i + 1].s END - x.e)), 'string_agg', '') END"
ORACLE: dict[str, str] = {
    "redact_export": f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'api_key="0123456789ab" ssn 123-45-6789 ' || COALESCE(text, '') ELSE text END AS text FROM documents), {_spans('d')}
SELECT id AS doc_id, len(kept)::INTEGER AS finds, array_to_string(list_transform(kept, lambda x: x.k), ',') AS kinds, md5({_CUT}) AS redacted_md5 FROM cut""",
    "redact_payloads": f"""WITH c AS (SELECT conv_id, turn, role, concat_ws(' ', text, 'call 415-555-0132') AS text, ROW_NUMBER() OVER () AS id FROM conversations), {_spans('c')}
SELECT c.conv_id, c.turn, md5({_CUT.replace('text', 'cut.text')}) AS said_md5, c.role FROM cut JOIN c ON c.id = cut.id""",
}
QUERIES = {f.__name__: f for f in (redact_export, redact_payloads)}
