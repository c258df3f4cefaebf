"""Stems, checks, clocks, ways and merge clusters on the driver's tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import graph
from memlake.session import table
from memlake.sources import traces


def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy(T.light_stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))


def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.luhn((F.col("o_orderkey") * 7919 + 400000000000).cast("string")).alias("valid"))


def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = traces.hlc(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000"), F.col("event_id"), F.col("event_type"))
    read = traces.parse_hlc(F.col("hlc"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("hlc")).select("event_id", "hlc", read["counter"].alias("counter"), read["node"].alias("node"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("dst"))


def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "id long"), 4).select("id", "depth")


def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.trim("text").alias("claim"), F.array((F.col("doc_id") % 2).cast("double"), F.lit(1.0)).alias("embedding"))
    return graph.merge_clusters(docs.where("claim <> ''"), ["source", "lang", "claim"], [], 0.8, "doc_id")


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.content_tokens(F.col("text")), " ").alias("terms"))


def task_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(T.task_class(F.concat_ws(" why ", "role", "text")).alias("task"), "role").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (content_terms, task_classes, light_stems, luhn_check, clock_text, path_lengths, merge_clusters)}

_SUFFIX = "CASE " + " ".join(f"WHEN regexp_matches(term, '^.{{4,}}{s}$') THEN left(term, length(term) - {len(s)})" for s in T.SUFFIXES) + " ELSE term END"
_WORDS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}'" for name, words in T.TASKS.items()) + " ELSE 'feature' END"
ORACLE = {
    "content_terms": "WITH u AS (SELECT conv_id, turn, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 2) AS l FROM conversations) x), "
    f"s AS (SELECT conv_id, turn, i, {_SUFFIX} AS s FROM u WHERE NOT list_contains({_WORDS}, term)), "
    "d AS (SELECT conv_id, turn, MIN(i) AS i, CASE WHEN length(s) >= 5 AND regexp_matches(s, '[^aeiou][yi]$') THEN left(s, length(s) - 1) ELSE s END AS stem FROM s GROUP BY conv_id, turn, stem) "
    "SELECT c.conv_id, c.turn, COALESCE(string_agg(stem, ' ' ORDER BY i), '') AS terms FROM conversations c LEFT JOIN d USING (conv_id, turn) GROUP BY c.conv_id, c.turn",
    "task_classes": f"SELECT {_CLASS} AS task, role, COUNT(*) AS n FROM (SELECT role, lower(concat_ws(' why ', role, text)) AS t FROM conversations) x GROUP BY 1, 2",
    "light_stems": "SELECT CASE WHEN length(s) >= 5 AND regexp_matches(s, '[^aeiou][yi]$') THEN left(s, length(s) - 1) ELSE s END AS stem, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS terms "
    f"FROM (SELECT n, {_SUFFIX} AS s FROM (SELECT term, COUNT(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 2)) AS term FROM documents) x GROUP BY term) y) z GROUP BY 1",
    "luhn_check": "SELECT o_orderkey, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INT WHEN d[i]::INT > 4 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END)) % 10 = 0 AS valid "
    "FROM (SELECT o_orderkey, reverse(CAST(o_orderkey * 7919 + 400000000000 AS VARCHAR)) AS d FROM orders) t",
    "clock_text": "SELECT event_id, lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 13, '0') || '.' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '.' || event_type AS hlc, event_id AS counter, event_type AS node FROM events",
    "path_lengths": "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst FROM events), w AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 4) SELECT id, MIN(depth) AS depth FROM w GROUP BY id",
    "merge_clusters": "SELECT id, survivor FROM (SELECT doc_id AS id, MIN(doc_id) OVER (PARTITION BY source, lang, trim(text), doc_id % 2) AS survivor FROM documents WHERE trim(text) <> '') t WHERE id <> survivor",
}
