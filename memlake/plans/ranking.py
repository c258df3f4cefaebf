"""Ranking, text, graph and fold queries by the DataFrame operators, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import communities, graph, postings, rank, temporal, vector_index
from memlake.session import file_stamp, table, work_dir

QUERY = ["thatin", "ononst", "hehely"]
_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 2)"
_BM25 = f"""
t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents),
s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS avgdl FROM t),
p AS (SELECT id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM t CROSS JOIN (VALUES ('thatin'), ('ononst'), ('hehely')) AS q(term)),
df AS (SELECT term, COUNT(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
bm AS (SELECT p.id, SUM(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM p JOIN df USING (term) CROSS JOIN s WHERE p.id IN (SELECT id FROM p WHERE tf > 0) GROUP BY p.id),
b AS (SELECT id, ROUND(score, 6) AS score FROM bm ORDER BY ROUND(score, 6) DESC, id LIMIT 80)"""
_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_VEC = f"v AS (SELECT a.vec_id AS id, ROUND({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY 2 DESC, 1 LIMIT 80)"


_kept: dict[tuple[str, str, str], str] = {}


def _kept_table(spark, d, table_name: str, build) -> str:
    """The folder of an index over one table, built at its first use in this application and again once the table's files change."""
    source = table(spark, d, table_name)
    key = spark.sparkContext.applicationId, build.__name__, file_stamp(source)
    if key not in _kept:
        path = work_dir(spark, build.__name__)
        build(spark, path, source)
        _kept[key] = path
    return _kept[key]


def _build_postings(spark, path: str, docs: DataFrame) -> None:
    postings.append(spark, path, docs, "first")


def _index(spark, d) -> str:
    return _kept_table(spark, d, "documents", _build_postings)


def _bm(spark, d) -> DataFrame:
    return postings.bm25(spark, _index(spark, d), QUERY).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(80)


def postings_by_bucket(spark, d):
    """The size of each bucket of the kept index: distinct terms, postings and tokens."""
    p = postings.postings(spark, _index(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return p.groupBy(F.substring("term", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("tokens"))


def _build_vectors(spark, path: str, vectors: DataFrame) -> None:
    vector_index.build(spark, path, vectors)


def _vec(spark, d) -> DataFrame:
    """The 80 nearest vectors to vector 0, from the kept index, with every cell that could hold one of them."""
    path = _kept_table(spark, d, "embeddings", _build_vectors)
    asked = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return vector_index.search(spark, path, asked[0] if asked else [0.0], 80, exact=True).withColumnRenamed("cosine", "score")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm(spark, d).orderBy(F.desc("score"), "id").limit(20)


def bm25_prefix_topk(spark, d):
    return postings.bm25(spark, _index(spark, d), ["thatin", "onon"], prefix=True).select("id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def vector_topk(spark, d):
    return _vec(spark, d).orderBy(F.desc("score"), "id").limit(20)


def rrf_fusion(spark, d):
    return rank.rrf([_bm(spark, d), _vec(spark, d)]).select("id", F.round("score", 6).alias("score"))


def hybrid_linear(spark, d):
    return rank.union_max([_bm(spark, d), _vec(spark, d)]).select("id", F.round("score", 6).alias("score"))


def hybrid_blend(spark, d):
    b, v = _bm(spark, d).withColumnRenamed("score", "b"), _vec(spark, d).withColumnRenamed("score", "v")
    raw = 0.5 * F.coalesce("b", F.lit(0.0)) + F.when(F.col("v").isNotNull(), 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") + 1) / 2))).otherwise(0.5 * F.coalesce("b", F.lit(0.0)))
    return b.join(v, "id", "full_outer").select("id", F.round(raw, 6).alias("raw"))


def normalize_per_kind(spark, d):
    kinds = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    joined = _bm(spark, d).withColumnRenamed("score", "raw").join(kinds, "id")
    return rank.normalise(joined, "kind").select("id", "kind", F.round("relevance", 6).alias("relevance"))


def weighted_score(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"))
    n = rank.normalise(_bm(spark, d).withColumnRenamed("score", "raw"))
    scope = F.coalesce(T.map_of({"src1": 1.0, "src2": 0.9})[F.col("scope")], F.lit(0.3))
    return n.join(docs, "id").select("id", F.round(0.5 * F.col("relevance") + 0.2 * rank.freshness((F.col("id") % 365).cast("double")) + 0.2 * 0.7 + 0.1 * scope, 6).alias("score"))


def usefulness_boost(spark, d):
    m = _bm(spark, d)
    factor = rank.usefulness_multiplier((F.col("id") % 41 - 20).cast("double"), (F.col("id") % 97).cast("double"))
    return m.select("id", F.round(rank.boosted(F.col("score"), factor), 6).alias("score"))


def lexical_coverage(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    n = sum(F.contains("t", F.lit(q)).cast("int") for q in QUERY)
    return docs.select("id", F.round(n / 3.0, 6).alias("coverage")).where("coverage > 0")


def normalize_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", T.normalise_memory(F.col("text")).alias("norm"))
    return docs.groupBy("lang", F.md5("norm").alias("norm_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


def redact_tally(spark, d):
    return table(spark, d, "documents").agg(*(F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(k) for k, p in T.SECRETS.items()))


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"), T.preview(F.col("text")).alias("preview"))


def tag_parser(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("[tags: B, a ,"), "lang", F.lit("] "), F.col("source")).alias("t"))
    return docs.select("doc_id", F.array_join(T.tags(F.col("t")), ",").alias("tags"))


def accent_folding(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("folded_md5"))


def document_frequency(spark, d):
    """Every term, from the kept index."""
    return postings.document_frequencies(spark, _index(spark, d))


def conflict_scan(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    pairs = communities.close_pairs(e, ["label"], 0.349999)  # a cosine just below the bound may round up to it
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("cosine", 6).alias("cosine")).where("cosine >= 0.35")


def session_drift(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", (F.length("text") % 100 / 100.0).alias("similarity"))
    return temporal.drift(c, 0.6)


def confidence_ema(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select(F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("memory_id"), F.col("event_id").alias("seq"), (F.col("value") >= 50).cast("double").alias("target"))
    return temporal.confidence(e).select("memory_id", F.round("confidence", 6).alias("confidence"))


def supersede_winner(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").select(F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("loser"), F.col("user_id").alias("survivor"), F.col("event_id").alias("clock"))
    return temporal.winners(e)


def latest_episode(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("identity"), "event_id", "value")
    return temporal.latest(e, ["repo", "identity"], ["event_id"])


def _edges(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("src"), (F.regexp_extract("props", "([0-9]+)", 1).cast("long") + 1000).alias("dst"))


def bfs_two_hop(spark, d):
    return graph.bfs(_edges(spark, d), spark.createDataFrame([(1,)], "id long"), 2, 12)


def degree_centrality(spark, d):
    return graph.degree_centrality(_edges(spark, d)).select("id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


def connected_components(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("a"), F.expr("doc_id - doc_id % 7").alias("b"))
    return graph.connected_components(e)


def _clicks(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("entity"), "event_id")


def shared_entities(spark, d):
    """The links of all clicks."""
    return graph.shared_entity_edges(_clicks(spark, d))


def budget_pack(spark, d):
    p = _bm(spark, d).select(F.lit(1).cast("long").alias("query_id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.estimate_tokens(F.col("text")).alias("cost"))
    out = rank.pack_budget(p.join(docs, "id"), 3000)
    return out.select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "used")


def mmr_rerank(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("kind"))
    return rank.mmr(_vec(spark, d).join(e, "id").withColumn("query_id", F.lit(0).cast("long")))


def context_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The flagship read: BM25 and vector candidates fused, scored, diversified and packed into a token budget."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("scope"), T.preview(F.col("text")).alias("summary"), T.estimate_tokens(F.col("text")).alias("cost"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    fused = rank.rrf([_bm(spark, d), _vec(spark, d)]).join(docs, "id").join(vectors, "id", "left")
    raw = fused.withColumn("raw", F.col("score")).drop("score")
    scored = rank.normalise(raw).withColumn("score", F.round(0.7 * F.col("relevance") + 0.3 * rank.freshness((F.col("id") % 365).cast("double")), 6))
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    chosen = rank.mmr(scored.select(F.lit(0).cast("long").alias("query_id"), "id", "kind", "score", F.coalesce("embedding", zero).alias("embedding")))
    packed = rank.pack_budget(chosen.withColumnRenamed("position", "rank").join(docs.select("id", "cost"), "id"), 3000)
    return packed.select(F.posexplode("ids").alias("position", "id")).join(docs, "id").select("position", "id", "kind", "scope", "summary", "cost").orderBy("position")


_NORM = "lower(regexp_replace(regexp_replace(trim(text), '[.!?;:]+$', ''), '\\s+', ' ', 'g'))"


def _nested(pairs: dict) -> str:
    out = "text"
    for kind, pattern in pairs.items():
        p = pattern.replace('\\"', '"')
        out = f"regexp_replace({out}, '{p}', '[REDACTED:{kind}]', 'g')"
    return out


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_EST = "CAST(ceil(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda t: t <> '')) * 1.33) AS BIGINT)"
_E = f"ed AS (SELECT user_id AS src, {_K} + 1000 AS dst FROM events WHERE event_type = 'purchase')"

_PREFIX = f"""
t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents),
s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS avgdl FROM t),
p AS (SELECT id, len(t) AS dl, q.term, len(list_filter(t, lambda x: starts_with(x, q.term))) AS tf FROM t CROSS JOIN (VALUES ('thatin'), ('onon')) AS q(term)),
df AS (SELECT term, COUNT(*) AS df FROM p WHERE tf > 0 GROUP BY term)"""
_GREEDY = f"""
r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM b),
c AS (SELECT r.r, r.id, CAST(ceil(len(list_filter(string_split_regex(trim(d.text), '\\s+'), lambda t: t <> '')) * 1.33) AS BIGINT) AS cost FROM r JOIN documents d ON d.doc_id = r.id),
g AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, []::BIGINT[] AS ids UNION ALL SELECT c.r, CASE WHEN g.used + c.cost <= 3000 THEN g.used + c.cost ELSE g.used END, CASE WHEN g.used + c.cost <= 3000 THEN list_append(g.ids, c.id) ELSE g.ids END FROM g JOIN c ON c.r = g.r + 1)"""
ORACLE: dict[str, str] = {
    "postings_by_bucket": f"SELECT substring(term, 1, 1) AS initial, COUNT(*) AS terms, CAST(SUM(df) AS BIGINT) AS postings, CAST(SUM(cf) AS BIGINT) AS tokens FROM (SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) t GROUP BY term) x GROUP BY 1",
    "bm25_prefix_topk": f"WITH {_PREFIX} SELECT id, ROUND(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS score FROM p JOIN df USING (term) CROSS JOIN s WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20",
    "budget_pack": f"WITH RECURSIVE {_BM25}, {_GREEDY} SELECT 1::BIGINT AS query_id, array_to_string(ids, ',') AS ids, used FROM g ORDER BY r DESC LIMIT 1",
    "bm25_topk": f"WITH {_BM25} SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20",
    "vector_topk": f"WITH {_VEC} SELECT id, score FROM v ORDER BY score DESC, id LIMIT 20",
    "rrf_fusion": f"WITH {_BM25}, {_VEC}, r AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM b UNION ALL SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM v), f AS (SELECT id, SUM(1.0 / (60 + r)) AS raw FROM r GROUP BY id) SELECT id, ROUND(raw / (SELECT MAX(raw) FROM f), 6) AS score FROM f",
    "hybrid_linear": f"WITH {_BM25}, {_VEC} SELECT id, ROUND(MAX(score), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM v) t GROUP BY id",
    "hybrid_blend": f"WITH {_BM25}, {_VEC} SELECT COALESCE(b.id, v.id) AS id, ROUND(0.5 * COALESCE(b.score, 0) + CASE WHEN v.score IS NOT NULL THEN 0.5 * greatest(0, least(1, (v.score + 1) / 2)) ELSE 0.5 * COALESCE(b.score, 0) END, 6) AS raw FROM b FULL OUTER JOIN v ON b.id = v.id",
    "normalize_per_kind": f"WITH {_BM25} SELECT b.id, d.lang AS kind, ROUND(b.score / MAX(b.score) OVER (PARTITION BY d.lang), 6) AS relevance FROM b JOIN documents d ON b.id = d.doc_id",
    "weighted_score": f"WITH {_BM25} SELECT b.id, ROUND(0.5 * b.score / (SELECT MAX(score) FROM b) + 0.2 * exp(-ln(2) * (b.id % 365) / 30.0) + 0.2 * 0.7 + 0.1 * CASE d.source WHEN 'src1' THEN 1.0 WHEN 'src2' THEN 0.9 ELSE 0.3 END, 6) AS score FROM b JOIN documents d ON b.id = d.doc_id",
    "lexical_coverage": "SELECT * FROM (SELECT doc_id AS id, ROUND((contains(lower(text), 'thatin')::INT + contains(lower(text), 'ononst')::INT + contains(lower(text), 'hehely')::INT) / 3.0, 6) AS coverage FROM documents) t WHERE coverage > 0",
    "usefulness_boost": f"WITH {_BM25}, f AS (SELECT id, score, 1 + greatest(-1, least(1, (id % 41 - 20) * 1.0::DOUBLE / greatest(id % 97, 1))) * 0.5 * least((id % 97) / 3.0, 1.0) AS m FROM b) SELECT id, ROUND(CASE WHEN m <= 1 THEN score * m ELSE least(score * m, score + 0.10) END, 6) AS score FROM f",
    "normalize_dedup": f"SELECT lang, md5({_NORM}) AS norm_md5, MIN(doc_id) AS doc_id, COUNT(*) AS n FROM documents GROUP BY 1, 2",
    "redact_secrets": f"SELECT doc_id, md5({_nested(T.SECRETS)}) AS redacted_md5 FROM documents",
    "redact_tally": "SELECT " + ", ".join("CAST(SUM(len(regexp_extract_all(text, '" + p.replace('\\"', '"') + f"'))) AS BIGINT) AS {k}" for k, p in T.SECRETS.items()) + " FROM documents",
    "token_estimate": f"SELECT doc_id, {_EST} AS tokens, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END AS preview FROM documents",
    "tag_parser": "SELECT doc_id, array_to_string(list_sort(list_distinct(['a', 'b', lang])), ',') AS tags FROM documents",
    "accent_folding": "SELECT doc_id, md5(translate(lower(text), 'áéíóúüñ', 'aeiouun')) AS folded_md5 FROM documents",
    "document_frequency": f"SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) t GROUP BY term",
    "conflict_scan": f"SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, ROUND({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) t WHERE cosine >= 0.35",
    "session_drift": "WITH s AS (SELECT conv_id AS session, turn, length(text) % 100 / 100.0 AS sim, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), l AS (SELECT *, n - ROW_NUMBER() OVER (PARTITION BY session ORDER BY turn) AS island FROM s WHERE n > 1 AND sim < 0.6) SELECT session, MIN(at_) AS drift_at FROM (SELECT session, island, MIN(turn) AS at_ FROM l GROUP BY 1, 2 HAVING COUNT(*) >= 3) t GROUP BY session",
    "confidence_ema": f"SELECT memory_id, ROUND(list_reduce(list_prepend(0.5::DOUBLE, list(t ORDER BY event_id)), lambda c, x: greatest(0.1, least(0.99, c + (x - c) * 0.05))), 6) AS confidence FROM (SELECT {_K} AS memory_id, event_id, CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS t FROM events WHERE event_type = 'click') e GROUP BY memory_id",
    "supersede_winner": f"SELECT loser, arg_max(survivor, clock) AS survivor, COUNT(DISTINCT survivor) > 1 AS conflict FROM (SELECT {_K} AS loser, user_id AS survivor, event_id AS clock FROM events WHERE event_type = 'signup') t GROUP BY loser",
    "latest_episode": "SELECT user_id AS repo, event_type AS identity, MAX(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "bfs_two_hop": f"WITH {_E}, u AS (SELECT src AS x, dst AS y FROM ed UNION SELECT dst, src FROM ed), h1 AS (SELECT DISTINCT y AS id FROM u WHERE x = 1 AND y <> 1), h2 AS (SELECT DISTINCT u.y AS id FROM u JOIN h1 ON u.x = h1.id WHERE u.y <> 1 AND u.y NOT IN (SELECT id FROM h1)) SELECT id, hop FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) t ORDER BY hop, id LIMIT 12",
    "degree_centrality": f"WITH {_E} SELECT id, CAST(SUM(i) AS BIGINT) AS in_degree, CAST(SUM(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM ed UNION ALL SELECT dst, 1, 0 FROM ed) t GROUP BY id",
    "connected_components": "SELECT doc_id AS id, doc_id - doc_id % 7 AS component FROM documents WHERE doc_id % 7 <> 0 UNION SELECT doc_id - doc_id % 7, doc_id - doc_id % 7 FROM documents WHERE doc_id % 7 <> 0",
    "shared_entities": f"WITH e AS (SELECT DISTINCT user_id AS id, {_K} AS entity FROM events WHERE event_type = 'click'), r AS (SELECT * FROM e WHERE entity IN (SELECT entity FROM e GROUP BY entity HAVING COUNT(*) BETWEEN 2 AND 32)), p AS (SELECT x.id AS src, y.id AS dst, COUNT(*) AS shared FROM r x JOIN r y ON x.entity = y.entity AND x.id < y.id GROUP BY 1, 2 HAVING COUNT(*) >= 2) SELECT src, dst, shared FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY shared DESC, dst) AS n FROM p) t WHERE n <= 8",
}

QUERIES = {
    f.__name__: f
    for f in (
        postings_by_bucket, bm25_topk, bm25_prefix_topk, vector_topk, rrf_fusion, hybrid_linear, hybrid_blend, normalize_per_kind, weighted_score, usefulness_boost, lexical_coverage, normalize_dedup, redact_secrets,
        redact_tally, token_estimate, tag_parser, accent_folding, document_frequency, conflict_scan, session_drift, confidence_ema, supersede_winner, latest_episode, bfs_two_hop, degree_centrality,
        connected_components, shared_entities, budget_pack, mmr_rerank, context_bundle,
    )
}
QUERIES |= {"document_frequency_all": document_frequency, "shared_entities_all": shared_entities}  # older names
ORACLE |= {"document_frequency_all": ORACLE["document_frequency"], "shared_entities_all": ORACLE["shared_entities"]}
