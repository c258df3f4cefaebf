"""The queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_two_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from memlake.llm.packing import assign, tokenize_pieces
    from memlake.session import written

    pieces = written(tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json")), "pieces")
    digests = pieces.select("part", "doc_id", "piece", "start", "length", "nth", F.crc32("ids").alias("ids_crc32"))
    return assign(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from memlake.llm.token_store import store_and_read

    rows = store_and_read(table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.bloom_lm import score

    return score(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.simhash import BITS, RADIUS, fingerprints, hamming_classes
    from memlake.session import written

    def like(a: str, b: str):
        differ = sum(F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 8), 16, 10).cast("long"))) for k in range(1, BITS // 4, 8))
        return F.greatest(F.lit(0.0), F.cos(differ * (3.141592653589793 / BITS)))

    found = fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"),
    )
    rows = written(found, "fingerprint-rows")
    near = hamming_classes(rows, RADIUS).select(F.col("fingerprint").alias("f"), "n_links", F.col("component").alias("near_class"))
    return rows.join(near, F.col("fingerprint") == F.col("f")).drop("f")


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.quotes import link

    return link(table(spark, sf_dir, "conversations"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.pii import KINDS, find, listed

    count = lambda n: F.size(F.filter("base", lambda s: s["kind_no"] == n)).cast("long")
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_pair_index(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from memlake.llm.pair_index import encode_decode

    rows = encode_decode(table(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), passages=True)


def op12_source_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.source_tries import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SOURCES = f"""
WITH d AS (SELECT row_number() OVER () AS n, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT n, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING COUNT(DISTINCT n) >= 3),
v AS (SELECT lang, COUNT(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, COUNT(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT g.lang, g.source, COALESCE(SUM(c.c), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT k.lang, t.source, k.term, COALESCE(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (COALESCE(c.c, 0) + 1)) // (t.total + v.v) AS p FROM k JOIN v USING (lang) JOIN t USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.term = k.term AND c.source = t.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (a.c + 1)) // (b.total + v.v) AS q FROM (SELECT lang, term, SUM(c)::HUGEINT AS c FROM c GROUP BY lang, term) a JOIN (SELECT lang, SUM(total) AS total FROM t GROUP BY lang) b USING (lang) JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, SUM((x.p - y.p) * (x.p - y.p) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r) x WHERE part = 'pair' OR rank <= 200"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, MIN(b) AS low FROM r GROUP BY a), l AS (SELECT a, COUNT(*) AS links FROM p GROUP BY a)
SELECT e.vec_id, COALESCE(l.links, 0) AS n_links, least(e.vec_id, COALESCE(c.low, e.vec_id)) AS component_id, e.vec_id <= COALESCE(c.low, e.vec_id) AS kept FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN l ON l.a = e.vec_id"""


QUERIES = {
    "op1_bloom_lm": op1_bloom_lm,
    "op2_order_minhash": op2_order_minhash,
    "op3_simhash": op3_simhash,
    "op4_quote_links": op4_quote_links,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_pii": op6_pii,
    "op7_pair_index": op7_pair_index,
    "op9_toxicity": op9_toxicity,
    "op8_best_two_fit": op8_best_two_fit,
    "op10_token_store": op10_token_store,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_source_tries": op12_source_tries,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op5_vector_dedup": _VECTORS, "op12_source_tries": _SOURCES}
