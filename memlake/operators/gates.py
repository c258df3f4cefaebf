"""Rules that keep, drop, weigh and choose candidates, with their parameters: column expressions and operators on any table."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.vector import cosine

#: Phrases that say that a text replaces an older one (fixed values).
CUES = ("now", "no longer", "renamed from", "switched from", "as of", "currently", "after the", "supersedes", "replaced by", "silently breaks")
#: Phrases of a lesson that soon ends (fixed values).
TRANSIENT = ("this session", "today", "just now", "for now", "temporarily", "workaround for now")
#: What a task's class multiplies in the weights before they are made to sum to 1 again (fixed values).
TASK_FACTORS = {"debug": ("freshness", 1.6), "refactor": ("scope", 1.6), "investigation": ("relevance", 1.4), "docs": ("confidence", 1.15)}
WEIGHTS = {"relevance": 0.5, "freshness": 0.2, "confidence": 0.2, "scope": 0.1}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def has_cue(text: Column, cues=CUES) -> Column:
    """Whether whole words of text, without regard to case and punctuation, hold a cue; false for null."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.coalesce(functools.reduce(operator.or_, (words.contains(f" {c} ") for c in cues)), F.lit(False))


def task_weights(kind: str, base: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """base with the weight that the task's class favours raised, summing to 1; base itself for another class."""
    if kind not in TASK_FACTORS:
        return dict(base)
    name, factor = TASK_FACTORS[kind]
    raised = {k: w * (factor if k == name else 1.0) for k, w in base.items()}
    return {k: w / sum(raised.values()) for k, w in raised.items()}


def decay(age_days: Column, half_life: float) -> Column:
    """Halves every half_life days; 1 for an unknown age, one below 0 or a half_life of 0 or less."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(F.lit(-0.6931471805599453 / half_life) * F.greatest(F.coalesce(age_days, F.lit(0.0)), F.lit(0.0)))


def resolution_score(confidence: Column, age_days: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * decay(age_days, 30.0)


def routing_gain(strength: Column, total: Column) -> Column:
    """At most 0.10 of a route's share of all strengths."""
    return F.when(total > 0, F.least(0.25 * strength / total, F.lit(0.10))).otherwise(0.0)


def route_strength(similarity: Column, cites: Column, age_days: Column) -> Column:
    return similarity * F.log1p(cites) / F.sqrt(1 + age_days)


def strip_tags(text: Column) -> Column:
    """text after a leading [tags: ...], unless nothing is left then."""
    rest = F.regexp_extract(text, r"(?s)^\s*\[tags: [^\]]*\]\s*(\S.*)$", 1)
    return F.when(rest != "", rest).otherwise(text)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc3339_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a time with its offset; null for other texts."""
    found = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]{1,6})?)(?:[Zz]|([+-])([0-9]{2}):([0-9]{2}))$"
    part = lambda k: F.regexp_extract(text, found, k)
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S] XXX"))
    shift = F.when(part(3) == "", 0).otherwise((part(4).try_cast("int") * 60 + part(5).try_cast("int")) * F.when(part(3) == "-", -1).otherwise(1))
    return F.when(text.rlike(found), F.unix_millis(local) - shift.cast("long") * 60000)


def window_days(spec: str) -> int | None:
    """Days of a window such as 7d; None for all."""
    if spec == "all":
        return None
    if not re.fullmatch(r"[0-9]+d", spec):
        raise ValueError(f"not a window: {spec}")
    return int(spec[:-1])


def term_weights(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """One row with w0, w1, ...: the inverse document frequency of each term as the beginning of a token, at least 0. One scan, one row a task.

    The pattern is tried only on texts that hold the term at all: the search for bytes is many times faster.
    """
    low = F.col("__low")
    counts = docs.select(F.lower(F.col(text)).alias("__low")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.when(low.contains(t), low.rlike(f"(^|[^a-z0-9_]){re.escape(t)}"))).alias(f"d{k}") for k, t in enumerate(terms)))
    return counts.select(*(F.greatest(F.lit(0.0), F.log((F.col("n") + 1) / (F.col(f"d{k}") + 1))).alias(f"w{k}") for k in range(len(terms))))


def weighted_coverage(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """docs with coverage: the share of the terms' weights whose term text contains; 0 where no term has a weight or text is null.

    The weights are one row of len(terms) numbers, so they are broadcast whatever docs is.
    """
    weights = term_weights(docs, terms, text)
    low = F.col("__low")
    hit = functools.reduce(operator.add, (F.when(low.contains(t), F.col(f"w{k}")).otherwise(0.0) for k, t in enumerate(terms)))
    total = functools.reduce(operator.add, (F.col(f"w{k}") for k in range(len(terms))))
    with_ = docs.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit("")))).crossJoin(F.broadcast(weights))
    return with_.withColumn("coverage", F.when(total > 1e-7, hit / total).otherwise(0.0)).drop("__low", *(f"w{k}" for k in range(len(terms))))


def semantic_floor(rows: DataFrame, floor: float, cosine: str = "cosine") -> DataFrame:
    """rows whose cosine reaches the floor or isn't known."""
    return rows.where(F.col(cosine).isNull() | (F.col(cosine) >= floor))


def abstain(rows: DataFrame, least_score: float, least_cosine: float) -> DataFrame:
    """rows(score, cosine), or none of them where the best score is below least_score or the best known cosine 0.10 or more below least_cosine."""
    best = rows.agg(F.max("score").alias("_best"), F.max("cosine").alias("_near")).where((F.col("_best") >= least_score) & F.coalesce(F.col("_near") >= least_cosine - 0.10, F.lit(True)))
    return rows.crossJoin(F.broadcast(best)).drop("_best", "_near")


def on_mounts(rows: DataFrame, mounts: set[str], scope: str = "scope") -> DataFrame:
    """rows whose scope is readable; project, repository and repo are one."""
    plain = F.when(F.col(scope).isin("project", "repository"), "repo").otherwise(F.col(scope))
    return rows.where(plain.isin(*{"repo" if m in ("project", "repository") else m for m in mounts}))


def listed(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, least: dict[str, float] | None = None, **equal) -> DataFrame:
    """A page of rows under the predicates that are given: column=value (None: not asked), least={column: bound}."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    for column, bound in (least or {}).items():
        rows = rows.where(F.col(column) >= bound)
    return rows.orderBy(*order).offset(offset).limit(limit)


def quality_gate(lessons: DataFrame, stored: DataFrame, keys: list[str], least: int = 10, most: int = 500) -> DataFrame:
    """lessons(keys..., text, lasting) with verdict: too_short, too_long, transient (unless lasting), duplicate of a stored text, or keep.

    A null text is empty. Only lessons within the lengths are compared with the stored texts, by a left semi join's key.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    low = F.translate(text, _UPPER, _LOWER)
    passing = functools.reduce(operator.or_, (low.contains(m) for m in TRANSIENT)) & ~F.coalesce(F.col("lasting"), F.lit(False))
    first = F.when(F.length(text) < least, "too_short").when(F.length(text) > most, "too_long").when(passing, "transient")
    judged = lessons.withColumn("_text", text).withColumn("_first", first)
    known = stored.select(*(F.col(k).alias(f"_{k}") for k in keys), F.trim(F.col("text")).alias("_same")).where(F.length("_same").between(least, most)).distinct().withColumn("_seen", F.lit(True))
    on = functools.reduce(operator.and_, (F.col(k) == F.col(f"_{k}") for k in keys), F.col("_text") == F.col("_same")) & F.col("_first").isNull()
    verdict = F.coalesce("_first", F.when(F.col("_seen"), "duplicate"), F.lit("keep"))
    return judged.join(known, on, "left").withColumn("verdict", verdict).drop("_text", "_first", "_same", "_seen", *(f"_{k}" for k in keys))


def recall_gate(rows: DataFrame, group: str, terms: list[str], least_row: float = 0.5, least_union: float = 0.6, most_doubt: float = 0.35) -> DataFrame:
    """group, eligible, coverage, entropy, uncertainty, passes from rows(group, score, words): whether a list answers the terms.

    words are stems; a closing e may be missing on either side. A row is eligible with a score above 0 and half of the terms. Only sums meet in a group.
    """
    def hit(t):
        return F.exists("words", lambda w: (w == t) | (w == t + "e") | (F.concat(w, F.lit("e")) == t))

    hits = [hit(t) for t in terms]
    rows = rows.select(group, "score", *(h.cast("int").alias(f"h{k}") for k, h in enumerate(hits)))
    rows = rows.withColumn("cover", functools.reduce(operator.add, (F.col(f"h{k}") for k in range(len(terms)))) / float(len(terms)))
    on = (F.col("cover") >= least_row) & (F.col("score") > 0)
    when = lambda x: F.when(on, x)
    s = F.col("score")
    found = rows.groupBy(group).agg(
        F.count_if(on).alias("eligible"), F.sum(when(s)).alias("_sum"), F.sum(when(s * F.log(s))).alias("_slog"), F.sum(when(s * F.col("cover"))).alias("_support"),
        *(F.max(when(F.col(f"h{k}"))).alias(f"u{k}") for k in range(len(terms))),
    )
    spread = F.log("_sum") - F.col("_slog") / F.col("_sum")
    entropy = F.when(F.col("eligible") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread / F.log(F.col("eligible"))))).otherwise(0.0)
    union = functools.reduce(operator.add, (F.coalesce(F.col(f"u{k}"), F.lit(0)) for k in range(len(terms)))) / float(len(terms))
    doubt = entropy * (1 - F.coalesce(F.col("_support") / F.col("_sum"), F.lit(0.0)))
    out = found.select(group, "eligible", union.alias("coverage"), entropy.alias("entropy"), doubt.alias("uncertainty"))
    return out.withColumn("passes", (F.col("eligible") > 0) & (F.col("uncertainty") <= most_doubt) & (F.col("coverage") >= least_union))


def survivors(rows: DataFrame, cluster: str) -> DataFrame:
    """(cluster, survivor) from rows(cluster, id, score, ts): the best of (max(score, 0) + 1) * (1 - rank / n), ranked by latest ts, ties by id."""
    all_ = Window.partitionBy(cluster)
    rank = F.row_number().over(all_.orderBy(F.desc_nulls_last("ts"), "id")) - 1
    value = rows.select(cluster, "id", "score", rank.alias("_rank"), F.count(F.lit(1)).over(all_).alias("_n"))
    worth = (F.greatest(F.col("score"), F.lit(0.0)) + 1.0) * (1.0 - F.col("_rank") / F.col("_n"))
    return value.groupBy(cluster).agg(F.max_by("id", F.struct(worth, -F.col("_rank"))).alias("survivor"))


def recent_sessions(log: DataFrame, session: str, ts: str, n: int) -> DataFrame:
    """(session, started, queries) of the last n sessions by first query, then without those of one query."""
    found = log.groupBy(session).agg(F.min(ts).alias("started"), F.count(F.lit(1)).alias("queries"))
    return found.orderBy(F.desc("started"), session).limit(n).where("queries > 1")


def anchor_similarity(rows: DataFrame, session: str, turn: str, embedding: str = "embedding") -> DataFrame:
    """(session, turn, similarity): cosine, within [-1, 1], of each turn to its session's first. One vector a session meets the join; AQE splits a long session."""
    first = rows.groupBy(session).agg(F.min_by(embedding, turn).alias("_anchor"))
    return rows.join(first, session).select(session, turn, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col(embedding), F.col("_anchor")))).alias("similarity"))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, query: str, ks: tuple[int, ...] = (2, 4)) -> DataFrame:
    """query, recall_at_k, hit_at_k for each k, reciprocal rank: ranked(query, id, rank) against distinct gold(query, id); queries without gold have none of them."""
    wanted = gold.select(query, "id").distinct()
    best = ranked.join(wanted, [query, "id"], "left_semi").groupBy(query).agg(*(F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks), F.min("rank").alias("_first"))
    sized = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("_gold")).join(best, query, "left")
    columns = [x for k in ks for x in ((F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.col("_gold")).alias(f"recall_at_{k}"), F.coalesce((F.col(f"_h{k}") > 0).cast("int"), F.lit(0)).alias(f"hit_at_{k}"))]
    return sized.select(query, *columns, F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


def stale_hits(ranked: DataFrame, stale: DataFrame, query: str, k: int) -> DataFrame:
    """(query, stale_hit) of every ranked query: whether one of its stale ids is among the first k."""
    seen = ranked.where(F.col("rank") <= k).join(stale.select(query, "id").distinct().withColumn("_stale", F.lit(1)), [query, "id"], "left")
    return seen.groupBy(query).agg(F.coalesce(F.max("_stale"), F.lit(0)).alias("stale_hit"))


def percentile_by_floor(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, percentile): the value at place floor(share * n), the last at most. Values are counted before the window, so only distinct ones meet in it."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_many"))
    w = Window.partitionBy(group)
    upto = counts.select(group, value, F.sum("_many").over(w.orderBy(value)).alias("_upto"), F.sum("_many").over(w).alias("_n"))
    place = F.least(F.floor(F.lit(share) * F.col("_n")), F.col("_n") - 1)
    return upto.where(F.col("_upto") > place).groupBy(group).agg(F.min(value).alias("percentile"))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; 0 where both are empty."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(0.0)


def lost_ids(before: DataFrame, after: DataFrame, id_: str = "id") -> DataFrame:
    """Ids that a rebuild has lost; a rebuild may only replace a table where this is empty."""
    return before.select(id_).distinct().join(after.select(id_), id_, "left_anti")


def stage_durations(spans: DataFrame, stage: str, took: str) -> DataFrame:
    return spans.groupBy(stage).agg(F.count(F.lit(1)).alias("runs"), F.sum(took).alias("total"), F.avg(took).alias("mean"), F.max(took).alias("longest"))


def json_ids(payload: Column, path: str = "$.memory_ids") -> Column:
    """The array of numbers at a path of a JSON text."""
    return F.from_json(F.get_json_object(payload, path), "array<bigint>")


def words_of(text: Column) -> Column:
    return T.content_tokens(text)
