"""Whether a text holds the value that a question asks for: a check of forms on columns, no model of meaning.

Only direct questions for one known attribute, or for one key in backticks, are judged; all others keep whatever rows they have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.facts import folded
from memlake.session import partitions, written

SMALL = 8 << 20  # bytes of judged pairs that are sent to all tasks; more are joined

#: Attributes: the words that ask for one, the form in which a text gives it (fixed values). The first two are secrets.
ATTRIBUTES = {
    "password": (r"\b(?:password|passphrase|contrasena)\b", r"""\b(?:password|passphrase|contrasena)\s*(?:is|es|=|:)\s*[`"']?([a-z0-9_+./-]+)"""),
    "encryption_key": (r"\b(?:encryption key|clave de cifrado|clave de encriptacion)\b", r"""\b(?:encryption key|clave de cifrado|clave de encriptacion)\s*(?:is|es|=|:)\s*[`"']?([a-z0-9_+./-]+)"""),
    "version": (r"\b(?:version|release number)\b", r"\b(?:version|release)\s*(?:is\s+|es\s+|=\s*|:\s*)?v?\d+(?:\.\d+)*\b"),
    "replicas": (r"\b(?:replica|replicas)\b", r"\b(?:\d+\s+(?:production\s+)?replicas?|replicas?\s*(?:count\s*)?(?:is\s+|are\s+|son\s+|=\s*|:\s*)?\d+)\b"),
    "retention": (
        r"\b(?:retention|retencion)\b|\b(?:days|dias|weeks|semanas)\b.*\b(?:keep|kept|retain\w*|conserv\w*)\b|\bhow long\b.*\b(?:keep|kept|retain\w*)\b",
        r"\b(?:retention|retencion|retained|retain|keep|kept|conserv\w*)\b[^.;\n]{0,64}\b\d+\s*(?:seconds?|segundos?|minutes?|minutos?|hours?|horas?|days?|dias?|weeks?|semanas?|months?|meses|years?|anos?)\b",
    ),
    "port": (r"\b(?:port|puerto)\b", r"\b(?:port|puerto)\s*(?:is\s+|es\s+|=\s*|:\s*)?\d{1,5}\b"),
    "timeout": (r"\b(?:timeout|tiempo de espera)\b", r"\b(?:timeout|tiempo de espera)\s*(?:is\s+|es\s+|=\s*|:\s*)?\d+(?:\.\d+)?\s*(?:ms|s|seconds?|segundos?|minutes?|minutos?)\b"),
    "retries": (r"\b(?:retries|retry count|reintentos)\b", r"\b(?:retries|retry count|reintentos)\s*(?:is\s+|are\s+|son\s+|=\s*|:\s*)?\d+\b|\b\d+\s+(?:retries|reintentos)\b"),
    "memory_limit": (r"\b(?:memory limit|limite de memoria)\b", r"\b(?:memory limit|limite de memoria)\s*(?:is\s+|es\s+|=\s*|:\s*)?\d+\s*(?:kib|mib|gib|kb|mb|gb|bytes)\b"),
}
SECRETS = ("password", "encryption_key")
KEY_VALUE = r"""\b([a-z_][a-z0-9_.-]*)`?\s*(?:=|:)\s*[`"']?([a-z0-9_+./-]+)"""
NONE_NEEDED = r"\b(?:no password (?:is )?required|password (?:is )?not required|no (?:se )?requiere contrasena)\b"
NEGATED = r"\b(?:not|never|no|nunca|sin|isn't|isnt|don't|doesn't)\b"
#: Beginnings of questions, those of questions for a key's value, and words of questions for advice (fixed values).
STARTS = ("what ", "what's ", "which ", "how many ", "how much ", "how long ", "que ", "cual ", "cuantos ", "cuantas ", "cuanto ", "tell me ", "dime ")
KEY_STARTS = ("what is ", "what's ", "cual es ", "que valor ")
ADVICE = ("should", "could", "would", "deberia", "debo")
#: Words after an attribute that make it another thing, and the plain words before it (fixed values).
OTHER_THING = ("control", "hashing", "policy", "rotation", "conflict", "file", "algorithm", "management")
PLAIN = (
    "what", "what's", "which", "is", "are", "the", "a", "an", "how", "many", "much", "long", "que", "cual", "es", "la", "el", "cuantos", "cuantas", "cuanto", "tell", "me", "dime", "current", "configured", "required",
    "authentication", "request", "tcp", "http", "database", "db", "sqlite", "postgresql", "postgres", "gateway", "client", "server", "listener", "worker", "memory", "production", "staging", "backup", "log", "logs", "base",
    "de", "datos", "del",
)
#: Components; a clause must name each that the question names (fixed values).
COMPONENTS = (
    r"\b(?:database|db|base de datos|sqlite|postgresql|postgres)\b", r"\b(?:gateway|puerta de enlace)\b", r"\b(?:client|cliente)\b", r"\b(?:server|servidor|listener)\b", r"\b(?:logs?|registros)\b",
    r"\b(?:backups?|copias de seguridad)\b", r"\b(?:workers?|trabajadores)\b", r"\bsqlite\b", r"\b(?:postgres|postgresql)\b", r"\bopenssl\b", r"\bredis\b", r"\bpython\b", r"\bnode\b", r"\brust\b",
)
#: Words of clauses that state nothing, and words that are no value of a secret or key (fixed values).
UNSTATED = ("example", "ejemplo", "hypothetical", "hipotetic", "unknown", "redacted", "not configured", "not installed", "no longer")
NO_VALUE = (
    "unknown", "redacted", "missing", "unavailable", "not", "stored", "configured", "required", "managed", "generated", "hidden", "provided", "set", "secret", "desconocida", "desconocido", "configurada", "configurado",
)


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def asked(rows: DataFrame, question: str) -> DataFrame:
    """rows with __asked: struct(kind, key, components) of a question that is judged, else null. kind is an attribute or "key"; components are patterns."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    q, names = F.regexp_replace(folded(F.col(question)), r"^[¿ \t\n]+", ""), F.transform(F.filter(words(F.col(question)), lambda w: w.rlike(r"^\p{Lu}")), folded)
    out = rows.withColumns({"__q": q, "__names": names})
    q, ticks = F.col("__q"), F.length("__q") - F.length(F.replace("__q", F.lit("`")))
    out = out.withColumns({"__ticks": ticks, "__key": F.get(F.split(q, "`"), F.lit(1)), "__kinds": F.filter(F.array(*(F.when(q.rlike(a), F.lit(k)) for k, (a, _) in ATTRIBUTES.items())), lambda k: k.isNotNull())})
    kind, forms = F.when(F.size("__kinds") == 1, F.get("__kinds", F.lit(0))), F.create_map(*(F.lit(x) for k, (a, _) in ATTRIBUTES.items() for x in (k, rf"^([\s\S]*?)(?:{a})([\s\S]*)$")))
    out = out.withColumn("__form", F.element_at(forms, kind))
    out = out.withColumns({"__before": words(F.call_function("regexp_extract", q, F.col("__form"), F.lit(1))), "__after": F.ltrim(F.call_function("regexp_extract", q, F.col("__form"), F.lit(2)))})
    direct = _any(q.startswith(s) for s in STARTS) & ~F.exists(words(q), lambda w: w.isin(*ADVICE))
    is_key = (F.col("__ticks") == 2) & F.col("__key").rlike(r"^[a-z0-9_.-]+$") & F.col("__key").rlike("[._]")
    plain = F.forall("__before", lambda w: w.isin(*PLAIN) | F.array_contains("__names", w)) & ~_any(F.col("__after").startswith(s) for s in OTHER_THING)
    other = ~direct | (F.col("__ticks") > 0) & ((F.col("__ticks") != 2) | ~_any(q.startswith(s) for s in KEY_STARTS))
    out = out.withColumn("__kind", F.when(other, None).when(is_key, "key").when(plain, kind))
    components = F.filter(F.array(*(F.when(q.rlike(c), F.lit(c)) for c in COMPONENTS)), lambda c: c.isNotNull())
    judged = F.struct(F.col("__kind").alias("kind"), F.when(F.col("__kind") == "key", F.col("__key")).alias("key"), components.alias("components"))
    return out.withColumn("__asked", F.when(F.col("__kind").isNotNull(), judged)).drop("__q", "__names", "__ticks", "__key", "__kinds", "__form", "__before", "__after", "__kind")


def stated(text: Column) -> Column:
    """The folded text without a leading `scope:kind - ` and [tags], and with a semicolon for each full stop before white space."""
    body = F.regexp_replace(F.regexp_replace(folded(text), r"^[^ ]*:[^ ]* - ", ""), r"^(?:\[[^\]]*+\]\s*+)++", "")
    return F.regexp_replace(F.translate(body, "\u0001\u0002", "  "), r"\.(\s)", ";$1")


def clauses(body: Column, value: Column | str) -> Column:
    """Clauses of a stated text, parted at semicolons, commas and line ends outside what the pattern `value` matches."""
    pieces = F.split(F.regexp_replace(body, value, F.lit("\u0001$0\u0002")), "[\u0001\u0002]")
    whole = F.array_join(F.transform(pieces, lambda x, k: F.when(k % 2 == 1, F.translate(x, ";,\n", "   ")).otherwise(x)), "")
    return F.split(whole, "[;,\n]")


def evidence(rows: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """rows with a column `evidence`: value_present, missing_value, or unrecognized for a question that is not judged.

    A clause counts if it gives the value in the attribute's form, names every component that the question names, and is neither negated nor
    unstated; of secrets and keys the value must be a real one. That no password is required answers a question for one. A null question
    isn't judged; a null or empty text holds no value. Matches that lie in one clause share its words. Rows stay as they are, repeated
    ones too; a column `evidence` that they have is replaced. Each different pair of question and text is judged once, dealt over all
    tasks, and joined back to its rows.
    """
    plain = rows.drop("evidence")
    pairs = plain.select(F.col(question).alias("__question"), F.col(text).alias("__text")).distinct()
    dealt = pairs.repartition(partitions(rows.sparkSession), "__question", "__text").sortWithinPartitions("__question")  # of one question the patterns are compiled once
    judged = written(_judged(dealt, "__question", "__text"), "evidence")
    size = judged.agg(F.sum(F.coalesce(F.octet_length("__question"), F.lit(0)) + F.coalesce(F.octet_length("__text"), F.lit(0)) + 64)).first()[0] or 0
    same = F.col(question).eqNullSafe(F.col("__question")) & F.col(text).eqNullSafe(F.col("__text"))
    return plain.join(F.broadcast(judged) if size <= SMALL else judged, same).drop("__question", "__text")


def _judged(rows: DataFrame, question: str, text: str) -> DataFrame:
    forms = F.create_map(*(F.lit(x) for k, (_, v) in {**ATTRIBUTES, "key": ("", KEY_VALUE)}.items() for x in (k, v)))
    a, parts = F.col("__asked"), F.col("__clauses")
    form = F.element_at(forms, a["kind"])
    sound = lambda c: ~_any(c.contains(w) for w in UNSTATED) & F.forall(a["components"], lambda p: F.regexp_like(c, p))
    real = lambda v: ~F.rtrim(v, F.lit(".")).isin(*NO_VALUE)
    pairs = lambda c: F.arrays_zip(F.regexp_extract_all(c, F.lit(KEY_VALUE), 1).alias("k"), F.regexp_extract_all(c, F.lit(KEY_VALUE), 2).alias("v"))
    given = lambda c: (
        F.when(a["kind"] == "key", F.exists(pairs(c), lambda x: (x["k"] == a["key"]) & real(x["v"])))
        .when(a["kind"].isin(*SECRETS), F.exists(F.regexp_extract_all(c, F.when(a["kind"].isin(*SECRETS), form).otherwise("()"), 1), real))
        .otherwise(F.regexp_like(c, form))
    )
    body = F.coalesce(stated(F.col(text)), F.lit(""))
    told = F.exists(parts, lambda c: given(c) & sound(c) & ~c.rlike(NEGATED))
    not_needed = (a["kind"] == "password") & F.exists(clauses(F.col("__body"), F.lit(NONE_NEEDED)), lambda c: c.rlike(NONE_NEEDED) & sound(c))
    judged = asked(rows, question).withColumn("__body", F.when(F.col("__asked").isNotNull(), body))
    judged = judged.withColumn("__clauses", clauses(F.col("__body"), form))
    return judged.withColumn("evidence", F.when(a.isNull(), "unrecognized").when(told | not_needed, "value_present").otherwise("missing_value")).drop("__asked", "__body", "__clauses")


def guarded(rows: DataFrame, bundle: str = "bundle", question: str = "question", text: str = "text", tokens: str = "tokens", score: str = "score") -> DataFrame:
    """(bundle, kept, excluded, used_tokens, top_score, skipped) of bundles whose rows lacking the asked value are dropped.

    used_tokens and top_score are of the rows kept, 0 without one; a top_score is never negative. One partial aggregation by bundle.
    """
    keep = F.col("evidence") != "missing_value"
    out = evidence(rows, question, text).groupBy(F.col(bundle).alias("bundle")).agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("excluded"), F.coalesce(F.sum(F.when(keep, F.col(tokens))), F.lit(0)).cast("long").alias("used_tokens"),
        F.greatest(F.coalesce(F.max(F.when(keep, F.col(score))), F.lit(0.0)), F.lit(0.0)).alias("top_score"),
    )
    return out.withColumn("skipped", F.col("kept") == 0)
