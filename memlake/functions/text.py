"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token constants of saved work per memory kind (fixed values).
SAVED_TOKENS = {"failure_pattern": 1500, "command": 400, "convention": 300, "fact": 500, "preference": 200}
#: Weight of a memory's scope in ranking (fixed values).
SCOPE_WEIGHT = {"run": 1.0, "repo": 0.9, "project": 0.7, "session": 0.7, "skill": 0.7, "user": 0.5, "org": 0.5}
#: Weight of a memory's origin (fixed values).
TRUST = {"local": 1.0, "derived": 1.0, "distilled": 0.95, "remote": 0.9, "pack": 0.85}
#: Named secrets and personal data by pattern (fixed values of public formats).
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "password": r"password=[0-9A-Za-z]+",
    "token": r"token = \"[0-9a-f]+\"",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}


def map_of(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def normalise_memory(text: Column) -> Column:
    """Trimmed, without closing . ! ? ; :, white space folded, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"[.!?;:]+$", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of [a-z0-9_] of two or more characters, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) >= 2)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")) * 1.33)


def preview(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def tags(text: Column) -> Column:
    """Sorted distinct lower-case tags of a leading [tags: a, b]."""
    inside = F.regexp_extract(text, r"^\[tags:([^\]]*)\]", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(inside, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def redact(text: Column) -> Column:
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), "áéíóúüñ", "aeiouun")


def scope_weight(scope: Column) -> Column:
    return F.coalesce(map_of(SCOPE_WEIGHT)[scope], F.lit(0.3))


def trust(origin: Column) -> Column:
    return F.coalesce(map_of(TRUST)[origin], F.lit(1.0))


#: Suffixes of the light stemmer, the first that leaves four characters goes (fixed values).
SUFFIXES = ("ing", "ed", "es", "s")


def light_stem(token: Column) -> Column:
    """token without its suffix, then without a closing y or i that follows a consonant where five characters or more are left."""
    stem = token
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        stem = F.when(token.endswith(suffix) & (F.length(token) >= n + 4), F.left(token, F.length(token) - n)).otherwise(stem)
    closing = (F.length(stem) >= 5) & stem.rlike("[^aeiou][yi]$")
    return F.when(closing, F.left(stem, F.length(stem) - 1)).otherwise(stem)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; false for an empty string or one with other characters."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(from_right, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.when(digits.rlike("^[0-9]+$"), total % 10 == 0).otherwise(F.lit(False))


#: Words that say nothing about a topic (fixed values).
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "your", "with", "this", "that", "these", "those", "from", "into", "about", "what", "whats",
    "which", "who", "whom", "how", "why", "when", "where", "can", "could", "would", "should", "will", "shall", "does", "did", "was", "were", "been",
    "being", "have", "has", "had", "its", "it", "is", "as", "at", "by", "of", "to", "in", "on", "or", "an", "be", "do", "me", "my", "we", "us", "our",
    "im", "ive", "let", "lets", "please", "tell", "give", "show", "want", "need", "get", "got", "use", "using", "there", "their", "they", "them",
    "then", "than", "some", "any", "all", "more", "most", "such", "via", "per", "during", "while", "until", "unless", "before", "after", "again",
    "against", "above", "below", "between", "through", "under", "over", "because", "also", "just", "only", "very", "much", "many", "each", "both",
    "same", "other", "another", "always", "never", "still", "even", "ever", "every", "first", "found", "thing", "things", "value", "default", "if",
    "so", "up", "out", "off", "down", "no", "yes",
)
#: Classes of a task by the words it contains, the first class that has one; "feature" without any (fixed values).
TASKS = {
    "debug": ("fix", "bug", "error", "fail", "crash", "panic", "regression", "broken", "debug", "stack trace", "exception"),
    "investigation": ("investigate", "analyze", "understand", " why ", "explore", "find out", "root cause", "audit", "trace"),
    "refactor": ("refactor", "rename", "cleanup", "clean up", "restructure", "simplify", "extract", "deduplicate", "reorganize"),
    "docs": ("document", "readme", "changelog", "comment", "docstring", "docs", "tutorial", "guide"),
}


def content_tokens(text: Column) -> Column:
    """Distinct stems of the tokens that are no stopwords, in order."""
    kept = F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, light_stem))


def task_class(task: Column) -> Column:
    """The class of a task's text; null for null."""
    low, found = F.lower(task), F.lit("feature")
    for name, words in reversed(TASKS.items()):
        found = F.when(low.rlike("|".join(words)), name).otherwise(found)
    return F.when(task.isNotNull(), found)
