"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base patterns give spans that always stay. High-recall generators propose further, possibly overlapping spans (numbers without
a plus sign, spelt-out addresses and numbers, cards with other separators, long IP addresses, secrets, identity numbers); boosted trees
over format and context features score them, and per-kind thresholds, calibrated on held-out examples, select. Of candidates that
overlap the one of the higher score stays. The trees are fitted with numpy on the driver from built examples (EXAMPLES of them), in
which the same forms are personal in some contexts and not in others, and become an array literal that an expression walks; no row leaves
the JVM.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = (*KINDS, "secret", "id")  # the last two have no base pattern
EXAMPLES = 2400  # bound of the built training set
PRECISION = 0.9  # least precision on the held-out half of the examples, for each kind's threshold
CONTEXT = 28  # characters before a candidate that its features read
CHUNK = 128  # matches whose places are worked out in one go

# Patterns of the contract, written so that Java's engine can't go back and forth: a run is entered at its start or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
# Generators of further candidates: (kind, pattern, a string that the text must hold or None). Repeated groups are possessive: Java matches
# greedy ones by recursion, as deep as the text is long.
MORE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", None),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++", " at "),
    ("phone", r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{2,4}\) ?|00[1-9][0-9]{0,2}[ .-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])", None),
    ("phone", rf"(?<![A-Za-z])(?i:{DIGIT}[ -]){{6,13}}+(?i:{DIGIT})(?![A-Za-z])", None),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_ -]{1,2}[0-9]{4}){3}(?![0-9])", None),
    ("ip", r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]{0,30}::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}+(?![0-9A-Za-z:])", ":"),
    ("secret", r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|key)[\"']? ?[=:] ?[\"']?[a-z0-9_.+/~!@#$%^&*-]{6,}+", None),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_+/-])", None),
    ("id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{1,2}[0-9]{6,9})(?![0-9A-Za-z-])", None),
    ("id", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", None),
)
GOOD_WORDS = {
    "email": "(mail|contact|write|reach|send)",
    "ip": "(ip|addr|host|server|login|client)",
    "card": "(card|visa|master|amex|credit|debit|pay)",
    "phone": "(phone|tel|call|fax|mobile|cell|dial|contact|whatsapp|sms)",
    "secret": "(key|token|secret|password|credential|auth|aws)",
    "id": "(ssn|social|passport|iban|licen|identity|national|tax|account)",
}
BAD_WORDS = "(order|invoice|version|isbn|ref|serial|ticket|date|page|sku|part|model|score|room|figure|table|commit|build|file)"
FEATURES = ("digits", "signs", "groups", "luhn", "good", "bad", "bracket", "size", "upper", "runs", "named")
_models: dict[str, dict] = {}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    d = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    weighed = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _found(matches: Column, between: Column) -> Column:
    """Spans (start, end, s) of regex matches and the pieces between them, in code points; worked out in chunks, as an array that grows by one is copied each time."""
    span = "array<struct<start:bigint,end:bigint,s:string>>"
    none = F.array().cast(span)

    def step(acc, i):
        s = F.element_at(matches, i)
        start = acc["pos"] + F.length(F.element_at(between, i))
        end = start + F.length(s)
        return F.struct(end.cast("long").alias("pos"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), s.alias("s")))).cast(span).alias("out"))

    def chunk(acc, k):
        begin = F.struct(F.element_at(acc, -1)["pos"].alias("pos"), none.alias("out"))
        places = F.sequence(k * CHUNK + 1, F.least((k + 1) * CHUNK, F.size(matches)))
        return F.concat(acc, F.array(F.aggregate(places, begin, step))).cast(f"array<struct<pos:bigint,out:{span}>>")

    start = F.array(F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out"))).cast(f"array<struct<pos:bigint,out:{span}>>")
    chunks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int"))
    return F.when(F.size(matches) > 0, F.aggregate(chunks, start, chunk, lambda acc: F.flatten(F.transform(acc, lambda a: a["out"])))).otherwise(none)


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.regexp_replace(p, "^0+(?=[0-9])", "").substr(1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(s))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _features(kind: str, text: Column, x: Column) -> list[Column]:
    s = x["s"]
    low = F.greatest(x["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, (low + 1).cast("int"), (x["start"] - low).cast("int")))
    digits = _digits(s)
    size = lambda pattern: F.length(F.regexp_replace(s, pattern, ""))
    return [
        F.length(digits), size("[0-9A-Za-z]"), F.size(F.split(s, "[^0-9A-Za-z]+")), F.when(luhn(digits), 1).otherwise(0),
        F.when(before.rlike(GOOD_WORDS[kind]), 1).otherwise(0), F.when(before.rlike(BAD_WORDS), 1).otherwise(0), F.when(s.rlike(r"[\[({]"), 1).otherwise(0), F.length(s),
        size("[^A-Z]"), F.size(F.split(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")), F.when(F.lower(s).rlike(f"^{GOOD_WORDS[kind]}|[.:= ](com|org|net|edu|io|info|[a-z]{{2}})$"), 1).otherwise(0),
    ]


def _with_matches(df: DataFrame, columns: dict[str, tuple[str, str | None]], text: str) -> DataFrame:
    """df with spans per name of {name: (pattern, needed string)} in its column text."""
    t = F.col(text)
    ask = {n: F.lit(True) if need is None else F.contains(t, F.lit(need)) for n, (_, need) in columns.items()}
    df = df.withColumns({f"m_{n}": F.when(ask[n], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (p, _) in columns.items()})
    df = df.withColumns({f"b_{n}": F.when(F.size(f"m_{n}") > 0, F.split(t, p, -1)) for n, (p, _) in columns.items()})
    return df.withColumns({n: _found(F.col(f"m_{n}"), F.col(f"b_{n}")) for n in columns}).drop(*(f"{x}_{n}" for n in columns for x in "mb"))


def _examples(seed: int = 7) -> list[tuple[int, str, int]]:
    """(place in MORE, text, label) built from rules.

    Both labels take the same forms; two in three are personal. A personal one mostly follows a fitting word or one that tells nothing, another
    one mostly a word of orders and versions, and one in twenty of both the wrong one. Content tells too, where it does in life: a card
    that fails Luhn's check is none, an address of twelve-hour clocks is none, a run with few changes between letters and digits is a name.
    """
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randrange(3, 9)))
    good = {"email": ["mail", "contact", "write to", "reach me:"], "ip": ["ip", "host", "client", "login from"], "card": ["card", "visa", "credit card", "pay with"], "phone": ["call", "tel", "phone", "mobile", "fax", "dial"], "secret": ["key", "token", "auth", "credential"], "id": ["ssn", "passport", "iban", "tax id", "identity"]}
    bad = ["order", "invoice", "version", "ref", "serial", "ticket", "part", "model", "page", "isbn", "file", "commit", "build"]
    spelt = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh"]

    def card(valid: bool) -> str:
        d = [int(c) for c in num(15)]
        total = sum(x if k % 2 else (2 * x) % 10 + 2 * x // 10 for k, x in enumerate(d))
        last = -total % 10
        s = "".join(map(str, d)) + str(last if valid else (last + r.randrange(1, 10)) % 10)
        return r.choice([".", "/", "  ", "_"]).join(s[k : k + 4] for k in (0, 4, 8, 12))

    def made(form: int, label: int) -> str:
        top = r.choice(["com", "org", "net", "de", "io"]) if label or r.random() < 0.4 else word()
        sep = r.choice(" .-")
        if form == 0:
            a, z, d = r.choice([(" [at] ", "", " [dot] "), ("[at]", "", "[dot]"), (" (at) ", "", "."), ("(at)", "", " (dot) "), (" {at} ", "", ".")])
            return f"{word()}{a}{word()}{z}{d}{top}"
        if form == 1:
            return f"{word()} at {word()} dot {top}"
        if form == 2:
            return r.choice([f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0044{sep}{num(4)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(3)}"])
        if form == 3:
            return r.choice(" -").join(r.choice(spelt) for _ in range(r.randrange(9, 13) if label else r.randrange(7, 13)))
        if form == 4:
            return card(bool(label) or r.random() < 0.05)
        if form == 5:
            long = r.choice([4, 4, 3]) if label else r.choice([1, 2, 2])
            parts = [hexa(long) if label else num(long) for _ in range(8)]
            return ":".join(parts) if r.random() < 0.5 else ":".join(parts[: r.randrange(1, 3)]) + "::" + ":".join(parts[:2])
        if form == 6:
            name = r.choice(["password", "token", "secret", "api_key", "pwd", "key"])
            value = r.choice([hexa(r.randrange(10, 40)), word() + num(3) + "!" + word()]) if label else r.choice([word() + word(), word() + "-" + word()])
            return name + r.choice(["=", ": ", " = "]) + r.choice(["", '"']) + value
        if form == 7:
            if label:
                return r.choice(["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "ghp_" + "".join(r.choice("abcdefghijkLMNOPQRSTUVWXYZ0123456789") for _ in range(36)), hexa(40), "sk-" + hexa(24)])
            return r.choice([word() + "-" + word() + "-" + word() + "-" + num(2), word() + "_" + word() + "_" + word() + "_v" + num(1), num(16), "report-" + num(4) + "-" + num(2) + "-" + num(2) + "-" + word()])
        if form == 8:
            return r.choice([f"{num(3)}-{num(2)}-{num(4)}", r.choice("ABCX") + num(8)])
        return r.choice(["DE", "GB", "FR"]) + num(2) + " " + " ".join(num(4) for _ in range(4 if label else 3)) + (" " + num(2) if label else "")

    out = []
    for k in range(EXAMPLES):
        form, label = k % len(MORE), int(k // len(MORE) % 3 > 0)
        kind, x = MORE[form][0], r.random()
        fitting, other = r.choice(good[kind]), r.choice(bad)
        cue = word() if x < (0.5 if label else 0.1) else (fitting if label else other) if x < 0.95 else (other if label else fitting)
        out.append((form, f"{word()} {word()}, {cue} {made(form, label)} {word()}.", label))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3) -> tuple[float, list]:
    """Logistic gradient boosting with trees of two levels: (start, [(feature, cut, left, right)]), a side being a (feature, cut, low, high) leaf pair."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f = np.full(len(y), base)
    trees = []

    def best(rows, g, h):
        found = (-1.0, 0, 0.0)
        for c in range(x.shape[1]):
            v = x[rows, c]
            for cut in np.unique(v)[:-1]:
                m = v <= cut
                a, b = g[rows][m].sum() ** 2 / (h[rows][m].sum() + 1), g[rows][~m].sum() ** 2 / (h[rows][~m].sum() + 1)
                if a + b > found[0] + 1e-12:
                    found = (a + b, c, float(cut))
        return found[1], found[2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        every = np.arange(len(y))
        c, cut = best(every, g, h)
        sides = []
        for rows in (every[x[:, c] <= cut], every[x[:, c] > cut]):
            c2, cut2 = best(rows, g, h) if len(rows) else (0, 0.0)
            low, high = rows[x[rows, c2] <= cut2], rows[x[rows, c2] > cut2]
            leaf = [rate * float(g[k].sum() / (h[k].sum() + 1)) for k in (low, high)]
            f[low] += leaf[0]
            f[high] += leaf[1]
            sides.append((c2, cut2, *leaf))
        trees.append((c, cut, *sides))
    return base, trees


def tree_score(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    """The boosted scores of rows of features."""
    f = np.full(len(x), model[0])
    side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
    for c, cut, low, high in model[1]:
        f += np.where(x[:, c] <= cut, side(low), side(high))
    return f


def tree_column(model: tuple[float, list], features: Column) -> Column:
    """The boosted score of a candidate's array of features; the trees are one constant, so that the plan stays small."""
    def leaf(side):
        return f"named_struct('c', {side[0] + 1}, 'cut', {side[1]!r}D, 'low', {side[2]!r}D, 'high', {side[3]!r}D)"

    trees = ", ".join(f"named_struct('c', {c + 1}, 'cut', {cut!r}D, 'low', {leaf(low)}, 'high', {leaf(high)})" for c, cut, low, high in model[1])
    value = lambda s: F.when(F.element_at(features, s["c"]) <= s["cut"], s["low"]).otherwise(s["high"])
    step = lambda acc, t: acc + F.when(F.element_at(features, t["c"]) <= t["cut"], value(t["low"])).otherwise(value(t["high"]))
    return F.aggregate(F.expr(f"array({trees})"), F.lit(float(model[0])), step)


def examples_found(spark: SparkSession) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind (features, labels, whether held out) of the candidates that the generators find in the built examples."""
    rows = _examples()
    values = ",".join("({},{},'{}',{})".format(k, form, text.replace("'", "''"), label) for k, (form, text, label) in enumerate(rows))
    made = spark.sql(f"SELECT * FROM VALUES {values} AS t(k, form, body, label)")
    made = _with_matches(made, {f"g{i}": (p, need) for i, (_, p, need) in enumerate(MORE)}, "body")
    def numbers(i, kind):
        mine = F.transform(f"g{i}", lambda x: F.array(*(c.cast("double") for c in _features(kind, F.col("body"), x))))
        return F.when(F.col("form") == i, mine).otherwise(F.array()).cast("array<array<double>>")

    found = F.concat(*(numbers(i, kind) for i, (kind, _, _) in enumerate(MORE)))
    got = made.select("k", "label", "form", F.explode(found).alias("f")).orderBy("k").collect()  # EXAMPLES rows
    out = {}
    for kind in dict.fromkeys(k for k, _, _ in MORE):
        mine = [r for r in got if MORE[r["form"]][0] == kind]
        out[kind] = np.array([r["f"] for r in mine]), np.array([float(r["label"]) for r in mine]), np.array([r["k"] // (3 * len(MORE)) % 2 == 1 for r in mine])
    return out


def train(spark: SparkSession) -> dict[str, tuple]:
    """Per kind (trees, threshold on the boosted score, precision, recall): fitted on half of the built examples; the other half sets the threshold, the one of the best F1 among those with PRECISION, and measures both."""
    key = spark.sparkContext.applicationId
    if key in _models:
        return _models[key]
    model = {}
    for kind, (x, y, odd) in examples_found(spark).items():
        trees = fit_trees(x[~odd], y[~odd])
        f, truth = tree_score(trees, x[odd]), y[odd]
        order = np.argsort(-f, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(truth) + 1)
        whole = 2 * np.cumsum(truth[order]) / (np.arange(1, len(truth) + 1) + truth.sum())
        last = np.append(f[order][1:] < f[order][:-1], True)
        fine = np.flatnonzero((right >= PRECISION) & last)
        at = int(fine[np.argmax(whole[fine])]) if len(fine) else -1
        model[kind] = (trees, float(f[order][at]) if len(fine) else float("inf"), float(right[at]) if len(fine) else 0.0, float(truth[order][: at + 1].sum() / truth.sum()))
    _models[key] = model
    return model


SPAN = "struct<start:bigint,kind_no:int,end:bigint>"


def _settled(entries: Column) -> Column:
    """The candidates that stay, from entries (start, kind_no, end, score; null in a base span) in that order, in one sweep: none that overlaps a base span, and of two that overlap the one of the higher score."""
    form = f"struct<out:array<{SPAN}>,held:{SPAN},score:double,base_end:bigint>"
    plain = lambda x: F.struct(x["start"], x["kind_no"], x["end"]).cast(SPAN)
    no = F.lit(None).cast(SPAN)

    def state(out, held, score, base_end):
        return F.struct(out.alias("out"), held.alias("held"), score.alias("score"), base_end.alias("base_end")).cast(form)

    def kept(acc):
        return F.when(acc["held"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))

    def step(acc, x):
        over = F.coalesce(x["start"] < acc["held"]["end"], F.lit(False))
        base = state(F.when(over, acc["out"]).otherwise(kept(acc)), no, F.lit(None).cast("double"), F.greatest(acc["base_end"], x["end"]))
        taken = state(F.when(over, acc["out"]).otherwise(kept(acc)), plain(x), x["score"], acc["base_end"])
        lost = (x["start"] < acc["base_end"]) | (over & (x["score"] <= acc["score"]))
        return F.when(x["score"].isNull(), base).when(lost, acc).otherwise(taken)

    return F.aggregate(entries, state(F.array().cast(f"array<{SPAN}>"), no, F.lit(None).cast("double"), F.lit(-1).cast("long")), step, kept)


def find(docs: DataFrame) -> DataFrame:
    """docs with base and spans, arrays of (start, kind_no, end) in that order; kind_no is the place in MORE_KINDS.

    A null text is empty and has none. Rows are independent: repeated rows give the same, null doc_ids and extra columns stay, whatever their
    names (but base and spans, which the result has itself); an empty table gives no rows.
    """
    model = train(docs.sparkSession)
    text = F.col("body")
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    df = docs.select(whole.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    df = _with_matches(df, {k: (BASE[k], NEEDS[k]) for k in KINDS} | {f"g{i}": (p, need) for i, (_, p, need) in enumerate(MORE)}, "body")

    def base_spans(kind):
        return F.transform(F.filter(kind, lambda x: _valid(kind, x["s"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end")).cast(SPAN))

    def candidates(i, kind):
        trees, least, _, _ = model[kind]
        if least == float("inf"):
            return F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,score:double>>")
        shaped = F.transform(f"g{i}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(*(c.cast("double") for c in _features(kind, text, x))).alias("f")))
        scored = F.transform(shaped, lambda x: F.struct(x["start"].alias("start"), F.lit(MORE_KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"), tree_column(trees, x["f"]).alias("score")))
        return F.filter(scored, lambda x: x["score"] >= least)

    form = "array<struct<start:bigint,kind_no:int,end:bigint,score:double>>"
    df = df.withColumn("base", F.array_sort(F.concat(*(base_spans(k) for k in KINDS))))
    df = df.withColumn("more", F.concat(*(F.when(F.size(f"g{i}") > 0, candidates(i, kind)).otherwise(F.array()).cast(form) for i, (kind, _, _) in enumerate(MORE))))
    every = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"], x["kind_no"], x["end"], F.lit(None).cast("double").alias("score"))).cast(form), "more"))
    df = df.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.concat("base", _settled(every)))).otherwise(F.col("base")))
    return df.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)), "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in MORE_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with [KIND] in place of each span; overlapping spans become one mark, the first one's."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in MORE_KINDS))

    def step(acc, s):
        piece = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        new = s["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).cast("long").alias("pos"), F.when(new, F.concat(acc["out"], F.array(piece, F.element_at(marks, s["kind_no"] + 1)))).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))), "")
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out")), step, end)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with their columns, the text redacted; a null text stays null, n_chars (if there) counts the new text. See find for the other cases."""
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    df = find(docs.select(whole.alias("kept"), F.col("text").cast("string").alias("text")))
    text = F.when(F.col("text").isNull(), None).otherwise(redacted(F.col("text"), F.col("spans")))
    df = df.select("kept", text.alias("redacted"))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted")}
    return df.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"kept.c{k}")).alias(c) for k, c in enumerate(columns)))
