"""Toxicity by non-negative positive-unlabelled learning.

The positives are documents whose label says toxic; the unlabelled ones are a bounded sample of documents whose labels are not read, so
no row is ever taken as a negative. A numpy classifier minimises the class-prior-corrected risk
    pi R_p(+) + max(0, R_u(-) - pi R_p(-))
over the words of a text and their beginnings. Every word counts: it is hashed to one of DIMENSIONS features, weighed by how far its rate
among the positives is from that among the unlabelled (a z value, shrunk towards 0). The prior pi and the cut come from positives and
unlabelled rows alone, by scores of models that were fitted on the other half of the sample: the prior as the least ratio of the two
tails (with its confidence slack), the cut as the place with the best recall squared over predicted share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import hash_spans, kind, laid, mix, running, runs, slices
from memlake.llm.workers import give_back, task
from memlake.session import ship, written

MAX_POSITIVE = 5_000  # bound of the sample of labelled toxic documents
MAX_UNLABELLED = 5_000  # bound of the sample of documents without their labels
DIMENSIONS = 1 << 18
SHRINK = 2.0  # a rate within this many standard errors tells nothing
BEGINNINGS = (5, 7)  # insults also come inflected
THRESHOLD = 0.7
FOLDS, HELD = 3, 1


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, feature) of the distinct words of each text and of their beginnings, each feature once; in order of the texts."""
    _, codes, begins = laid(texts)
    start, end = runs(kind("letters")[codes])
    total = running(codes)
    word, text = hash_spans(total, start, end), np.searchsorted(begins, start, "right") - 1
    order = np.lexsort((word, text))
    new = np.append(True, (word[order][1:] != word[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
    at = order[new]
    start, end, found, of = start[at], end[at], [word[at]], [text[at]]
    for n in BEGINNINGS:
        long = end - start > n
        found.append(mix(hash_spans(total, start[long], start[long] + n) + np.uint64(n)))
        of.append(text[at][long])
    both = np.unique(np.concatenate(of) * DIMENSIONS + (np.concatenate(found) >> np.uint64(20)).astype(np.int64) % DIMENSIONS)
    return both // DIMENSIONS, both % DIMENSIONS


def held_out(doc_id):
    """crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


class Rows:
    """Documents as sparse rows of features; 32-bit numbers, as the driver holds them all."""

    def __init__(self, found: list[np.ndarray]):
        self.n = len(found)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f in found])
        self.at = np.concatenate(found) if found else np.zeros(0, np.int32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, v[self.row], width)

    def presence(self) -> np.ndarray:
        """Number of rows with each feature."""
        return np.bincount(self.at, minlength=DIMENSIONS)

    def narrowed(self, place: np.ndarray) -> Rows:
        """Only the features with a place there."""
        out, keep = Rows([]), place[self.at] >= 0
        out.n, out.row, out.at = self.n, self.row[keep], place[self.at[keep]]
        return out


def evidence(p: Rows, u: Rows) -> np.ndarray:
    """For each feature the shrunk z value of its rate among the positives against that among the unlabelled."""
    a, b = p.presence(), u.presence()
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
    z = (odds(a, p.n) - odds(b, u.n)) / np.sqrt(1 / (a + 0.5) + 1 / (p.n - a + 0.5) + 1 / (b + 0.5) + 1 / (u.n - b + 0.5))
    return np.where(a + b > 0, np.sign(z) * np.maximum(0, np.abs(z) - SHRINK), 0.0)


def fit_nnpu(p: Rows, u: Rows, prior: float, epochs: int = 200, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias) of the classifier with the least non-negative PU risk for that class prior."""
    z = evidence(p, u)
    active = np.flatnonzero(z)
    place = np.full(DIMENSIONS, -1, np.int32)
    place[active] = np.arange(len(active))
    scale = z[active]
    p, u = p.narrowed(place), u.narrowed(place)
    w, b = np.zeros(len(active)), 0.0
    m = v = np.zeros(len(active) + 1)
    for t in range(1, epochs + 1):
        fp, fu = p.times(w * scale) + b, u.times(w * scale) + b
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()

        def gradient(rows, d):
            return np.append(rows.back(d, len(active)) * scale, d.sum()) / rows.n

        if negative >= 0:
            g = prior * gradient(p, sp - 1) + gradient(u, su) - prior * gradient(p, sp)
        else:  # the corrected risk may not go below zero: step back
            g = prior * gradient(p, sp) - gradient(u, su)
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], float(b - step[-1])
    out = np.zeros(DIMENSIONS)
    out[active] = w * scale
    return out, b


def estimate_prior(fp: np.ndarray, fu: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled: the least ratio of the tails, where the slack of both tails is least."""
    cuts = np.unique(fp)
    tail = lambda f: 1 - np.searchsorted(np.sort(f), cuts, "left") / len(f)
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * len(f))) for f in (fp, fu))
    tp, tu = tail(fp), tail(fu)
    best = int(np.argmin((tu + (1 + gamma) * slack) / tp))
    return float(np.clip(tu[best] / tp[best], 1 / (len(fu) + 1), 0.5))


def choose_cut(fp: np.ndarray, fu: np.ndarray) -> float:
    """The cut with the best recall squared over predicted share, in the middle of the gap below it."""
    every = np.unique(np.concatenate([fp, fu]))
    recall = 1 - np.searchsorted(np.sort(fp), every, "left") / len(fp)
    share = 1 - np.searchsorted(np.sort(fu), every, "left") / len(fu)
    k = int(np.argmax(np.where(share <= 0.5, recall**2 / (share + 0.5 / len(fu)), 0)))  # most text is not toxic
    return float((every[k] + every[k - 1]) / 2 if k else every[0] - 1e-9)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """A model (weights, bias, shift, prior) from the documents outside the held-out fold: those labelled toxic, and a sample whose labels are not read.

    Rows with a null doc_id or text don't teach, null labels say nothing; a doc_id labelled twice is toxic if one label says so. Without a
    positive, or without another document, the model has no weights and gives next to 0 everywhere.
    """
    ship(docs.sparkSession)
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30)
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("known")).distinct()
    toxic = toxic.where(~held_out(F.col("known")))
    toxic = toxic.where(spread(F.col("known")) < min(1.0, max_positive / max(1, toxic.count())))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, max_unlabelled / max(1, rows.count()))
    joined = rows.join(F.broadcast(toxic), F.col("doc_id") == F.col("known"), "left")  # max_positive ids
    sample = joined.select("doc_id", "text", F.col("known").isNotNull().alias("positive"), (spread(F.hash("doc_id")) < share).alias("unlabelled")).where("positive or unlabelled")

    @task("features")
    def run(batches):
        for b in batches:
            for part, texts in slices(b, 1):
                of, found = features(texts)
                mine = np.split(found.astype("<i4"), np.searchsorted(of, np.arange(1, len(texts))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([f.tobytes() for f in mine], pa.binary())], ["doc_id", "positive", "unlabelled", "found"])

    got = written(sample.mapInArrow(run, "doc_id long, positive boolean, unlabelled boolean, found binary"), "toxic-sample").orderBy("doc_id", "found").collect()  # max_positive + max_unlabelled rows
    of = {c: [(r["doc_id"], np.frombuffer(r["found"], "<i4")) for r in got if r[c]] for c in ("positive", "unlabelled")}
    others = any(not r["positive"] for r in got)
    del got
    if not of["positive"] or not others:
        return {"weights": np.zeros(1, np.float32), "bias": 0.0, "shift": -10.0, "prior": 0.0}

    def rows_of(c, half=None):
        return Rows([f for d, f in of[c] if half is None or (d * 0x9E3779B97F4A7C15 >> 32 & 1) == half])

    out: dict[str, list] = {"positive": [], "unlabelled": []}
    start = 0.1  # of the models whose scores give the prior
    for half in (0, 1):
        train = rows_of("positive", half), rows_of("unlabelled", half)
        if train[0].n and train[1].n:
            w, _ = fit_nnpu(*train, start)
            for c in out:
                out[c].append(rows_of(c, 1 - half).times(w))
    p, u = rows_of("positive"), rows_of("unlabelled")
    fp, fu = (np.concatenate([x for x in out[c]]) if out[c] else np.zeros(0) for c in ("positive", "unlabelled"))
    if not len(fp) or not len(fu):  # too few rows for halves
        w, _ = fit_nnpu(p, u, start)
        fp, fu = p.times(w), u.times(w)
    prior = estimate_prior(fp, fu)
    w, b = fit_nnpu(p, u, prior)
    out = {"positive": [], "unlabelled": []}
    for half in (0, 1):
        train = rows_of("positive", half), rows_of("unlabelled", half)
        if train[0].n and train[1].n:
            v, c0 = fit_nnpu(*train, prior)
            for c in out:
                out[c].append(rows_of(c, 1 - half).times(v) + c0)
    fp, fu = (np.concatenate(out[c]) if out[c] else np.zeros(0) for c in ("positive", "unlabelled"))
    cut = choose_cut(fp, fu) if len(fp) and len(fu) else choose_cut(p.times(w) + b, u.times(w) + b)
    del p, u, out, of
    give_back()
    return {"weights": w.astype(np.float32), "bias": b, "shift": float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut), "prior": prior}


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """rows with a score from their column text, which is dropped; an empty or null text has the score of no words. The other columns may have any type, but not the names text and score."""
    ship(rows.sparkSession)
    weights, add = model["weights"], model["bias"] + model["shift"]
    keep = [c for c in rows.columns if c != "text"]

    @task("features")
    def run(batches):
        for b in batches:
            for part, texts in slices(b, len(keep)):
                if len(weights) > 1:
                    of, found = features(texts)
                    f = np.bincount(of, weights[found], len(texts))
                else:
                    f = np.zeros(len(texts))
                s = 1 / (1 + np.exp(-np.clip(f + add, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(s)], [*keep, "score"])

    whole = rows.select(*keep, "text")
    return whole.mapInArrow(run, rows.select(*keep, F.lit(0.0).alias("score")).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text); nothing but its text makes a row's score.

    A null text is empty, a null doc_id is not held out and does not teach, repeated rows have a row each with equal scores, an empty table
    gives no rows; without any label all scores are next to 0. Other columns are ignored.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
