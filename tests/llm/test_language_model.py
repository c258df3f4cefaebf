"""The language model's scores are log probabilities: their mass over the vocabulary, and the same scores from a model counted in Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import bloom_lm as L


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(seed, texts, words, kinds):
    """Texts in which a word leads to some of its own successors or to any word, frequent ones first."""
    r = random.Random(seed)
    any_word = lambda: int(kinds ** r.random()) - 1
    out = []
    for _ in range(texts):
        w, text = any_word(), []
        for _ in range(r.randrange(1, words)):
            text.append(f"w{w}")
            w = (w * 7 + int(9 ** r.random())) % kinds if r.random() < 0.6 else any_word()
        out.append(" ".join(text))
    return out


def counted(train, shards=16):
    """(filter, model, unigram counts) from plain counting of texts."""
    one, two, history_of = Counter(), Counter(), {}
    place = {}
    for t in train:
        w, ends = L.tokens(pa.array([t], pa.string()))
        h, key = L.bigrams(w, ends)
        one.update(w.tolist())
        two.update(key.tolist())
        history_of.update(zip(key.tolist(), [None, *w.tolist()[:-1]]))
        place.update(zip(w.tolist(), [*re.findall(r"[^\x20\x09-\x0D]+", t or ""), None]))
    total, distinct = sum(one.values()), len(one)
    level = lambda n: int(L.level_of(np.array([n]))[0])
    value = L.level_values(L.TOP + 1)
    single, every, mass, words = (np.zeros(L.TOP + 1) for _ in range(4))
    for key, n in two.items():
        q = L.TOP if history_of[key] is None else level(one[history_of[key]])
        single[q] += n == 1
        every[q] += n
        mass[q] += value[level(n)]
    for n in one.values():
        words[level(n)] += 1
    unigram = L.mix(np.array(list(one), np.uint64))
    keys = np.concatenate([np.array(list(two), np.uint64), unigram])
    levels = L.level_of(np.array([*two.values(), *one.values()]))
    shard, checks = L.shard_of(keys, shards), L.checks_for(distinct)
    raw = {s: L.build_filter(keys[shard == s], levels[shard == s], checks) for s in range(shards) if (shard == s).any()}
    bits = np.concatenate([np.frombuffer(x, np.uint64) for x in raw.values()])
    table = L.Filter({s: len(x) for s, x in raw.items()}, shards, checks)
    for s, x in raw.items():
        table.put(s, x)
    error = float(((np.bitwise_count(bits) / 64) ** L.HASHES).mean())
    return table, L.Smoothing(total, distinct, single, every, mass, words, error), one


def log_probability(table, model, text):
    w, ends = L.tokens(pa.array([text], pa.string()))
    level = table.levels(L.mix(w))
    past = L.before(level, ends)
    pair = np.where((level > 0) & (past > 0), table.levels(L.bigrams(w, ends)[1]), 0)
    return float(np.log10(model.probability(level, past, pair)).sum())


def test_mass_over_the_vocabulary_is_one_for_histories_of_every_level():
    table, model, one = counted(corpus(1, 6000, 120, 40_000))
    words = np.array(list(one), np.uint64)
    assert len(words) > 20_000
    own = table.levels(L.mix(words))
    end = L.END
    by_level = {}
    for h, n in one.items():
        if h != int(end):
            by_level.setdefault(int(L.level_of(np.array([n]))[0]), []).append(h)
    r = random.Random(2)
    masses = lambda h, past: float(model.probability(own, np.full(len(words), past), table.levels(L.mix(L.mix(np.uint64(h)) + words))).sum())
    checked = 0
    for q, histories in by_level.items():
        some = histories if len(histories) <= 150 else r.sample(histories, 150)
        got = [masses(h, q) for h in some]
        assert max(got) < 1.35, (q, max(got))  # a history's own sum: within the width of a level
        if len(histories) <= 150 or q == 1:
            checked += 1
            assert abs(np.mean(got) - 1) < 0.02, (q, np.mean(got))
        assert abs(np.mean(got) - 1) < 0.04, (q, np.mean(got))
    assert checked > 5
    assert abs(masses(int(L.START), L.TOP) - 1) < 0.02


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST, 20_000])
def test_scores_are_those_of_a_model_counted_in_python(spark, limit):
    texts = corpus(3, 300, 60, 900) + [None, "", "W1 w1\x1fx  unseen"]
    rows = [(k, t) for k, t in enumerate(texts)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    table, model, _ = counted([t for k, t in rows if not held(k)])
    got = {x["doc_id"]: x for x in L.score(docs(spark, rows), max_broadcast=limit).collect()}
    for k, t in rows:
        assert got[k]["held_out"] == held(k)
        assert abs(got[k]["score"] - log_probability(table, model, t)) < 1e-6


def test_held_out_texts_score_above_the_base(spark):
    rows = list(enumerate(corpus(4, 1500, 100, 2000)))
    got = [x for x in L.score(docs(spark, rows)).collect() if x["held_out"]]
    assert len(got) > 200 and sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_long_texts_repeats_and_other_columns(spark):
    long = " ".join(corpus(5, 2500, 60, 5000))
    assert len(long) > 300_000
    rows = [(1, long), (1, long), (2, "w1 w2"), (2, "w1 w2")]
    got = L.score(docs(spark, rows).selectExpr("doc_id", "text", "1 AS score", "2 AS known", "3 AS levels")).collect()
    assert len(got) == 4 and {x["doc_id"] for x in got} == {1, 2} and all(np.isfinite(x["score"]) for x in got)


def test_texts_are_read_as_often_whatever_the_limit(spark, monkeypatch):
    """A model larger than the limit took a pass over the texts, and a written table, for each part of it."""
    names, put = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: names.append(name) or put(df, name))
    rows, got = list(enumerate(corpus(6, 200, 60, 900))), []
    for limit in (L.MAX_BROADCAST, 4_000):
        names.clear()
        got.append(sorted(map(tuple, L.score(docs(spark, rows), max_broadcast=limit).collect())))
        assert names == ["unigrams", "bigrams", "lm-scores"]
    assert np.allclose([x[5:] for x in got[0]], [x[5:] for x in got[1]], rtol=0, atol=1e-9) and [x[:5] for x in got[0]] == [x[:5] for x in got[1]]
