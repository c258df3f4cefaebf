"""Suffix dedup, source tries and periodic runs against brute force on made rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from memlake.llm import periodic_runs as P
from memlake.llm import queries, source_tries, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, h long, key string, spans int, part string, value int"


def table(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, la, s, 1, "k", 2, "p", 3) for d, t, la, s in rows], SCHEMA)


# ---- suffix dedup


def brute_kept(rows, least=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        gone = gone[: len(t)]
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating_rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghé ñ") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = prose(90), prose(300)
    rows = [(1, None), (2, ""), (3, "short"), (None, passage), (4, "a" * 2000), (5, "ab" * 700 + "x"), (6, prose(5000)), (6, "z" * 399)]
    rows += [(k, prose(40) + passage + prose(rnd.randint(0, 60))) for k in range(10, 22)]
    for k in range(30, 50):  # near copies
        w = base.split(" ")
        for _ in range(3):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((k, " ".join(w)))
    return rows + [(60, base), (60, base), (61, base)]


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_suffix_dedup_whole(spark, monkeypatch, most):
    """Also with anchors split by ranges of offsets and by windows."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = repeating_rows()
    got = suffix_dedup.remove_repeats(table(spark, [(d, t, "en", "s") for d, t in rows]))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_kept(rows)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_array_orders_all():
    rnd = random.Random(2)
    for _ in range(60):
        k = rnd.choice([1, 2, 26])
        parts = [bytes(rnd.randrange(97, 97 + k) for _ in range(rnd.randint(1, 50))) for _ in range(rnd.randint(1, 5))]
        joined = b"".join(p + b"\x00" for p in parts)
        codes = np.frombuffer(joined, np.uint8).astype(np.int64)
        codes = np.where(codes == 0, 0, codes + 1)
        end = lambda i: joined.index(b"\x00", i)
        assert suffix_dedup.suffix_array(codes).tolist() == sorted(range(len(joined)), key=lambda i: (joined[i : end(i)] + b"\x00", end(i)))


# ---- source tries


def brute_divergence(rows):
    docs = [(la or "", s or "", source_tries.terms_of(t)) for _, t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = defaultdict(Counter)
        for la, s, ts in docs:
            if la == lang:
                count[s].update(t for t in ts if df[t] >= 3)
        total = {s: sum(c.values()) for s, c in count.items()}
        whole = sum(count.values(), Counter())
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        for s in count:
            pair = [(o, sum((p(count[s][t], total[s]) - p(count[o][t], total[o])) ** 2 // p(count[o][t], total[o]) for t in kept)) for o in count if o != s]
            term = []
            for t in kept:
                x, q = p(count[s][t], total[s]), p(whole[t], sum(total.values()))
                if count[s][t] and x > q:
                    term.append((t.decode(), (x - q) ** 2 // q))
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


def trie_rows():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcXYZé中") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    rows = [(1, None, None, None), (2, "", "xx", "lonely"), (3, "once two", "yy", "a"), (3, "", "yy", "b"), (4, "w" * 50_000 + " KK ß1ab c", "en", "s1")]
    for k in range(200):
        rows.append((k % 50, " ".join(rnd.choice(words[: rnd.choice([20, 300])]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "s2", "s3", None, "é"])))
    return rows


def test_source_tries_whole(spark, monkeypatch):
    rows = trie_rows()
    want = brute_divergence(rows)
    assert sorted(map(tuple, source_tries.divergence(table(spark, rows)).collect())) == want
    monkeypatch.setattr(source_tries, "RANGE", 1)  # a range for every few rows of leaves
    assert sorted(map(tuple, source_tries.divergence(table(spark, rows).repartition(7)).collect())) == want


def test_source_tries_ranges_hold_a_bounded_share_of_like_tries(spark, monkeypatch):
    """Rows of like tries began at like places, so a range held a row of every trie, however many there were."""
    monkeypatch.setattr(source_tries, "CHUNK", 50)
    monkeypatch.setattr(source_tries, "RANGE", 200)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = [(k, " ".join(words), "en", f"s{k % 2}") for k in range(60)]
    tries = source_tries.written(source_tries.count_tries(table(spark, rows).repartition(60)), "tries")
    cuts = [x[1] for x in source_tries.cut_places(tries)]
    full = Counter(sum(c <= w for c in cuts) for r in tries.collect() for w in source_tries.Trie.read(source_tries._batch([r.asDict()]), 0).terms)
    assert sum(full.values()) > 4000 and max(full.values()) < 3 * 200
    assert sorted(map(tuple, source_tries.divergence(table(spark, rows).repartition(60)).collect())) == brute_divergence(rows)


def test_source_tries_empty(spark):
    assert source_tries.divergence(table(spark, [])).count() == 0


def test_source_tries_oracle(spark, tmp_path):
    table(spark, [(d, None if t is None else t.replace("K", "k"), la, s) for d, t, la, s in trie_rows()]).select("doc_id", "text", "lang", "source").toPandas().to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(c.execute(queries.ORACLE_SQL["op12_source_tries"]).fetchall())
    assert sorted(map(tuple, queries.op12_source_tries(spark, str(tmp_path)).collect())) == want


def test_tries_split_and_merge_alike():
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"ab\xc3\xa9") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    tries, docs, count = [], Counter(), defaultdict(Counter)
    for _ in range(5):
        seen, by = Counter(), {}
        for s in rnd.sample("pqrs", 3):
            by[s] = Counter(rnd.choice(words) for _ in range(50))
            seen.update(by[s].keys())
            count[s].update(by[s])
        docs.update(seen)
        trie = source_tries.Trie.counted(seen, by)
        tries += [trie.part(0, 17), trie.part(17, len(trie.terms))]
    whole = source_tries.Trie.merged(tries)
    assert whole.terms == sorted(docs) and whole.docs.tolist() == [docs[t] for t in whole.terms]
    got, at = defaultdict(Counter), whole.ends()
    for k, t in enumerate(whole.terms):
        for s, n in zip(whole.source[at[k] : at[k + 1]].tolist(), whole.count[at[k] : at[k + 1]].tolist()):
            got[whole.names[s]][t] += n
    assert got == count
    row = whole.row()
    assert source_tries.Trie.read(source_tries._batch([row]), 0).terms == whole.terms


def test_shares_beyond_64_bits():
    assert source_tries.shares(np.array([9_300_000_000 * 3]), 10**12).tolist() == [1 + 10**9 * (9_300_000_000 * 3 + 1) // 10**12]


# ---- periodic runs


def brute_runs(words):
    n, out = len(words), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i + p - s
            if i > s and size >= max(24, 3 * p):
                seg = words[s : s + size]
                if not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.add((s, size, p))
            i = max(i, s) + 1 if i == s else i
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rnd):
    k, n = rnd.choice([1, 2, 3, 5, 40]), rnd.randint(0, 110)
    ids = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 10:
            a, p, m = rnd.randrange(n), rnd.randint(1, 14), rnd.randint(0, 80)
            for i in range(a + p, min(n, a + m)):
                ids[i] = ids[i - p]
    return [str(x).encode() for x in ids]


def test_runs_are_all_found():
    rnd = random.Random(4)
    for _ in range(500):
        words = periodic_words(rnd)
        assert P.find(words) == P.runs_of([int(w) for w in words]) == brute_runs(words)


def test_runs_when_hashes_agree_by_chance(monkeypatch):
    """The words decide, whatever the hashes say."""
    monkeypatch.setattr(P.Words, "_alike", lambda self, i, j, n: True)
    rnd = random.Random(8)
    for _ in range(150):
        words = periodic_words(rnd)
        assert P.find(words) == brute_runs(words)


def test_periodic_runs_whole(spark):
    import zlib

    rnd = random.Random(6)
    rows = [(None, "a " * 100), (1, None), (2, ""), (2, ""), (3, "é x " * 40), (4, " \t a\x0bb\x1c " * 40), (7, "la " * 200_000)]
    rows += [(k, " ".join(w.decode() for w in periodic_words(rnd)) if k % 2 else " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randint(1, 400)))) for k in range(10, 150)]
    got = P.periodic_runs(table(spark, [(d, t, "en", "s") for d, t in rows]))
    want = []
    for d, t in rows:
        words = (t or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = P.find(words) if n > 1000 else brute_runs(words)
        if n > 1000:
            assert runs == [(0, n, 1)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        drop = {i for s, m, p in runs for i in range(s + p, s + m)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert P.periodic_runs(table(spark, [])).count() == 0
