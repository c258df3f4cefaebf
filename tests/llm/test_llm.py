"""The corpus operators against brute force, round trips and held-out accuracy, with the hard cases of each."""

import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma tau upsilon phi chi psi omega nu xi rho mu".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


HARD = [(1, None), (2, ""), (3, " "), (4, "a  b "), (5, "é😀 x"), (5, "é😀 x"), (None, "none"), (9, "w" * 5000), (10, "the <|endoftext|> end"), (11, "a\n\n b\tc")]


def test_chunked_ids_equal_the_library():
    from memlake.llm.chunk_bpe import ChunkBpe

    c = ChunkBpe(P.path("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = [t or "" for _, t in HARD] + ["".join(r.choice("abcE ,.\n\té1'") for _ in range(200)) for _ in range(200)]
    for t, raw in zip(texts, c.encode(texts)):
        assert np.frombuffer(raw, c.type).tolist() == c.lib.encode(t, add_special_tokens=False).ids


def test_pair_index_equals_the_library():
    from tokenizers import Tokenizer

    from memlake.llm.pair_index import PairIndexBpe

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), PairIndexBpe(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    texts = [t or "" for _, t in HARD] + ["".join(r.choice("abceinorst'. ,1éΣ<|>") for _ in range(150)) for _ in range(300)] + ["it's ΣΑΣ İ ́a", "\x1ca\x85b"]
    for t, (raw, text) in zip(texts, own.encode_decode(texts)):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and text == lib.decode(ids, skip_special_tokens=False)


def test_token_store_round_trip_and_random_access(spark):
    from tokenizers import Tokenizer

    from memlake.llm.token_store import Block, encode_block, store_and_read

    ids = np.random.RandomState(0).randint(0, 1 << 18, 5000).astype("<u4")
    for bits in (8, 16):
        b = Block(encode_block(ids, bits))
        assert [b[k] for k in range(0, 5000, 37)] == ids[::37].tolist() and (b.slice(600, 3001) == ids[600:3001]).all()
    assert len(Block(encode_block(np.zeros(0, "<u4")))) == 0
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(((r["start"], r["doc_id"], r["ids"]) for r in store_and_read(docs(spark, HARD), P.path("byte_bpe_50k.json")).collect()))
    at = 0
    for (start, doc, raw), (want, text) in zip(got, sorted(HARD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        assert (start, doc) == (at, want) and np.frombuffer(raw, "<u4").tolist() == [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        at += len(raw) // 4
    assert store_and_read(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_is_whole_gapless_and_tight(spark):
    from memlake.llm.packing import pack, plan_best_two_fit

    r = random.Random(3)
    hist = {}
    for _ in range(4000):
        s = min(2047, int(r.lognormvariate(5.5, 1)) + 1)
        hist[s] = hist.get(s, 0) + 1
    plan = plan_best_two_fit(hist)
    used = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= 2048
        for s, n in pattern:
            used[s] = used.get(s, 0) + n * times
    assert used == hist and sum(t for _, t in plan) <= 1.01 * sum(s * n for s, n in hist.items()) / 2048 + 1
    rows = pack(docs(spark, HARD), P.path("byte_bpe_50k.json"), capacity=16).collect()
    seq = {}
    for x in rows:
        assert len(x["ids"]) == 4 * x["length"]
        seq.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert sum(x["piece"] == 0 for x in rows) == len(HARD)
    assert pack(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_alignment_equals_brute_force():
    from memlake.llm.order_minhash import similar

    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
            p = q
        return p[-1]

    r = random.Random(4)
    for _ in range(300):
        a = [r.randrange(20) for _ in range(r.randrange(1, 90))]
        b = list(a)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.randrange(20)] * r.randrange(2)
        m = lcs(a, b)
        assert similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (len(b) > 0 and m / (len(a) + len(b) - m) >= 0.8)


def test_near_duplicates_group_copies_and_leave_others(spark):
    from memlake.llm.order_minhash import near_duplicates

    r = random.Random(5)
    base = [prose(r, 150) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(40):  # near copies of the first
        w = base[0].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[1]), (201, base[1].upper()), (202, " ".join(reversed(base[2].split(" ")))), (300, None), (301, ""), (None, base[3]), (4, base[4]), (400, "ab"), (401, "ab")]
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    cls = {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] is not None}
    assert all(cls[100 + k] == 0 for k in range(40)) and cls[200] == cls[201] == 1 and cls[202] == 202 and cls[301] == 300 and cls[401] == 400
    assert all(cls[k] == k for k in range(12)) and [x["class_id"] for x in got if x["doc_id"] is None] == [None]
    assert near_duplicates(docs(spark, [])).count() == 0


def test_fingerprints_and_radius(spark):
    from memlake.llm.hashing import word_hashes
    from memlake.llm.simhash import edited, fingerprint, fingerprints, hamming_classes

    r = random.Random(6)
    rows = [(k, prose(r, r.randrange(1, 60))) for k in range(60)] + [(70, None), (71, ""), (None, "x"), (5, "again")]
    got = fingerprints(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] if x[0] is not None else -1, x[1] or ""), reverse=True)
    want = [(i, edited(t or "", order[(k + 1) % len(order)][1] or ""), fingerprint(word_hashes([t])[0]).hex()) for k, (i, t) in enumerate(order)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    assert sorted(((x["doc_id"], x["edited"], x["fingerprint"]) for x in got), key=key) == sorted(want, key=key)
    base = r.getrandbits(128)
    prints = []
    for _ in range(150):
        v = base if r.random() < 0.7 else r.getrandbits(128)
        for _ in range(r.randrange(5)):
            v ^= 1 << r.randrange(128)
        prints.append(v)
    df = spark.createDataFrame([(f"{v:032X}",) for v in prints], "fingerprint string")
    for x in hamming_classes(df, 3, tile_rows=16).collect():
        v = int(x["fingerprint"], 16)
        assert x["n_links"] == sum((v ^ o).bit_count() <= 3 for o in prints) - 1
    assert fingerprints(docs(spark, [])).count() == 0


def test_vectors_equal_brute_force(spark):
    from memlake.llm.vector_dedup import near_duplicates

    g = np.random.RandomState(7)
    v = g.randn(60, 8)
    v[20:50] = v[0] + 0.25 * g.randn(30, 8)
    v[50] = v[0]
    rows = [(k, [float(np.float32(x)) for x in v[k]], k % 2) for k in range(60)]
    rows += [(90, None, 0), (91, [0.0] * 8, 0), (92, [float("nan")] * 8, 0), (93, rows[0][1], None), (94, [1.0] * 3, 0), (95, [None] * 8, 0), (None, rows[0][1], 0), (96, [], 0)]
    got = {x["vec_id"]: x for x in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile_rows=8).collect()}
    assert len(got) == len(rows)
    m = np.array([r[1] for r in rows[:60]])
    c = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    link = (c >= 0.93) & (np.arange(60)[:, None] % 2 == np.arange(60) % 2)
    np.fill_diagonal(link, False)
    low = np.arange(60)
    for _ in range(60):
        low = np.minimum(low, np.where(link, low[None, :], 999).min(1))
    for k in range(60):
        assert (got[k]["n_links"], got[k]["component_id"]) == (link[k].sum(), low[k])
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (90, 91, 92, 93, 94, 95, 96))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_personal_data_base_equals_brute_force(spark):
    from memlake.llm.pii import find, redact

    r = random.Random(8)
    texts = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "é😀 +49 30 1234567 call 743-555-3824", "x" * 3000 + "@" + "y" * 50 + ".com", "7 " * 9000]
    texts += ["".join(r.choice("0123456789. -+()@ab") for _ in range(200)) for _ in range(200)]
    df = docs(spark, list(enumerate(texts)))
    for x in find(df).collect():
        want = base_spans(texts[x["doc_id"]] or "")
        assert [tuple(s) for s in x["base"]] == want and {tuple(s) for s in x["spans"]} >= set(want)
    got = {x["doc_id"]: x["text"] for x in redact(df).collect()}
    assert got[0] is None and got[4] == "[CARD]" and got[5] == "é😀 [PHONE] call [PHONE]"


def test_toxicity_on_held_out_rows(spark):
    from memlake.llm.toxicity import classify

    r = random.Random(9)
    rows, labels = [(5000, None), (5001, "")], []
    for k in range(900):
        bad = k % 6 == 0
        w = prose(r, 60).split(" ")
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["nasty", "rotten", "vile"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in classify(docs(spark, rows), lab).collect()}
    assert len(got) == len(rows) and not got[5000]["predicted"] and not got[5001]["predicted"]
    held = [(got[k]["predicted"], y) for k, y in labels if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _ in labels)
    assert np.mean([a == b for a, b in held]) > 0.95
    assert classify(docs(spark, rows), lab.where("toxic = 0")).where("predicted = 1").count() == 0


def test_language_model_base_is_exact_and_rounds_agree(spark):
    from memlake.llm.bloom_lm import score

    r = random.Random(10)
    rows = [(k, prose(r, r.randrange(1, 80))) for k in range(120)] + [(500, None), (501, ""), (None, "Alpha1\x1f b"), (7, "twice")]
    one = {(x["doc_id"], x["n_tokens"]): x for x in score(docs(spark, rows)).collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = [w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t)]
    n, kinds = len(train), len(set(train))
    for i, t in rows:
        x = one[i, len(tokens(t))]
        want = sum(np.log10((train.count(w) + 0.5) / (n + 0.5 * (kinds + 1))) for w in tokens(t))
        assert abs(x["base_score"] - want) < 1e-6 and x["n_known"] == sum(w in train for w in tokens(t)) and x["train_tokens"] == n
    for x in score(docs(spark, rows), max_broadcast=1500).collect():
        assert abs(x["score"] - one[x["doc_id"], x["n_tokens"]]["score"]) < 1e-9
    assert score(docs(spark, [])).count() == 0


def test_quotes_link_and_order(spark):
    from memlake.llm.quotes import formatted, link

    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine."), (1, 2, "user", "> > How are you?\n> Fine.\n\nGood!"), (1, 3, "user", "On Mon X wrote:\n> hello THERE\nhi again"), (1, 4, "user", None), (None, 0, "user", "x"), (2, None, "user", "")]
    got = link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    by = {(x["conv_id"], x["turn"]): x for x in got.collect()}
    assert len(by) == len(rows)
    assert [by[1, k]["answers"] for k in range(5)] == [None, 0, 1, 0, None] and [by[1, k]["n_linked"] for k in range(5)] == [0, 1, 2, 1, 0]
    assert [by[1, k]["position"] for k in range(5)] == [0, 1, 2, 3, 4] and by[1, 3]["body"] == "hi again"
    assert formatted(got.where("conv_id = 1")).first()["chat"].startswith("<|user|>\nHello there.\nHow are you?\n<|assistant|>\nFine.")


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    rows = []
    for k in range(300):
        w = prose(r, 40).split(" ")
        if k % 6 == 0:
            w[3] = w[9] = "vile"
        rows.append((k, " ".join(w) + (" me@x.org" if k % 10 == 1 else ""), "en", "s", 1))
    rows.append((400, rows[1][1], "en", "s", 1))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {x["doc_id"]: x["text"] for x in d.collect()}
    assert set(ids) == {k for k in range(300) if k % 6} and "[EMAIL]" in ids[1] and "@" not in ids[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(ids)
