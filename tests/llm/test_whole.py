"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np

from tests.llm.test_llm import WORDS, docs


def test_alike_texts_in_a_bucket_that_a_hot_component_fills(spark):
    from memlake.llm.hashing import word_hashes
    from memlake.llm.order_minhash import SKETCHES, bucket_components, shingles

    r = random.Random(21)
    words = lambda n: [r.choice(WORDS) + str(r.randrange(10_000)) for _ in range(n)]
    start, hot, pairs = words(60), words(60), [words(60) for _ in range(5)]
    texts = {k: start + hot + ["copy", str(k)] for k in range(300)}
    for k, tail in enumerate(pairs):
        texts |= {1000 + k: start + tail + ["this"], 2000 + k: start + tail + ["that"]}
    bucket = spark.createDataFrame([(k, 3, 77, 4) for k in texts], "id long, sketch int, sig long, salts int")
    marks = spark.createDataFrame([(k, [k * 100 + n if n != 3 else 77 for n in range(SKETCHES)]) for k in texts], "id long, marks array<long>")
    seqs = spark.createDataFrame([(k, shingles(word_hashes([" ".join(t)])[0]).tobytes()) for k, t in texts.items()], "id long, seq binary")
    want = {k: 0 if k < 300 else k if k < 2000 else k - 1000 for k in texts}
    for rows in (256, 16):
        assert {x["id"]: x["component"] for x in bucket_components(bucket, marks, seqs, tile_rows=rows).collect()} == want


def test_one_word_edits_of_short_texts(spark):
    from memlake.llm.hashing import word_hashes
    from memlake.llm.order_minhash import near_duplicates, shingles, similar

    r = random.Random(22)
    rows = []
    for k in range(120):
        w = [r.choice(WORDS) + str(r.randrange(10_000)) for _ in range(6 + k % 12)]
        at = (0, len(w) // 2, len(w))[k // 12 % 3]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:at] + ["more"] + w[at:]))]
    linked = {i: similar(*map(shingles, word_hashes([t, u]))) for (i, t), (_, u) in zip(rows[::2], rows[1::2])}
    assert sum(linked.values()) > 30 and not all(linked.values())
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(docs(spark, rows)).collect()}
    assert {i: got[i + 1] == i for i in linked} == linked


def test_quotes_of_several_lines(spark):
    from memlake.llm.quotes import link

    texts = [
        "one a\ntwo b\nthree c\nfour d\n\nfive e\n\nsix f\nseven g",
        "other x\nother y",
        "> two b\n> Three C!\nlines of a paragraph",
        "> four d\n>\n> five e\nparts of paragraphs",
        "> two b\n> four d\nnot a run",
        "> > other x\n> > other y\n> lines of a paragraph\nnested",
        "two b\nthree c\nagain",
        "> two b\n> three c\nthe latest",
    ]
    got = link(spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    by = {x["turn"]: x for x in got}
    assert [by[k]["answers"] for k in range(8)] == [None, None, 0, 0, None, 2, None, 6]
    assert [by[k]["n_linked"] for k in range(8)] == [0, 0, 1, 1, 0, 2, 0, 1]


def test_fingerprints_of_edited_texts_are_near(spark):
    from memlake.llm.simhash import fingerprints, hamming_classes

    r = random.Random(23)
    rows = []
    for k in range(100):
        w = [r.choice(WORDS) + str(r.randrange(10_000)) for _ in range((50, 100, 200, 500)[k % 4])]
        near = list(w)
        for at in r.sample(range(len(w)), len(w) // 50):
            near[at] = f"changed{r.randrange(10_000)}"
        rows += [(k, " ".join(w)), (1000 + k, " ".join(near))]
    prints = {x["doc_id"]: x["fingerprint"] for x in fingerprints(docs(spark, rows)).collect()}
    got = {x["fingerprint"]: (x["n_links"], x["component"]) for x in hamming_classes(spark.createDataFrame([(f,) for f in prints.values()], "fingerprint string"), tile_rows=16).collect()}
    wide = {k: int(v, 16) for k, v in prints.items()}
    for k, f in prints.items():
        assert got[f][0] == sum((wide[k] ^ o).bit_count() <= 15 for o in wide.values()) - 1
    assert sum(got[prints[k]][1] == got[prints[1000 + k]][1] for k in range(100)) >= 95
    assert len({got[prints[k]][1] for k in range(100)}) == 100
