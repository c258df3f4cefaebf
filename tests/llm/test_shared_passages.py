"""Words in passages that other documents have too, against brute force on made rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from memlake.llm import queries, shared_passages, suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute_shared(rows, least=51):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    owners = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            owners[tuple(w[i : i + least])].add(k)
    out = []
    for (d, _), w in zip(rows, words):
        covered = {j for i in range(len(w) - least + 1) if len(owners[tuple(w[i : i + least])]) > 1 for j in range(i, i + least)}
        out.append((d, len(covered)))
    return sorted(out, key=str)


def passage_rows():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, short, within, common = prose(51), prose(50), prose(60), prose(8)
    assert len(passage.encode()) < 400
    rows = [(1, None), (2, ""), (3, passage), (None, within + "\n" + prose(9) + " " + within), (4, "a " * 300), (5, "b " * 70), (5, "b\n" * 90), (6, prose(3000)), (6, "x" * 500)]
    rows += [(k, f"{prose(30)} {passage} {prose(rnd.randint(0, 30))}") for k in range(10, 20)]
    rows += [(20, prose(40) + "\t " + passage.replace(" ", "\n") + "\r\n" + prose(5)), (21, f"{prose(9)} {short} {prose(9)}"), (22, f"{short} {prose(20)}")]
    rows += [(k, f"{prose(60)} {common} {prose(60)}") for k in range(23, 29)]
    twice = prose(70)
    rows += [(30, f"{twice} q {twice}"), (31, f"{prose(20)} {' '.join(twice.split()[:55])} {prose(20)}"), (32, f"{' '.join(twice.split()[15:])} z")]
    base = prose(250).split()
    for k in range(40, 52):  # near copies
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((k, " ".join(w)))
    return rows + [(60, " ".join(base)), (60, " ".join(base)), (61, within.upper()), (62, within.upper()), (63, short + "!"), (64, short + "!")]


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_shared_words(spark, monkeypatch, most):
    """Also with the windows of an anchor dealt by themselves; the contract's columns stay as they are without passages."""
    monkeypatch.setattr(shared_passages, "MOST", most)
    rows = passage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, passages=True)
    assert got.columns == [*COLUMNS, "n_shared_words"]
    assert sorted(map(tuple, got.select("doc_id", "n_shared_words").collect()), key=str) == brute_shared(rows)
    if most == 4096:
        assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str)


def test_query_tells_passages_below_400_bytes(spark, tmp_path):
    rnd = random.Random(9)
    prose = lambda n: " ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(n))
    passage = prose(55)
    rows = [(1, f"{prose(90)} {passage} {prose(90)}"), (2, f"{prose(80)} {passage}"), (3, prose(200))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["n_shared_words"]) for r in queries.op11_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 55), 2: (0, 55), 3: (0, 0)}
