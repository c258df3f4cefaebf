"""Pairs that a group of near copies takes."""

import random

from memlake.llm import order_minhash as O


def test_a_text_of_a_large_group_meets_few_pivots(spark, monkeypatch):
    """Their number grows with the group, not its square, and one pivot is met once by however many sketches."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    written = O.written
    pairs: list[int] = []

    def counted(df, name, *more):
        out = written(df, name, *more)
        pairs.extend([out.count()] * (name == "pairs"))
        return out

    monkeypatch.setattr(O, "written", counted)
    a_row = []
    for n in (150, 600):
        pairs.clear()
        texts = [list(words) for _ in range(n)]
        for t in texts:
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
        got = O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == n and {r["class_id"] for r in got} == {0}
        a_row.append(sum(pairs) / n)
    assert max(a_row) < 6
