"""The kept index: batches, pruning, prefixes and the scores of a scan."""

import math

import pytest

from memlake.operators import postings, rank


def rows(spark, texts, first=1):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


TEXTS = ["alpha beta beta gamma", "alpha alphabet alphabetical", None, "", "Gamma gamma x delta_1 42", "beta " * 50]


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.append(spark, path, rows(spark, TEXTS[:3]), "a")
    postings.append(spark, path, rows(spark, TEXTS[3:], 4), "b")
    return path


@pytest.mark.parametrize("query,prefix", [(["alpha", "beta"], False), (["gamma", "gamma", "nowhere"], False), (["al", "alphabet", "de"], True), (["42"], False)])
def test_scores_are_those_of_a_scan(spark, index, query, prefix):
    got = scores(postings.bm25(spark, index, query, prefix))
    assert got == scores(rank.bm25(rows(spark, [t or "" for t in TEXTS]), query, prefix=prefix)) and got


def test_a_batch_written_again_replaces_itself(spark, index):
    before = scores(postings.bm25(spark, index, ["beta"]))
    postings.append(spark, index, rows(spark, TEXTS[3:], 4), "b")
    assert scores(postings.bm25(spark, index, ["beta"])) == before


def test_frequencies_span_batches(spark, index):
    got = {r["term"]: (r["df"], r["cf"]) for r in postings.document_frequencies(spark, index).collect()}
    assert got["beta"] == (2, 52) and got["gamma"] == (2, 3) and got["delta_1"] == (1, 1) and "x" not in got


def test_only_asked_buckets_are_read(spark, index):
    for query, prefix in ((["alpha"], False), (["al"], True)):
        df = postings.matching(postings.postings(spark, index), query, prefix)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "alpha" in plan.split("PushedFilters: [")[1] or "StringStartsWith(term,al)" in plan
        folders = {f.split("/bucket=")[1].split("/")[0] for f in (r[0] for r in df.selectExpr("input_file_name()").distinct().collect())}
        assert len(folders) == 1


def test_short_prefixes_and_empty_questions(spark, index):
    with pytest.raises(ValueError):
        postings.bm25(spark, index, ["a"], prefix=True)
    assert postings.bm25(spark, index, []).count() == 0
    assert postings.bm25(spark, index, ["nowhere"]).count() == 0


def test_an_index_of_nothing(spark, tmp_path):
    postings.append(spark, str(tmp_path / "i"), rows(spark, []), "a")
    assert postings.bm25(spark, str(tmp_path / "i"), ["alpha"]).count() == 0
    assert postings.document_frequencies(spark, str(tmp_path / "i")).count() == 0


def test_a_frequent_term_weighs_little(spark, index):
    one = scores(postings.bm25(spark, index, ["delta_1"]))
    assert math.isclose(sum(one.values()), sum(scores(rank.bm25(rows(spark, [t or "" for t in TEXTS]), ["delta_1"])).values()), abs_tol=1e-9)


def test_a_frequent_beginning_is_dealt_over_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        postings.append(spark, str(tmp_path / "i"), spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Aa1 aa2 aa2 x").alias("text")), "one")
        per = [r["count"] for r in postings.postings(spark, str(tmp_path / "i")).groupBy(F.input_file_name()).count().collect()]
        assert sum(per) == 800 and max(per) < 500
        assert sorted(tuple(r) for r in postings.document_frequencies(spark, str(tmp_path / "i")).collect()) == [("aa1", 400, 400), ("aa2", 400, 800)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
