"""A kept inverted index: postings, term statistics and document lengths as Parquet tables that grow by batches.

Layout under the index's folder, each table partitioned by batch and bucket:

    postings  term, id, tf, dl   sorted by (term, id) within a file
    terms     term, df, cf       one row a term and batch
    totals    docs, length       one row a batch (not bucketed)

A term's bucket is a hash of its first two characters (no token is shorter), so a question for terms, or for words that begin with a
prefix of two characters or more, reads the folders of its buckets alone; within a file the sorted terms let Parquet skip row groups.
The postings of a frequent term are spread over files by a hash of the document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import partitions, ship

K1, B = 1.2, 0.75
BUCKETS = 64
SLOTS = 4  # of documents in buckets, for each task of a build
_HEAD = 2  # characters of a term that decide its bucket
_POSTING = "term string, id long, tf long, dl long, bucket int, batch string"
_TERM = "term string, df long, cf long, bucket int, batch string"
_TOTAL = "docs long, length long, batch string"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, _HEAD)), F.lit(BUCKETS)).cast("int")


def _count(batches):
    """(id, lower-case text) rows to (term, id, tf, dl): a document's tokens, as functions.text.tokens has them, are counted where they are, before anything is moved."""
    words = re.compile("[a-z0-9_]{2,}").findall
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            term, tf, size, dl = [], [], [], []
            for text in part.column(1).to_pylist():
                counts = Counter(words(text))
                term += counts
                tf += counts.values()
                size.append(len(counts))
                dl.append(counts.total())
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(np.repeat(ids, size), pa.int64()), pa.array(tf, pa.int64()), pa.array(np.repeat(dl, size), pa.int64())], ["term", "id", "tf", "dl"])


def append(spark: SparkSession, path: str, docs: DataFrame, batch: str, id: str = "doc_id", text: str = "text") -> None:
    """Adds docs to the index at path as one batch, whose ids no other batch may hold; writing a batch again replaces it.

    A null text has no tokens but counts as a document; a row without id is left out. One shuffle moves each (term, document) once.
    """
    ship(spark)
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    n = partitions(spark)
    counted = rows.mapInArrow(_count, "term string, id long, tf long, dl long").withColumn("bucket", bucket_of(F.col("term")))
    slots = F.lit(max(1, SLOTS * n // BUCKETS))  # several of a bucket, so that no task gets much more than its share of a frequent one
    at = lambda table: f"{path}/{table}/batch={batch}"
    counted.repartition(n, "bucket", F.pmod(F.xxhash64("id"), slots)).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    kept = spark.read.schema("term string, id long, tf long, dl long, bucket int").parquet(at("postings"))
    terms = kept.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    terms.repartition(n, "bucket", F.pmod(F.xxhash64("term"), slots)).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("terms"))
    totals = rows.agg(F.count(F.lit(1)).alias("docs")).crossJoin(kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("length")))
    totals.write.mode("overwrite").parquet(at("totals"))


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POSTING).parquet(f"{path}/postings")


def document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf) over all batches, for every term."""
    return spark.read.schema(_TERM).parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def matching(df: DataFrame, asked: list[str], prefix: bool = False) -> DataFrame:
    """Rows of a table of the index whose term is asked for (or begins with what is asked), with the asked word as `asked`.

    Only buckets of the asked words are read. With prefix, a word shorter than two characters would have no bucket and is an error.
    """
    if prefix and any(len(q) < _HEAD for q in asked):
        raise ValueError(f"a prefix has at least {_HEAD} characters")
    near = lambda q: F.startswith("term", F.lit(q)) if prefix else F.col("term") == q
    found, word = F.lit(False), None
    for q in asked:
        hit = (F.col("bucket") == bucket_of(F.lit(q))) & near(q)
        found = found | hit
        word = F.when(hit, q) if word is None else word.when(hit, q)
    if prefix:  # a term may begin with several of the asked words
        words = F.filter(F.array(*(F.when(near(q), q) for q in asked)), lambda w: w.isNotNull())
        return df.where(found).withColumn("asked", F.explode(words))
    return df.where(found).withColumn("asked", word)


def bm25(spark: SparkSession, path: str, query: list[str], prefix: bool = False) -> DataFrame:
    """(id, score): BM25 of the query's words over the index; with prefix a word also stands for all words it begins, as one.

    Repeated words count once; words that no document has add nothing; an index without documents gives no rows.
    """
    asked = sorted(set(query))
    if not asked:
        return spark.createDataFrame([], "id long, score double")
    hits = matching(postings(spark, path), asked, prefix).groupBy("id", "asked").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    if prefix:  # documents of several matching terms count once
        df = hits.groupBy("asked").agg(F.count(F.lit(1)).alias("df"))
    else:
        df = matching(spark.read.schema(_TERM).parquet(f"{path}/terms"), asked).groupBy("asked").agg(F.sum("df").alias("df"))
    totals = spark.read.schema(_TOTAL).parquet(f"{path}/totals").agg(F.sum("docs").alias("n"), (F.sum("length") / F.sum("docs")).alias("avgdl"))
    known = F.broadcast(df.crossJoin(totals))  # a row for each asked word
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(known, "asked").groupBy("id").agg(F.sum(weight * gain).alias("score"))
