"""Queries that are one SQL text, with the few words that differ between Spark and the oracle as macros."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memlake.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MACROS = {
    # name: (Spark, oracle)
    "SEC": ("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {0})", "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', {0})"),
    "K": ("CAST(regexp_extract({0}, '([0-9]+)', 1) AS BIGINT)", "CAST(regexp_extract({0}, '([0-9]+)', 1) AS BIGINT)"),
    "L": ("CAST({0} AS BIGINT)", "CAST({0} AS BIGINT)"),
    "R": ("ROUND(CAST({0} AS DOUBLE), 6)", "ROUND(CAST({0} AS DOUBLE), 6)"),
    "HAS": ("contains({0}, '{1}')", "contains({0}, '{1}')"),
    "MATCHES": ("({0} RLIKE '{1}')", "regexp_matches({0}, '{1}')"),
    "REPL": ("regexp_replace({0}, '{1}', '{2}')", "regexp_replace({0}, '{1}', '{2}', 'g')"),
}


def dialect(sql: str, side: int) -> str:
    """sql with $NAME<<a||b>> replaced; macros may nest."""
    pattern = re.compile(r"\$([A-Z]+)<<((?:(?!<<|>>).)*)>>", re.S)
    while pattern.search(sql):
        sql = pattern.sub(lambda m: MACROS[m[1]][side].format(*m[2].split("||")), sql)
    return sql


def spark_query(sql: str):
    text = dialect(sql, 0)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not used:
            return spark.sql(text)
        return spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?!\()", r"{\1}", text), **{t: table(spark, sf_dir, t) for t in used})

    return run
