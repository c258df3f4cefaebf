"""The vector query against its SQL on made rows with close groups and unsound vectors."""

import duckdb
import numpy as np

from memlake.llm import queries


def test_links_and_components_equal_the_sql(spark, tmp_path):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(30, 64))
    rows = [(k, np.float32(middle[k % 30] + 0.18 * rnd.normal(size=64)).astype(float).tolist(), None if k % 50 == 0 else k % 30 // 15) for k in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[3][1], 0), (904, rows[3][1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(c.execute(queries.ORACLE_SQL["op5_vector_dedup"]).fetchall())
    got = queries.op5_vector_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] for r in want) > 100
