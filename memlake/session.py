"""Session helpers: builder, code shipping and shared work folders."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 2 << 20  # of a batch between Spark and Python; batches of long texts would else be tens of MB on both sides

_shipped: set[str] = set()
_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app: str = "memlake", cpus: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of any cluster, once per application, and keep their batches small."""
    sc = spark.sparkContext
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="memlake"), "memlake_src.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def _bytes(text: str) -> int:
    """Bytes of a setting such as 64m or 67108864b."""
    number = text.lower().rstrip("b").rstrip("kmg")
    unit = text.lower().rstrip("b")[len(number) :]
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose executors could not see it, that is an error.
    """
    app = spark.sparkContext.applicationId
    base = _folders.get(app) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _folders[app] = tempfile.mkdtemp(prefix="memlake-ck")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this application has written with `written`; DataFrames that read them end with it."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, moved: bool = True) -> DataFrame:
    """df written to the shared folder in as many buckets of `key` as the session has shuffle partitions, so that joins on it don't move it again.

    moved: rows go to a task for each bucket first; else each task writes a file for each bucket it has rows of, which suits few rows of many bytes.
    """
    spark = df.sparkSession
    n, path = partitions(spark), work_dir(spark, name)
    label = "memlake_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    (df.repartition(n, key) if moved else df).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(label)
    return spark.table(label)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_stamp(df: DataFrame) -> str:
    """Names, sizes and times of the files a DataFrame reads: changes when any of them does. Looked up on the driver, no data is read."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return "\n".join(out)
