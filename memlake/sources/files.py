"""File trees as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPET = 4096
SNIFFED = 8192
#: Extension to language, "unknown" for others (fixed values).
LANGUAGES = {
    "rs": "rust", "toml": "toml", "json": "json", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript",
    "py": "python", "go": "go", "md": "markdown", "mdx": "markdown", "yml": "yaml", "yaml": "yaml", "html": "html", "css": "css", "sql": "sql",
}
#: Files that describe a project (fixed values).
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod")
SECRET_NAME = r"(?i)^(\.env(\..*)?|.*\.pem|.*\.key|id_rsa.*)$"
PREVIEW_LINES = 12


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def looks_binary(content: Column) -> Column:
    """Whether a zero byte lies in the first bytes."""
    return F.contains(F.substring(content, 1, SNIFFED).cast("string"), F.lit("\x00"))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[F.regexp_extract(path, r"\.([^./]+)$", 1)], F.lit("unknown"))


def read_tree(spark: SparkSession, root: str, most_bytes: int = 1 << 20, skip: tuple[str, ...] = (".git", "node_modules", "target")) -> DataFrame:
    """(path, size, modified, language, sha256, snippet, manifest) of each text file under root.

    Files over most_bytes, in skipped folders, of secret names or with a zero byte near their start are left out, and so are
    files of no bytes, which Spark's reader skips. The size filter is pushed to the source, so large files are never read.
    manifest holds the first lines of a project's description as a JSON array, else null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    for folder in skip:
        files = files.where(~F.col("path").contains(f"/{folder}/"))
    files = files.where(~base_name(F.col("path")).rlike(SECRET_NAME)).where(~looks_binary(F.col("content")))
    snippet = F.expr(f"make_valid_utf8(CAST(substring(content, 1, {SNIPPET}) AS STRING))")
    lines = F.slice(F.split(F.col("snippet"), "\n"), 1, PREVIEW_LINES)
    return (
        files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), language(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"), snippet.alias("snippet"))
        .withColumn("manifest", F.when(base_name(F.col("path")).isin(*MANIFESTS), F.to_json(lines)))
    )
