"""Event traces and memory packs as JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id string, run_id string, ts timestamp, kind string, schema_version int, payload string, origin string, hlc string"
#: Event kinds that a sync batch may carry (fixed values).
SYNCED = ("memory.accepted", "memory.proposed", "memory.rejected", "memory.invalidated", "memory.restored", "memory.corrected", "memory.cited", "memory.superseded")
#: One hybrid clock reading: 13 digits of milliseconds, 10 of a counter, the node (fixed format).
HLC = "%013d.%010d.%s"


class BrokenTrace(ValueError):
    """A trace holds a line that is no event."""


def read_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of JSON-lines traces, one row an event_id (its first by ts, then hlc).

    A crash may cut a file's last line short: where that line is broken and has no closing brace it is left out. Any other line that
    is no event (no JSON object, or no event_id) raises BrokenTrace; only their number reaches the driver. Blank lines are skipped,
    a file without lines gives no rows, and the payload stays JSON text.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")).where("trim(value) <> ''")
    parsed = lines.withColumn("e", F.from_json("value", EVENT + ", broken string", {"columnNameOfCorruptRecord": "broken"}))
    bad = F.col("e").isNull() | F.col("e.broken").isNotNull() | F.col("e.event_id").isNull()
    cut = bad & ~F.rtrim("value").endswith("}")
    files = parsed.groupBy("file").agg(F.count_if(bad).alias("n"), F.max(F.struct("at", cut.alias("cut"))).alias("last"))
    n = files.agg(F.sum(F.col("n") - F.col("last.cut").cast("int"))).first()[0]
    if n:
        raise BrokenTrace(f"{n} broken lines")
    return first_by_id(parsed.where(~bad).select("e.*").drop("broken"))


def first_by_id(events: DataFrame) -> DataFrame:
    """One row an event_id: the first by (ts, hlc). A partial aggregate, so repeated ids shrink before the shuffle."""
    rest = [c for c in events.columns if c not in ("event_id", "ts", "hlc")]
    return events.groupBy("event_id").agg(F.min(F.struct("ts", "hlc", *rest)).alias("r")).select("event_id", "r.*").select(*events.columns)


def append_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def export_batch(events: DataFrame, since: Column | str, kinds: tuple[str, ...] = SYNCED) -> DataFrame:
    """Events after the cursor of the kinds that may leave, their payloads redacted; the next cursor is their greatest hlc."""
    from memlake.functions.text import redact

    cursor = since if isinstance(since, Column) else F.lit(since)
    return events.where((F.col("hlc") > cursor) & F.col("kind").isin(*kinds)).withColumn("payload", redact(F.col("payload")))


def import_batch(known: DataFrame, batch: DataFrame, kinds: tuple[str, ...] = SYNCED) -> DataFrame:
    """The events of a batch that are new: of an allowed kind, of no known event_id, one each, and one a superseded pair."""
    new = first_by_id(batch.where(F.col("kind").isin(*kinds)).join(known.select("event_id"), "event_id", "left_anti").select(*batch.columns))
    pair = F.when(F.col("kind") == "memory.superseded", F.concat_ws(">", F.get_json_object("payload", "$.memory_id"), F.get_json_object("payload", "$.survivor_id"))).otherwise(F.col("event_id"))
    keyed = new.withColumn("pair", pair)
    return keyed.groupBy("kind", "pair").agg(F.min(F.struct("hlc", "event_id", *(c for c in new.columns if c not in ("hlc", "event_id", "kind")))).alias("r")).select("kind", "r.*").select(*new.columns)


def read_pack(spark: SparkSession, paths: str | list[str], entry: str = "scope string, kind string, text string, confidence double") -> DataFrame:
    """Memories of packs: an object with `memories`, or a bare array of them. One file is one pack."""
    whole = spark.read.text(paths, wholetext=True)
    both = F.coalesce(F.from_json("value", f"memories array<struct<{_fields(entry)}>>")["memories"], F.from_json("value", f"array<struct<{_fields(entry)}>>"))
    return whole.select(F.explode(both).alias("m")).select("m.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in ddl.split(",")))


def hlc(millis: Column, counter: Column, node: Column) -> Column:
    """A clock reading whose text order is its causal order."""
    return F.format_string(HLC, millis.cast("long"), counter.cast("long"), node)


def parse_hlc(text: Column) -> Column:
    """struct(millis, counter, node); null where the text is no reading."""
    part = lambda n: F.regexp_extract(text, r"^(\d{13})\.(\d{10})\.(.+)$", n)
    return F.when(part(3) != "", F.struct(part(1).cast("long").alias("millis"), part(2).cast("long").alias("counter"), part(3).alias("node")))


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds in the first ten characters of a ULID (Crockford's base 32, public format)."""
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    value = F.aggregate(F.split(F.substring(F.upper(ulid), 1, 10), ""), F.lit(0).cast("long"), lambda s, c: s * 32 + (F.position(c, F.lit(digits)) - 1).cast("long"))
    return F.when(F.upper(ulid).rlike(f"^[{digits}]{{10}}"), value)


def seq_within(events: DataFrame, key: str) -> DataFrame:
    """Causal order within a key: (hlc, event_id)."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("hlc", "event_id")))
