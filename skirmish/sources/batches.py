"""Event batches: the wire JSON, the stored table, and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One wide row for every event kind.
EVENT = (
    "k STRING, ts BIGINT, mob BIGINT, src STRING, tgt STRING, dmg BIGINT, amt BIGINT, typ STRING, sp STRING, "
    "tank BOOLEAN, mods INT, killer STRING, name STRING, classes ARRAY<STRING>, level INT, owner STRING, "
    "kind STRING, label STRING, copper BIGINT, item STRING, qty BIGINT, result STRING, off BOOLEAN"
)
BATCH = f"seq BIGINT, events ARRAY<STRUCT<{EVENT.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' BOOLEAN', ': BOOLEAN').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY')}>>, _bad STRING"

# Event kinds with a meaning; others are kept as inert rows.
KINDS = [
    "melee", "spell", "dot", "rip", "ds", "heal", "slay", "cast", "miss", "absorb", "resist", "who", "fizzle", "pet",
    "login", "raid_mark", "currency_loot", "item_loot", "item_sell", "item_hoard", "item_enhance", "item_merge", "cc", "hb",
]


def _parsed(df: DataFrame, column: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return df.withColumn("_b", F.from_json(F.col(column), BATCH, options))


def read_event_batches(df: DataFrame, column: str = "batch") -> DataFrame:
    """One row per event of the batch JSON in ``column``, with its position.

    Unknown kinds stay as rows with time 0 and no payload; text that is no batch yields nothing
    here and one row in :func:`rejected_batches`.
    """
    return events_of(_parsed(df, column), column)


def events_of(parsed: DataFrame, column: str = "batch") -> DataFrame:
    """:func:`read_event_batches` on rows parsed already."""
    rows = parsed.filter(F.col("_b._bad").isNull() & F.col("_b.events").isNotNull())
    keep = [c for c in parsed.columns if c not in (column, "seq", "_b")]
    out = rows.select(*keep, F.col("_b.seq").alias("seq"), F.posexplode("_b.events").alias("pos", "e")).select(*keep, "seq", "pos", "e.*")
    known = F.col("k").isin(KINDS)
    return out.withColumn("ts", F.when(known, F.col("ts")).otherwise(F.lit(0).cast("long")))


def rejected_batches(df: DataFrame, column: str = "batch") -> DataFrame:
    """Rows whose text is not a batch."""
    return rejects_of(_parsed(df, column))


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("_b").isNull() | F.col("_b._bad").isNotNull() | F.col("_b.events").isNull()).drop("_b")


def max_log_ts(df: DataFrame, column: str = "batch") -> DataFrame:
    """Add ``log_ts``, the largest event time of each batch; null without one."""
    times = F.filter(F.transform(F.col("_b.events"), lambda e: e["ts"]), lambda t: t > 0)
    return _parsed(df, column).withColumn("log_ts", F.array_max(times)).drop("_b")


def to_batches(events: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON batch per stream and log second, events in line order."""
    fields = [c.split()[0] for c in EVENT.split(", ")]
    e = F.struct(F.col("line_no"), F.struct(*[F.col(f) for f in fields if f in events.columns]).alias("e"))
    out = events.groupBy(*keys, "ts").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("events"))
    return out.select(*keys, F.col("ts").alias("log_ts"), F.to_json(F.struct(F.lit(0).alias("seq"), "events")).alias("batch"))


def with_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("log_date", F.to_date(F.timestamp_add("SECOND", F.col(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))))


def write_events(events: DataFrame, path: str, mode: str = "append", span: int = 1 << 22) -> None:
    """Append events to the store, by stream and log day.

    Rows are spread over (stream, day) plus a slice of ``span`` line numbers, so that one busy day
    is written by several tasks, each into few files.  Pass ``FILE_SPAN`` for lines read from files.
    """
    rows = with_date(events).withColumn("_slice", F.expr(f"line_no div {int(span)}"))
    rows = rows.repartition("stream_id", "log_date", "_slice").sortWithinPartitions("stream_id", "log_date", "line_no").drop("_slice")
    rows.write.mode(mode).partitionBy("stream_id", "log_date").parquet(path)


def read_events(
    spark: SparkSession, path: str, streams: list[str] | None = None, from_ts: int | None = None, to_ts: int | None = None,
    from_id: int | None = None, to_id: int | None = None, order: str = "line_no", files: list[str] | None = None,
) -> DataFrame:
    """Stored events of some streams and of a range of log time or of positions, ends included.

    The stream and the day select folders; time and position are pushed to Parquet.  Reads what :func:`write_events`
    wrote and what a stream ingested.  ``files`` are those to read, of all, see :mod:`skirmish.sources.positions`.
    """
    df = spark.read.parquet(path).limit(0) if files == [] else spark.read.option("basePath", path).parquet(*(files or [path]))
    df = df.withColumn("stream_id", F.col("stream_id").cast("string")).drop("epoch")
    if from_id is not None:
        df = df.filter(F.col(order) >= from_id)
    if to_id is not None:
        df = df.filter(F.col(order) <= to_id)
    day = lambda t: F.to_date(F.timestamp_add("SECOND", F.lit(t), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    if streams is not None:
        df = df.filter(F.col("stream_id").isin(streams))
    if from_ts is not None:
        df = df.filter((F.col("log_date") >= day(from_ts)) & (F.col("ts") >= from_ts))
    if to_ts is not None:
        df = df.filter((F.col("log_date") <= day(to_ts)) & (F.col("ts") <= to_ts))
    return df


def import_legacy_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Batches of a JSON-lines export, and the malformed rows (to count or keep)."""
    schema = "wall_ts BIGINT, log_ts BIGINT, seq BIGINT, batch STRING, _bad STRING"
    raw = spark.read.text(path).filter(F.trim("value") != "")
    rows = raw.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("r._bad").isNull() & F.col("r.wall_ts").isNotNull() & F.col("r.batch").isNotNull()
    good = rows.filter(ok).select("r.wall_ts", F.coalesce("r.log_ts", F.lit(0)).alias("log_ts"), F.coalesce("r.seq", F.lit(0)).alias("seq"), "r.batch")
    return good, rows.filter(~F.coalesce(ok, F.lit(False))).select("value")
