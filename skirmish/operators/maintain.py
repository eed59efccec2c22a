"""Retention and edits of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.operators.ordered import Carry, scan, stage
from skirmish.operators.sessions import sessionize, session_reanchor, sessions

KEYS = ["stream_id"]


def _stamp():
    return F.coalesce("log_ts", "wall_ts")


def cutoff_of(now: int, days: int | None = None, before: int | None = None) -> int:
    """Cutoff from exactly one of an age in days and a moment."""
    if (days is None) == (before is None):
        raise ValueError("give exactly one of days and before")
    return before if before is not None else now - days * 86_400


def prune(batches: DataFrame, cutoff: int, streams: list[str] | None = None) -> DataFrame:
    """Batches that stay: log time (or arrival time) at or after the cutoff."""
    gone = _stamp() < cutoff
    return batches.filter(~(gone & F.col("stream_id").isin(streams)) if streams is not None else ~gone)


def prune_markers(markers: DataFrame, cutoff: int) -> DataFrame:
    return markers.filter(F.col("ts") >= cutoff)


def prune_store(spark: SparkSession, path: str, cutoff: int) -> None:
    """Prune an event store in place: only the folders of the day of the cutoff are rewritten,
    earlier days are dropped whole.  Dynamic overwrite replaces exactly the folders written."""
    df = spark.read.parquet(path)
    day = F.to_date(F.timestamp_add("SECOND", F.lit(cutoff), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    edge = df.filter((F.col("log_date") == day) & (F.col("ts") >= cutoff))
    old = [r["log_date"] for r in df.filter(F.col("log_date") < day).select("log_date").distinct().collect()]
    edge = stage(edge)
    at_edge = stage(df.filter(F.col("log_date") == day).select("stream_id").distinct())
    edge.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "log_date").parquet(path)
    _delete_folders(spark, path, [f"stream_id=*/log_date={d}" for d in old])
    edge_day = spark.range(1).select(day.alias("d")).first()["d"]
    emptied = at_edge.join(edge.select("stream_id").distinct(), "stream_id", "left_anti")
    for r in emptied.toLocalIterator():  # folder names only; the rows stay on the cluster
        _delete_folders(spark, path, [f"stream_id={r['stream_id']}/log_date={edge_day}"])


def _delete_folders(spark: SparkSession, path: str, globs: list[str]) -> None:
    jvm = spark._jvm
    for g in globs:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{g}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for st in fs.globStatus(p) or []:
            fs.delete(st.getPath(), True)


def purge_stream(spark: SparkSession, path: str, stream_id: str) -> None:
    """Delete all of one stream's rows: its folder."""
    _delete_folders(spark, path, [f"stream_id={stream_id}"])


def repair_sessions(sessions_: DataFrame, survivors: DataFrame) -> DataFrame:
    return session_reanchor(sessions_, survivors)


def rebuild_sessions(existing: DataFrame, batches: DataFrame) -> DataFrame:
    """Sessions from stored batches for streams that have none; others keep theirs."""
    todo = batches.join(existing.select("stream_id").distinct(), "stream_id", "left_anti")
    todo = todo.withColumn("log_ts", _stamp())
    fresh = sessions(sessionize(todo))
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same key; names are compared in lower case.  Of several new rows of a key the greatest stays."""
    low = rows.withColumn("name", F.lower("name")) if "name" in keys else rows
    rest = [c for c in table.columns if c not in keys]
    if rest:
        low = low.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
    else:
        low = low.select(*keys).distinct()
    return table.join(low.select(*keys), keys, "left_anti").unionByName(low.select(*table.columns))


def delete(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    low = rows.withColumn("name", F.lower("name")) if "name" in keys else rows
    return table.join(low.select(*keys), keys, "left_anti")


def add_markers(markers: DataFrame, fresh: DataFrame) -> DataFrame:
    """New markers with the next ids of their stream, at most one per second and kind."""
    new = fresh.dropDuplicates(["stream_id", "ts", "kind"]).join(markers.select("stream_id", "ts", "kind"), ["stream_id", "ts", "kind"], "left_anti")
    top = markers.groupBy("stream_id").agg(F.max("id").alias("_top"))
    # Kinds of one second follow each other by name, numbered inside their second.
    at = Window.partitionBy("stream_id", "ts").orderBy("kind")
    new = new.withColumns({"_place": F.row_number().over(at), "_of": F.count("*").over(Window.partitionBy("stream_id", "ts"))})
    seconds = new.groupBy("stream_id", "ts").agg(F.max("_of").alias("_of"))
    upto = scan(seconds, ["stream_id"], "ts", [Carry("_upto", "sum", F.col("_of"))], 1 << 24).select("stream_id", "ts", "_upto")
    new = new.join(upto, ["stream_id", "ts"]).withColumn("_n", F.col("_upto") - F.col("_of") + F.col("_place"))
    new = new.join(top, "stream_id", "left").withColumn("id", F.coalesce("_top", F.lit(0)) + F.col("_n"))
    return markers.unionByName(new.select(*markers.columns))


def retention(spark: SparkSession, path: str, now: int, days: int) -> None:
    """The scheduled job: prune every stream to the last ``days`` days."""
    prune_store(spark, path, cutoff_of(now, days=days))
