"""A sparse index of stored positions, so that a seek opens a few files and scans none of the others."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.sources.batches import read_events


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files below a folder, from the listing that any read of it makes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).inputFiles()


def _plain(path: str) -> str:
    """One spelling of a path, whose blanks and slashes a listing and a row's metadata write differently."""
    return re.sub(r"^(\w+:)/+", r"\1/", unquote(path))


def update_index(spark: SparkSession, store: str, index: str, order: str = "line_no") -> int:
    """Add the store's new files to the index; returns how many.  Run it after each write.

    A row per stream and file: the first and last position, the earliest and latest log time, and the number of rows.  Only files that
    the index lacks are read, and of those only the stream, position and time columns.
    """
    try:
        known = {_plain(r.file) for r in spark.read.parquet(index).select("file").toLocalIterator()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = set()
    new = [f for f in _files(spark, store) if _plain(f) not in known]
    if new:
        rows = spark.read.option("basePath", store).parquet(*new)
        rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("stream_id").cast("string").alias("stream_id")).agg(
            F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("rows"),
        ).coalesce(1 + len(new) // 1000).write.mode("append").parquet(index)
    return len(new)


def _holding(index: DataFrame, id: int | None, ts: int | None) -> DataFrame:
    """Per stream the files that may hold the first position sought.

    Positions of files may overlap and times need not ascend: of the files that hold some row sought, those that begin after another
    has surely given one are left out.
    """
    fit = F.lit(True)
    if id is not None:
        fit = fit & (F.col("last_id") >= id)
    if ts is not None:
        fit = fit & (F.col("max_ts") >= ts)
    found = index.filter(fit)
    # A file gives a position no larger than its last one, if only one of the two conditions is set.
    sure = F.col("last_id") if id is None or ts is None else F.lit(None).cast("long")
    bound = found.groupBy("stream_id").agg(F.min(sure).alias("_bound"))
    return found.join(bound, "stream_id").filter(F.col("_bound").isNull() | (F.col("first_id") <= F.col("_bound"))).select("stream_id", "file")


def seek(spark: SparkSession, store: str, index: str, id: int | None = None, ts: int | None = None, order: str = "line_no", streams: list[str] | None = None) -> DataFrame:
    """Per stream the first stored position at or after ``id`` and, in stored order, the first with a log time of ``ts`` or later.

    Log time may step back inside a stream; then the first row in the order of positions counts, not the least time.  Streams without such a
    row are left out.  Returns (stream_id, position, ts).
    """
    entries = spark.read.parquet(index)
    entries = entries if streams is None else entries.filter(F.col("stream_id").isin(streams))
    files = [r.file for r in _holding(entries, id, ts).select("file").distinct().toLocalIterator()]
    rows = spark.read.option("basePath", store).parquet(*files) if files else spark.read.parquet(store).limit(0)
    rows = rows.withColumn("stream_id", F.col("stream_id").cast("string"))
    for column, least in ((order, id), ("ts", ts)):
        rows = rows if least is None else rows.filter(F.col(column) >= least)
    rows = rows if streams is None else rows.filter(F.col("stream_id").isin(streams))
    return rows.groupBy("stream_id").agg(F.min(order).alias("position"), F.min_by("ts", order).alias("ts"))


def read_range(spark: SparkSession, store: str, index: str, from_id: int | None = None, to_id: int | None = None, from_ts: int | None = None, to_ts: int | None = None, order: str = "line_no") -> DataFrame:
    """Stored events of a range of positions and log times, ends included, from the files that can hold any."""
    fit = F.lit(True)
    for column, least in (("last_id", from_id), ("max_ts", from_ts)):
        fit = fit if least is None else fit & (F.col(column) >= least)
    for column, most in (("first_id", to_id), ("min_ts", to_ts)):
        fit = fit if most is None else fit & (F.col(column) <= most)
    files = [r.file for r in spark.read.parquet(index).filter(fit).select("file").distinct().toLocalIterator()]
    return read_events(spark, store, from_ts=from_ts, to_ts=to_ts, from_id=from_id, to_id=to_id, order=order, files=files)
