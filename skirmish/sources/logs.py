"""Log files as rows of ``(stream_id, player, server, source_file, line_no, raw)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.names import player_from_filename, server_from_filename

# Chunk width for ordered operators over ``line_no`` of files: it counts about two per byte.
FILE_SPAN = 1 << 28

LOG_GLOB = "eqlog_*.txt"


def _identity():
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    return [
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stream_id"),
        player_from_filename(path).alias("player"),
        server_from_filename(path).alias("server"),
        name.alias("source_file"),
    ]


def read_logs(spark: SparkSession, path: str, pattern: str | None = LOG_GLOB) -> DataFrame:
    """All lines of the log files under a folder, or of one file; empty lines are dropped.

    Files are split into blocks and read in parallel; ``line_no`` orders the lines of a file
    and has gaps.
    """
    reader = spark.read
    if pattern and not path.endswith(".txt"):
        reader = reader.option("pathGlobFilter", pattern)
    # Rows of a task are numbered in reading order.  A task holds less than two splits' worth of
    # bytes and so of rows, hence twice the block offset plus the row number is in file order.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line_no = (F.col("_metadata.file_block_start") * 2 + row).alias("line_no")
    rows = reader.text(path).select(*_identity(), line_no, F.make_valid_utf8(F.col("value")).alias("raw"))
    return rows.filter(F.col("raw") != "")


def list_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files with their size, from file listing alone."""
    reader = spark.read.format("binaryFile")
    if not path.endswith(".txt"):
        reader = reader.option("pathGlobFilter", LOG_GLOB)
    return reader.load(path).select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("source_file"), player_from_filename(F.col("path")).alias("player"),
        server_from_filename(F.col("path")).alias("server"), "length", "modificationTime")


# Lines that a streamed chunk may hold.
CHUNK_LINES = 1 << 20


def stream_logs(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of closed log chunks as they arrive in a folder.

    The file source delivers a file once, so a shipper must rotate chunks rather than append, at
    most ``CHUNK_LINES`` lines each; a longer one is an error.  ``line_no`` holds the chunk's number and the line's place in
    it.  The number is the digits before ``.txt`` when the shipper counts its chunks (``eqlog_P_S.17.txt``), else the file time in
    milliseconds; a shipper that may close two chunks of a stream in one millisecond must count them.
    """
    reader = spark.readStream.option("pathGlobFilter", LOG_GLOB).option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    counted = F.regexp_extract("_metadata.file_name", r"\.(\d+)\.txt$", 1).try_cast("long")
    at = F.coalesce(counted, F.unix_millis("_metadata.file_modification_time"))
    lines = F.posexplode(F.split(F.make_valid_utf8(F.col("value")), "\r?\n")).alias("_pos", "raw")
    rows = reader.text(path).select(*_identity(), at.alias("_at"), lines)
    line_no = F.when(F.col("_pos") < CHUNK_LINES, F.col("_at") * CHUNK_LINES + F.col("_pos")).otherwise(F.raise_error(F.concat(F.lit("too many lines in "), "source_file")))
    rows = rows.select("stream_id", "player", "server", "source_file", line_no.alias("line_no"), "raw")
    return rows.filter(F.col("raw") != "")
