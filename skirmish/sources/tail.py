"""Growing log files as a stream: complete lines only, from the byte where the last batch ended."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skirmish.functions.names import player_from_filename, server_from_filename
from skirmish.sources.logs import LOG_GLOB

_BLOCK = 1 << 20
# Splits of one batch, beyond one for each file; those of a larger backlog are wider.
_TASKS = 512
# Bits of a line number that hold the byte in the file; the rest is the minute in which the log began.
_BYTES = 36
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_STAMP = re.compile(rb"\[\w{3} (\w{3}) +(\d+) (\d\d):(\d\d):\d\d (\d{4})\]")
_SCHEMA = "path string, line_no long, raw string"


def _minute(line: bytes) -> int:
    """Minutes since 1970 of the line's stamp, months as of 31 days: enough to tell logs apart and to order them; 0 without a stamp."""
    m = _STAMP.match(line)
    month = _MONTHS.get(m[1].decode()) if m else None
    return 0 if month is None else ((((int(m[5]) - 1970) * 12 + month) * 31 + int(m[2]) - 1) * 24 + int(m[3])) * 60 + int(m[4])


class _Split(InputPartition):
    """Lines of a file that start in a range of bytes; ``end`` of the range is that of a line if it is ``last``."""

    def __init__(self, path: str, start: int, stop: int, end: int, first: int, minute: int):
        self.path, self.start, self.stop, self.end, self.first, self.minute = path, start, stop, end, first, minute


class _Tail(DataSourceStreamReader):
    """Offsets are, per file, the end of its last complete line, a hash of its first line, and the minute that line names."""

    def __init__(self, options: dict):
        self.system, self.folder = fs.FileSystem.from_uri(options["path"])
        self.pattern = options.get("pattern", LOG_GLOB)
        self.split = int(options.get("splitBytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.pattern) and info.size:
                try:
                    with self.system.open_input_file(info.path) as f:
                        end = self._last_line(f, info.size)
                        if end:
                            head = next(_lines(f, 0, 1, end))[1]
                            found[info.path] = [end, xxhash.xxh64_hexdigest(head), _minute(head)]
                except FileNotFoundError:  # gone since it was listed
                    continue
        return found

    @staticmethod
    def _last_line(f: pa.NativeFile, size: int) -> int:
        """The end of the last complete line among the first ``size`` bytes."""
        while size > 0:
            start = max(0, size - _BLOCK)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for path, (stop, head, minute) in sorted(end.items()):
            begun, known, _ = start.get(path, [0, head, minute])
            # Another first line, or an end before the last one: the file was begun anew.
            first = begun if known == head and begun <= stop else 0
            ranges.append((path, first, stop, minute))
        # A large backlog has wider splits rather than more and more tasks.
        width = max(self.split, sum(stop - first for _, first, stop, _ in ranges) // _TASKS)
        return [_Split(path, a, min(a + width, stop), stop, first, minute) for path, first, stop, minute in ranges for a in range(first, stop, width)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        p = partition
        numbers, texts, size = [], [], 0
        with self.system.open_input_file(p.path) as f:
            for at, line in _lines(f, p.start, p.stop, p.end, inside=p.start > p.first):
                text = line.rstrip(b"\r").decode("utf-8", "replace")
                if text:
                    numbers.append(p.minute << _BYTES | at)
                    texts.append(text)
                    size += len(line)
                if size >= _BLOCK:
                    yield self._batch(p.path, numbers, texts)
                    numbers, texts, size = [], [], 0
        yield self._batch(p.path, numbers, texts)

    @staticmethod
    def _batch(path: str, numbers: list[int], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["path", "line_no", "raw"])


def _lines(f: pa.NativeFile, start: int, stop: int, end: int, inside: bool = False) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the complete lines before ``end`` that start in [start, stop); ``inside``: a line may reach over ``start``."""
    at = start - 1 if inside else start
    f.seek(at)
    rest = b""
    while at < stop:
        block = f.read(min(_BLOCK, end - at - len(rest)))
        if not block:
            return
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if start <= at < stop:
                yield at, line
            at += len(line) + 1


class GrowingLogs(DataSource):
    """Streaming source ``growing_logs``; see :func:`tail_logs`."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


def tail_logs(spark: SparkSession, path: str, pattern: str = LOG_GLOB, split_bytes: int = 64 << 20) -> DataFrame:
    """Lines of the growing log files of a folder, as they are completed: (stream_id, player, server, source_file, line_no, raw).

    A batch reads each file from the byte where the last one ended to its last line end; the half line behind it waits.  A file
    that became shorter or got another first line was begun anew and is read from its start.  New bytes are
    read in splits of ``split_bytes``, or wider ones where there would be over 512, so a large backlog spreads over tasks; nothing bounds the lines of a file.  ``line_no`` is the byte where
    the line starts, below the minute of the log's first stamp, so lines of a log that was begun anew come after those before;
    two logs begun in one minute, or without stamps, would share numbers.  Empty lines are dropped, and bytes that are no text become marks.

    The folder (a local path, or a URI that Arrow's file systems know) must be one that driver and executors share.
    """
    spark.dataSource.register(GrowingLogs)
    rows = spark.readStream.format("growing_logs").option("path", path).option("pattern", pattern).option("splitBytes", split_bytes).load()
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stream_id"), player_from_filename(F.col("path")).alias("player"),
                       server_from_filename(F.col("path")).alias("server"), name.alias("source_file"), "line_no", "raw")
