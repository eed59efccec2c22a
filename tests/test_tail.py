import random
import tempfile

from pyspark.sql import functions as F

from skirmish.sources.tail import tail_logs

STAMP = "[Fri Feb 27 22:{:02d}:00 2026] "


def collect(spark, folder, out, cp, **kw):
    q = tail_logs(spark, folder, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).orderBy("source_file", "line_no").collect()


def test_growing_file(spark):
    """Appended lines, a half line, many splits, a restart, a file begun anew, bytes that are no text."""
    folder, out, cp = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    path = f"{folder}/eqlog_Izzin_rivervale.txt"
    r = random.Random(1)
    lines = [STAMP.format(0) + "x" * r.randint(0, 90) + f" {i}" for i in range(200)]
    with open(path, "w", newline="") as f:
        f.write("".join(x + ("\r\n" if i % 3 else "\n") for i, x in enumerate(lines[:120])) + "\n" + lines[120][:20])
    got = collect(spark, folder, out, cp, split_bytes=64)
    assert [x.raw for x in got] == lines[:120]
    assert {(x.stream_id, x.player, x.server, x.source_file) for x in got} == {("eqlog_Izzin_rivervale", "Izzin", "rivervale", "eqlog_Izzin_rivervale.txt")}
    with open(path, "ab") as f:
        f.write((lines[120][20:] + "\n" + "".join(x + "\n" for x in lines[121:])).encode() + b"caf\xe9\nnot yet")
    got = collect(spark, folder, out, cp, split_bytes=64)
    assert [x.raw for x in got] == [*lines, "caf\ufffd"]
    assert len({x.line_no for x in got}) == 201
    # Begun anew, at first shorter, then longer than before.
    with open(path, "w") as f:
        f.write(STAMP.format(5) + "new\n")
    got = collect(spark, folder, out, cp)
    assert got[-1].raw == STAMP.format(5) + "new" and len(got) == 202
    with open(path, "w") as f:
        f.writelines(STAMP.format(9) + f"again {i}\n" for i in range(2))
    with open(f"{folder}/eqlog_Al_x.txt", "w") as f:
        f.write("no stamp\n")
    with open(f"{folder}/other.txt", "w") as f:
        f.write("not a log\n")
    got = collect(spark, folder, out, cp)
    assert [x.raw for x in got] == ["no stamp", *lines, "caf\ufffd", STAMP.format(5) + "new", STAMP.format(9) + "again 0", STAMP.format(9) + "again 1"]


def test_no_line_limit_and_empty_folder(spark):
    folder, out, cp = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    with open(f"{folder}/eqlog_B_x.txt", "w") as f:
        f.write("y" * 3_000_000 + "\n" + "a\n" * 1_200_000)
    got = tail_logs(spark, folder).groupBy("stream_id").agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("longest"))
    q = got.writeStream.outputMode("complete").format("memory").queryName("tailed").trigger(processingTime="100 milliseconds").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("tailed").collect()] == [("eqlog_B_x", 1_200_001, 3_000_000)]


def test_large_backlog_has_wider_splits():
    """The splits of a batch stay few, cover every byte once, and small backlogs keep the width asked for."""
    from skirmish.sources.tail import _Tail

    tail = _Tail({"path": "/tmp", "splitBytes": "65536"})
    end = {"a": [10**10, "x", 0], "b": [3 * 10**9, "y", 0], "c": [70_000, "z", 0]}
    parts = tail.partitions({"b": [10**9, "y", 0]}, end)
    assert len(parts) <= 512 + 3
    for path, first in (("a", 0), ("b", 10**9), ("c", 0)):
        mine = [(p.start, p.stop) for p in parts if p.path == path]
        assert mine[0][0] == first and mine[-1][1] == end[path][0] and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
    assert [(p.start, p.stop) for p in tail.partitions({}, {"c": end["c"]})] == [(0, 65536), (65536, 70_000)]
