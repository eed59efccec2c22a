"""Queries that run as streams: two runs over growing input, state kept in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import times
from skirmish.operators import aggregates as A
from skirmish.operators import instances as I
from skirmish.operators.ordered import stage
from skirmish.operators.parse import match_lines, parse_coverage
from skirmish.plans.q_chat import LOOP_RULES, LOOP_SEED, LOOP_SQL
from skirmish.plans.q_parse import _COV
from skirmish.plans.q_time import folder
from skirmish.plans.registry import query
from skirmish.plans.render import EPOCH, base_events, combat_events, combat_lines, order_batches
from skirmish.plans.sql import BATCH, EV, INST, big
from skirmish.sources import batches as B
from skirmish.sources.tail import tail_logs
from skirmish.streaming import live

GAP = 150 * 86400


def _twice(spark: SparkSession, df: DataFrame, first, build, mode: str = "append") -> DataFrame:
    """Feed the rows where ``first`` holds, then the rest, to one stream, and read its sink."""
    live.use_rocksdb(spark)
    src, out, cp = folder(spark), folder(spark), folder(spark)
    for part in (first, ~first):
        df.filter(part).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(df.schema).parquet(src))
        with live.sized(spark):
            q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def _in_order(spark: SparkSession, df: DataFrame, build, rows: int = 2_000_000, order: str = "line_no", numbers: DataFrame | None = None, same: bool = False) -> DataFrame:
    """Feed the rows to one stream in the order of their lines, two runs at least and at most about ``rows`` rows each, and read its sink.

    A micro-batch holds the rows of a stream together, so its size is bounded here, and the memory of a task with it.  ``numbers`` has the lines'
    numbers where that is less work than to make the rows.  With ``same`` the stream is built for the first run and started again for the others.
    """
    live.use_rocksdb(spark)
    src, out, cp = folder(spark), folder(spark), folder(spark)
    numbers = (df if numbers is None else numbers).select(order)
    n = max(2, -(-numbers.count() // rows))
    cuts = sorted({int(x) for x in numbers.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n)})
    at, stream = F.col(order), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.filter(at >= low)
        (part if high is None else part.filter(at < high)).write.mode("append").parquet(src)
        if stream is None or not same:
            stream = build(spark.readStream.schema(df.schema).parquet(src))
        with live.sized(spark):
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def _merged(spark: SparkSession, df: DataFrame, first, build, keys: list[str]) -> DataFrame:
    """As ``_twice`` in output mode update: the last row of every key."""
    live.use_rocksdb(spark)
    src, out, cp = folder(spark), folder(spark), folder(spark)

    def write(rows, epoch):
        rows.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    for part in (first, ~first):
        df.filter(part).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(df.schema).parquet(src))
        with live.sized(spark):
            q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*keys, "v.*")


@query("stream_sessions", f"""WITH {BATCH}, p AS (SELECT *, lag(log_ts) OVER (PARTITION BY stream_id ORDER BY id) AS prev FROM bt)
SELECT CAST(stream_id AS VARCHAR) AS stream_id, id, log_ts, CAST(sum(CASE WHEN prev IS NULL OR login OR log_ts - prev >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY id) AS BIGINT) AS session FROM p""")
def stream_sessions(spark, sf):
    b = order_batches(spark, sf).select(F.col("stream_id").cast("string").alias("stream_id"), "id", "log_ts", "login")
    half = F.col("id") < b.count() // 2
    return _twice(spark, b, half, lambda s: live.stream_sessions(s, GAP))


@query("stream_instances", f"WITH {INST} SELECT stream_id, line_no, own AS mob FROM iv WHERE touch OR k = 'slay'")
def stream_instances(spark, sf):
    ev = combat_events(spark, sf).select("stream_id", "line_no", "ts", "k", "tgt", "off", "mob_name", "touch")
    return _in_order(spark, ev, lambda s: live.stream_instances(s, I.GAP))


@query("stream_lines_to_instances", f"WITH {INST} SELECT stream_id, line_no, own AS mob FROM iv WHERE touch OR k = 'slay'")
def stream_lines_to_instances(spark, sf):
    """Log text in, instances out: parsing, direction and instances as one stream of two chained states."""
    build = lambda s: live.stream_instances(live.stream_events(s, only=["off"]), I.GAP)
    # A run's lines lie close together in the table; dealt out, every core renders and parses some of them.
    lines = combat_lines(spark, sf, spark.sparkContext.defaultParallelism)
    return _in_order(spark, lines, build, numbers=base_events(spark, sf), same=True)


@query("tailed_lines", _COV)
def tailed_lines(spark, sf):
    """Log files that grow in number while a stream follows them, in small splits; every line once, whatever its pattern."""
    rows = combat_lines(spark, sf)
    src, out, cp = folder(spark), folder(spark), folder(spark)
    for part in (F.col("line_no") % 3 > 0, F.col("line_no") % 3 == 0):
        rows.filter(part).select("raw").write.mode("append").text(src)
        q = tail_logs(spark, src, "part-*", 1 << 16).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
        q.processAllAvailable()
        q.stop()
    return parse_coverage(match_lines(spark.read.parquet(out)))


@query("stream_seconds", f"WITH {EV} SELECT stream_id, ts, count(*) AS events, min(line_no) AS first_line FROM ev GROUP BY ALL")
def stream_seconds(spark, sf):
    """Seconds of a stream whose second half holds the early times: however late, no row is lost."""
    ev = combat_events(spark, sf).select("stream_id", "ts", "line_no")
    return _merged(spark, ev, F.col("ts") >= EPOCH + 10_000, live.batches_by_second, ["stream_id", "ts"])


@query("live_totals", f"WITH {EV} SELECT stream_id, src AS player, {big('dmg')} AS dmg, count(*) AS hits FROM dm GROUP BY ALL")
def live_totals(spark, sf):
    """Running totals, each micro-batch's changed rows merged into a table by key."""
    ev = combat_events(spark, sf).select("stream_id", "ts", "k", "src", "dmg", "tank")
    return _merged(spark, ev, F.col("ts") < EPOCH + 10_000, live.live_totals, ["stream_id", "player"])


@query("stream_ingest", f"WITH {EV} SELECT stream_id, k, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT stream_id, 'rejected', count(DISTINCT ts) FROM ev GROUP BY ALL")
def stream_ingest(spark, sf):
    """Batches with a broken copy of each; events to the store, the rest to the reject folder."""
    b = B.to_batches(combat_events(spark, sf), ["stream_id"])
    b = stage(b.unionByName(b.withColumn("batch", F.substring("batch", 1, 30))))
    src, store, rejects, cp = (folder(spark) for _ in range(4))
    for part in (F.col("log_ts") < EPOCH + 10_000, F.col("log_ts") >= EPOCH + 10_000):
        b.filter(part).write.mode("append").parquet(src)
        s = spark.readStream.schema(b.schema).parquet(src)
        live.ingest(s, store, rejects, cp).trigger(availableNow=True).start().awaitTermination()
    good = B.read_events(spark, store).groupBy("stream_id", "k").agg(F.count(F.lit(1)).alias("n"))
    bad = spark.read.schema("stream_id STRING, batch STRING").json(rejects).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad.select("stream_id", F.lit("rejected").alias("k"), "n"))


@query("stream_ingest_once", f"WITH {EV} SELECT stream_id, k, ts, count(*) AS n, sum(coalesce(dmg, 0)) AS dmg FROM ev WHERE ts BETWEEN {EPOCH + 3_000} AND {EPOCH + 15_000} GROUP BY ALL".replace("sum(coalesce(dmg, 0))", "CAST(sum(coalesce(dmg, 0)) AS BIGINT)"))
def stream_ingest_once(spark, sf):
    """Every batch sent in both halves of a stream, the second time resent; a time range of the store read back."""
    b = B.to_batches(combat_events(spark, sf), ["stream_id"]).withColumns({"run": F.lit(1), "seq": F.col("log_ts")})
    b = stage(b)
    src, store, rejects, cp = (folder(spark) for _ in range(4))
    live.use_rocksdb(spark)
    for part in (F.col("log_ts") < EPOCH + 10_000, F.col("log_ts") >= EPOCH + 5_000):
        b.filter(part).write.mode("append").parquet(src)
        s = spark.readStream.schema(b.schema).parquet(src)
        with live.sized(spark):
            q = live.ingest(s, store, rejects, cp).trigger(availableNow=True).start()
        q.awaitTermination()
    ev = B.read_events(spark, store, from_ts=EPOCH + 3_000, to_ts=EPOCH + 15_000)
    return ev.groupBy("stream_id", "k", "ts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("dmg", F.lit(0))).alias("dmg"))


@query("stream_dedupe", f"WITH {BATCH} SELECT id, log_ts FROM bt")
def stream_dedupe(spark, sf):
    """Every batch sent twice; the copies are dropped while the stream runs."""
    b = order_batches(spark, sf).select(F.col("stream_id").cast("string").alias("stream_id"), "id", "log_ts", "seq").withColumn("run", F.col("id"))
    return _twice(spark, b.unionByName(b), F.col("id") >= 0, live.drop_resent).select("id", "log_ts")


@query("replay_range", f"WITH {BATCH} SELECT id, log_ts FROM bt WHERE id BETWEEN 1000 AND 9000")
def replay_range(spark, sf):
    """A bounded range of stored batches, replayed as a stream that stops at its end."""
    b = order_batches(spark, sf).select("id", "log_ts")
    return _twice(spark, b, F.col("id") < 5000, lambda s: live.replay(s, 1000, 9000))


@query("stream_rules", LOOP_SQL)
def stream_rules(spark, sf):
    """Self-dependent rules in a stream fed twice; alerts with a delay leave by timers, so it runs on until they have."""
    rows = combat_lines(spark, sf).withColumn("ts", times.line_epoch(F.col("raw"))).select("stream_id", "line_no", "ts", "raw")
    live.use_rocksdb(spark)
    src, out, cp = folder(spark), folder(spark), folder(spark)
    for part in (F.col("ts") < EPOCH + 10_000, F.col("ts") >= EPOCH + 10_000):
        rows.filter(part).write.mode("append").parquet(src)
        stream = live.stream_rules(spark.readStream.schema(rows.schema).parquet(src), LOOP_RULES, seeds=LOOP_SEED)
        with live.sized(spark):
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        live.stop_when_idle(q, 0.5)
    return spark.read.parquet(out).select("stream_id", "line_no", "rule_id", "message", "fire_ts")


_RESET = 1704067200 + 12_000


@query("reset_scope", f"WITH {EV} SELECT stream_id, src AS player, {big('dmg')} AS dmg, count(*) AS hits, count(*) FILTER (mods % 2 = 1) AS crits, CAST(0 AS BIGINT) AS twincasts FROM dm WHERE ts >= {_RESET} GROUP BY ALL")
def reset_scope(spark, sf):
    """Totals since a reset; what is known about names stays."""
    return A.damage_by_player(A.since_reset(combat_events(spark, sf), _RESET))


