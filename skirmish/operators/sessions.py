"""Play sessions, marks, zone instances and the segments they cut the timeline into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import names, times
from skirmish.operators.ordered import SPAN, Carry, as_of, scan, segment, stage

KEYS = ["stream_id"]

# Fixed values.
SESSION_GAP = 3600
CREATE_SECS = 600
SPLIT_SECS = 60
RUN_STRIDE = 1_000_000
ACTIVE_IDLE = 30
HOUR = 3_600


def batch_by_second(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """One batch per log second: event count, first line and last line."""
    return events.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("events"), F.min(order).alias("first_line"), F.max(order).alias("last_line"),
        F.max(F.col("k") == "login").alias("login"),
    )


def split_batches(batch_events: DataFrame, keys: list[str], secs: int = SPLIT_SECS) -> DataFrame:
    """Window number of each event inside its batch, counted from the batch's own minimum.

    A batch spanning at most ``secs`` stays whole.  Windows have no upper number.
    """
    spans = batch_events.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    rows = batch_events.join(spans, keys)
    slot = F.expr(f"(ts - _lo) div {int(secs)}")
    return rows.withColumn(
        "slot", F.when(F.col("_hi") - F.col("_lo") <= secs, F.lit(0)).otherwise(slot).cast("long")
    ).drop("_lo", "_hi")


def throttle_heartbeats(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """At most one heartbeat per log second; none before the first time of the log."""
    hb = F.col("k") == "hb"
    first = events.filter(hb & (F.col("ts") != 0)).groupBy(*keys, "ts").agg(F.min(order).alias(order)).select(*keys, order)
    return events.filter(~F.coalesce(hb, F.lit(False))).unionByName(events.filter(hb).join(first, [*keys, order], "left_semi"))


def sessionize(
    batches: DataFrame, gap: int = SESSION_GAP, keys: list[str] = KEYS, order: str = "id", login: Column | None = None, span: int | None = SPAN
) -> DataFrame:
    """Session number of each stored batch: cut at a login, or a jump of the log clock.

    The jump is measured against the previous stored batch; going backwards never cuts.
    Batches without a log time belong to the session running at that point.
    """
    login = F.lit(False) if login is None else F.coalesce(login, F.lit(False))
    return segment(
        batches, keys, order,
        state=F.struct(F.col("log_ts").alias("ts"), login.alias("login")),
        cut=lambda prev, cur: cur["login"] | (cur["ts"] - prev["ts"] >= gap),
        member=F.col("log_ts").isNotNull(), span=span, start="session_start", num="session",
    ).withColumn("session", F.greatest("session", F.lit(1)))


def sessions(sessionized: DataFrame, keys: list[str] = KEYS, order: str = "id", offset: int = 0, span: int | None = SPAN) -> DataFrame:
    """Session table: first batch, start times, label, batch count, and end."""
    out = sessionized.groupBy(*keys, F.col("session").alias("num")).agg(
        F.min(order).alias("start_batch_id"),
        F.min_by(F.coalesce("log_ts", "wall_ts"), order).alias("start_log_ts"),
        F.min_by("wall_ts", order).alias("start_wall_ts"),
        F.max_by(F.coalesce("log_ts", "wall_ts"), order).alias("_last"),
        F.count(F.lit(1)).alias("batches"),
    )
    out = out.withColumn("label", times.session_label(F.col("start_log_ts"), offset))
    out = scan(out, keys, "num", [Carry("_next", "next", F.col("start_log_ts"))], span)
    out = out.withColumn("end_log_ts", F.coalesce("_next", "_last"))
    return out.withColumn("duration", F.greatest(F.col("end_log_ts") - F.col("start_log_ts"), F.lit(0))).drop("_next", "_last")


def assign_session(rows: DataFrame, sessions_: DataFrame, keys: list[str] = KEYS, order: str = "id", span: int = SPAN) -> DataFrame:
    """Add the number of the last session starting at or before each row."""
    return as_of(rows, sessions_, keys, order, "start_batch_id", "session", F.col("num"), span)


def resolve_session(sessions_: DataFrame, which: str | int, keys: list[str] = KEYS) -> DataFrame:
    """Window of ``"latest"`` or of a number: start, and the next start (null when open).

    Streams without that session are left out, which means their whole timeline.
    """
    rows = scan(sessions_, keys, "num", [Carry("until", "next", F.col("start_log_ts"))])
    if str(which).lower() == "latest":
        last = sessions_.groupBy(*keys).agg(F.max("num").alias("num"))
        rows = rows.join(last, [*keys, "num"], "left_semi")
    else:
        rows = rows.filter(F.col("num") == int(which))
    return rows.select(*keys, "num", F.col("start_log_ts").alias("from_ts"), "until")


def in_window(rows: DataFrame, sessions_: DataFrame, start: int | None = None, end: int | None = None, session: str | int | None = None,
              keys: list[str] = KEYS, ts: str = "ts") -> DataFrame:
    """The rows of an explicit time range, else of a session, else all: an explicit bound beats the session.

    A stream without that session keeps its whole timeline.
    """
    if start is not None or end is not None or session is None:
        return time_range(rows, start, end, ts)
    window = resolve_session(sessions_, session, keys).select(*keys, F.col("from_ts").alias("_from"), F.col("until").alias("_until"))
    out = rows.join(window, keys, "left")
    inside = F.coalesce(F.col(ts) >= F.col("_from"), F.lit(True)) & F.coalesce(F.col(ts) < F.col("_until"), F.lit(True))
    return out.filter(inside).drop("_from", "_until")


def session_reanchor(sessions_: DataFrame, survivors: DataFrame, keys: list[str] = KEYS, order: str = "id") -> DataFrame:
    """Sessions after pruning: the newest one starting before the survivors moves to the first
    of them, earlier ones go; streams without survivors lose all."""
    first = survivors.groupBy(*keys).agg(F.min(order).alias("_min"))
    rows = sessions_.join(first, keys)
    keep = rows.filter(F.col("start_batch_id") <= F.col("_min")).groupBy(*keys).agg(F.max("num").alias("_keep"))
    return (
        rows.join(keep, keys, "left")
        .filter(F.col("_keep").isNull() | (F.col("num") >= F.col("_keep")))
        .withColumn("start_batch_id", F.when(F.col("num") == F.col("_keep"), F.greatest("start_batch_id", "_min")).otherwise(F.col("start_batch_id")))
        .drop("_min", "_keep")
    )


def client_runs(batches: DataFrame, keys: list[str] = KEYS, order: str = "id", span: int = SPAN) -> DataFrame:
    """Client run of each batch: ``seq`` 0 after anything else starts a new run."""
    return segment(
        batches, keys, order, state=F.struct(F.col("seq").alias("seq")),
        cut=lambda prev, cur: (cur["seq"] == 0) & (prev["seq"] != 0), span=span, start="run_start", num="run",
    ).withColumn("run_id_base", F.col("run") * RUN_STRIDE)


def dedupe_batches(batches: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Resent batches (same run, seq and log time) stored once, under their lowest id."""
    group = [*keys, "run", "seq", "log_ts"]
    first = batches.groupBy(*group).agg(F.min("id").alias("id")).select(*keys, "id")
    return batches.join(first, [*keys, "id"], "left_semi")


def marks(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """Raid and instance marks, at most one per second and kind (the first)."""
    rows = events.filter(F.col("k") == "raid_mark")
    return rows.groupBy(*keys, "ts", "kind").agg(F.min_by("label", order).alias("label"), F.min(order).alias(order))


def zone_instance_changes(parsed: DataFrame, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """``instance`` marks: arrivals in an instanced zone other than the current one.

    A zone counts as instanced when its entry line carries a tier, or when the log owner
    created an instance of it under ten minutes before; the first entry after a creation
    takes its number.  A creation also makes the next entry count even into the same zone.
    """
    p = F.col("pattern")
    rows = parsed.filter(p.isin("instance_create", "instance_enter", "zone_enter"))
    create = (p == "instance_create") & (F.lower("src") == F.lower("player"))
    rows = rows.filter(create | (p != "instance_create"))
    made = F.when(create, F.struct(F.col(order).alias("line"), F.col("ts").alias("ts"), F.col("zone_text").alias("zone"), F.col("zone_num").alias("num")))
    rows = scan(rows.withColumn("_made", made), keys, order, [Carry("_c", "last", F.col("_made"), inclusive=False)], span)
    c = F.col("_c")
    fits = F.coalesce(F.col("zone_text").startswith(c["zone"]) & (F.col("ts") - c["ts"] < CREATE_SECS), F.lit(False))
    # The pending creation is used up by the first tiered entry, or the first plain entry that fits.
    uses = (p == "instance_enter") | ((p == "zone_enter") & fits)
    rows = rows.withColumn("_uses", uses & c.isNotNull())
    rows = scan(rows, keys, order, [Carry("_used", "last", F.when(F.col("_uses"), c["line"]), inclusive=False)], span)
    pending = c.isNotNull() & ~F.coalesce(F.col("_used") == c["line"], F.lit(False))
    tiered, plain = p == "instance_enter", (p == "zone_enter") & pending & fits
    rows = rows.withColumns({"_plain": plain, "_numbered": pending & fits, "_enter": tiered | plain})
    rows = segment(
        rows, keys, order, state=F.struct(F.col("zone_text").alias("zone"), F.col("_plain").alias("plain")),
        cut=lambda prev, cur: cur["plain"] | (prev["zone"] != cur["zone"]),
        member=F.col("_enter"), breaker=F.col("_made").isNotNull(), span=span, start="_at", num="_nth",
    )
    base = F.when(F.col("_plain"), F.col("zone_text")).otherwise(names.instance_label(F.col("zone_text")))
    label = F.when(F.col("_numbered"), F.concat(base, F.lit(" #"), F.col("_c.num").cast("string"))).otherwise(base)
    return rows.filter(F.col("_enter") & (F.col("_at") == F.col(order))).select(
        *keys, order, "ts", F.lit("raid_mark").alias("k"), F.lit("instance").alias("kind"), label.alias("label"))


def segments(sessions_: DataFrame, marks_: DataFrame, keys: list[str] = KEYS, span: int | None = HOUR) -> DataFrame:
    """Timeline of each stream: sessions, and inside them raids and zone instances.

    Every session start and mark opens a segment that lasts to the next one; ``raid_end`` opens
    an ordinary stretch.  Marks come after a session start of the same second.  The last segment
    stays open (null ``end_ts``) and is kept even when nothing follows.
    """
    rank = F.when(F.col("kind") == "session", 0).when(F.col("kind") == "raid_end", 1).when(F.col("kind") == "raid_start", 2).otherwise(3)
    rows = sessions_.select(*keys, F.col("start_log_ts").alias("start_ts"), F.lit("session").alias("kind"), "label").unionByName(
        marks_.select(*keys, F.col("ts").alias("start_ts"), "kind", "label"))
    rows = rows.withColumn("_pos", F.col("start_ts") * 4 + rank).groupBy(*keys, "_pos").agg(
        F.first("start_ts").alias("start_ts"), F.first("kind").alias("kind"), F.min("label").alias("label"))
    return scan(rows, keys, "_pos", [Carry("end_ts", "next", F.col("start_ts")), Carry("segment", "sum", F.lit(1).cast("long"))], span and span * 4).drop("_pos")


# Scopes by level: what opens one, and what ends it.
_LEVELS = {
    "session": ("session", ("session",)),
    "raid": ("raid_start", ("session", "raid_start", "raid_end")),
    "instance": ("instance", ("session", "instance")),
}


def nested_scopes(sessions_: DataFrame, marks_: DataFrame, keys: list[str] = KEYS, span: int | None = HOUR) -> DataFrame:
    """Sessions, raids and zone instances as scopes that hold each other: (keys, level, scope, start_ts, end_ts, label).

    A raid lasts to the next raid mark and a zone instance to the next instance, both at most to the next session, so
    an instance does not cut the raid it happens in.  ``scope`` counts each level from 1; a null ``end_ts`` is open.
    """
    rank = F.when(F.col("kind") == "session", 0).when(F.col("kind") == "raid_end", 1).when(F.col("kind") == "raid_start", 2).otherwise(3)
    rows = sessions_.select(*keys, F.col("start_log_ts").alias("start_ts"), F.lit("session").alias("kind"), "label").unionByName(
        marks_.select(*keys, F.col("ts").alias("start_ts"), "kind", "label"))
    rows = rows.groupBy(*keys, (F.col("start_ts") * 4 + rank).alias("_pos"), "start_ts", "kind").agg(F.min("label").alias("label"))
    out = []
    for level, (opens, ends) in _LEVELS.items():
        opening = F.col("kind") == opens
        part = scan(rows.filter(F.col("kind").isin(*ends)), keys, "_pos", [
            Carry("end_ts", "next", F.col("start_ts")), Carry("scope", "sum", F.when(opening, F.lit(1).cast("long")))], span and span * 4)
        out.append(part.filter(opening).select(*keys, F.lit(level).alias("level"), "scope", "start_ts", "end_ts", "label"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def assign_scopes(rows: DataFrame, scopes: DataFrame, keys: list[str] = KEYS, ts: str = "ts", span: int | None = HOUR) -> DataFrame:
    """Add ``session``, ``raid`` and ``instance``: the scope of each level that holds the row, null outside all."""
    value = F.struct(F.col("end_ts").alias("e"), F.col("scope").alias("v"))
    starts = scopes.filter(F.col("end_ts").isNull() | (F.col("end_ts") > F.col("start_ts"))).select(
        *keys, (F.col("start_ts") * 2).cast("long").alias("_pos"), F.col("level").alias("_level"), value.alias("_val"))
    both = rows.withColumns({"_pos": (F.col(ts) * 2 + 1).cast("long"), "_left": F.lit(True)}).unionByName(starts, allowMissingColumns=True)
    # Scopes of several levels may start together; a carry sees one level, and every row comes after them.
    out = scan(both, keys, "_pos", [Carry(f"_{x}", "last", F.when(F.col("_level") == x, F.col("_val"))) for x in _LEVELS], span and span * 2).filter("_left")
    held = lambda x: F.when(x["e"].isNull() | (F.col(ts) < x["e"]), x["v"])
    return out.withColumns({x: held(F.col(f"_{x}")) for x in _LEVELS}).drop("_pos", "_left", "_level", "_val", *[f"_{x}" for x in _LEVELS])


def number_pulls(rows: DataFrame, within: list[str], keys: list[str] = KEYS, pull: str = "pull", span: int | None = SPAN) -> DataFrame:
    """Add ``number``: pulls counted from 1 in every scope of ``within`` (columns of scopes) of the stream."""
    some = rows.select(*keys, *within, pull).filter(F.col(pull).isNotNull()).distinct()
    # Null scopes are a scope of their own.
    safe = [F.coalesce(F.col(c), F.lit(-1)).alias(f"_{c}") for c in within]
    by = [*keys, *[f"_{c}" for c in within]]
    numbered = scan(some.select(*keys, *safe, pull), by, pull, [Carry("number", "sum", F.lit(1).cast("long"))], span)
    return rows.select("*", *safe).join(numbered, [*by, pull], "left").drop(*[f"_{c}" for c in within])


def assign_scope(rows: DataFrame, scopes: DataFrame, keys: list[str] = KEYS, ts: str = "ts", span: int | None = HOUR, scope: str = "segment") -> DataFrame:
    """Add the scope whose window ``[start_ts, end_ts)`` holds each row; null outside all.

    Windows of one stream do not overlap, so the latest start decides.
    """
    value = F.struct(F.col("start_ts").alias("s"), F.col("end_ts").alias("e"), F.col(scope).alias("v"))
    out = as_of(rows, scopes.filter(F.col("end_ts").isNull() | (F.col("end_ts") > F.col("start_ts"))), keys, ts, "start_ts", "_scope", value, span)
    inside = F.col("_scope").isNotNull() & (F.col("_scope.e").isNull() | (F.col(ts) < F.col("_scope.e")))
    return out.withColumn(scope, F.when(inside, F.col("_scope.v"))).drop("_scope")


def all_scopes(rows: DataFrame, scopes: DataFrame, keys: list[str] = KEYS, ts: str = "ts", scope: str = "segment") -> DataFrame:
    """Every row with every scope whose window ``[start_ts, end_ts)`` holds it; rows outside all are left out.

    Windows may overlap in any way, as raids that several viewers marked.  A join on equal keys, not on a range: a window of up to
    2^n seconds lies in at most two buckets of that width, so windows are listed under their own width and the buckets they touch,
    and a row looks once in each width that occurs.  A window without end lies in one bucket that holds all time.  However long a window, it is
    listed twice at most; a stream with many rows or windows spreads over its buckets.  A null or empty window holds nothing.
    """
    start, end = F.col("start_ts"), F.col("end_ts")
    open_ = F.lit(63)
    width = F.when(end.isNull(), open_).otherwise(F.greatest(F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))), F.lit(0))).cast("int")
    windows = scopes.filter(start.isNotNull() & (end.isNull() | (end > start))).select(*keys, "start_ts", "end_ts", scope, width.alias("_width"))
    bucket = lambda t, w: F.when(w == open_, F.lit(0).cast("long")).otherwise(F.floor(t / F.pow(F.lit(2.0), w)).cast("long"))
    w = F.col("_width")
    listed = windows.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(start, w), bucket(F.coalesce(end, start + 1) - 1, w)))))
    widths = [r["_width"] for r in windows.select("_width").distinct().collect()]
    name = F.explode(F.array(*[F.struct(F.lit(x).alias("_width"), bucket(F.col(ts), F.lit(x)).alias("_bucket")) for x in widths] or [F.lit(None).cast("struct<_width:int,_bucket:bigint>")]))
    seen = rows.filter(F.col(ts).isNotNull()).withColumn("_at", name).select("*", "_at._width", "_at._bucket").drop("_at")
    met = seen.join(listed.withColumnsRenamed({"start_ts": "_start", "end_ts": "_end"}), [*keys, "_width", "_bucket"])
    return met.filter((F.col(ts) >= F.col("_start")) & (F.col("_end").isNull() | (F.col(ts) < F.col("_end")))).drop("_width", "_bucket", "_start", "_end")


def scope_totals(rows: DataFrame, scopes: DataFrame, value: str, keys: list[str] = KEYS, ts: str = "ts", span: int = HOUR, scope: str = "segment") -> DataFrame:
    """Rows and the sum of whole numbers ``value`` in every scope ``[start_ts, end_ts)``: (keys, scope, rows, total); none for a scope without rows.

    As :func:`all_scopes` with an aggregate, but no row meets a scope: what a scope holds is what came before its end less what
    came before its start.  The work grows with rows and scopes, however many scopes hold a row.
    """
    start, end = F.col("start_ts"), F.col("end_ts")
    seconds = rows.filter(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_m"), F.sum(F.col(value).cast("decimal(20,0)")).alias("_v"))
    windows = scopes.filter(start.isNotNull() & (end.isNull() | (end > start)))
    # A window without end is read off after all time.
    after = F.lit((1 << 62) - 1).cast("long")
    bounds = windows.select(*keys, scope, F.inline(F.array(
        F.struct(start.cast("long").alias("_t"), F.lit(-1).alias("_sign")), F.struct(F.coalesce(end.cast("long"), after).alias("_t"), F.lit(1).alias("_sign")))))
    times_ = bounds.groupBy(*keys, "_t").agg(F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_m"), F.lit(0).cast("decimal(30,0)").alias("_v"))
    line = seconds.withColumn("_v", F.coalesce(F.col("_v").cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))).unionByName(times_)
    line = stage(line.groupBy(*keys, "_t").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"), F.sum("_v").cast("decimal(30,0)").alias("_v"), F.max(F.col("_n") == 0).alias("_bound")))
    run = scan(line, keys, "_t", [Carry(f"_r{c}", "sum", F.col(f"_{c}"), inclusive=False) for c in "nmv"], span)
    met = bounds.join(run.filter("_bound").select(*keys, "_t", "_rn", "_rm", "_rv"), [*keys, "_t"])
    less = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("_sign"))
    out = met.groupBy(*keys, scope).agg(less("_rn").alias("rows"), less("_rm").alias("_m"), less("_rv").alias("_v"))
    return out.filter("rows > 0").select(*keys, scope, "rows", F.when(F.col("_m") > 0, F.col("_v").cast("long")).alias("total"))


def marker_pairs(marks_: DataFrame, keys: list[str] = KEYS, span: int = HOUR) -> DataFrame:
    """Raid windows: each ``raid_start`` to the next raid mark of its stream, open at the end."""
    rows = marks_.filter(F.col("kind").isin("raid_start", "raid_end"))
    rows = rows.withColumn("_pos", F.col("ts") * 2 + (F.col("kind") == "raid_start").cast("long"))
    rows = scan(rows, keys, "_pos", [Carry("end_ts", "next", F.col("ts"))], span * 2)
    return rows.filter(F.col("kind") == "raid_start").select(*keys, F.col("ts").alias("start_ts"), "end_ts", "label")


def time_range(rows: DataFrame, start: int | None, end: int | None, ts: str = "ts") -> DataFrame:
    """Rows between two log times, both included; either side may be open."""
    out = rows if start is None else rows.filter(F.col(ts) >= start)
    return out if end is None else out.filter(F.col(ts) <= end)


def last_lines(rows: DataFrame, n: int, order: str = "line_no", keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows, in order; with ``keys`` the last ``n`` of each, limited before the shuffle."""
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return rows.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def fight_window(damage: DataFrame, deaths: DataFrame | None = None, by: list[str] = KEYS) -> DataFrame:
    """First damage, and the end: the last death when all mobs of the scope died, else the last damage."""
    out = damage.groupBy(*by).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))
    if deaths is not None:
        ends = deaths.groupBy(*by).agg(F.max("slain_ts").alias("_end"), F.min(F.col("slain_ts").isNotNull()).alias("_all"))
        out = out.join(ends, by, "left").withColumn("last_ts", F.when(F.col("_all"), F.greatest("_end", "start_ts")).otherwise(F.col("last_ts"))).drop("_end", "_all")
    return out.withColumn("elapsed", F.col("last_ts") - F.col("start_ts"))
