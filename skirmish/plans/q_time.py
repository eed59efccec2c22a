"""Queries over stored batches, sessions, segments, the stream registry and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skirmish.operators import aggregates as A
from skirmish.operators import maintain as M
from skirmish.operators import sessions as S
from skirmish.operators.ordered import shared_folder, span_for, stage
from skirmish.plans.registry import query
from skirmish.plans.render import EPOCH, combat_events, order_batches, streams
from skirmish.plans.sql import BATCH, EV, SESS, SESS_GAP, STREAM, big
from skirmish.sources import batches as B
from skirmish.sources import positions as P
from skirmish.sources import tables as T

_SPAN = 1 << 14
CUT = 852076800  # 1997-01-01
NOW = 1000000000


def folder(spark) -> str:
    """A fresh folder in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def sessioned(spark, sf, span=_SPAN):
    return S.sessionize(order_batches(spark, sf), SESS_GAP, login=F.col("login"), span=span)


def _session_table(spark, sf):
    """The sessions and the span of log times for what follows: None, and nothing staged, where every stream is one window."""
    span = span_for(order_batches(spark, sf), S.KEYS, _SPAN)
    if span is None:
        return S.sessions(sessioned(spark, sf, None), span=None), None
    return stage(S.sessions(sessioned(spark, sf))), 1 << 26


def _segments(spark, sf):
    ss, span = _session_table(spark, sf)
    return S.segments(ss, _marks(spark, sf), span=span), span


def _scopes(spark, sf):
    ss, span = _session_table(spark, sf)
    return stage(S.nested_scopes(stage(ss), _three_marks(spark, sf), span=span)), span


@query("sessionize", f"WITH {SESS} SELECT stream_id, id, log_ts, CAST(session AS BIGINT) AS session FROM sx")
def sessionize(spark, sf):
    return sessioned(spark, sf).select("stream_id", "id", "log_ts", "session")


_LABEL = "strftime(make_timestamp(start_log_ts * 1000000), '%b %-d, %Y')"


@query("session_summary", f"""WITH {SESS} SELECT stream_id, num, start_batch_id, start_log_ts, start_wall_ts, batches, {_LABEL} AS label, end_log_ts,
  greatest(end_log_ts - start_log_ts, 0) AS duration FROM ss""")
def session_summary(spark, sf):
    return S.sessions(sessioned(spark, sf))


@query("assign_session", f"WITH {SESS} SELECT stream_id, id, CAST(session AS BIGINT) AS session FROM sx")
def assign_session(spark, sf):
    """Batches find their session again in the stored session table."""
    ss = stage(S.sessions(sessioned(spark, sf)))
    return S.assign_session(order_batches(spark, sf), ss, span=_SPAN).select("stream_id", "id", "session")


@query("latest_session", f"WITH {SESS} SELECT stream_id, max(num) AS num, max_by(start_log_ts, num) AS from_ts, NULL::BIGINT AS until FROM ss GROUP BY ALL")
def latest_session(spark, sf):
    return S.resolve_session(stage(S.sessions(sessioned(spark, sf))), "latest")


@query("numbered_session", f"""WITH {SESS}, w AS (SELECT stream_id, num, start_log_ts AS from_ts, lead(start_log_ts) OVER (PARTITION BY stream_id ORDER BY num) AS until FROM ss)
SELECT * FROM w WHERE num = 2""")
def numbered_session(spark, sf):
    return S.resolve_session(stage(S.sessions(sessioned(spark, sf))), 2)


@query("session_window", f"""WITH {SESS}, w AS (SELECT stream_id, num, start_log_ts AS from_ts, lead(start_log_ts) OVER (PARTITION BY stream_id ORDER BY num) AS until FROM ss)
SELECT b.stream_id, b.id, b.log_ts FROM bt b LEFT JOIN (SELECT * FROM w WHERE num = 2) w USING (stream_id) WHERE coalesce(b.log_ts >= w.from_ts, true) AND coalesce(b.log_ts < w.until, true)""")
def session_window(spark, sf):
    """Batches of the second session; streams with fewer keep all."""
    rows = order_batches(spark, sf).select("stream_id", "id", "log_ts")
    return S.in_window(rows, stage(S.sessions(sessioned(spark, sf))), session=2, ts="log_ts")


@query("explicit_window", f"WITH {BATCH} SELECT stream_id, id, log_ts FROM bt WHERE log_ts >= {CUT}")
def explicit_window(spark, sf):
    """An explicit start beats the session asked for."""
    rows = order_batches(spark, sf).select("stream_id", "id", "log_ts")
    return S.in_window(rows, stage(S.sessions(sessioned(spark, sf))), start=CUT, session=2, ts="log_ts")


@query("store_positions", f"WITH {EV} SELECT stream_id, line_no, ts, k FROM ev WHERE line_no BETWEEN 1000 AND 4000")
def store_positions(spark, sf):
    """Stored events of a range of positions."""
    path = folder(spark)
    B.write_events(combat_events(spark, sf), path)
    return B.read_events(spark, path, from_id=1000, to_id=4000).select("stream_id", "line_no", "ts", "k")


@query("client_runs", f"""WITH {BATCH}, r AS (SELECT stream_id, id, seq, lag(seq) OVER (PARTITION BY stream_id ORDER BY id) AS p FROM bt)
SELECT stream_id, id, CAST(sum(CASE WHEN p IS NULL OR (seq = 0 AND p <> 0) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY id) AS BIGINT) AS run FROM r""")
def client_runs(spark, sf):
    return S.client_runs(order_batches(spark, sf), span=_SPAN).select("stream_id", "id", "run")


@query("dedupe_batches", f"WITH {BATCH} SELECT stream_id, id, seq, log_ts FROM bt")
def dedupe_batches(spark, sf):
    """Every batch is sent twice; the second copy has a later id."""
    b = order_batches(spark, sf).select("stream_id", "id", "seq", "log_ts").withColumn("run", F.col("id"))
    again = b.withColumn("id", F.col("id") + 1_000_000_000)
    return S.dedupe_batches(b.unionByName(again)).drop("run")


@query("session_reanchor", f"""WITH {SESS}, k AS (SELECT stream_id, min(id) AS m FROM bt WHERE log_ts >= {CUT} GROUP BY ALL),
j AS (SELECT ss.*, m, max(CASE WHEN start_batch_id <= m THEN num END) OVER (PARTITION BY stream_id) AS keep FROM ss JOIN k USING (stream_id))
SELECT stream_id, num, CASE WHEN num = keep THEN greatest(start_batch_id, m) ELSE start_batch_id END AS start_batch_id FROM j WHERE keep IS NULL OR num >= keep""")
def session_reanchor(spark, sf):
    b = order_batches(spark, sf)
    ss = S.sessions(sessioned(spark, sf))
    return M.repair_sessions(ss, M.prune(b, CUT)).select("stream_id", "num", "start_batch_id")


@query("prune", f"WITH {BATCH} SELECT stream_id, count(*) AS batches, min(log_ts) AS first FROM bt WHERE log_ts >= {CUT} GROUP BY ALL")
def prune(spark, sf):
    return M.prune(order_batches(spark, sf), M.cutoff_of(NOW, before=CUT)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("batches"), F.min("log_ts").alias("first"))


@query("rebuild_sessions", f"""WITH {BATCH}, p AS (SELECT *, lag(log_ts) OVER (PARTITION BY stream_id ORDER BY id) AS prev FROM bt WHERE stream_id NOT IN (SELECT stream_id FROM bt WHERE login)),
x AS (SELECT *, sum(CASE WHEN prev IS NULL OR log_ts - prev >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY id) AS num FROM p),
o AS (SELECT stream_id, min(log_ts) AS start_log_ts FROM bt WHERE login GROUP BY ALL)
SELECT stream_id, CAST(num AS BIGINT) AS num, min_by(log_ts, id) AS start_log_ts FROM x GROUP BY stream_id, num UNION ALL SELECT stream_id, 1, start_log_ts FROM o""")
def rebuild_sessions(spark, sf):
    """Streams with a login already have one session and keep it."""
    b = order_batches(spark, sf)
    old = b.filter("login").groupBy("stream_id").agg(F.min("log_ts").alias("start_log_ts")).select("stream_id", F.lit(1).cast("long").alias("num"), "start_log_ts")
    return M.rebuild_sessions(old, b)


@query("stream_stats", f"""WITH {BATCH} SELECT stream_id, count(*) AS batches, min_by(wall_ts, id) AS first_wall, max_by(wall_ts, id) AS last_wall,
  min_by(log_ts, id) AS first_log, max_by(log_ts, id) AS last_log FROM bt GROUP BY ALL""")
def stream_stats(spark, sf):
    return A.stream_stats(order_batches(spark, sf))


@query("liveness", f"""WITH {BATCH}, l AS (SELECT stream_id, max_by(log_ts, id) AS last_log FROM bt GROUP BY ALL)
SELECT *, {NOW} - last_log AS idle_secs, {NOW} - last_log <= 100000000 AS active FROM l""")
def liveness(spark, sf):
    return A.liveness(order_batches(spark, sf), NOW, 100_000_000)


@query("seek_by_time", f"WITH {BATCH} SELECT stream_id, min(id) AS id FROM bt WHERE log_ts >= {CUT} GROUP BY ALL")
def seek_by_time(spark, sf):
    """First stored batch at or after a log time, in stored order."""
    return order_batches(spark, sf).filter(F.col("log_ts") >= CUT).groupBy("stream_id").agg(F.min("id").alias("id"))


@query("seek_positions", f"WITH {EV} SELECT stream_id, min(line_no) AS position, min_by(ts, line_no) AS ts FROM ev WHERE ts >= {EPOCH + 9_000} GROUP BY ALL")
def seek_positions(spark, sf):
    """The first stored row of each stream at or after a time, through the position index; stored in parts that overlap."""
    store, index = folder(spark), folder(spark)
    ev = combat_events(spark, sf)
    for part in range(3):
        B.write_events(ev.filter(F.col("line_no") % 3 == part), store, span=1 << 11)
        P.update_index(spark, store, index)
    return P.seek(spark, store, index, ts=EPOCH + 9_000)


# Raids as several viewers marked them, from a minute to a day and some without end: windows that overlap.
_VIEWS = EV + """, vw AS (SELECT stream_id, line_no AS raid, ts AS start_ts, CASE WHEN line_no % 97 > 0 THEN ts + 60 * (1 + (line_no * 7919) % 1440) END AS end_ts FROM ev WHERE k = 'slay' AND line_no % 5 = 0)"""


@query("overlapping_raids", f"""WITH {_VIEWS} SELECT vw.stream_id, raid, count(*) AS hits, {big('dmg')} AS dmg FROM vw JOIN ev ON ev.stream_id = vw.stream_id AND ev.ts >= start_ts AND (end_ts IS NULL OR ev.ts < end_ts)
WHERE ev.k = 'spell' GROUP BY ALL""")
def overlapping_raids(spark, sf):
    """Spell damage inside every raid window that holds it, however the windows overlap."""
    ev = combat_events(spark, sf)
    start, n = F.col("ts"), F.col("line_no")
    raids = ev.filter((F.col("k") == "slay") & (n % 5 == 0)).select("stream_id", n.alias("raid"), start.alias("start_ts"), F.when(n % 97 > 0, start + 60 * (1 + (n * 7919) % 1440)).alias("end_ts"))
    hits = S.scope_totals(ev.filter("k = 'spell'").select("stream_id", "ts", "dmg"), raids, "dmg", scope="raid")
    return hits.withColumnsRenamed({"rows": "hits", "total": "dmg"})


# Marks from the batches: each one opens or closes a raid.
_MARKS = BATCH + """, mk AS (SELECT stream_id, log_ts AS ts, CASE WHEN id % 2 = 0 THEN 'raid_start' ELSE 'raid_end' END AS kind, min(CAST(id % 100 AS VARCHAR)) AS label
  FROM bt GROUP BY ALL)"""


def _marks(spark, sf):
    return order_batches(spark, sf).groupBy("stream_id", F.col("log_ts").alias("ts"), F.when(F.col("id") % 2 == 0, "raid_start").otherwise("raid_end").alias("kind")).agg(
        F.min((F.col("id") % 100).cast("string")).alias("label"))


_PAIRS = _MARKS + """, mp AS (SELECT *, lead(ts) OVER (PARTITION BY stream_id ORDER BY ts, kind) AS end_ts FROM mk)"""


@query("marker_pairs", f"WITH {_PAIRS} SELECT stream_id, ts AS start_ts, end_ts, label FROM mp WHERE kind = 'raid_start'")
def marker_pairs(spark, sf):
    return S.marker_pairs(_marks(spark, sf), span=1 << 26)


_SEGS = SESS + _MARKS[len(BATCH):] + f""", bo AS (SELECT stream_id, start_log_ts AS start_ts, 'session' AS kind, {_LABEL} AS label, 0 AS r FROM ss
  UNION ALL SELECT stream_id, ts, kind, label, CASE kind WHEN 'raid_end' THEN 1 ELSE 2 END FROM mk),
bo2 AS (SELECT stream_id, start_ts, kind, r, min(label) AS label FROM bo GROUP BY ALL),
sg AS (SELECT stream_id, start_ts, kind, label, lead(start_ts) OVER w AS end_ts, row_number() OVER w AS segment FROM bo2 WINDOW w AS (PARTITION BY stream_id ORDER BY start_ts, r))"""


@query("segments", f"WITH {_SEGS} SELECT * FROM sg")
def segments(spark, sf):
    return _segments(spark, sf)[0]


@query("assign_scope", f"""WITH {_SEGS}, f AS (SELECT * FROM sg WHERE end_ts IS NULL OR end_ts > start_ts)
SELECT bt.stream_id, bt.id, f.segment FROM bt ASOF LEFT JOIN f ON bt.stream_id = f.stream_id AND bt.log_ts >= f.start_ts""")
def assign_scope(spark, sf):
    """Segment of every batch, by log time."""
    seg, span = _segments(spark, sf)
    seg = seg if span is None else stage(seg)
    return S.assign_scope(order_batches(spark, sf), seg, ts="log_ts", span=span).select("stream_id", "id", "segment")


@query("segment_totals", f"""WITH {_SEGS}, f AS (SELECT * FROM sg WHERE end_ts IS NULL OR end_ts > start_ts),
j AS (SELECT bt.stream_id, f.segment, f.kind, bt.id FROM bt ASOF LEFT JOIN f ON bt.stream_id = f.stream_id AND bt.log_ts >= f.start_ts)
SELECT kind, count(*) AS batches FROM j GROUP BY ALL""")
def segment_totals(spark, sf):
    """Batches per kind of segment."""
    seg, span = _segments(spark, sf)
    seg = seg if span is None else stage(seg)
    rows = S.assign_scope(order_batches(spark, sf), seg, ts="log_ts", span=span, scope="kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("batches"))


def _three_marks(spark, sf):
    kind = F.element_at(F.array(F.lit("raid_start"), F.lit("raid_end"), F.lit("instance")), (F.col("id") % 3).cast("int") + 1)
    return order_batches(spark, sf).groupBy("stream_id", F.col("log_ts").alias("ts"), kind.alias("kind")).agg(F.min((F.col("id") % 100).cast("string")).alias("label"))


_NEST = SESS + f""", mk3 AS (SELECT stream_id, log_ts AS ts, CASE id % 3 WHEN 0 THEN 'raid_start' WHEN 1 THEN 'raid_end' ELSE 'instance' END AS kind, min(CAST(id % 100 AS VARCHAR)) AS label FROM bt GROUP BY ALL),
b3 AS (SELECT stream_id, start_log_ts AS start_ts, 'session' AS kind, {_LABEL} AS label, 0 AS r FROM ss UNION ALL SELECT stream_id, ts, kind, label, CASE kind WHEN 'raid_end' THEN 1 WHEN 'raid_start' THEN 2 ELSE 3 END FROM mk3),
b4 AS (SELECT stream_id, start_ts, kind, r, min(label) AS label FROM b3 GROUP BY ALL),
ns AS (""" + " UNION ALL ".join(
    f"""SELECT stream_id, '{level}' AS level, CAST(n AS BIGINT) AS scope, start_ts, end_ts, label FROM (
  SELECT *, lead(start_ts) OVER w AS end_ts, count(*) FILTER (kind = '{opens}') OVER w AS n FROM b4 WHERE kind IN {tuple(ends) if len(ends) > 1 else f"('{ends[0]}')"} WINDOW w AS (PARTITION BY stream_id ORDER BY start_ts, r)) WHERE kind = '{opens}'"""
    for level, (opens, ends) in S._LEVELS.items()) + ")"


@query("nested_scopes", f"WITH {_NEST} SELECT * FROM ns")
def nested_scopes(spark, sf):
    """Sessions, raids and instances that hold each other."""
    return S.nested_scopes(stage(S.sessions(sessioned(spark, sf))), _three_marks(spark, sf), span=1 << 26)


_IN = " ".join(
    f"ASOF LEFT JOIN (SELECT * FROM ns WHERE level = '{x}' AND (end_ts IS NULL OR end_ts > start_ts)) {x[0]} ON bt.stream_id = {x[0]}.stream_id AND bt.log_ts >= {x[0]}.start_ts" for x in S._LEVELS)
_VALS = ", ".join(f"CASE WHEN {x[0]}.end_ts IS NULL OR bt.log_ts < {x[0]}.end_ts THEN {x[0]}.scope END AS {x}" for x in S._LEVELS)


@query("raid_totals", f"WITH {_NEST}, x AS (SELECT bt.stream_id, {_VALS} FROM bt {_IN}) SELECT stream_id, raid, count(*) AS batches, count(DISTINCT instance) AS instances FROM x WHERE raid IS NOT NULL GROUP BY ALL")
def raid_totals(spark, sf):
    """Batches of every raid, over all the zone instances inside it."""
    sc, span = _scopes(spark, sf)
    rows = S.assign_scopes(order_batches(spark, sf), sc, ts="log_ts", span=span)
    return rows.filter("raid is not null").groupBy("stream_id", "raid").agg(F.count("*").alias("batches"), F.count_distinct("instance").alias("instances"))


@query("numbered_pulls", f"WITH {_NEST}, x AS (SELECT bt.stream_id, bt.id // 3 AS pull, {_VALS} FROM bt {_IN}), d AS (SELECT DISTINCT stream_id, session, raid, pull FROM x) SELECT *, row_number() OVER (PARTITION BY stream_id, session, raid ORDER BY pull) AS number FROM d")
def numbered_pulls(spark, sf):
    """Pulls (three batches each) counted anew in every session and raid."""
    sc, span = _scopes(spark, sf)
    rows = S.assign_scopes(order_batches(spark, sf).withColumn("pull", F.expr("id div 3")), sc, ts="log_ts", span=span)
    return S.number_pulls(stage(rows.select("stream_id", "session", "raid", "pull").distinct()), ["session", "raid"], span=span and 1 << 20)


@query("add_markers", f"""WITH {_MARKS}, old AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts) AS id FROM mk WHERE kind = 'raid_start'),
nw AS (SELECT *, coalesce((SELECT max(id) FROM old WHERE old.stream_id = mk.stream_id), 0) + row_number() OVER (PARTITION BY stream_id ORDER BY ts) AS id FROM mk WHERE kind = 'raid_end')
SELECT stream_id, id, ts, kind, label FROM old UNION ALL SELECT stream_id, id, ts, kind, label FROM nw""")
def add_markers(spark, sf):
    m = _marks(spark, sf)
    from pyspark.sql import Window

    old = m.filter("kind = 'raid_start'").withColumn("id", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts")).cast("long"))
    old = old.select("stream_id", "id", "ts", "kind", "label")
    return M.add_markers(old, m)


@query("edit_roster", f"""WITH {BATCH}, t AS (SELECT DISTINCT stream_id, 'pab' AS name, 'Pab' AS display FROM bt)
SELECT stream_id, name, CASE WHEN stream_id % 2 = 0 THEN 'PAB' ELSE display END AS display FROM t WHERE stream_id % 5 <> 0""")
def edit_roster(spark, sf):
    """Upsert on a lower-case name, then delete."""
    t = order_batches(spark, sf).select("stream_id").distinct().withColumns({"name": F.lit("pab"), "display": F.lit("Pab")})
    new = t.filter("stream_id % 2 = 0").withColumns({"name": F.lit("Pab"), "display": F.lit("PAB")})
    return M.delete(M.upsert(t, new, ["stream_id", "name"]), t.filter("stream_id % 5 = 0"), ["stream_id", "name"])


@query("stream_registry", f"""WITH {STREAM} SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY lower(game), lower(server), lower(player) ORDER BY public_stream DESC, updated_at DESC, stream_id) = 1""")
def stream_registry(spark, sf):
    return T.one_per_identity(streams(spark, sf))


@query("public_streams", f"WITH {STREAM} SELECT stream_id, player FROM st WHERE public_stream")
def public_streams(spark, sf):
    return T.find_public(streams(spark, sf)).select("stream_id", "player")


@query("stream_rollup", f"""WITH {STREAM}, s AS (SELECT *, lower(game) AS g, lower(server) AS s, lower(player) AS p FROM st)
SELECT CAST(3 AS INTEGER) AS level, min_by(game, stream_id) AS game, min_by(server, stream_id) AS server, min_by(player, stream_id) AS player, count(*) AS streams, max(updated_at) AS last_log FROM s GROUP BY g, s, p
UNION ALL SELECT 2, min_by(game, stream_id), min_by(server, stream_id), NULL, count(*), max(updated_at) FROM s GROUP BY g, s
UNION ALL SELECT 1, min_by(game, stream_id), NULL, NULL, count(*), max(updated_at) FROM s GROUP BY g
UNION ALL SELECT 0, NULL, NULL, NULL, count(*), max(updated_at) FROM s""")
def stream_rollup(spark, sf):
    st = streams(spark, sf)
    return A.stream_rollup(st, st.select("stream_id", F.col("updated_at").alias("last_log")))


_LIVE = "lv AS (SELECT stream_id, updated_at AS last_log, 1704080000 - updated_at AS idle_secs, 1704080000 - updated_at <= 6000 AS active FROM st)"


@query("siblings", f"""WITH {STREAM}, {_LIVE} SELECT a.stream_id, b.stream_id AS sibling, b.player, b.server, b.game, lv.idle_secs, lv.active
FROM st a JOIN st b ON a.owner_key = b.owner_key AND a.stream_id <> b.stream_id AND a.owner_key <> '' JOIN lv ON lv.stream_id = b.stream_id""")
def siblings(spark, sf):
    st = streams(spark, sf)
    live = st.select("stream_id", F.col("updated_at").alias("last_log"), (1704080000 - F.col("updated_at")).alias("idle_secs"))
    return A.siblings(st, live.withColumn("active", F.col("idle_secs") <= 6000))


@query("find_stream", f"WITH {STREAM} SELECT DISTINCT stream_id, player FROM st WHERE (lower(game), lower(server), lower(player)) IN (SELECT (lower(game), lower(server), lower(player)) FROM st WHERE is_replay)")
def find_stream(spark, sf):
    st = streams(spark, sf)
    want = st.filter("is_replay").select(F.upper("game").alias("game"), F.upper("server").alias("server"), F.upper("player").alias("player"))
    return A.find_stream(st, want).select("stream_id", "player")


@query("class_cache", f"""WITH {STREAM}, c AS (SELECT player AS name, min(game) AS a FROM st WHERE NOT public_stream GROUP BY ALL), f AS (SELECT player AS name, max(game) AS b FROM st WHERE public_stream GROUP BY ALL)
SELECT name, coalesce(b, a) AS classes FROM c FULL JOIN f USING (name)""")
def class_cache(spark, sf):
    st = streams(spark, sf)
    cache = st.filter("NOT public_stream").groupBy(F.col("player").alias("name")).agg(F.array(F.min("game")).alias("classes"))
    fresh = st.filter("public_stream").groupBy(F.col("player").alias("name")).agg(F.array(F.max("game")).alias("classes"))
    return A.update_class_cache(cache, fresh).withColumn("classes", F.element_at("classes", 1))


@query("event_batches", f"WITH {EV} SELECT stream_id, ts, k, src, tgt, coalesce(dmg, amt) AS amount, count(*) AS n FROM ev GROUP BY ALL")
def event_batches(spark, sf):
    """Events to one-second JSON batches and back."""
    b = B.to_batches(combat_events(spark, sf), ["stream_id"])
    return B.read_event_batches(b.drop("log_ts")).groupBy("stream_id", "ts", "k", "src", "tgt", F.coalesce("dmg", "amt").alias("amount")).agg(F.count(F.lit(1)).alias("n"))


@query("unknown_events", f"WITH {EV} SELECT stream_id, count(*) AS events, CAST(count(*) AS BIGINT) AS inert FROM ev GROUP BY ALL")
def unknown_events(spark, sf):
    """Events of a kind nobody knows stay as rows with time 0; text that is no batch is dropped."""
    ev = combat_events(spark, sf).withColumn("k", F.lit("time_travel"))
    b = B.to_batches(ev, ["stream_id"]).drop("log_ts")
    bad = b.withColumn("batch", F.substring("batch", 1, 30))
    return B.read_event_batches(b.unionByName(bad)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("ts") == 0).alias("inert"))


@query("rejected_batches", f"WITH {EV} SELECT stream_id, count(DISTINCT ts) AS rejected FROM ev GROUP BY ALL")
def rejected_batches(spark, sf):
    b = B.to_batches(combat_events(spark, sf), ["stream_id"]).drop("log_ts")
    bad = b.withColumn("batch", F.substring("batch", 1, 30))
    return B.rejected_batches(b.unionByName(bad)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("rejected"))


@query("max_log_ts", f"WITH {EV} SELECT stream_id, ts AS log_ts, count(DISTINCT ts) AS batches FROM ev GROUP BY ALL")
def max_log_ts(spark, sf):
    b = B.to_batches(combat_events(spark, sf), ["stream_id"]).drop("log_ts")
    return B.max_log_ts(b).groupBy("stream_id", "log_ts").agg(F.count(F.lit(1)).alias("batches"))


@query("event_store", f"WITH {EV} SELECT stream_id, k, count(*) AS n, {big('coalesce(dmg, 0)')} AS dmg FROM ev WHERE ts BETWEEN 1704070000 AND 1704080000 AND stream_id IN ('s1', 's2', 's5') GROUP BY ALL")
def event_store(spark, sf):
    """Events written by stream and day, then a range of three streams read back."""
    path = folder(spark)
    B.write_events(combat_events(spark, sf), path)
    ev = B.read_events(spark, path, ["s1", "s2", "s5"], 1704070000, 1704080000)
    return ev.groupBy("stream_id", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("dmg", F.lit(0))).alias("dmg"))


@query("pruned_store", f"WITH {EV} SELECT stream_id, count(*) AS n, min(ts) AS first FROM ev WHERE ts >= 1704078000 AND stream_id <> 's3' GROUP BY ALL")
def pruned_store(spark, sf):
    """The stored events after pruning at a moment and purging one stream."""
    path = folder(spark)
    B.write_events(combat_events(spark, sf), path)
    M.prune_store(spark, path, 1704078000)
    M.purge_stream(spark, path, "s3")
    return B.read_events(spark, path).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


@query("legacy_import", f"WITH {BATCH} SELECT wall_ts, CASE WHEN id % 4 = 0 THEN 0 ELSE log_ts END AS log_ts, seq FROM bt WHERE id % 9 <> 0")
def legacy_import(spark, sf):
    """A JSON-lines export with missing log times and malformed rows."""
    b = order_batches(spark, sf)
    line = F.to_json(F.struct("wall_ts", F.when(F.col("id") % 4 != 0, F.col("log_ts")).alias("log_ts"), "seq", F.struct(F.col("seq").alias("seq")).alias("batch")))
    path = folder(spark)
    b.select(F.when(F.col("id") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    good, _ = B.import_legacy_batches(spark, path)
    return good.select("wall_ts", "log_ts", "seq")


@query("spell_icon_names", "SELECT CAST(p_size AS INTEGER) AS icon_id, string_agg(p_name, '|' ORDER BY p_name) AS names, count(*) AS n FROM (SELECT DISTINCT p_size, p_name FROM part) GROUP BY ALL")
def spell_icon_names(spark, sf):
    """``part`` as a caret-delimited spell file; names per icon."""
    from skirmish.plans.render import table

    row = F.array_repeat(F.lit(""), 77)
    p = table(spark, sf, "part")
    cells = F.transform(row, lambda x, i: F.when(i == T.SPELL_NAME, F.col("p_name")).when(i == T.SPELL_ICON, F.col("p_size").cast("string")).otherwise(x))
    short = p.select(F.concat_ws("^", F.lit("x"), "p_name").alias("value"))
    path = folder(spark)
    p.select(F.array_join(cells, "^").alias("value")).unionByName(short).write.text(path)
    names = T.read_spell_names(spark, path)
    wanted = p.select(F.col("p_size").cast("int").alias("icon_id")).distinct()
    return T.spell_icon_names(wanted, names).select("icon_id", F.array_join(F.array_sort("names"), "|").alias("names"), F.size("names").cast("long").alias("n"))
