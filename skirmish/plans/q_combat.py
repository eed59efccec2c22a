"""Queries over combat events: totals, instances, pulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import times
from skirmish.operators import aggregates as A
from skirmish.operators import classify as C
from skirmish.operators import instances as I
from skirmish.operators import pulls as P
from skirmish.operators import sessions as S
from skirmish.operators.ordered import ranked, stage
from skirmish.operators.parse import parse_lines
from skirmish.plans.registry import query
from skirmish.plans.render import combat_events, combat_lines, loot_events
from skirmish.plans.sql import EV, INST, LOOT, big

K = ["stream_id"]
NOW = 1704067200 + 20_000


# Chunks of the ordered operators, small enough that every stream spans several of them.
_SPAN = 1 << 12


def instanced(spark, sf):
    return I.assign_instances(combat_events(spark, sf), span=_SPAN)


def stored(spark, sf):
    """The attributed events as a stored table, for queries that read them more than once."""
    return stage(instanced(spark, sf))


def wall(ev):
    """First to last damage of each stream."""
    return S.fight_window(ev.filter(F.col("dmg").isNotNull()))


_DPS = "CAST(round(dmg / greatest(CAST(elapsed AS DOUBLE), 0.001)) AS BIGINT)"
_WALL = "fw AS (SELECT stream_id, max(ts) - min(ts) AS elapsed FROM ev WHERE dmg IS NOT NULL GROUP BY ALL)"

_DBP = f"""WITH {EV}, {_WALL}, d AS (
  SELECT stream_id, src AS player, {big('dmg')} AS dmg, count(*) AS hits, count(*) FILTER (mods % 2 = 1) AS crits, CAST(0 AS BIGINT) AS twincasts
  FROM dm GROUP BY ALL)
SELECT d.*, {_DPS} AS dps FROM d JOIN fw USING (stream_id)"""


@query("damage_by_player", _DBP)
def damage_by_player(spark, sf):
    ev = combat_events(spark, sf)
    return A.damage_by_player(ev, K, wall(ev))


@query("damage_from_text", _DBP)
def damage_from_text(spark, sf):
    """Rendered lines through the whole cascade and the exact direction rules."""
    parsed = stage(parse_lines(combat_lines(spark, sf)).select(
        "stream_id", "line_no", "player", "pattern", "ts", "k", "src", "tgt", "dmg", "amt", "typ", "sp", "mods", "off", "verb"))
    ev = C.classify(parsed)
    return A.damage_by_player(ev, K, S.fight_window(parsed.filter(F.col("dmg").isNotNull())))


@query("damage_by_type", f"WITH {EV} SELECT stream_id, src AS player, typ, {big('dmg')} AS dmg, count(*) AS hits FROM dm WHERE typ IS NOT NULL GROUP BY ALL")
def damage_by_type(spark, sf):
    return A.damage_by_type(combat_events(spark, sf))


@query("damage_by_spell", f"WITH {EV} SELECT stream_id, src AS player, sp, {big('dmg')} AS dmg, count(*) AS hits FROM dm WHERE sp IS NOT NULL GROUP BY ALL")
def damage_by_spell(spark, sf):
    return A.damage_by_spell(combat_events(spark, sf))


for _name, _who, _spell in [("healing_by_player", "src", False), ("healing_by_spell", "src", True), ("healed_by_player", "tgt", False), ("healed_by_spell", "tgt", True)]:
    _sp = "sp, " if _spell else ""
    _sql = f"WITH {EV} SELECT stream_id, {_who} AS player, {_sp}{big('amt')} AS amt, count(*) AS heals FROM ev WHERE k = 'heal' GROUP BY ALL HAVING sum(amt) > 0"
    query(_name, _sql)(lambda spark, sf, w=_who, s=_spell: A.healing(combat_events(spark, sf), w, K, s))


@query("tanked_by_player", f"WITH {EV} SELECT stream_id, tgt AS player, {big('dmg')} AS dmg, count(*) AS hits FROM tk GROUP BY ALL")
def tanked_by_player(spark, sf):
    return A.tanked_by_player(combat_events(spark, sf))


@query("tanked_by_type", f"WITH {EV} SELECT stream_id, tgt AS player, typ, {big('dmg')} AS dmg, count(*) AS hits FROM tk GROUP BY ALL")
def tanked_by_type(spark, sf):
    return A.tanked_by_player(combat_events(spark, sf), K, True)


@query("avoidance_by_player", f"WITH {EV} SELECT stream_id, tgt AS player, typ, count(*) AS n FROM ev WHERE k = 'miss' GROUP BY ALL")
def avoidance_by_player(spark, sf):
    return A.avoidance_by_player(combat_events(spark, sf))


@query("mob_instances", f"WITH {INST} SELECT *, false AS parked FROM ins")
def mob_instances(spark, sf):
    return I.mob_instances(instanced(spark, sf))


@query("instance_of_line", f"WITH {INST} SELECT stream_id, line_no, k, mob FROM iv")
def instance_of_line(spark, sf):
    """Attribution of every event: own instance, kill, or the last one touched."""
    return instanced(spark, sf).select("stream_id", "line_no", "k", "mob")


_BUCKETS = {
    "instance_damage": ("damage", "dmg IS NOT NULL AND NOT tank", "src", "dmg"),
    "instance_tanking": ("tanking", "dmg IS NOT NULL AND tank", "tgt", "dmg"),
    "instance_healing": ("healing", "k = 'heal'", "src", "amt"),
    "instance_healed": ("healed", "k = 'heal'", "tgt", "amt"),
}


def _bucket_sql(which):
    _, cond, who, amount = _BUCKETS[which]
    return f"SELECT stream_id, mob, {who} AS player, {big(amount)} AS amount, count(*) AS n FROM iv WHERE {cond} AND mob IS NOT NULL GROUP BY ALL"


for _name in _BUCKETS:
    query(_name, f"WITH {INST} {_bucket_sql(_name)}")(lambda spark, sf, b=_BUCKETS[_name][0]: A.instance_bucket(instanced(spark, sf), b))


@query("tanking_rollup", f"""WITH {INST}, b AS ({_bucket_sql('instance_tanking')})
SELECT * FROM b UNION ALL BY NAME SELECT stream_id, NULL::BIGINT AS mob, player, {big('amount')} AS amount, {big('n')} AS n FROM b GROUP BY ALL""")
def tanking_rollup(spark, sf):
    return A.tanking_rollup(instanced(spark, sf))


@query("fight_totals", f"""WITH {EV}, t AS (SELECT stream_id, coalesce({big('dmg')} FILTER (NOT tank), 0) AS dmg, {big('amt')} AS heals,
  max(ts) FILTER (dmg IS NOT NULL) - min(ts) FILTER (dmg IS NOT NULL) AS elapsed, count(*) AS lines FROM ev GROUP BY ALL)
SELECT *, {_DPS} AS dps FROM t""".replace(f"coalesce({big('dmg')} FILTER (NOT tank), 0)", "CAST(coalesce(sum(dmg) FILTER (NOT tank), 0) AS BIGINT)"))
def fight_totals(spark, sf):
    return A.fight_totals(combat_events(spark, sf))


@query("fight_window", f"WITH {EV} SELECT stream_id, min(ts) AS start_ts, max(ts) AS last_ts, max(ts) - min(ts) AS elapsed FROM ev WHERE dmg IS NOT NULL GROUP BY ALL")
def fight_window(spark, sf):
    return wall(combat_events(spark, sf))


@query("mob_list", f"""WITH {INST}, o AS (SELECT ins.*, {NOW} - last_ts AS idle, (SELECT min(ts) FROM ev WHERE dmg IS NOT NULL AND ev.stream_id = ins.stream_id) AS st FROM ins)
SELECT stream_id, mob, name, first_ts, last_ts, slain_ts, false AS parked, touches, idle >= 15 AS timed_out,
  slain_ts IS NOT NULL OR idle >= 15 AS is_dead, NOT (slain_ts IS NOT NULL OR idle >= 15) AND idle < 5 AS is_active,
  CASE WHEN first_ts >= st THEN first_ts - st END AS first_offset, CASE WHEN last_ts >= st THEN last_ts - st END AS last_offset,
  last_ts - first_ts AS encounter_secs, CASE WHEN idle >= 15 THEN 15 ELSE idle END AS last_seen_secs FROM o""")
def mob_list(spark, sf):
    return I.mob_list(I.mob_instances(instanced(spark, sf)), NOW, fight=wall(combat_events(spark, sf)))


for _name, _taken in [("hit_ranges", False), ("hit_ranges_taken", True)]:
    _sql = f"""WITH {EV} SELECT stream_id, {'tgt' if _taken else 'src'} AS player, coalesce(sp, typ) AS what, count(*) AS hits, min(dmg) AS low, max(dmg) AS high,
      count(*) FILTER (mods % 2 = 1) AS crits, round(sum(dmg) / count(*), 6) AS avg, round(count(*) FILTER (mods % 2 = 1) / count(*), 6) AS crit_rate
      FROM {'tk' if _taken else 'dm'} GROUP BY ALL"""
    query(_name, _sql)(lambda spark, sf, t=_taken: A.hit_ranges(combat_events(spark, sf), K, t).withColumns(
        {"avg": F.round("avg", 6), "crit_rate": F.round("crit_rate", 6)}))


@query("melee_accuracy", f"""WITH {EV}, m AS (SELECT stream_id, src AS player, count(*) FILTER (k = 'melee') AS landed, count(*) FILTER (k = 'miss') AS avoided,
  count(*) FILTER (typ = 'dodge') AS dodge, CAST(0 AS BIGINT) AS parry, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS riposte, count(*) FILTER (typ = 'miss') AS missed
  FROM ev WHERE (k = 'melee' AND NOT tank) OR (k = 'miss' AND NOT src_is_mob) GROUP BY ALL)
SELECT *, round(landed / (landed + avoided), 6) AS accuracy FROM m""")
def melee_accuracy(spark, sf):
    return A.melee_accuracy(combat_events(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("loot_summary", f"WITH {LOOT} SELECT stream_id, k, item, CAST(sum(coalesce(qty, 1)) AS BIGINT) AS qty, CAST(sum(coalesce(copper, 0)) AS BIGINT) AS copper, count(*) AS n FROM lt GROUP BY ALL")
def loot_summary(spark, sf):
    ev = loot_events(spark, sf).withColumn("result", F.lit(None).cast("string"))
    return A.loot_summary(ev)


@query("coin_totals", f"WITH {LOOT} SELECT stream_id, CAST(0 AS BIGINT) AS dropped, {big('copper')} AS sold, {big('copper')} AS total FROM lt WHERE k = 'item_sell' GROUP BY ALL")
def coin_totals(spark, sf):
    return A.coin_totals(loot_events(spark, sf))


@query("group_share", f"""WITH {EV}, d AS (SELECT stream_id, src AS player, {big('dmg')} AS amount FROM dm GROUP BY ALL)
SELECT stream_id, player, amount, CAST(sum(amount) OVER (PARTITION BY stream_id) AS BIGINT) AS group_total,
  round(amount / sum(amount) OVER (PARTITION BY stream_id), 9) AS share FROM d""")
def group_share(spark, sf):
    d = A.damage_by_player(combat_events(spark, sf)).select("stream_id", "player", F.col("dmg").alias("amount"))
    return A.group_share(d).withColumn("share", F.round("share", 9))


_BRK = f"""WITH {EV}, {_WALL}, b AS (
  SELECT stream_id, src AS player, typ AS what, {big('dmg')} AS dmg, count(*) AS hits, false AS is_spell FROM dm WHERE typ IS NOT NULL GROUP BY ALL
  UNION ALL SELECT stream_id, src, sp, {big('dmg')}, count(*), true FROM dm WHERE sp IS NOT NULL GROUP BY ALL)
SELECT b.*, {_DPS} AS rate FROM b JOIN fw USING (stream_id)"""


@query("breakdown", _BRK)
def breakdown(spark, sf):
    ev = combat_events(spark, sf)
    return A.breakdown(ev, K, wall(ev))


_TOP = 3


def _meter_sql(which):
    return f"""WITH {INST}, b AS ({_bucket_sql(which)}), g AS (
  SELECT *, CAST(sum(amount) OVER (PARTITION BY stream_id, mob) AS BIGINT) AS group_total,
    row_number() OVER (PARTITION BY stream_id, mob ORDER BY amount DESC, player) AS rank FROM b),
m AS (SELECT g.*, name, greatest(last_ts - first_ts, 0) AS elapsed FROM g JOIN ins USING (stream_id, mob) WHERE rank <= {_TOP})
SELECT stream_id, mob, player, amount, n, group_total, round(CASE WHEN group_total > 0 THEN amount / group_total ELSE 0 END, 9) AS share, name, elapsed,
  CAST(rank AS INT) AS rank, CAST(round(amount / greatest(CAST(elapsed AS DOUBLE), 0.001)) AS BIGINT) AS rate,
  CAST(round(group_total / greatest(CAST(elapsed AS DOUBLE), 0.001)) AS BIGINT) AS footer_rate FROM m"""


for _name in _BUCKETS:
    def _meter(spark, sf, b=_BUCKETS[_name][0]):
        ev = stored(spark, sf)
        return A.meter_snapshot(ev, I.mob_instances(ev), b, _TOP).withColumn("share", F.round("share", 9))

    query("meter_" + _BUCKETS[_name][0], _meter_sql(_name))(_meter)


def _fmt_k(x):
    return (f"CASE WHEN {x} >= 1000000 THEN regexp_replace(printf('%.1fM', {x} / 1000000.0), '\\.0M$', 'M') "
            f"WHEN {x} >= 1000 THEN regexp_replace(printf('%.1fK', {x} / 1000.0), '\\.0K$', 'K') ELSE CAST({x} AS VARCHAR) END")


@query("summary_line", f"""WITH m AS ({_meter_sql('instance_damage')}), l AS (
  SELECT stream_id, mob, name, group_total, footer_rate, elapsed,
    string_agg(rank || '. ' || player || ' ' || {_fmt_k('amount')} || ' (' || printf('%.0f', share * 100.0) || '%)', ', ' ORDER BY rank) AS body FROM m GROUP BY ALL)
SELECT stream_id, mob, name || ': ' || {_fmt_k('group_total')} || ' dmg (' || {_fmt_k('footer_rate')} || ' dps) over ' ||
  CASE WHEN elapsed >= 60 THEN printf('%d:%02d', elapsed // 60, elapsed % 60) ELSE elapsed || 's' END || ' | ' || body AS line FROM l""")
def summary_line(spark, sf):
    ev = stored(spark, sf)
    return A.summary_line(A.meter_snapshot(ev, I.mob_instances(ev), "damage", _TOP), "damage")


@query("timeline", f"""WITH {EV}, p AS (SELECT stream_id, src AS player, ts, {big('dmg')} AS dmg FROM dm GROUP BY ALL),
r AS (SELECT *, CAST(sum(dmg) OVER w AS BIGINT) AS total, ts - first_value(ts) OVER w AS age FROM p WINDOW w AS (PARTITION BY stream_id, player ORDER BY ts))
SELECT stream_id, player, ts, dmg, total, CAST(round(total / greatest(CAST(age AS DOUBLE), 0.001)) AS BIGINT) AS rate FROM r""")
def timeline(spark, sf):
    return A.timeline(combat_events(spark, sf), span=_SPAN)


_NAMED = """nm0 AS (SELECT stream_id, CASE WHEN k = 'slay' THEN tgt ELSE mob_name END AS w FROM ev),
nm AS (SELECT stream_id, lower(w) AS name, count(*) AS lines, bool_or(regexp_matches(w, '^[a-z]')) AS lowercase FROM nm0 WHERE w IS NOT NULL GROUP BY ALL),
dd0 AS (SELECT stream_id, lower(tgt) AS name, ts - lag(ts) OVER (PARTITION BY stream_id, lower(tgt) ORDER BY line_no) AS d FROM ev WHERE k = 'slay'),
dd AS (SELECT stream_id, name, count(*) AS deaths, bool_or(coalesce(d <= 90, false)) AS concurrent FROM dd0 GROUP BY ALL),
nd AS (SELECT nm.stream_id, nm.name, lines, lowercase, coalesce(concurrent, false) AS concurrent, NOT lowercase AND NOT coalesce(concurrent, false) AS is_named
  FROM nm LEFT JOIN dd USING (stream_id, name))"""


def _mob_word():
    return F.when(F.col("k") == "slay", F.col("tgt")).otherwise(F.col("mob_name"))


@query("named_mobs", f"WITH {EV}, {_NAMED} SELECT * FROM nd")
def named_mobs(spark, sf):
    return P.named_mobs(combat_events(spark, sf), _mob_word(), span=_SPAN)


@query("corpse_concurrency", f"WITH {EV}, {_NAMED} SELECT stream_id, name, deaths, concurrent FROM dd")
def corpse_concurrency(spark, sf):
    return P.corpse_concurrency(combat_events(spark, sf).filter("k = 'slay'"), span=_SPAN)




@query("mob_overrides", f"""WITH {EV}, {_NAMED}, ov AS (SELECT stream_id, CASE WHEN i = 0 THEN 'emperor crush' ELSE 'a gnoll' END AS name,
  CASE WHEN i = 0 THEN 'trash' ELSE 'named' END AS kind FROM (SELECT DISTINCT stream_id FROM ev), (SELECT unnest([0, 1]) AS i))
SELECT nd.stream_id, nd.name, lines, lowercase, concurrent, coalesce(kind = 'named', is_named) AS is_named FROM nd LEFT JOIN ov USING (stream_id, name)""")
def mob_overrides(spark, sf):
    ev = combat_events(spark, sf)
    both = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in [("Emperor Crush", "trash"), ("a gnoll", "named")]])
    ov = ev.select("stream_id").distinct().select("stream_id", F.explode(both).alias("o")).select("stream_id", "o.*")
    return P.apply_mob_overrides(P.named_mobs(ev, _mob_word()), ov)


# Pulls: gap chains only, as the combat rows hold no loot lines.
_PULLS = """pe AS (SELECT *, greatest(last_ts, coalesce(slain_ts, last_ts)) AS e FROM ins),
pr AS (SELECT *, max(e) OVER (PARTITION BY stream_id ORDER BY mob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pe),
pl AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR first_ts - reach > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY mob) AS BIGINT) AS pull FROM pr)"""


@query("pulls", f"WITH {INST}, {_PULLS} SELECT stream_id, mob, name, first_ts, last_ts, slain_ts, touches, false AS parked, pull FROM pl")
def pulls(spark, sf):
    return P.pulls(stage(I.mob_instances(instanced(spark, sf))), span=_SPAN)


@query("pulls_with_loot", f"""WITH {INST}, {_PULLS}, hl AS (SELECT stream_id, line_no, ts FROM ev WHERE k = 'heal'),
c1 AS (SELECT *, max(coalesce(slain_ts, 1099511627776)) OVER (PARTITION BY stream_id, pull ORDER BY mob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM pl),
c2 AS (SELECT c1.*, (SELECT max(ts) FROM hl WHERE hl.stream_id = c1.stream_id AND hl.line_no < c1.mob) AS looted FROM c1),
c3 AS (SELECT *, CAST(sum(CASE WHEN dead IS NULL OR coalesce(dead <= first_ts AND looted >= dead, false) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY mob) AS BIGINT) AS p2 FROM c2)
SELECT stream_id, mob, name, first_ts, last_ts, slain_ts, touches, false AS parked, p2 AS pull FROM c3""")
def pulls_with_loot(spark, sf):
    """Corpse-boundary cut; heal lines stand in for loot lines."""
    ev = stored(spark, sf)
    loots = ev.filter("k = 'heal'").select("stream_id", "line_no", "ts")
    return P.pulls(stage(I.mob_instances(ev)), loots, span=_SPAN)


@query("pull_summary", f"""WITH {INST}, {_PULLS}, {_NAMED}, d AS (SELECT stream_id, mob, {big('dmg')} AS dmg FROM iv WHERE dmg IS NOT NULL AND NOT tank AND mob IS NOT NULL GROUP BY ALL),
j AS (SELECT pl.*, coalesce(d.dmg, 0) AS d, coalesce(nd.is_named, false) AS nmd FROM pl LEFT JOIN d USING (stream_id, mob) LEFT JOIN nd ON nd.stream_id = pl.stream_id AND nd.name = lower(pl.name)),
g AS (SELECT stream_id, pull, lower(name) AS ln, count(*) AS n, min(first_ts) AS s, max(last_ts) AS e, sum(d) AS d, bool_or(nmd) AS nmd, min_by(name, mob) AS display FROM j GROUP BY ALL),
u AS (SELECT stream_id, pull, {big('n')} AS members, min(s) AS start_ts, max(e) AS end_ts, {big('d')} AS dmg,
  string_agg(ln || ' x' || n, ', ' ORDER BY ln || ' x' || n) AS composition, coalesce(string_agg(display, ' + ' ORDER BY display) FILTER (nmd), '') AS named FROM g GROUP BY ALL)
SELECT *, CAST(round(dmg / greatest(CAST(end_ts - start_ts AS DOUBLE), 0.001)) AS BIGINT) AS dps FROM u""")
def pull_summary(spark, sf):
    ev = stored(spark, sf)
    dmg = A.instance_bucket(ev, "damage").groupBy("stream_id", "mob").agg(F.sum("amount").alias("dmg"))
    return P.pull_summary(P.pulls(stage(I.mob_instances(ev)), span=_SPAN), dmg, P.named_mobs(ev, _mob_word()))


@query("player_evidence", f"""WITH {EV}, a AS (
  SELECT stream_id, src AS name, true AS d, false AS h FROM dm UNION ALL SELECT stream_id, src, false, true FROM ev WHERE k = 'heal'
  UNION ALL SELECT stream_id, tgt, false, true FROM ev WHERE k = 'heal')
SELECT stream_id, name, bool_or(d) AS dealt, false AS listed, bool_or(h) AS healed, bool_or(d) AS is_player FROM a GROUP BY ALL""")
def player_evidence(spark, sf):
    return A.player_evidence(combat_events(spark, sf))


_ROSTER = """ro AS (SELECT stream_id, src AS player FROM dm UNION SELECT stream_id, tgt FROM tk
  UNION SELECT stream_id, src FROM ev WHERE k = 'heal' UNION SELECT stream_id, tgt FROM ev WHERE k = 'heal')"""


@query("segment_roster", f"WITH {EV}, {_ROSTER} SELECT * FROM ro WHERE lower(player) <> lower('HERO' || substr('abcdefgh', CAST(substr(stream_id, 2) AS INT) + 1, 1))")
def segment_roster(spark, sf):
    """Roster of each stream without the owner, who is excluded by hand."""
    ev = combat_events(spark, sf)
    return A.segment_roster(ev, K, ev.select("stream_id", F.upper("player").alias("name")).distinct())


@query("headline_mob", f"""WITH {EV}, h AS (SELECT stream_id, tgt AS name, count(DISTINCT src) AS attackers FROM dm GROUP BY ALL)
SELECT stream_id, name, attackers FROM h QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY attackers DESC, name DESC) = 1""")
def headline_mob(spark, sf):
    return A.headline_mob(combat_events(spark, sf))


@query("confirmed_mobs_removed", f"WITH {EV}, p AS (SELECT stream_id, src AS player, count(*) AS n FROM ev WHERE k <> 'slay' GROUP BY ALL) SELECT * FROM p WHERE (stream_id, lower(player)) NOT IN (SELECT (stream_id, lower(mob_name)) FROM ev WHERE mob_name IS NOT NULL)")
def confirmed_mobs_removed(spark, sf):
    ev = combat_events(spark, sf)
    names = ev.filter("k <> 'slay'").groupBy("stream_id", F.col("src").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    mobs = ev.filter(F.col("mob_name").isNotNull()).select("stream_id", F.explode(F.array("mob_name", F.concat(F.upper(F.substring("mob_name", 1, 1)), F.expr("substring(mob_name, 2)")))).alias("name")).distinct()
    return A.drop_confirmed_mobs(names, mobs)


@query("player_engaged", f"""WITH {INST} SELECT stream_id, mob, max(ts) AS engaged_ts FROM iv WHERE dmg IS NOT NULL AND mob IS NOT NULL
  AND (CASE WHEN tank THEN tgt ELSE src END) = player GROUP BY ALL""")
def player_engaged(spark, sf):
    return I.player_engaged(instanced(spark, sf), _no_pets(spark))


def _no_pets(spark):
    return spark.range(0).selectExpr("cast(id as string) as stream_id", "cast(id as string) as name", "cast(id as string) as owner")


@query("view_instance", f"""WITH {INST}, en AS (SELECT DISTINCT stream_id, mob FROM iv WHERE dmg IS NOT NULL AND mob IS NOT NULL AND (CASE WHEN tank THEN tgt ELSE src END) = player)
SELECT stream_id, max_by(mob, (last_ts, mob)) AS mob FROM ins SEMI JOIN en USING (stream_id, mob) GROUP BY ALL""")
def view_instance(spark, sf):
    ev = stored(spark, sf)
    return I.view_instance(I.mob_instances(ev), I.player_engaged(ev, _no_pets(spark)))


@query("mob_picker", f"""WITH {INST} SELECT stream_id, mob, name, last_ts, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY last_ts DESC, mob DESC) AS INT) AS rank FROM ins
QUALIFY rank <= 6""")
def mob_picker(spark, sf):
    """Six most recently seen instances of each stream."""
    return ranked(I.mob_instances(instanced(spark, sf)).select("stream_id", "mob", "name", "last_ts"), K, [F.col("last_ts").desc(), F.col("mob").desc()], 6)


@query("time_range", f"WITH {EV} SELECT stream_id, line_no, ts, k FROM ev WHERE ts BETWEEN {NOW - 15000} AND {NOW - 5000}")
def time_range(spark, sf):
    return S.time_range(combat_events(spark, sf), NOW - 15000, NOW - 5000).select("stream_id", "line_no", "ts", "k")


@query("last_lines", f"WITH {EV} SELECT stream_id, line_no, ts, k FROM ev ORDER BY line_no DESC LIMIT 50")
def last_lines(spark, sf):
    return S.last_lines(combat_events(spark, sf).select("stream_id", "line_no", "ts", "k"), 50)


@query("last_lines_by_stream", f"WITH {EV} SELECT stream_id, line_no, ts, k FROM ev QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY line_no DESC) <= 20")
def last_lines_by_stream(spark, sf):
    return S.last_lines(combat_events(spark, sf).select("stream_id", "line_no", "ts", "k"), 20, keys=["stream_id"])


@query("ranked_damage", f"""WITH {EV}, d AS (SELECT stream_id, src AS player, {big('dmg')} AS dmg FROM dm GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY dmg DESC, player) AS INT) AS rank FROM d QUALIFY rank <= 5""")
def ranked_damage(spark, sf):
    d = A.damage_by_player(combat_events(spark, sf)).select("stream_id", "player", "dmg")
    return ranked(d, K, [F.col("dmg").desc(), F.col("player")], 5)


@query("batch_by_second", f"WITH {EV} SELECT stream_id, ts, count(*) AS events, min(line_no) AS first_line, max(line_no) AS last_line, false AS login FROM ev GROUP BY ALL")
def batch_by_second(spark, sf):
    return S.batch_by_second(combat_events(spark, sf))


@query("split_batches", f"""WITH {EV}, b AS (SELECT *, ts // 300 AS batch, min(ts) OVER w AS lo, max(ts) OVER w AS hi FROM ev WINDOW w AS (PARTITION BY stream_id, ts // 300))
SELECT stream_id, batch, CASE WHEN hi - lo <= 60 THEN 0 ELSE (ts - lo) // 60 END AS slot, count(*) AS n FROM b GROUP BY ALL""")
def split_batches(spark, sf):
    ev = combat_events(spark, sf).withColumn("batch", F.expr("ts div 300"))
    return S.split_batches(ev, ["stream_id", "batch"]).groupBy("stream_id", "batch", "slot").agg(F.count(F.lit(1)).alias("n"))


@query("fmt_amounts", f"""WITH {EV}, d AS (SELECT stream_id, src AS player, {big('dmg')} AS dmg, max(ts) - min(ts) AS secs FROM dm GROUP BY ALL)
SELECT stream_id, player, {_fmt_k('dmg')} AS total, {_fmt_k('dmg * 1000')} AS thousandfold,
  CASE WHEN secs >= 60 THEN printf('%d:%02d', secs // 60, secs % 60) ELSE secs || 's' END AS length FROM d""")
def fmt_amounts(spark, sf):
    d = A.damage_rows(combat_events(spark, sf)).groupBy("stream_id", F.col("src").alias("player")).agg(
        F.sum("dmg").alias("dmg"), (F.max("ts") - F.min("ts")).alias("secs"))
    return d.select("stream_id", "player", times.fmt_k(F.col("dmg")).alias("total"), times.fmt_k(F.col("dmg") * 1000).alias("thousandfold"),
                    times.fmt_duration(F.col("secs")).alias("length"))


