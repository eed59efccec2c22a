"""Queries over text: the pattern cascade, scalar functions, loot lines, direction and pets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import chatter, mods, names, templates, times
from skirmish.operators import aggregates as A
from skirmish.operators import classify as C
from skirmish.operators import instances as I
from skirmish.operators import sessions as S
from skirmish.operators.ordered import stage
from skirmish.operators.parse import carry_ts, explain_lines, match_lines, parse_coverage, parse_lines
from skirmish.plans.registry import query
from skirmish.plans.render import _WIDE, combat_events, combat_lines, loot_lines, table, wide_lines
from skirmish.plans.sql import BASE, EV, INST, LOOT, big, letters, pick

_N = len(_WIDE)
_SHAPES = ", ".join(f"({i}, {repr(n) if n else 'NULL'})" for i, (n, _) in enumerate(_WIDE))
_SH = f"sh(i, pattern) AS (VALUES {_SHAPES})"
_P50 = f"'P' || {letters('line_no % 50')}"


@query("pattern_cascade", f"WITH {BASE}, {_SH} SELECT pattern, count(*) AS lines FROM base JOIN sh ON line_no % {_N} = i GROUP BY ALL")
def pattern_cascade(spark, sf):
    return parse_coverage(match_lines(wide_lines(spark, sf)))


_COV = f"""WITH {EV} SELECT CASE WHEN k = 'melee' THEN 'melee' WHEN k = 'spell' THEN 'hit_by_spell' WHEN k = 'heal' THEN 'heal' WHEN k = 'miss' THEN 'miss'
  WHEN src IS NOT NULL AND user_is_owner THEN 'slay_you' ELSE 'slain_by' END AS pattern, count(*) AS lines FROM
  (SELECT ev.*, starts_with(src, 'Hero') AS user_is_owner FROM ev) GROUP BY ALL"""


@query("parse_coverage", _COV)
def coverage(spark, sf):
    return parse_coverage(match_lines(combat_lines(spark, sf)))


@query("explain_lines", f"WITH {EV} SELECT stream_id, line_no, 'hit_by_spell' AS pattern FROM ev WHERE sp = 'Ice Comet'")
def explain(spark, sf):
    rows = explain_lines(match_lines(combat_lines(spark, sf)), ["ice comet", "points"], only_matched=True)
    return rows.select("stream_id", "line_no", "pattern")


@query("parsed_fields", f"""WITH {BASE}, {_SH}, w AS (SELECT * FROM base JOIN sh ON line_no % {_N} = i)
SELECT pattern, CAST(coalesce(sum(CASE WHEN pattern IN ('hit_by_spell', 'melee', 'dot', 'riposte', 'damage_shield', 'shield_proc', 'shield_burn', 'has_taken', 'extra_damage') THEN n END), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(CASE WHEN pattern = 'heal' THEN n END), 0) AS BIGINT) AS amt,
  CAST(coalesce(sum(CASE WHEN pattern = 'currency' THEN n * 1000 + 103 WHEN pattern = 'loot_sold' THEN n * 10 + 4 END), 0) AS BIGINT) AS copper,
  CAST(coalesce(sum(CASE WHEN pattern = 'loot_kept' THEN 1 WHEN pattern = 'loot_sold' THEN 4 END), 0) AS BIGINT) AS qty,
  CAST(sum(CASE WHEN pattern = 'melee' THEN 5 ELSE 0 END) AS BIGINT) AS mods FROM w GROUP BY ALL""")
def parsed_fields(spark, sf):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return parse_lines(wide_lines(spark, sf)).groupBy("pattern").agg(zero("dmg"), zero("amt"), zero("copper"), zero("qty"), zero("mods"))


@query("parsed_names", f"""WITH {BASE}, {_SH}, w AS (SELECT *, {_P50} AS p, CASE WHEN mobn = 'orc legionnaire' THEN 'Orc legionnaire' ELSE mobn END AS m FROM base JOIN sh ON line_no % {_N} = i)
SELECT stream_id, line_no, pattern, CASE WHEN pattern IN ('melee', 'hit_by_spell', 'dot', 'riposte', 'damage_shield', 'shield_proc', 'cc_wake', 'slay_has', 'slain_by', 'extra_damage', 'miss', 'resist', 'heal', 'cast') THEN p
    WHEN pattern = 'shield_burn' THEN mobn WHEN pattern = 'slay_you' THEN player WHEN pattern = 'has_taken' THEN player WHEN pattern = 'absorb_skin' THEN mobn END AS src,
  CASE WHEN pattern IN ('melee', 'hit_by_spell', 'slay_you', 'slay_has', 'miss') THEN mobn WHEN pattern IN ('dot', 'riposte', 'damage_shield', 'shield_proc', 'cc_park', 'cc_wake', 'slain_by', 'died', 'has_taken', 'extra_damage', 'resist') THEN m
    WHEN pattern = 'shield_burn' THEN player WHEN pattern IN ('absorb_skin', 'absorb_rune', 'heal') THEN p END AS tgt
FROM w WHERE pattern NOT IN ('who', 'berserk', 'fizzle', 'loot_kept', 'loot_sold', 'loot_hoard', 'loot_enhance')""")
def parsed_names(spark, sf):
    rows = parse_lines(wide_lines(spark, sf))
    skip = ["who", "berserk", "fizzle", "loot_kept", "loot_sold", "loot_hoard", "loot_enhance"]
    return rows.filter(F.col("pattern").isNotNull() & ~F.col("pattern").isin(skip)).select("stream_id", "line_no", "pattern", "src", "tgt")


_EVENT_COLS = ["stream_id", "line_no", "ts", "k", "src", "tgt", "dmg", "amt", "typ", "sp", "tank", "mods", "src_is_mob", "mob_name"]


@query("classified_events", f"WITH {EV} SELECT {', '.join(_EVENT_COLS)} FROM ev")
def classified_events(spark, sf):
    """Every rendered line parsed and given its direction, against the source rows."""
    parsed = stage(parse_lines(combat_lines(spark, sf)).select(
        "stream_id", "line_no", "player", "pattern", "ts", "k", "src", "tgt", "dmg", "amt", "typ", "sp", "mods", "off", "verb"))
    return C.classify(parsed).select(*_EVENT_COLS)


@query("explain_events", f"""WITH {EV}, f AS (SELECT stream_id, src, min(line_no) AS first FROM dm GROUP BY ALL)
SELECT ev.stream_id, line_no, CASE WHEN k = 'slay' THEN NULL WHEN src_is_mob THEN 'blank in the name' WHEN first < line_no THEN 'known player'
  WHEN first = line_no THEN 'first swing of a player' ELSE 'no evidence' END AS direction_rule FROM ev LEFT JOIN f ON f.stream_id = ev.stream_id AND f.src = ev.src""")
def explain_events(spark, sf):
    parsed = stage(parse_lines(combat_lines(spark, sf)).select(
        "stream_id", "line_no", "player", "pattern", "ts", "k", "src", "tgt", "dmg", "amt", "typ", "sp", "mods", "off", "verb"))
    return C.explain_events(parsed).select("stream_id", "line_no", "direction_rule")


@query("parse_loot_lines", f"WITH {LOOT} SELECT stream_id, line_no, ts, k, item, qty, copper, 'a gnoll' AS tgt FROM lt")
def parse_loot_lines(spark, sf):
    made = ["ts", "k", "item", "qty", "copper", "tgt"]
    return parse_lines(loot_lines(spark, sf), only=made).select("stream_id", "line_no", *made)


@query("carry_ts", f"""WITH {BASE}, t AS (SELECT stream_id, line_no, CASE WHEN line_no % 3 = 0 THEN ts END AS ts FROM base)
SELECT stream_id, line_no, coalesce(last_value(ts IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY line_no), 0) AS ts FROM t""")
def carry(spark, sf):
    """Two lines in three lose their time and take it from the line before."""
    rows = combat_events(spark, sf).select("stream_id", "line_no", F.when(F.col("line_no") % 3 == 0, F.col("ts")).alias("ts"))
    return carry_ts(rows, span=1 << 10)


@query("log_times", f"WITH {BASE} SELECT stream_id, line_no, ts, ts - 3600 + 7 AS berlin FROM base")
def log_times(spark, sf):
    """Prefix to epoch, in UTC and in a winter zone with a clock skew."""
    rows = combat_lines(spark, sf)
    return rows.select("stream_id", "line_no", times.line_epoch(F.col("raw")).alias("ts"), times.line_epoch(F.col("raw"), "Europe/Berlin", 7).alias("berlin"))


_FORMS = ["hits", "slashes", "frenzies", "kick", "smites", "ponders"]
_BASES = ["hit", "slash", "frenzy", "kick", "smite", "hit"]
_AVOID = ["dodges", "parries", "misses", "blocked", "ripostes", "INVULNERABLE", "absorbs", "ducks"]
_KINDS = ["dodge", "parry", "miss", "block", "riposte", "invulnerable", "absorb", "miss"]
_CLS = ["Warrior", "shd", "Shadow Knight", "ENC", "tinker", "beastlord"]
_CODES = ["WAR", "SHD", "SHD", "ENC", "", "BST"]
_NAMES = ["You", "A rat", "An orc", "Aaron", "yOu", "a wisp"]


@query("name_functions", f"""WITH {BASE} SELECT line_no, {pick(_BASES, 'line_no')} AS verb, {pick(_KINDS, 'line_no')} AS avoid, nullif({pick(_CODES, 'line_no')}, '') AS code,
  CASE WHEN lower({pick(_NAMES, 'line_no')}) = 'you' THEN player ELSE {pick(['You', 'a rat', 'an orc', 'Aaron', 'yOu', 'a wisp'], 'line_no')} END AS name,
  CASE WHEN line_no % 3 = 0 THEN {_P50} END AS owner, 'Hole ' || (line_no % 9) AS zone FROM base""")
def name_functions(spark, sf):
    """Verbs, avoidance words, classes, names, pet owners and zone labels."""
    i = F.col("line_no")
    pick_ = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (i % len(vs)).cast("int") + 1)
    who = F.concat(F.lit("P"), F.translate((i % 50).cast("string"), "0123456789", "abcdefghij"))
    pet = F.when(i % 3 == 0, F.concat(who, F.when(i % 2 == 0, "'s warder").otherwise("`s warder"))).otherwise(F.concat(F.lit("a "), who, F.lit("'s warder")))
    return combat_events(spark, sf).select(
        "line_no", names.normalize_verb(pick_(_FORMS)).alias("verb"), names.normalize_miss(pick_(_AVOID)).alias("avoid"),
        names.class_code(pick_(_CLS)).alias("code"), names.norm(pick_(_NAMES), F.col("player")).alias("name"),
        names.warder_owner(pet).alias("owner"), names.instance_label(F.concat(F.lit("Hole "), (i % 9).cast("string"), F.lit(" (Refined)"))).alias("zone"))


@query("parse_copper", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) + CASE WHEN l_linenumber = 2 THEN 9000000000000000000 ELSE 0 END END AS copper FROM lineitem""")
def parse_copper(spark, sf):
    """A price spelled in coins and read back; some have 16 digits of platinum, some more than a long holds."""
    c = F.floor("l_extendedprice").cast("long")
    li = table(spark, sf, "lineitem").withColumn("c", c)
    more = F.when(F.col("l_linenumber") == 2, F.lit(9_000_000_000_000_000)).otherwise(F.lit(0))
    text = F.concat((F.expr("c div 1000") + more).cast("string"), F.when(F.col("l_linenumber") == 3, "1000000000000000000").otherwise(""), F.lit(" platinum "), F.expr("c div 100 % 10").cast("string"), F.lit(" gold and "),
                    (F.col("c") % 100).cast("string"), F.lit(" copper"))
    return li.select("l_orderkey", "l_linenumber", names.parse_copper(text).alias("copper"))


_FLAG = list(mods.FLAGS)


@query("hit_modifiers", f"""WITH {BASE} SELECT line_no, CAST(CASE WHEN line_no % 4 = 0 THEN 0 ELSE (1 << CAST(line_no % 11 AS INT)) | 1 END AS INTEGER) AS mods,
  CASE WHEN line_no % 4 = 0 THEN 'Rysk hits a rat (sort of)' ELSE 'Rysk hits a rat' END AS line FROM base""")
def hit_modifiers(spark, sf):
    """Eleven flags by turns, always with Critical; a suffix without a flag stays in the line."""
    word = F.element_at(F.array(*[F.lit(mods.FLAGS[f][1][-1]) for f in _FLAG]), (F.col("line_no") % 11).cast("int") + 1)
    line = F.when(F.col("line_no") % 4 == 0, "Rysk hits a rat (sort of)").otherwise(F.concat(F.lit("Rysk hits a rat ("), word, F.lit(" Critical)")))
    rows = combat_events(spark, sf).select("line_no", line.alias("raw")).withColumn("mods", mods.suffix_mods(F.col("raw")))
    return rows.select("line_no", "mods", mods.strip_mods(F.col("raw"), F.col("mods")).alias("line"))


_MSGS = ["raid start", "Raid Start -- Vox D3", "when is raid start?", "raidend: wiped", "raid start now", "raid end---gg"]
_VERBS = ["say to your guild", "tell your party", "shout", "says", "tells General:1", "tells you"]


@query("chat_marks", f"""WITH {BASE}, m AS (SELECT line_no, CAST(line_no % 6 AS INT) AS j, (line_no // 6) % 6 AS v FROM base)
SELECT line_no, {pick(_VERBS, 'v')} AS verb, CASE j WHEN 0 THEN 'raid_start' WHEN 1 THEN 'raid_start' WHEN 3 THEN 'raid_end' WHEN 5 THEN 'raid_end' END AS kind,
  CASE j WHEN 0 THEN '' WHEN 1 THEN 'Vox D3' WHEN 3 THEN 'wiped' WHEN 5 THEN 'gg' END AS label,
  v = 0 AS guild, v = 1 AS grp, v = 2 AS shout, v = 3 AS say, v = 5 AS tell, v = 4 AS custom FROM m""")
def chat_marks(spark, sf):
    """Parts of a chat line, its channel, and the raid call it may be."""
    i = F.col("line_no")
    at = lambda vs, k: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs)).cast("int") + 1)
    line = F.concat(F.lit("Zyro "), at(_VERBS, F.expr("line_no div 6")), F.lit(", '"), at(_MSGS, i), F.lit("'"))
    rows = combat_events(spark, sf).select("line_no", chatter.chat_parts(line).alias("c"))
    verb, mark = F.col("c.verb"), chatter.raid_mark(F.col("c.msg"))
    ch = lambda c, n, custom="": chatter.channel_matches(c, custom, verb).alias(n)
    return rows.select("line_no", verb.alias("verb"), mark["kind"].alias("kind"), mark["label"].alias("label"), ch("guild", "guild"), ch("group", "grp"),
                       ch("shout", "shout"), ch("say", "say"), ch("tell", "tell"), ch("custom", "custom", "general"))


@query("marks", f"""WITH {BASE}, m AS (SELECT stream_id, line_no, ts, CASE WHEN line_no % 2 = 0 THEN 'raid_start' ELSE 'raid_end' END AS kind, CAST(line_no % 10 AS VARCHAR) AS label FROM base)
SELECT stream_id, ts, kind, min_by(label, line_no) AS label, min(line_no) AS line_no FROM m GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY stream_id, ts, kind"))
def marks(spark, sf):
    """Own chat calls parsed from text, one per second and kind."""
    ev = combat_events(spark, sf)
    i = F.col("line_no")
    from skirmish.plans.render import log_prefix

    raw = F.concat(log_prefix(F.col("ts")), F.lit("You shout, 'raid "), F.when(i % 2 == 0, "start").otherwise("end"), F.lit(" -- "), (i % 10).cast("string"), F.lit("'"))
    return S.marks(parse_lines(ev.select("stream_id", "player", "line_no", raw.alias("raw"))))


@query("heartbeats", f"WITH {BASE} SELECT stream_id, ts, min(line_no) AS line_no FROM base WHERE line_no % {_N} = 9 GROUP BY ALL")
def heartbeats(spark, sf):
    rows = stage(parse_lines(wide_lines(spark, sf)).filter("k = 'hb'").select("stream_id", "line_no", "ts", "k"))
    return S.throttle_heartbeats(rows).select("stream_id", "ts", "line_no")


@query("class_list", f"""WITH {BASE}, w AS (SELECT *, {_P50} AS name FROM base WHERE line_no % {_N} = 29)
SELECT DISTINCT stream_id, name, 'WAR,SHD,ROG' AS classes, CAST(50 AS INTEGER) AS level, 'WAR' AS "primary" FROM w""")
def class_list(spark, sf):
    rows = A.class_list(parse_lines(wide_lines(spark, sf)))
    return rows.withColumn("classes", F.array_join("classes", ","))


@query("enriched_damage", f"""WITH {BASE}, d AS (SELECT stream_id, {_P50} AS player, {big('n')} AS dmg FROM base WHERE line_no % {_N} IN (0, 1, 2, 3, 4, 5, 24) GROUP BY ALL),
c AS (SELECT DISTINCT stream_id, {_P50} AS player FROM base WHERE line_no % {_N} = 29)
SELECT d.*, CASE WHEN c.player IS NOT NULL THEN 'WAR' END AS "primary" FROM d LEFT JOIN c USING (stream_id, player)""")
def enriched_damage(spark, sf):
    p = stage(parse_lines(wide_lines(spark, sf)))
    mine = p.filter(F.col("src").startswith("P"))
    d = A.damage_by_player(mine.withColumn("tank", F.lit(False))).select("stream_id", "player", "dmg")
    return A.enrich_classes(d, A.class_list(p)).select("stream_id", "player", "dmg", "primary")


@query("resists_by_player", f"WITH {BASE} SELECT stream_id, {_P50} AS player, 'Tashania' AS sp, count(*) AS n FROM base WHERE line_no % {_N} = 28 GROUP BY ALL")
def resists_by_player(spark, sf):
    return A.resists_by_player(parse_lines(wide_lines(spark, sf)))


@query("fizzles_by_spell", f"WITH {BASE} SELECT stream_id, 'Light Healing' AS sp, count(*) AS n FROM base WHERE line_no % {_N} = 11 GROUP BY ALL")
def fizzles_by_spell(spark, sf):
    return A.fizzles_by_spell(parse_lines(wide_lines(spark, sf)))


_AS_OF = 1704067200 + 20_000


@query("active_casts", f"""WITH {BASE}, c AS (SELECT stream_id, {_P50} AS player, max_by(ts, line_no) AS ts FROM base WHERE line_no % {_N} = 10 GROUP BY ALL)
SELECT stream_id, player, 'Lesser Summoning: Water' AS sp, ts FROM c WHERE {_AS_OF} - ts < 10""")
def active_casts(spark, sf):
    return A.active_casts(parse_lines(wide_lines(spark, sf)), _AS_OF)


# Casts and sightings for the as-of lookups, from the rows of events.
def _cast_rows(spark, sf):
    ev = combat_events(spark, sf)
    i = F.col("line_no")
    cast = F.col("k") == "heal"
    pet = F.element_at(F.array(*[F.lit(p) for p in ("Labarer", "Gobaner", "Zarab", "Xobtik")]), (i % 4).cast("int") + 1)
    return ev, i, cast, pet


_PETS = ["Labarer", "Gobaner", "Zarab", "Xobtik"]


@query("pet_owner_by_buff", f"""WITH {EV}, c AS (SELECT stream_id, line_no, ts, src AS owner FROM ev WHERE k = 'heal'), s AS (SELECT stream_id, line_no, ts, {pick(_PETS, 'line_no')} AS name FROM ev WHERE k = 'slay'),
j AS (SELECT s.*, c.owner, c.line_no AS cl, c.ts AS cts FROM s ASOF JOIN c ON s.stream_id = c.stream_id AND s.line_no > c.line_no)
SELECT stream_id, line_no, ts, name, owner FROM j WHERE ts - cts <= 10 AND owner <> name QUALIFY row_number() OVER (PARTITION BY stream_id, cl ORDER BY line_no) = 1""")
def pet_owner_by_buff(spark, sf):
    """Heals stand in for buff casts, kills for pets going berserk."""
    ev, i, cast, pet = _cast_rows(spark, sf)
    seen = F.col("k") == "slay"
    rows = ev.filter(cast | seen).select(
        "stream_id", "line_no", "ts", F.when(cast, "cast").otherwise("berserk").alias("pattern"), F.when(cast, F.col("src")).otherwise(pet).alias("src"), F.when(cast, "Burnout II").alias("sp"))
    return C.pet_owner_by_buff(rows, span=1 << 12)


# Sightings one by one: a name and a cast are used up by the first that fits.
@query("pet_owner_by_summon", f"""WITH RECURSIVE {EV}, c AS (SELECT stream_id, line_no, ts, src AS owner FROM ev WHERE k = 'heal'), s AS (SELECT stream_id, line_no, ts, {pick(_PETS, 'line_no')} AS name FROM ev WHERE k = 'miss'),
j AS (SELECT s.*, c.owner, c.line_no AS cl, c.ts AS cts FROM s ASOF JOIN c ON s.stream_id = c.stream_id AND s.line_no > c.line_no),
h AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS n FROM j WHERE greatest(ts - cts, 0) <= 60 AND owner <> name),
r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS casts, false AS won FROM h
  UNION ALL SELECT h.stream_id, h.n,
    CASE WHEN list_contains(names, h.name) OR list_contains(casts, h.cl) THEN names ELSE list_append(names, h.name) END,
    CASE WHEN list_contains(names, h.name) OR list_contains(casts, h.cl) THEN casts ELSE list_append(casts, h.cl) END,
    NOT (list_contains(names, h.name) OR list_contains(casts, h.cl)) FROM r JOIN h ON h.stream_id = r.stream_id AND h.n = r.n + 1)
SELECT h.stream_id, h.line_no, h.ts, h.name, h.owner FROM r JOIN h USING (stream_id, n) WHERE won""")
def pet_owner_by_summon(spark, sf):
    """Heals stand in for summon casts, misses for the first swings of pets."""
    ev, i, cast, pet = _cast_rows(spark, sf)
    seen = F.col("k") == "miss"
    rows = ev.filter(cast | seen).select(
        "stream_id", "line_no", "ts", F.when(cast, "cast").otherwise("miss").alias("pattern"), F.when(cast, F.col("src")).otherwise(pet).alias("src"), F.when(cast, "Lesser Summoning: Water").alias("sp"))
    return C.pet_owner_by_summon(stage(rows), span=1 << 12)


@query("attribute_spell", f"""WITH {EV}, c AS (SELECT stream_id, line_no, src, {pick(['Ice Comet', 'Lure', 'Shock'], 'line_no')} AS sp FROM ev WHERE k = 'heal'),
h AS (SELECT stream_id, line_no, {pick(['Ice Comet', 'Lure', 'Shock'], 'line_no')} AS sp FROM ev WHERE k = 'spell')
SELECT h.stream_id, h.line_no, h.sp, c.src AS caster FROM h ASOF LEFT JOIN c ON h.stream_id = c.stream_id AND h.sp = c.sp AND h.line_no > c.line_no""")
def attribute_spell(spark, sf):
    ev = combat_events(spark, sf)
    sp = F.element_at(F.array(F.lit("Ice Comet"), F.lit("Lure"), F.lit("Shock")), (F.col("line_no") % 3).cast("int") + 1)
    rows = ev.filter("k IN ('heal', 'spell')").select("stream_id", "line_no", F.when(F.col("k") == "heal", "cast").otherwise("spell_hit").alias("pattern"), F.when(F.col("k") == "heal", F.col("src")).alias("src"), sp.alias("sp"))
    return C.attribute_spell(rows, span=1 << 12).filter("pattern = 'spell_hit'").select("stream_id", "line_no", "sp", "caster")


# Loot lines added to the combat rows: every heal becomes a looted corpse.
_LOOTED = INST.replace("mt0 AS (\n  SELECT *, lower(CASE WHEN touch THEN mob_name WHEN k = 'slay' THEN tgt END) AS mk FROM ev)",
                       "mt0 AS (\n  SELECT *, lower(CASE WHEN touch THEN mob_name WHEN k = 'slay' THEN tgt WHEN k = 'heal' THEN CASE WHEN line_no % 5 = 0 THEN 'a stranger' ELSE " + pick(["a gnoll", "an orc pawn", "a fire beetle", "Emperor Crush", "orc legionnaire", "Lord Nagafen"], "line_no") + " END END) AS mk FROM ev)")


@query("attribute_loot", f"""WITH {_LOOTED}, kl AS (SELECT *, max_by({{'t': ts, 'm': own}}, line_no) FILTER (k = 'slay') OVER w AS kill FROM ai
  WINDOW w AS (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT stream_id, line_no, coalesce(own, CASE WHEN ts - kill.t <= 120 THEN kill.m END) AS mob FROM kl WHERE k = 'heal'""")
def attribute_loot(spark, sf):
    ev = combat_events(spark, sf)
    i = F.col("line_no")
    from skirmish.plans.render import MOBS

    mob = F.element_at(F.array(*[F.lit(m) for m in MOBS]), (i % len(MOBS)).cast("int") + 1)
    heal = F.col("k") == "heal"
    ev = ev.withColumns({"tgt": F.when(heal, F.when(i % 5 == 0, "a stranger").otherwise(mob)).otherwise(F.col("tgt")), "k": F.when(heal, "item_loot").otherwise(F.col("k"))})
    return I.assign_instances(ev, span=1 << 12).filter("k = 'item_loot'").select("stream_id", "line_no", "mob")


@query("parked_intervals", f"""WITH {EV}, t AS (SELECT stream_id, line_no, ts, lower(mob_name) AS name, k, lead(ts) OVER (PARTITION BY stream_id, lower(mob_name) ORDER BY line_no) AS until_ts FROM ev WHERE touch)
SELECT stream_id, name, ts AS from_ts, until_ts FROM t WHERE k = 'miss'""")
def parked_intervals(spark, sf):
    """Swings dodged stand in for crowd control landing."""
    ev = combat_events(spark, sf)
    park = F.col("touch") & (F.col("k") == "miss")
    ev = ev.withColumns({"k": F.when(park, "cc").otherwise(F.col("k")), "off": F.when(park, F.lit(False)), "mob": F.lit(None).cast("long")})
    return I.parked_intervals(ev, span=1 << 12).drop("mob")


@query("templates", f"""WITH {EV} SELECT line_no, src || ' hit {{who}} for ' || dmg AS text, dmg > 20 AS big FROM dm WHERE k = 'spell'""")
def template_text(spark, sf):
    """Placeholders filled from columns; an unknown one stays."""
    ev = A.damage_rows(combat_events(spark, sf)).filter("k = 'spell'")
    vals = {"src": F.col("src"), "1": F.col("dmg").cast("string")}
    return ev.select("line_no", templates.resolve_template("{src} hit {who} for {1}", vals).alias("text"),
                     templates.cmp_numeric(F.col("dmg").cast("string"), F.lit("20"), "gt").alias("big"))


_ZONES = ["The City of Guk 4 (Refined)", "East Freeport", "The City of Guk 4 (Refined)", "Befallen 4 (Refined)", "The Plane of Sky"]


@query("zone_instance_changes", f"""WITH {BASE}, z AS (SELECT stream_id, line_no, ts, {pick(_ZONES, 'line_no // 3')} AS zone FROM base),
t AS (SELECT *, lag(zone) OVER (PARTITION BY stream_id ORDER BY line_no) AS prev FROM z WHERE zone LIKE '%(%')
SELECT stream_id, line_no, ts, 'raid_mark' AS k, 'instance' AS kind, regexp_replace(zone, ' \\(.*\\)$', '') AS label FROM t WHERE prev IS NULL OR prev <> zone""")
def zone_instance_changes(spark, sf):
    ev = combat_events(spark, sf)
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.expr("line_no div 3") % len(_ZONES)).cast("int") + 1)
    rows = ev.select("stream_id", "player", "line_no", "ts", zone.alias("zone_text"), F.lit(None).cast("long").alias("zone_num"), F.lit(None).cast("string").alias("src"))
    rows = rows.withColumn("pattern", F.when(F.contains("zone_text", F.lit("(")), "instance_enter").otherwise("zone_enter"))
    return S.zone_instance_changes(rows, span=1 << 12)
