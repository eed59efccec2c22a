"""Queries over chat, corpora and trigger rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.functions import chatter
from skirmish.operators import chat as C
from skirmish.operators import rules as R
from skirmish.operators.ordered import stage
from skirmish.plans.registry import query
from skirmish.plans.render import EPOCH, chat_lines, combat_lines, spread, table, wide_lines
from skirmish.plans.sql import BASE, EV, letters, pick
from skirmish.sources import tables as T

_SPAN = 1 << 12

# One row per message with the game line before it; "_CHAT_EVENTS" by turns.
_EVK = ["slay", "item_loot", "slay", "item_loot", "resist", "", ""]
_EVD = ["a gnoll", "a Bat Meat", "Pab", "3 gold", "", "", ""]
# The corpus pattern for loot does not read the dashed form.
_CTK = ["slay", "", "death", "", "", "", "cast"]
_CTS = ["You slew a gnoll", "", "Pab slain by a gnoll", "", "", "", "You casting Ice Comet"]

CHAT = f"""cv AS (SELECT 'c' || (conv_id % 8) AS stream_id, conv_id * 1048576 + turn * 2 AS line_no, {EPOCH} + conv_id * 100 + turn * 12 AS ets,
    {EPOCH} + conv_id * 100 + turn * 12 + 7 AS ts, conv_id * 3 + turn AS e,
    CASE WHEN turn % 4 = 3 THEN 'Izzin' ELSE upper(role[1]) || role[2:] || {letters('conv_id % 10')} END AS speaker,
    trim(regexp_replace(text, '[''"\\r\\n\\t]', ' ', 'g'), ' ') AS text, turn FROM conversations),
ce AS (SELECT *, nullif({pick(_EVK, 'e')}, '') AS ek, {pick(_EVD, 'e')} AS ed, nullif({pick(_CTK, 'e')}, '') AS ck, {pick(_CTS, 'e')} AS cs FROM cv)"""

_RL = "|".join(C.chatter.REAL_LIFE)
_TAC = "|".join(w.replace("'", "''") for w in C.chatter.TACTICAL)
_CORR = CHAT + f""", ev1 AS (SELECT stream_id, line_no, ets, ek, ed FROM ce WHERE ek IS NOT NULL),
jn AS (SELECT ce.stream_id, ce.line_no + 1 AS line_no, ce.ts, speaker, text, CASE WHEN ce.ts - ev1.ets <= 30 THEN ev1.ek END AS event_kind,
    CASE WHEN ce.ts - ev1.ets <= 30 THEN ev1.ed END AS event_detail, CASE WHEN ce.ts - ev1.ets <= 30 THEN ce.ts - ev1.ets END AS event_lag_secs
  FROM ce ASOF LEFT JOIN ev1 ON ce.stream_id = ev1.stream_id AND ce.line_no >= ev1.line_no),
jw AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM jn),
co AS (SELECT stream_id, line_no, ts, speaker, 'group' AS channel, text, event_kind, event_detail, event_lag_secs,
  CASE WHEN len(w) BETWEEN 2 AND 7 AND regexp_full_match(ltrim(w[-1], '+-'), '\\d+') AND regexp_matches(w[1], '^\\p{{Lu}}') THEN 'loot'
    WHEN regexp_matches(' ' || lower(text) || ' ', ' (?:{_RL}) ') THEN 'real_life' WHEN regexp_matches(' ' || lower(text) || ' ', ' (?:{_TAC}) ') THEN 'tactical'
    WHEN event_kind IS NOT NULL THEN 'reactive' ELSE 'social' END AS msg_class FROM jw)"""


@query("correlate_chat", f"WITH {_CORR} SELECT * FROM co")
def correlate_chat(spark, sf):
    return C.correlate_chat(chat_lines(spark, sf), span=_SPAN)


@query("correlated_speaker", f"WITH {_CORR} SELECT * FROM co WHERE speaker = 'Izzin'")
def correlated_speaker(spark, sf):
    return C.correlate_chat(chat_lines(spark, sf), speaker="Izzin", span=_SPAN)


@query("flat_corpus", f"WITH {CHAT} SELECT speaker, 'group' AS channel, text FROM cv")
def flat_corpus(spark, sf):
    return C.flat_corpus(C.correlate_chat(chat_lines(spark, sf), span=_SPAN))


@query("speaker_stats", f"""WITH {_CORR}, m AS (SELECT speaker, list_sort(list(event_lag_secs) FILTER (msg_class = 'reactive')) AS l, count(*) AS total, count(*) FILTER (msg_class = 'reactive') AS reactive,
  count(*) FILTER (msg_class = 'real_life') AS rl_meta, count(*) FILTER (msg_class = 'tactical') AS tactical, count(*) FILTER (msg_class = 'loot') AS loot,
  count(*) FILTER (msg_class = 'social') AS social, round(sum(length(text)) / count(*), 1) AS avg_msg_len FROM co GROUP BY ALL)
SELECT * EXCLUDE (l), coalesce(l[len(l) // 2 + 1], 0) AS median_reaction_secs FROM m""")
def speaker_stats(spark, sf):
    return C.speaker_stats(stage(C.correlate_chat(chat_lines(spark, sf), span=_SPAN)))


_CORPUS = CHAT + """, cx AS (SELECT m.stream_id, m.line_no + 1 AS line_no, m.ts, m.speaker, m.text,
    coalesce(string_agg(c.ck || '=' || c.cs, ';' ORDER BY c.line_no), '') AS context, coalesce(list(c.ck ORDER BY c.line_no) FILTER (c.ck IS NOT NULL), []) AS kinds,
    list(c.cs ORDER BY c.line_no) FILTER (c.ck IS NOT NULL) AS sums
  FROM ce m LEFT JOIN ce c ON c.stream_id = m.stream_id AND c.ck IS NOT NULL AND c.line_no <= m.line_no AND c.ets >= m.ts - 60 GROUP BY ALL)"""


def _archetypes(spark, sf):
    """Labels of half of the speakers, from their names."""
    t = table(spark, sf, "conversations").select("conv_id", "role").distinct()
    n = F.col("conv_id") % 10
    name = F.concat(F.upper(F.substring("role", 1, 1)), F.expr("substring(role, 2)"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    lab = F.element_at(F.array(*[F.lit(a) for a in C.ARCHETYPES]), (n % 5).cast("int") + 1)
    return t.filter(n % 2 == 0).select(name.alias("speaker"), lab.alias("archetype")).distinct()


_ARCH = f"""ar AS (SELECT DISTINCT upper(role[1]) || role[2:] || {letters('conv_id % 10')} AS speaker, {pick(list(C.ARCHETYPES), 'conv_id % 10')} AS archetype FROM conversations WHERE conv_id % 2 = 0)"""
_LAB = _CORPUS + f""", {_ARCH}, lc AS (SELECT cx.*, coalesce(ar.archetype, 'Unknown') AS archetype FROM cx LEFT JOIN ar USING (speaker))"""


def corpus(spark, sf, unknown=True):
    return C.extract_corpus(chat_lines(spark, sf), _archetypes(spark, sf), include_unknown=unknown)


@query("extract_corpus", f"WITH {_LAB} SELECT stream_id, line_no, ts, speaker, 'group' AS channel, text, context, archetype FROM lc WHERE archetype <> 'Unknown'")
def extract_corpus(spark, sf):
    rows = corpus(spark, sf, False)
    return rows.withColumn("context", F.array_join(F.transform("context", lambda e: F.concat(e["kind"], F.lit("="), e["summary"])), ";"))


@query("corpus_stats", f"""WITH {_LAB}, a AS (SELECT archetype, count(*) AS n FROM lc GROUP BY ALL), s AS (SELECT speaker, count(*) AS n FROM lc GROUP BY ALL ORDER BY n DESC, speaker LIMIT 15)
SELECT 'archetype' AS stat, archetype AS value, n, round(n * 100.0 / sum(n) OVER (), 1) AS percent FROM a UNION ALL SELECT 'channel', 'group', count(*), NULL FROM lc UNION ALL SELECT 'speaker', speaker, n, NULL FROM s""")
def corpus_stats(spark, sf):
    return C.corpus_stats(stage(corpus(spark, sf).select("archetype", "channel", "speaker")))


_TRIG = """CASE last_k WHEN 'slay' THEN 'MobKilled' WHEN 'death' THEN CASE WHEN len(list_filter(kinds, lambda x: x = 'death')) >= 2 THEN 'Wipe' ELSE 'PlayerDied' END
  WHEN 'loot' THEN 'Loot' WHEN 'cast' THEN 'Incoming' ELSE 'Banter' END"""
_REG = "CASE last_k WHEN 'slay' THEN 'Elated' WHEN 'death' THEN 'Frustrated' WHEN 'loot' THEN 'Elated' WHEN 'cast' THEN 'Engaged' ELSE 'Neutral' END"
_BUCKET = {"QuietAnchor": "[TERSE] [PATIENT]", "ChaoticNarrator": "[VERBOSE] [HUMOROUS]", "RaidLeader": "[SERIOUS] [PATIENT]", "ReactiveObserver": "[TERSE] [SERIOUS] [PATIENT]", "TacticalFocused": "[SERIOUS] [PATIENT]", "Unknown": ""}
_KNOWN = "('QuietAnchor', 'ChaoticNarrator', 'RaidLeader')"


@query("training_prefix", f"""WITH {_LAB}, k AS (SELECT *, kinds[-1] AS last_k FROM lc), t AS (SELECT *, {_TRIG} AS trigger, {_REG} AS register FROM k)
SELECT stream_id, line_no, register, trigger, trim('[ARCH] [' || CASE WHEN archetype IN {_KNOWN} THEN archetype ELSE 'Unknown' END || '] [REG] [' || register || '] [TRIG] [' || trigger || '] ' ||
  CASE archetype {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _BUCKET.items())} END) AS tokens,
  CASE trigger WHEN 'MobKilled' THEN 'a gnoll' WHEN 'PlayerDied' THEN 'a gnoll' WHEN 'Wipe' THEN 'a gnoll' WHEN 'Incoming' THEN 'Ice Comet' END AS slot FROM t""")
def training_prefix(spark, sf):
    rows = C.training_prefix(corpus(spark, sf))
    return rows.select("stream_id", "line_no", "register", "trigger", F.array_join("tokens", " ").alias("tokens"), "slot")


@query("training_set", f"""WITH {CHAT} SELECT split, count(*) AS n, CAST(count(*) * 128 AS BIGINT) AS ids FROM (SELECT CASE WHEN row_number() OVER () <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS split FROM cv) GROUP BY ALL""")
def training_set(spark, sf):
    """Sequences by a word-length tokenizer; sizes of the two splits."""
    rows = stage(C.training_prefix(corpus(spark, sf)).select("stream_id", "line_no", "tokens", "slot", "text"))
    out = C.training_set(rows, lambda s: [len(w) for w in s.split()], vocab_size=1000, eos=2, pad=0, max_len=128)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("seq")).cast("long").alias("ids"))


@query("training_lengths", f"""WITH {_LAB}, k AS (SELECT *, kinds[-1] AS last_k FROM lc), t AS (SELECT *, {_TRIG} AS trigger, {_REG} AS register FROM k),
p AS (SELECT text, 6 + len(list_filter(string_split(CASE archetype {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _BUCKET.items())} END, ' '), lambda x: x <> ''))
  + CASE trigger WHEN 'MobKilled' THEN 2 WHEN 'PlayerDied' THEN 2 WHEN 'Wipe' THEN 2 WHEN 'Incoming' THEN 2 ELSE 0 END + 1 AS prefix_len FROM t)
SELECT CAST(prefix_len AS INTEGER) AS prefix_len, CAST(prefix_len + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + 1 AS INTEGER) AS full_len, count(*) AS n FROM p GROUP BY ALL""")
def training_lengths(spark, sf):
    """Sequences at their own length: how many of each prefix and full length."""
    rows = stage(C.training_prefix(corpus(spark, sf)).select("stream_id", "line_no", "tokens", "slot", "text"))
    out = C.training_set(rows, lambda s: [len(w) for w in s.split()], vocab_size=1000, eos=2, pad=0)
    return out.filter(F.size("seq") == F.col("full_len")).groupBy("prefix_len", "full_len").agg(F.count(F.lit(1)).alias("n"))


# Documents as a corpus: language and source as the speaker.
_HUM = r"""(?i)(?:^|[^\p{L}\p{N}_])(?:(?:lol|lmao|lmfao|rofl|haha|hehe|heh|xd|kek|gg)(?:$|[^\p{L}\p{N}_])|:[-o]?[)DdPp3]|;-?[)])"""
_FEAT = f"""dc AS (SELECT lang || '/' || source AS speaker, text, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{85}}\\x0B]+'), lambda x: x <> '')) AS wc FROM documents),
fr AS (SELECT speaker, count(*) AS n, sum(wc) / count(*) AS avg_words, count(*) FILTER (regexp_matches(text, '{_HUM}')) / count(*) AS humor_frac,
  count(*) FILTER (regexp_matches(text, '! *$')) / count(*) AS exclaim_frac, count(*) FILTER (regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{3,}}(?:$|[^\\p{{L}}\\p{{N}}_])')) / count(*) AS caps_frac
  FROM dc GROUP BY ALL HAVING count(*) >= 15),
ft AS (SELECT *, least(avg_words / greatest(max(avg_words) OVER (), 1.0), 1.0) AS verbosity, least(humor_frac * 2.5 + exclaim_frac * 0.4 + caps_frac * 0.3, 1.0) AS humor,
  greatest(0.0, least(1.0, 0.92 - exclaim_frac * 0.7 - caps_frac * 0.3)) AS patience FROM fr)"""


def _doc_corpus(spark, sf):
    return spread(table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), "source").alias("speaker"), "text"))


_ROUND = ["avg_words", "humor_frac", "exclaim_frac", "caps_frac", "verbosity", "humor", "patience"]


@query("speaker_features", f"WITH {_FEAT} SELECT speaker, n, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUND)} FROM ft")
def speaker_features(spark, sf):
    return C.speaker_features(_doc_corpus(spark, sf)).withColumns({c: F.round(c, 6) for c in _ROUND})


_PROF = ", ".join(f"('{a}', {i}, {v}, {h}, {p})" for i, (a, (v, h, p)) in enumerate(C.ARCHETYPES.items()))
_RANK = f"""{_FEAT}, pr(archetype, i, v, h, p) AS (VALUES {_PROF}),
rk AS (SELECT speaker, archetype, sqrt((verbosity - v) * (verbosity - v) + (humor - h) * (humor - h) + (patience - p) * (patience - p)) AS dist, i FROM ft, pr),
rr AS (SELECT speaker, CAST(row_number() OVER (PARTITION BY speaker ORDER BY dist, i) AS INTEGER) AS rank, archetype, round(dist, 6) AS dist FROM rk)"""


@query("rank_archetypes", f"WITH {_RANK} SELECT * FROM rr WHERE rank <= 3")
def rank_archetypes(spark, sf):
    return C.rank_archetypes(C.speaker_features(_doc_corpus(spark, sf)), 3).withColumn("dist", F.round("dist", 6))


@query("suggest_map", f"WITH {_RANK} SELECT speaker, archetype FROM rr WHERE rank = 1 AND NOT ends_with(speaker, '1')")
def suggest_map(spark, sf):
    known = _doc_corpus(spark, sf).filter(F.col("speaker").endswith("1")).select("speaker", F.lit("RaidLeader").alias("archetype")).distinct()
    return C.suggest_map(C.speaker_features(_doc_corpus(spark, sf)), known)


@query("update_archetype_map", f"WITH {_RANK} SELECT speaker, CASE WHEN ends_with(speaker, '1') THEN 'RaidLeader' ELSE archetype END AS archetype FROM rr WHERE rank = 1")
def update_archetype_map(spark, sf):
    f = C.speaker_features(_doc_corpus(spark, sf))
    known = f.filter(F.col("speaker").endswith("1")).select("speaker", F.lit("RaidLeader").alias("archetype"))
    return T.update_archetype_map(known, C.rank_archetypes(f, 1).select("speaker", "archetype"))


for _n in (1, 2):
    _sql = f"""WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}]+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, turn, role, unnest([array_to_string(w[i:i + {_n - 1}], ' ') FOR i IN range(1, len(w) - {_n - 2})]) AS gram FROM w),
c AS (SELECT conv_id, turn, role, gram, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT conv_id, turn, sum(c) AS total FROM c WHERE role = 'user' GROUP BY ALL),
m AS (SELECT h.conv_id, h.turn, r.turn AS rt, sum(least(h.c, r.c)) AS m FROM c h JOIN c r ON h.conv_id = r.conv_id AND h.gram = r.gram WHERE h.role = 'user' AND r.role = 'assistant' GROUP BY ALL),
b AS (SELECT conv_id, turn, max(m) AS m FROM m GROUP BY ALL)
SELECT q.conv_id, q.turn, round(coalesce(b.m / t.total, 0), 9) AS precision FROM conversations q LEFT JOIN t USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn) WHERE q.role = 'user'"""

    def _ngrams(spark, sf, n=_n):
        c = table(spark, sf, "conversations")
        hyps = c.filter("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("of"), "text")
        refs = c.filter("role = 'assistant'").select(F.col("conv_id").alias("of"), F.col("turn").alias("ref_id"), "text")
        return C.ngram_precision(hyps, refs, n, "of").select("id.*", F.round("precision", 9).alias("precision"))

    query(f"ngram_precision_{_n}", _sql)(_ngrams)


# Rules.

RULES = [
    {"rule_id": 1, "name": "big hit", "logic": "all", "conditions": [
        {"type": "match", "match_type": "regex", "pattern": r"^(?P<who>\w+) hit (?P<mob>.+?) for (?P<dmg>\d+) points? of fire damage by (.+)\."},
        {"type": "var", "var_name": "dmg", "op": "gte", "value": "{limit}"}],
     "actions": [{"type": "alert", "message": "{who} hit {mob} for {1}/{3}", "delay_secs": 2.5}, {"type": "voice", "tts_text": "big {nobody}", "priority": "emergency"}]},
    {"rule_id": 2, "name": "crit text", "logic": "any", "conditions": [
        {"type": "match", "match_type": "regex", "pattern": r"points of damage\. (Critical)"},
        {"type": "match", "match_type": "exact", "pattern": "tries to bite"}],
     "actions": [{"type": "notice", "message": "look"}]},
    {"rule_id": 3, "name": "slain", "logic": "all", "conditions": [{"type": "match", "match_type": "glob", "pattern": "{mob} has been slain by {who}!"}],
     "actions": [{"type": "sound", "sounds": ["bell"]}, {"type": "voice", "tts_text": ""}]},
    {"rule_id": 4, "name": "off", "enabled": False, "logic": "all", "conditions": [], "actions": [{"type": "alert", "message": "never"}]},
    {"rule_id": 5, "name": "broken", "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": "(unclosed"}], "actions": [{"type": "alert", "message": "never"}]},
]
_SEED = {"limit": "30"}
_TXT = EV + """, tx AS (SELECT ev.*, starts_with(src, 'Hero') AS own,
  k = 'spell' AND dmg >= 30 AS r1, (k = 'melee' AND line_no % 5 = 0) OR (k = 'miss' AND typ = 'dodge') AS r2, k = 'slay' AND NOT starts_with(src, 'Hero') AS r3,
  CASE WHEN starts_with(src, 'Hero') THEN 'You' ELSE src END AS who FROM ev)"""


def _rule_lines(spark, sf):
    lines = combat_lines(spark, sf)
    from skirmish.functions import times

    return lines.withColumn("ts", times.line_epoch(F.col("raw")))


@query("apply_rules", f"""WITH {_TXT} SELECT stream_id, line_no, 1 AS rule_id, 0 AS action, 'alert' AS type, who || ' hit ' || tgt || ' for ' || who || '/' || dmg AS message, 'operational' AS priority, ts + 2.5 AS fire_ts FROM tx WHERE r1
UNION ALL SELECT stream_id, line_no, 1, 1, 'voice', 'big {{nobody}}', 'emergency', CAST(ts AS DOUBLE) FROM tx WHERE r1
UNION ALL SELECT stream_id, line_no, 2, 0, 'notice', 'look', 'operational', CAST(ts AS DOUBLE) FROM tx WHERE r2
UNION ALL SELECT stream_id, line_no, 3, 0, 'sound', '', 'operational', CAST(ts AS DOUBLE) FROM tx WHERE r3""")
def apply_rules(spark, sf):
    out = R.apply_rules(_rule_lines(spark, sf), RULES, seeds=_SEED, span=_SPAN)
    return out.select("stream_id", "line_no", "rule_id", "action", "type", "message", "priority", "fire_ts")


@query("alert_targets", f"WITH {_TXT} SELECT 'alert' AS target, CAST(count(*) FILTER (r1) * 2 + count(*) FILTER (r3) AS BIGINT) AS n FROM tx UNION ALL SELECT 'notice', count(*) FILTER (r2) FROM tx")
def alert_targets(spark, sf):
    a, n = R.by_target(R.apply_rules(_rule_lines(spark, sf), RULES, seeds=_SEED, span=_SPAN))
    cnt = lambda d, t: d.groupBy(F.lit(t).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return cnt(a, "alert").unionByName(cnt(n, "notice"))


@query("preview_rules", f"""WITH {_TXT} SELECT stream_id, line_no, 'big hit' AS rule, true AS emergency, true AS shows_alert, false AS shows_notice, false AS plays_sound, true AS speaks,
  CAST(dmg AS VARCHAR) || '|' || tgt || '|' || who AS captures FROM tx WHERE r1
UNION ALL SELECT stream_id, line_no, 'crit text', false, false, true, false, false, '' FROM tx WHERE r2
UNION ALL SELECT stream_id, line_no, 'slain', false, false, false, true, true, (upper(tgt[1]) || tgt[2:]) || '|' || who FROM tx WHERE r3""")
def preview_rules(spark, sf):
    out = R.preview_rules(combat_lines(spark, sf), RULES, seeds=_SEED)
    return out.withColumn("captures", F.array_join("captures", "|")).drop("raw", "player", "nth")


@query("rule_hits_by_line", f"""WITH {_TXT} SELECT stream_id, line_no, CASE WHEN r1 THEN 'big hit' WHEN r2 THEN 'crit text' WHEN r3 THEN 'slain' END AS rules, r1 AS emergency, r1 AS shows_alert, r2 AS shows_notice, r3 AS plays_sound,
  r1 OR r3 AS speaks FROM tx""")
def rule_hits_by_line(spark, sf):
    return R.rule_hits_by_line(combat_lines(spark, sf), RULES, seeds=_SEED).drop("raw", "player", "captures")


@query("alert_history", f"""WITH {_TXT}, a AS (SELECT stream_id, line_no, 2 AS rule_id, CAST(ts AS DOUBLE) AS fire_ts FROM tx WHERE r2),
n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY fire_ts DESC, line_no DESC) AS r FROM a)
SELECT stream_id, line_no, {EPOCH} + 21000 - fire_ts AS age FROM n WHERE r <= 20 AND {EPOCH} + 21000 - fire_ts <= 2000""")
def alert_history(spark, sf):
    a = R.apply_rules(_rule_lines(spark, sf), [RULES[1]], span=_SPAN)
    return R.alert_history(a, EPOCH + 21000, 20, 2000).select("stream_id", "line_no", "age")


@query("preset_hits", f"""WITH {EV}, p AS (SELECT *, starts_with(src, 'Hero') AS own FROM ev), h AS (
  SELECT CASE WHEN own THEN 'You slay a mob' ELSE 'A mob is slain (by anyone)' END AS rule FROM p WHERE k = 'slay'
  UNION ALL SELECT 'You melee a target' FROM p WHERE own AND ((k = 'melee' AND NOT tank) OR k = 'spell')
  UNION ALL SELECT 'Something melees you' FROM p WHERE tank AND starts_with(tgt, 'Hero')
  UNION ALL SELECT 'Someone heals a target' FROM p WHERE k = 'heal')
SELECT rule, count(*) AS n FROM h GROUP BY ALL""")
def preset_hits(spark, sf):
    """All sixteen presets over all lines."""
    return R.preview_rules(combat_lines(spark, sf), R.preset_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


VAR_RULES = [
    {"rule_id": 1, "name": "warn", "logic": "all", "conditions": [
        {"type": "match", "match_type": "regex", "pattern": r" has been slain by (?P<who>\w+)!"}, {"type": "var", "var_name": "healer", "op": "equals", "value": "{who}"}],
     "actions": [{"type": "alert", "message": "{healer} after {amount}"}]},
    {"rule_id": 2, "name": "remember", "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": r"^(?P<h>\w+) healed .+ for (?P<n>\d+) hit points"}],
     "actions": [{"type": "store", "var_name": "healer", "value": "{h}"}, {"type": "store", "var_name": "amount", "value": "{n} of {base}"}]},
]


@query("rules_with_variables", f"""WITH {_TXT}, h AS (SELECT stream_id, line_no, who, amt FROM tx WHERE k = 'heal')
SELECT tx.stream_id, tx.line_no, h.who || ' after ' || h.amt || ' of ten' AS message FROM tx ASOF JOIN h ON tx.stream_id = h.stream_id AND tx.line_no > h.line_no WHERE r3 AND tx.who = h.who""")
def rules_with_variables(spark, sf):
    out = R.apply_rules(_rule_lines(spark, sf), VAR_RULES, seeds={"base": "ten"}, span=_SPAN)
    return out.select("stream_id", "line_no", "message")


# A rule that disarms itself until the next heal, and a lamp that every death switches; both read what they wrote.
LOOP_RULES = [
    {"rule_id": 1, "name": "first death", "logic": "all", "conditions": [
        {"type": "match", "match_type": "regex", "pattern": r" has been slain by (?P<who>.+)!"}, {"type": "var", "var_name": "armed", "op": "equals", "value": "yes"}],
     "actions": [{"type": "alert", "message": "{who} after {healer}", "delay_secs": 0.5}, {"type": "store", "var_name": "armed", "value": "no"}]},
    {"rule_id": 2, "name": "arm", "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": r"^(?P<h>\w+) healed .+ for \d+ hit points"}],
     "actions": [{"type": "store", "var_name": "armed", "value": "yes"}, {"type": "store", "var_name": "healer", "value": "{h}"}]},
    {"rule_id": 3, "name": "lit", "logic": "all", "conditions": [
        {"type": "match", "match_type": "exact", "pattern": " has been slain by "}, {"type": "var", "var_name": "lamp", "op": "equals", "value": "off"}],
     "actions": [{"type": "store", "var_name": "next", "value": "on"}]},
    {"rule_id": 4, "name": "dark", "logic": "all", "conditions": [
        {"type": "match", "match_type": "exact", "pattern": " has been slain by "}, {"type": "var", "var_name": "lamp", "op": "equals", "value": "on"}],
     "actions": [{"type": "store", "var_name": "next", "value": "off"}]},
    {"rule_id": 5, "name": "switch", "logic": "all", "conditions": [
        {"type": "match", "match_type": "exact", "pattern": " has been slain by "}, {"type": "var", "var_name": "next", "op": "isset"}],
     "actions": [{"type": "store", "var_name": "lamp", "value": "{next}"}, {"type": "notice", "message": "lamp {lamp}"}]},
]
LOOP_SEED = {"armed": "yes", "lamp": "off"}

LOOP_SQL = f"""WITH RECURSIVE {_TXT}, e AS (SELECT stream_id, line_no, ts, k = 'slay' AS death, who, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS n FROM tx WHERE r3 OR k = 'heal'),
st AS (SELECT stream_id, 0::BIGINT AS n, NULL::BIGINT AS line_no, NULL::BIGINT AS ts, 'yes' AS armed, 'off' AS lamp, NULL::VARCHAR AS healer, NULL::VARCHAR AS once, NULL::VARCHAR AS said FROM e WHERE n = 1
UNION ALL SELECT e.stream_id, e.n, e.line_no, e.ts, CASE WHEN death THEN 'no' ELSE 'yes' END, CASE WHEN NOT death THEN lamp WHEN lamp = 'off' THEN 'on' ELSE 'off' END, CASE WHEN death THEN healer ELSE who END,
  CASE WHEN death AND armed = 'yes' THEN who || ' after ' || coalesce(healer, '{{healer}}') END, CASE WHEN death THEN 'lamp ' || CASE WHEN lamp = 'off' THEN 'on' ELSE 'off' END END
  FROM st JOIN e ON e.stream_id = st.stream_id AND e.n = st.n + 1)
SELECT stream_id, line_no, 1 AS rule_id, once AS message, ts + 0.5 AS fire_ts FROM st WHERE once IS NOT NULL
UNION ALL SELECT stream_id, line_no, 5, said, CAST(ts AS DOUBLE) FROM st WHERE said IS NOT NULL"""


@query("rules_that_read_what_they_wrote", LOOP_SQL)
def rules_that_read_what_they_wrote(spark, sf):
    out = R.apply_rules(_rule_lines(spark, sf), LOOP_RULES, seeds=LOOP_SEED, span=_SPAN)
    return out.select("stream_id", "line_no", "rule_id", "message", "fire_ts")


@query("chat_condition", f"WITH {BASE} SELECT stream_id, line_no, 'P' || {letters('line_no % 50')} || ' in guild' AS message FROM base WHERE line_no % 36 = 32 AND n >= 10")
def chat_condition(spark, sf):
    """A guild-chat condition on wide lines; the quoted hit never counts as combat."""
    rule = {"rule_id": 1, "name": "guild", "logic": "all", "conditions": [
        {"type": "chat", "channel": "guild", "match_type": "regex", "pattern": r"for (?P<n>\d+) points"}, {"type": "var", "var_name": "n", "op": "gte", "value": "10"}],
        "actions": [{"type": "alert", "message": "{speaker} in guild"}]}
    rows = wide_lines(spark, sf).withColumn("ts", F.lit(0).cast("long"))
    return R.apply_rules(rows, [rule]).select("stream_id", "line_no", "message")


@query("message_class", f"""WITH {_CORR} SELECT stream_id, line_no, CASE WHEN msg_class = 'reactive' THEN 'social' ELSE msg_class END AS msg_class FROM co""")
def message_class(spark, sf):
    """Classes of messages when nothing happened before."""
    rows = C.correlate_chat(chat_lines(spark, sf), span=_SPAN)
    return rows.select("stream_id", "line_no", chatter.message_class(F.col("text"), F.lit(False)).alias("msg_class"))


