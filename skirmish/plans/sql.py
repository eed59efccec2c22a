"""Shared SQL of the oracles: the driver's tables as events, in DuckDB's dialect."""

from skirmish.plans.render import EPOCH, MOBS, SPEEDUP, STREAMS

_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"


def letters(x: str) -> str:
    return _LETTERS.format(x)


def pick(values: list[str], i: str) -> str:
    lst = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{lst}])[CAST(({i}) % {len(values)} AS INT) + 1]"


BASE = f"""base AS (
  SELECT 's' || (user_id % {STREAMS}) AS stream_id, event_id AS line_no, 'Hero' || {letters(f'user_id % {STREAMS}')} AS player,
    {EPOCH} + (epoch_us(ts) - {EPOCH}000000) // {SPEEDUP}000000 AS ts,
    CASE WHEN user_id < {STREAMS} THEN 'Hero' || {letters('user_id')} ELSE 'P' || {letters('user_id')} END AS actor,
    user_id < {STREAMS} AS mine, {pick(MOBS, 'event_id')} AS mobn,
    CAST(floor(value) AS BIGINT) AS n, event_type AS et,
    (event_type = 'click' AND event_id % 7 = 3) AS bite, (event_type = 'error' AND event_id % 2 = 1) AS dodge
  FROM events)"""

EV = BASE + """, ev0 AS (
  SELECT *, CASE WHEN mobn = 'orc legionnaire' THEN 'Orc legionnaire' ELSE mobn END AS opening, bite OR dodge AS by_mob,
    et IN ('click', 'purchase') AS hit FROM base),
ev AS (
  SELECT stream_id, line_no, player, ts,
    CASE et WHEN 'click' THEN 'melee' WHEN 'view' THEN 'heal' WHEN 'purchase' THEN 'spell' WHEN 'error' THEN 'miss' ELSE 'slay' END AS k,
    CASE WHEN by_mob THEN opening ELSE actor END AS src,
    CASE WHEN by_mob THEN actor WHEN et = 'view' THEN player WHEN et = 'signup' AND NOT mine THEN opening ELSE mobn END AS tgt,
    CASE WHEN hit THEN n END AS dmg, CASE WHEN et = 'view' THEN n END AS amt,
    CASE WHEN bite THEN 'bite' WHEN et = 'click' THEN 'slash' WHEN dodge THEN 'dodge' WHEN et = 'error' THEN 'miss' END AS typ,
    CASE WHEN et = 'view' THEN 'Light Healing' WHEN et = 'purchase' THEN CASE WHEN line_no % 2 = 0 THEN 'Burst of Flame' ELSE 'Ice Comet' END END AS sp,
    bite AS tank, CASE WHEN et = 'click' AND line_no % 5 = 0 THEN 1 ELSE 0 END AS mods, by_mob AS src_is_mob,
    CASE WHEN by_mob THEN opening WHEN hit OR dodge THEN mobn END AS mob_name, (hit OR dodge) AS touch, et
  FROM ev0),
dm AS (SELECT * FROM ev WHERE dmg IS NOT NULL AND NOT tank),
tk AS (SELECT * FROM ev WHERE dmg IS NOT NULL AND tank)"""

# Instances in the form of one window per stream and mob name.
INST = EV + """, mt0 AS (
  SELECT *, lower(CASE WHEN touch THEN mob_name WHEN k = 'slay' THEN tgt END) AS mk FROM ev),
mt AS (
  SELECT *, max(CASE WHEN touch THEN line_no END) OVER w AS ptl, max(CASE WHEN touch THEN ts END) OVER w AS pts,
    max(CASE WHEN k = 'slay' THEN line_no END) OVER w AS psl
  FROM mt0 WINDOW w AS (PARTITION BY stream_id, mk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mi AS (
  SELECT *, CASE WHEN mk IS NULL THEN NULL ELSE max(CASE WHEN touch AND (ptl IS NULL OR coalesce(psl > ptl, false) OR ts - pts >= 15) THEN line_no END)
    OVER (PARTITION BY stream_id, mk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS own FROM mt),
ai AS (
  SELECT *, max_by(own, line_no) FILTER (touch) OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS act FROM mi),
iv AS (SELECT *, CASE WHEN touch OR k = 'slay' THEN own WHEN k IN ('heal', 'miss') THEN act END AS mob FROM ai),
ins AS (
  SELECT stream_id, mob,
    coalesce(max_by(mob_name, line_no) FILTER (touch AND regexp_matches(mob_name, '^[a-z]')), min_by(mob_name, line_no) FILTER (touch)) AS name,
    min(ts) FILTER (touch) AS first_ts, max_by(ts, line_no) FILTER (touch) AS last_ts, min(ts) FILTER (k = 'slay') AS slain_ts,
    CAST(count(*) FILTER (touch) AS BIGINT) AS touches
  FROM iv WHERE (touch OR k = 'slay') AND mob IS NOT NULL GROUP BY ALL)"""

LOOT = f"""lt AS (
  SELECT 's' || (l_suppkey % {STREAMS}) AS stream_id, l_orderkey * 8 + l_linenumber AS line_no, epoch_us(l_shipdate) // 1000000 AS ts,
    CASE l_returnflag WHEN 'A' THEN 'item_loot' WHEN 'N' THEN 'item_sell' ELSE 'item_hoard' END AS k, p_name AS item,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN CAST(l_quantity AS BIGINT) END AS qty,
    CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_extendedprice) AS BIGINT) END AS copper
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BATCH = """bt AS (
  SELECT o_custkey AS stream_id, o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS log_ts,
    epoch_us(o_orderdate) // 1000000 + o_orderkey % 7 AS wall_ts, o_orderkey % 5 AS seq, o_orderpriority = '1-URGENT' AS login FROM orders)"""

# Sessions of the batches with the gap the queries use.
SESS_GAP = 150 * 86400
SESS = BATCH + f""", sx0 AS (SELECT *, lag(log_ts) OVER (PARTITION BY stream_id ORDER BY id) AS prev FROM bt),
sx AS (SELECT *, sum(CASE WHEN prev IS NULL OR login OR log_ts - prev >= {SESS_GAP} THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY id) AS session FROM sx0),
ss0 AS (SELECT stream_id, CAST(session AS BIGINT) AS num, min(id) AS start_batch_id, min_by(log_ts, id) AS start_log_ts,
  min_by(wall_ts, id) AS start_wall_ts, max_by(log_ts, id) AS last_log, count(*) AS batches FROM sx GROUP BY ALL),
ss AS (SELECT *, coalesce(lead(start_log_ts) OVER (PARTITION BY stream_id ORDER BY num), last_log) AS end_log_ts FROM ss0)"""

STREAM = f"""st AS (
  SELECT s_suppkey AS stream_id, r_name AS game, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS server,
    'P' || {letters('s_suppkey % 40')} AS player, s_acctbal > 2000 AS public_stream, s_suppkey % 10 = 0 AS is_replay,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'k' || (s_suppkey // 4) END AS owner_key, {EPOCH} + CAST(floor(s_acctbal) AS BIGINT) AS updated_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def big(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"
