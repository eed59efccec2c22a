"""The driver's tables seen as logs: rendered lines, and the events those lines stand for.

``combat_lines`` renders text from the ``events`` table; ``combat_events`` projects the same
rows straight to typed events, the shape a stored event table has.  A parse query goes through
the text, an aggregate reads the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators.once import once

# Log time runs 128 times faster than the table's clock, so that rows of one stream come
# seconds apart, as in a log.
EPOCH = 1704067200
SPEEDUP = 128

MOBS = ["a gnoll", "an orc pawn", "a fire beetle", "Emperor Crush", "orc legionnaire", "Lord Nagafen"]
ITEMS = ["Bat Meat", "Crystallized Sulfur", "Giant Bat Fur", "Throwing Boulder"]
STREAMS = 8

# The patterns of ``wide_lines``, one line shape each; see ``_WIDE``.
_WIDE = [
    ("hit_by_spell", "{p} hit {m} for {n} points of fire damage by Burst of Flame."),
    ("melee", "{p} crushes {m} for {n} points of damage. (Lucky Critical)"),
    ("dot", "{M} has been damaged by {p}'s Envenomed Bolt for {n} points of damage."),
    ("riposte", "{M} was injured by {p}'s riposte for {n} points of damage."),
    ("damage_shield", "{M} was struck by {p}'s damage shield for {n} points."),
    ("shield_proc", "{M} is burned by {p}'s flames for {n} points of non-melee damage."),
    ("shield_burn", "YOU are burned by {m}'s flames for {n} points of non-melee damage!"),
    ("cc_park", "{M} has been mesmerized."),
    ("cc_wake", "{M} has been awakened by {p}."),
    ("heartbeat", "You are stunned!"),
    ("cast", "{p} begins casting Lesser Summoning: Water."),
    ("fizzle", "Your Light Healing spell fizzles!"),
    ("berserk", "Labarer goes berserk."),
    ("slay_you", "You have slain {m}!"),
    ("slay_has", "{p} has slain {m}!"),
    ("slain_by", "{M} was slain by {p}!"),
    ("died", "{M} died."),
    ("currency", "You receive {n} platinum, 1 gold and 3 copper from the corpse."),
    ("loot_kept", "--You have looted a Crystallized Sulfur from {m}'s corpse.--"),
    ("loot_sold", "You looted 4 Giant Bat Fur from {m}'s corpse and sold it for {n} silver and 4 copper."),
    ("loot_hoard", "You looted a Throwing Boulder from {m}'s corpse and stored it in your Dragon Hoard"),
    ("loot_enhance", "You looted a Mask from {m}'s corpse to create a Mask +1"),
    ("merge", "You have successfully merged two items together to create a new item: Boots of the Long Road +2"),
    ("has_taken", "{M} has taken {n} damage from your Envenomed Bolt."),
    ("extra_damage", "{M} has taken an extra {n} points of non-melee damage from {p}'s Bane spell."),
    ("miss", "{p} tries to slash {m}, but {m} parries!"),
    ("absorb_skin", "{p}'s magical skin absorbs the damage of {m}'s thorns."),
    ("absorb_rune", "{p} has shielded itself from {n} points of damage."),
    ("resist", "{M} resisted {p}'s Tashania!"),
    ("who", "[50 Warrior Shadow Knight Rogue] {p} (Troll)"),
    ("heal", "{p} healed {p} over time for {n} hit points by Chloroblast."),
    ("login", "Welcome to EverQuest Legends!"),
    ("chat", "{p} tells the guild, 'you slash {m} for {n} points of damage.'"),
    ("zone_enter", "You have entered East Freeport."),
    ("instance_enter", "You have entered The City of Guk 4 (Refined)."),
    (None, "The sky darkens over {p}."),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows out to so many tasks, or to ``skirmish.spread`` where a session sets it, as a bench on one unsplittable file does."""
    tasks = tasks or df.sparkSession.conf.get("skirmish.spread", None)
    return df.repartition(int(tasks)) if tasks else df


# Micros of a time column that carries no zone; the session's zone plays no part.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({} as timestamp_ntz))"


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int") + 1)


def letters(n: Column) -> Column:
    """A number spelled in letters, as names hold no digits."""
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


def base_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ``events`` with stream, owner, actor, mob and amount."""
    e = table(spark, sf, "events")
    sid = F.col("user_id") % STREAMS
    owner = F.concat(F.lit("Hero"), letters(sid))
    mine = F.col("user_id") < STREAMS
    return e.select(
        F.concat(F.lit("s"), sid.cast("string")).alias("stream_id"),
        F.col("event_id").alias("line_no"),
        owner.alias("player"),
        F.expr(f"{EPOCH} + ({_MICROS.format('ts')} - {EPOCH}000000) div {SPEEDUP}000000").alias("ts"),
        F.when(mine, owner).otherwise(F.concat(F.lit("P"), letters(F.col("user_id")))).alias("actor"),
        mine.alias("mine"),
        _pick(MOBS, F.col("event_id")).alias("mobn"),
        F.floor("value").cast("long").alias("n"),
        F.col("event_type").alias("et"),
    )


def combat_events(spark: SparkSession, sf: str) -> DataFrame:
    """Typed, attributed events of the ``events`` table."""
    b = base_events(spark, sf)
    et, i = F.col("et"), F.col("line_no")
    bite = (et == "click") & (i % 7 == 3)
    dodge = (et == "error") & (i % 2 == 1)
    by_mob = bite | dodge
    hit = et.isin("click", "purchase")
    actor, mob = F.col("actor"), F.col("mobn")
    # A name without an article shows capitalized where it opens the sentence.
    opening = F.when(mob == "orc legionnaire", "Orc legionnaire").otherwise(mob)
    third = ~F.col("mine")
    heal = et == "view"
    touch = hit | dodge
    return b.select(
        "stream_id", "line_no", "player", "ts",
        F.when(et == "click", "melee").when(heal, "heal").when(et == "purchase", "spell").when(et == "error", "miss").otherwise("slay").alias("k"),
        F.when(by_mob, opening).otherwise(actor).alias("src"),
        F.when(by_mob, actor).when(heal, F.col("player")).when((et == "signup") & third, opening).otherwise(mob).alias("tgt"),
        F.when(hit, F.col("n")).alias("dmg"),
        F.when(heal, F.col("n")).alias("amt"),
        F.when(bite, "bite").when(et == "click", "slash").when(dodge, "dodge").when(et == "error", "miss").alias("typ"),
        F.when(heal, "Light Healing").when(et == "purchase", F.when(i % 2 == 0, "Burst of Flame").otherwise("Ice Comet")).alias("sp"),
        bite.alias("tank"),
        F.when((et == "click") & (i % 5 == 0), 1).otherwise(0).alias("mods"),
        by_mob.alias("src_is_mob"),
        F.when(by_mob, opening).when(touch, mob).alias("mob_name"),
        touch.alias("touch"),
        F.lit(None).cast("boolean").alias("off"),
        F.lit(None).cast("string").alias("name"),
    )


def log_prefix(ts: Column) -> Column:
    t = F.timestamp_add("SECOND", ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.lit("["), F.date_format(t, "EEE MMM dd HH:mm:ss yyyy"), F.lit("] "))


def _cap(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def combat_lines(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """Log text of the ``events`` table, first person for the owner's own rows, made by so many tasks."""
    b = spread(base_events(spark, sf), tasks)
    et, i, mine = F.col("et"), F.col("line_no"), F.col("mine")
    who, you = F.col("actor"), F.when(mine, "YOU").otherwise(F.col("actor"))
    mob, big, n = F.col("mobn"), _cap(F.col("mobn")), F.col("n").cast("string")
    crit = F.when(i % 5 == 0, " (Critical)").otherwise("")
    spell = F.when(i % 2 == 0, "Burst of Flame").otherwise("Ice Comet")
    say = lambda first, third: F.when(mine, F.concat(*first)).otherwise(F.concat(*third))
    L = F.lit
    body = (
        F.when((et == "click") & (i % 7 == 3), F.concat(big, L(" bites "), you, L(" for "), n, L(" points of damage."), crit))
        .when(et == "click", say([L("You slash "), mob, L(" for "), n, L(" points of damage."), crit],
                                 [who, L(" slashes "), mob, L(" for "), n, L(" points of damage."), crit]))
        .when(et == "view", F.concat(say([L("You")], [who]), L(" healed "), F.col("player"), L(" for "), n, L(" hit points by Light Healing.")))
        .when(et == "purchase", F.concat(say([L("You")], [who]), L(" hit "), mob, L(" for "), n, L(" points of fire damage by "), spell, L(".")))
        .when((et == "error") & (i % 2 == 1), F.concat(big, L(" tries to bite "), you, L(", but "), you, L(" dodges!")))
        .when(et == "error", say([L("You try to slash "), mob, L(", but miss!")], [who, L(" tries to slash "), mob, L(", but misses!")]))
        .otherwise(say([L("You have slain "), mob, L("!")], [big, L(" has been slain by "), who, L("!")]))
    )
    return once(b, raw=F.concat(log_prefix(F.col("ts")), body)).select("stream_id", "player", "line_no", "raw")


def wide_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One of every line shape in turn, over the rows of ``events``; ``shape`` tells which."""
    b = spread(base_events(spark, sf))
    fill = {"p": F.concat(F.lit("P"), letters(F.col("line_no") % 50)), "m": F.col("mobn"), "M": _cap(F.col("mobn")), "n": F.col("n").cast("string")}
    import re

    def text(t: str) -> Column:
        return F.concat(*[fill[p[1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w\})", t) if p])

    shape = (F.col("line_no") % len(_WIDE)).cast("int")
    body = F
    for j, (_, t) in enumerate(_WIDE):
        body = body.when(shape == j, text(t))
    return once(b, shape=shape, raw=F.concat(log_prefix(F.col("ts")), body)).select("stream_id", "player", "line_no", "shape", "n", "raw")


def loot_events(spark: SparkSession, sf: str) -> DataFrame:
    """Loot of ``lineitem`` with the names of ``part``: kept, sold or hoarded."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    kept, sold = F.col("l_returnflag") == "A", F.col("l_returnflag") == "N"
    return li.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % STREAMS).cast("string")).alias("stream_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
        F.expr(f"{_MICROS.format('l_shipdate')} div 1000000").alias("ts"),
        F.when(kept, "item_loot").when(sold, "item_sell").otherwise("item_hoard").alias("k"),
        F.col("p_name").alias("item"),
        F.when(kept, F.lit(1).cast("long")).when(sold, F.col("l_quantity").cast("long")).alias("qty"),
        F.when(sold, F.floor("l_extendedprice").cast("long")).alias("copper"),
    )


def loot_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same as log text; the price is spelled in coins."""
    ev = spread(loot_events(spark, sf))
    c = F.col("copper")
    coins = F.concat(
        F.expr("copper div 1000").cast("string"), F.lit(" platinum, "), F.expr("copper div 100 % 10").cast("string"), F.lit(" gold, "),
        F.expr("copper div 10 % 10").cast("string"), F.lit(" silver and "), (c % 10).cast("string"), F.lit(" copper"))
    k, item = F.col("k"), F.col("item")
    body = (
        F.when(k == "item_loot", F.concat(F.lit("--You have looted "), item, F.lit(" from a gnoll's corpse.--")))
        .when(k == "item_sell", F.concat(F.lit("You looted "), F.col("qty").cast("string"), F.lit(" "), item, F.lit(" from a gnoll's corpse and sold it for "), coins, F.lit(".")))
        .otherwise(F.concat(F.lit("You looted "), item, F.lit(" from a gnoll's corpse and stored it in your Dragon Hoard")))
    )
    return once(ev, raw=F.concat(log_prefix(F.col("ts")), body)).select("stream_id", F.lit("Izzin").alias("player"), "line_no", "raw")


def order_batches(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as stored batches of one stream per customer; arrival order is the order key."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("id"),
        F.expr(f"{_MICROS.format('o_orderdate')} div 1000000").alias("log_ts"),
        F.expr(f"{_MICROS.format('o_orderdate')} div 1000000 + o_orderkey % 7").alias("wall_ts"),
        (F.col("o_orderkey") % 5).alias("seq"),
        (F.col("o_orderpriority") == "1-URGENT").alias("login"),
    )


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """``supplier`` as the stream registry: region, nation and supplier as game, server, player."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        F.col("s_suppkey").alias("stream_id"), F.col("r_name").alias("game"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("server"),
        F.concat(F.lit("P"), letters(F.col("s_suppkey") % 40)).alias("player"),
        (F.col("s_acctbal") > 2000).alias("public_stream"), (F.col("s_suppkey") % 10 == 0).alias("is_replay"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("k"), F.expr("s_suppkey div 4").cast("string"))).alias("owner_key"),
        (F.lit(EPOCH) + F.floor("s_acctbal").cast("long")).alias("updated_at"),
    )


_CHAT_EVENTS = [
    "You have slain a gnoll!", "--You have looted a Bat Meat from a gnoll's corpse.--", "Pab has been slain by a gnoll!",
    "You receive 3 gold from the corpse.", "A gnoll resisted your Tashania!", "The sky darkens.", "You begin casting Ice Comet.",
]


def chat_text() -> Column:
    return F.trim(F.regexp_replace("text", r"['\"\r\n\t]", " "))


def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as group chat with a game line before each message."""
    c = table(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.lit(EPOCH) + conv * 100 + turn * 12
    game = _pick(_CHAT_EVENTS, conv * 3 + turn)
    speaker = F.concat(_cap(F.col("role")), letters(conv % 10))
    msg = F.when(turn % 4 == 3, F.concat(F.lit("You tell your party, '"), chat_text(), F.lit("'"))).otherwise(
        F.concat(speaker, F.lit(" tells the group, '"), chat_text(), F.lit("'")))
    rows = c.select(
        F.concat(F.lit("c"), (conv % STREAMS).cast("string")).alias("stream_id"), F.lit("Izzin").alias("player"), conv, turn, at.alias("at"),
        F.posexplode(F.array(game, msg)).alias("pos", "body"))
    rows = once(rows, raw=F.concat(log_prefix(F.col("at") + F.col("pos") * 7), F.col("body")))
    return rows.select("stream_id", "player", (F.col("conv_id") * (1 << 20) + F.col("turn") * 2 + F.col("pos")).alias("line_no"), "raw")
