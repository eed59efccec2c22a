"""Mob instances: which rows belong to one spawn of a mob, and what hangs off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.ordered import SPAN, Carry, scan, segment

KEYS = ["stream_id"]

# Idle seconds that end an instance, and seconds a kill still explains a loot.
GAP = 15
LOOT_SECS = 120
ACTIVE_SECS = 5
PARK_SECS = 300

_LOOT = ("item_loot", "item_sell", "item_hoard", "item_enhance")
_CARRIED = ("heal", "miss", "absorb", "currency_loot")


def assign_instances(
    events: DataFrame, gap: int = GAP, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN
) -> DataFrame:
    """Add ``mob``: the instance a row belongs to, named by the line that opened it.

    Needs ``k, ts, tgt, off, mob_name, touch``.  A touch under ``gap`` seconds after the last
    one of that name (any case) continues it, a parked mob never times out, and a kill makes
    the next touch a new instance.  Kills and loot take the newest instance of the name; loot
    without one falls back to the last kill; heals, misses by players, absorbs and coins take
    the last instance touched in the stream.
    """
    k = F.col("k")
    named = F.when(F.col("touch"), F.col("mob_name")).when((k == "slay") | k.isin(*_LOOT), F.col("tgt"))
    rows = events.withColumn("_mob", F.lower(named))
    parked = F.coalesce((k == "cc") & ~F.coalesce(F.col("off"), F.lit(True)), F.lit(False))
    rows = segment(
        rows, [*keys, "_mob"], order,
        state=F.struct(F.col("ts").alias("ts"), parked.alias("parked")),
        cut=lambda prev, cur: ~prev["parked"] & (cur["ts"] - prev["ts"] >= gap),
        member=F.coalesce(F.col("touch"), F.lit(False)),
        breaker=F.coalesce(k == "slay", F.lit(False)),
        span=span, start="_own", num="_n",
    )
    own = F.when(F.col("_mob").isNotNull(), F.col("_own"))
    rows = rows.withColumn("_own", own)
    rows = scan(rows, keys, order, [
        Carry("_active", "last", F.when(F.col("touch"), F.col("_own"))),
        # Plain numbers rather than a struct keep the chunk summaries a hash aggregate.
        Carry("_kill_ts", "last", F.when(k == "slay", F.col("ts"))),
        Carry("_kill", "last", F.when(k == "slay", F.coalesce("_own", F.lit(-1)))),
    ], span)
    fresh = F.when((F.col("ts") - F.col("_kill_ts") <= LOOT_SECS) & (F.col("_kill") >= 0), F.col("_kill"))
    mob = (
        F.when(k.isin(*_LOOT), F.coalesce("_own", fresh))
        .when(F.col("touch") | (k == "slay"), F.col("_own"))
        .when(k.isin(*_CARRIED), F.col("_active"))
    )
    return rows.withColumn("mob", mob).drop("_mob", "_own", "_n", "_active", "_kill", "_kill_ts")


def mob_instances(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """One row per instance: display name, first and last log time, death, parked state.

    The display name is the form seen in mid-sentence when there is one.
    """
    low = F.col("mob_name").rlike("^[a-z]")
    touch = F.coalesce(F.col("touch"), F.lit(False))
    line = F.col(order)
    parked = (F.col("k") == "cc") & ~F.coalesce(F.col("off"), F.lit(True))
    return events.filter((touch | (F.col("k") == "slay")) & F.col("mob").isNotNull()).groupBy(*keys, "mob").agg(
        F.coalesce(F.max_by("mob_name", F.when(touch & low, line)), F.min_by("mob_name", F.when(touch, line))).alias("name"),
        F.min(F.when(touch, F.col("ts"))).alias("first_ts"),
        F.max_by("ts", F.when(touch, line)).alias("last_ts"),
        F.min(F.when(F.col("k") == "slay", F.col("ts"))).alias("slain_ts"),
        F.coalesce(F.max_by(parked, F.when(touch, line)), F.lit(False)).alias("parked"),
        F.sum(touch.cast("long")).alias("touches"),
    )


def mob_list(instances: DataFrame, as_of: Column | int, gap: int = GAP, fight: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Status of each instance at a moment: dead (slain, or idle unless parked) or active.

    With the fight window of each stream, also how long after its start the mob was first and
    last seen; null when that lies before it.
    """
    now = F.lit(as_of) if isinstance(as_of, int) else as_of
    idle = now - F.col("last_ts")
    out = instances.withColumn("timed_out", ~F.col("parked") & (idle >= gap))
    out = out.withColumn("is_dead", F.col("slain_ts").isNotNull() | F.col("timed_out"))
    if fight is not None:
        at = lambda c: F.when(F.col(c) >= F.col("_start"), F.col(c) - F.col("_start"))
        out = out.join(fight.select(*keys, F.col("start_ts").alias("_start")), keys, "left").withColumns(
            {"first_offset": at("first_ts"), "last_offset": at("last_ts")}).drop("_start")
    return out.withColumns({
        "is_active": ~F.col("is_dead") & (idle < ACTIVE_SECS),
        "encounter_secs": F.col("last_ts") - F.col("first_ts"),
        "last_seen_secs": F.when(F.col("timed_out"), F.lit(gap).cast("long")).otherwise(idle),
    })


def parked_intervals(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """Spans in which a mob was parked: from the landing to its next line, or open."""
    rows = events.filter(F.coalesce(F.col("touch"), F.lit(False)) & F.col("mob_name").isNotNull()).withColumn("_mob", F.lower("mob_name"))
    rows = scan(rows, [*keys, "_mob"], order, [Carry("until_ts", "next", F.col("ts"))], span)
    landing = (F.col("k") == "cc") & ~F.coalesce(F.col("off"), F.lit(True))
    return rows.filter(landing).select(*keys, "mob", F.col("_mob").alias("name"), F.col("ts").alias("from_ts"), "until_ts")


def player_engaged(events: DataFrame, pets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Instances the log owner or one of their pets hit, or was hit by."""
    hits = events.filter(F.col("dmg").isNotNull() & F.col("mob").isNotNull()).select(
        *keys, "mob", "ts", "player", F.when(F.col("tank"), F.col("tgt")).otherwise(F.col("src")).alias("name"))
    mine = pets.select(*keys, "name", "owner").distinct()
    hits = hits.join(mine, [*keys, "name"], "left")
    return hits.filter((F.col("name") == F.col("player")) | (F.col("owner") == F.col("player"))).groupBy(*keys, "mob").agg(
        F.max("ts").alias("engaged_ts"))


def view_instance(instances: DataFrame, engaged: DataFrame, pinned: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The pinned instance where it exists, else the one last seen among the engaged."""
    rows = instances.join(engaged.select(*keys, "mob", F.lit(True).alias("_engaged")), [*keys, "mob"], "left")
    pin = F.col("mob") == F.lit(pinned) if pinned is not None else F.lit(False)
    rows = rows.filter(pin | F.coalesce("_engaged", F.lit(False))).withColumn("_pin", pin)
    return rows.groupBy(*keys).agg(F.max_by("mob", F.struct("_pin", "last_ts", "mob")).alias("mob"))
