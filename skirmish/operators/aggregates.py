"""Tables over events.  ``by`` is the scope: stream, session, segment, pull or instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import mods, times
from skirmish.operators.ordered import SPAN, Carry, ranked, scan

KEYS = ["stream_id"]

_DAMAGE = ("melee", "spell", "dot", "rip", "ds")
_LOOT = ("item_loot", "item_sell", "item_hoard", "item_enhance", "item_merge")
CAST_SECS = 10


def damage_rows(events: DataFrame) -> DataFrame:
    """Player-side damage."""
    return events.filter(F.col("k").isin(*_DAMAGE) & ~F.coalesce("tank", F.lit(False)))


def tank_rows(events: DataFrame) -> DataFrame:
    """Damage taken from mobs."""
    return events.filter(F.col("k").isin(*_DAMAGE) & F.coalesce("tank", F.lit(False)))


def _crits(flag: str = "critical") -> Column:
    # Damage shields carry no flags of their own, and ripostes count as crits only.
    none = ["ds"] if flag == "critical" else ["ds", "rip"]
    return F.count_if(mods.has_flag(F.col("mods"), flag) & ~F.col("k").isin(none))


def damage_by_player(events: DataFrame, by: list[str] = KEYS, elapsed: DataFrame | None = None) -> DataFrame:
    """Damage, hits, crits and twincasts per player; rate over the scope's fight time."""
    out = damage_rows(events).groupBy(*by, "src").agg(
        F.sum("dmg").alias("dmg"), F.count(F.lit(1)).alias("hits"), _crits().alias("crits"), _crits("twincast").alias("twincasts"))
    if elapsed is not None:
        out = out.join(elapsed.select(*by, "elapsed"), by).withColumn("dps", times.rate(F.col("dmg"), F.col("elapsed"))).drop("elapsed")
    return out.withColumnRenamed("src", "player")


def damage_by_type(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Damage per melee verb, ``dot``, ``ds`` or ``riposte``.  DoT damage also counts under its
    spell, so types and spells together exceed the total."""
    return damage_rows(events).filter(F.col("typ").isNotNull()).groupBy(*by, F.col("src").alias("player"), "typ").agg(
        F.sum("dmg").alias("dmg"), F.count(F.lit(1)).alias("hits"))


def damage_by_spell(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    return damage_rows(events).filter(F.col("sp").isNotNull()).groupBy(*by, F.col("src").alias("player"), "sp").agg(
        F.sum("dmg").alias("dmg"), F.count(F.lit(1)).alias("hits"))


def healing(events: DataFrame, who: str = "src", by: list[str] = KEYS, spell: bool = False) -> DataFrame:
    """Healing cast (``who='src'``) or received (``who='tgt'``); only amounts above zero."""
    cols = [*by, F.col(who).alias("player"), *(["sp"] if spell else [])]
    return events.filter(F.col("k") == "heal").groupBy(*cols).agg(
        F.sum("amt").alias("amt"), F.count(F.lit(1)).alias("heals")).filter(F.col("amt") > 0)


def tanked_by_player(events: DataFrame, by: list[str] = KEYS, typ: bool = False) -> DataFrame:
    cols = [*by, F.col("tgt").alias("player"), *(["typ"] if typ else [])]
    return tank_rows(events).groupBy(*cols).agg(F.sum("dmg").alias("dmg"), F.count(F.lit(1)).alias("hits"))


def avoidance_by_player(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Avoided swings per defender and kind."""
    return events.filter(F.col("k") == "miss").groupBy(*by, F.col("tgt").alias("player"), "typ").agg(F.count(F.lit(1)).alias("n"))


def resists_by_player(events: DataFrame, by: list[str] = KEYS, spell: bool = True) -> DataFrame:
    cols = [*by, F.col("src").alias("player"), *(["sp"] if spell else [])]
    return events.filter(F.col("k") == "resist").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def fizzles_by_spell(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    return events.filter(F.col("k") == "fizzle").groupBy(*by, "sp").agg(F.count(F.lit(1)).alias("n"))


def bucket(events: DataFrame, which: str) -> DataFrame:
    """Rows of one meter bucket as ``(player, amount)``: damage, tanking, healing or healed."""
    if which == "damage":
        return damage_rows(events).withColumns({"player": F.col("src"), "amount": F.col("dmg")})
    if which == "tanking":
        return tank_rows(events).withColumns({"player": F.col("tgt"), "amount": F.col("dmg")})
    heals = events.filter(F.col("k") == "heal")
    return heals.withColumns({"player": F.col("src" if which == "healing" else "tgt"), "amount": F.col("amt")})


def instance_bucket(events: DataFrame, which: str, keys: list[str] = KEYS) -> DataFrame:
    """Amount per instance and player; rows without an instance count for none."""
    return bucket(events, which).filter(F.col("mob").isNotNull()).groupBy(*keys, "mob", "player").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def tanking_rollup(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Instance tanking merged per player; a null ``mob`` is the player's total."""
    per = instance_bucket(events, "tanking", keys)
    total = per.groupBy(*keys, "player").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    return per.unionByName(total.withColumn("mob", F.lit(None).cast("long")))


def fight_totals(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Damage, heals, span and rate of a scope."""
    hit = F.col("k").isin(*_DAMAGE)
    mine = hit & ~F.coalesce("tank", F.lit(False))
    out = events.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(mine, F.col("dmg"))), F.lit(0)).alias("dmg"),
        F.coalesce(F.sum(F.when(F.col("k") == "heal", F.col("amt"))), F.lit(0)).alias("heals"),
        F.coalesce(F.max(F.when(hit, F.col("ts"))) - F.min(F.when(hit, F.col("ts"))), F.lit(0)).alias("elapsed"),
        F.count(F.lit(1)).alias("lines"),
    )
    return out.withColumn("dps", times.rate(F.col("dmg"), F.col("elapsed")))


def hit_ranges(events: DataFrame, by: list[str] = KEYS, taken: bool = False) -> DataFrame:
    """Hits, low, average, high and crit rate per type or spell."""
    rows = tank_rows(events) if taken else damage_rows(events)
    who = F.col("tgt" if taken else "src")
    out = rows.groupBy(*by, who.alias("player"), F.coalesce("sp", "typ").alias("what")).agg(
        F.count(F.lit(1)).alias("hits"), F.min("dmg").alias("low"), F.sum("dmg").alias("_sum"), F.max("dmg").alias("high"), _crits().alias("crits"))
    return out.withColumns({"avg": F.col("_sum") / F.col("hits"), "crit_rate": F.col("crits") / F.col("hits")}).drop("_sum")


def melee_accuracy(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Landed swings against avoided ones per player, with the kinds of avoidance."""
    swing = ((F.col("k") == "melee") & ~F.coalesce("tank", F.lit(False))) | ((F.col("k") == "miss") & ~F.coalesce("src_is_mob", F.lit(False)))
    miss = F.col("k") == "miss"
    kind = lambda t: F.count_if(miss & (F.col("typ") == t)).alias(t)
    out = events.filter(swing).groupBy(*by, F.col("src").alias("player")).agg(
        F.count_if(~miss).alias("landed"), F.count_if(miss).alias("avoided"), kind("dodge"), kind("parry"), kind("block"), kind("riposte"),
        F.count_if(miss & (F.col("typ") == "miss")).alias("missed"))
    return out.withColumn("accuracy", F.col("landed") / (F.col("landed") + F.col("avoided")))


def loot_summary(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Items by what became of them: quantity and copper."""
    return events.filter(F.col("k").isin(*_LOOT)).groupBy(*by, "k", F.coalesce("item", "result").alias("item")).agg(
        F.sum(F.coalesce("qty", F.lit(1))).alias("qty"), F.sum(F.coalesce("copper", F.lit(0))).alias("copper"), F.count(F.lit(1)).alias("n"))


def coin_totals(events: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Copper dropped and copper from sales."""
    drop, sold = F.col("k") == "currency_loot", F.col("k") == "item_sell"
    out = events.filter(drop | sold).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(drop, F.col("copper"))), F.lit(0)).alias("dropped"), F.coalesce(F.sum(F.when(sold, F.col("copper"))), F.lit(0)).alias("sold"))
    return out.withColumn("total", F.col("dropped") + F.col("sold"))


def group_share(totals: DataFrame, by: list[str] = KEYS, amount: str = "amount") -> DataFrame:
    """Share of the whole scope total.  The totals are aggregated first and joined back, so a
    large scope is never one window."""
    whole = totals.groupBy(*by).agg(F.sum(amount).alias("group_total"))
    out = totals.join(whole, by)
    return out.withColumn("share", F.when(F.col("group_total") > 0, F.col(amount) / F.col("group_total")).otherwise(F.lit(0.0)))


def breakdown(events: DataFrame, by: list[str] = KEYS, elapsed: DataFrame | None = None) -> DataFrame:
    """Types and spells of each player in one list, with rates."""
    both = damage_by_type(events, by).withColumn("is_spell", F.lit(False)).withColumnRenamed("typ", "what").unionByName(
        damage_by_spell(events, by).withColumn("is_spell", F.lit(True)).withColumnRenamed("sp", "what"))
    if elapsed is not None:
        both = both.join(elapsed.select(*by, "elapsed"), by).withColumn("rate", times.rate(F.col("dmg"), F.col("elapsed"))).drop("elapsed")
    return both


def meter_snapshot(
    events: DataFrame, instances: DataFrame, which: str, rows: int, keys: list[str] = KEYS, mobs: DataFrame | None = None
) -> DataFrame:
    """Top players of each instance with rate, share of all players, and the footer total.

    With the confirmed mobs given, the tanking meter leaves them out.
    """
    per = instance_bucket(events, which, keys)
    if mobs is not None and which == "tanking":
        per = drop_confirmed_mobs(per, mobs, keys)
    per = group_share(per, [*keys, "mob"])
    per = per.join(instances.select(*keys, "mob", "name", F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(0)).alias("elapsed")), [*keys, "mob"])
    top = ranked(per, [*keys, "mob"], [F.col("amount").desc(), F.col("player")], rows)
    return top.withColumns({"rate": times.rate(F.col("amount"), F.col("elapsed")), "footer_rate": times.rate(F.col("group_total"), F.col("elapsed"))})


def summary_line(snapshot: DataFrame, which: str, keys: list[str] = KEYS) -> DataFrame:
    """One pasteable line per instance from :func:`meter_snapshot`."""
    unit, per = ("dmg", "dps") if which in ("damage", "tanking") else ("heal", "hps")
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("player"), F.lit(" "), times.fmt_k(F.col("amount")),
        F.lit(" ("), F.rint(F.col("share") * 100.0).cast("long").cast("string"), F.lit("%)"))
    rows = snapshot.withColumn("_e", F.struct("rank", entry.alias("t")))
    out = rows.groupBy(*keys, "mob", "name", "group_total", "footer_rate", "elapsed").agg(F.array_sort(F.collect_list("_e")).alias("_l"))
    head = F.concat(
        F.col("name"), F.lit(": "), times.fmt_k(F.col("group_total")), F.lit(f" {unit} ("), times.fmt_k(F.col("footer_rate")),
        F.lit(f" {per}) over "), times.fmt_duration(F.col("elapsed")), F.lit(" | "))
    return out.select(*keys, "mob", F.concat(head, F.array_join(F.transform("_l", lambda x: x["t"]), ", ")).alias("line"))


def timeline(events: DataFrame, by: list[str] = KEYS, span: int = SPAN) -> DataFrame:
    """Damage per player and second, with the running total and the rate since the first hit."""
    per = damage_rows(events).groupBy(*by, F.col("src").alias("player"), "ts").agg(F.sum("dmg").alias("dmg"))
    out = scan(per, [*by, "player"], "ts", [Carry("total", "sum", F.col("dmg")), Carry("_first", "min", F.col("ts"))], span)
    return out.withColumn("rate", times.rate(F.col("total"), F.col("ts") - F.col("_first"))).drop("_first")


def player_evidence(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Names with what speaks for a player: damage dealt from a player position, or a /who row.
    Heals prove nothing."""
    dealt = damage_rows(events).select(*keys, F.col("src").alias("name"), F.lit(True).alias("d"), F.lit(False).alias("w"), F.lit(False).alias("h"))
    who = events.filter(F.col("k") == "who").select(*keys, "name", F.lit(False).alias("d"), F.lit(True).alias("w"), F.lit(False).alias("h"))
    heal = events.filter(F.col("k") == "heal").select(*keys, F.explode(F.array("src", "tgt")).alias("name"), F.lit(False).alias("d"), F.lit(False).alias("w"), F.lit(True).alias("h"))
    return dealt.unionByName(who).unionByName(heal).groupBy(*keys, "name").agg(
        F.bool_or("d").alias("dealt"), F.bool_or("w").alias("listed"), F.bool_or("h").alias("healed")
    ).withColumn("is_player", F.col("dealt") | F.col("listed"))


def segment_roster(events: DataFrame, by: list[str], exclusions: DataFrame | None = None) -> DataFrame:
    """Everyone who dealt, tanked, healed or was healed in a scope, minus its exclusions."""
    parts = [bucket(events, b).select(*by, "player") for b in ("damage", "tanking", "healing", "healed")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
    return apply_roster(out, exclusions, by) if exclusions is not None else out


def apply_roster(rows: DataFrame, exclusions: DataFrame, by: list[str], name: str = "player") -> DataFrame:
    """Drop names excluded in that scope only (any case)."""
    ex = exclusions.select(*by, F.lower("name").alias("_ex")).distinct()
    return rows.withColumn("_ex", F.lower(name)).join(ex, [*by, "_ex"], "left_anti").drop("_ex")


def drop_confirmed_mobs(rows: DataFrame, mobs: DataFrame, keys: list[str] = KEYS, name: str = "player") -> DataFrame:
    """Drop names that are mobs, in any case."""
    return apply_roster(rows, mobs, keys, name)


def class_list(events: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """Latest classes and level of every name listed by /who; the first class is primary."""
    out = events.filter(F.col("k") == "who").groupBy(*keys, "name").agg(
        F.max_by("classes", order).alias("classes"), F.max_by("level", order).alias("level"))
    return out.withColumn("primary", F.element_at("classes", 1))


def enrich_classes(rows: DataFrame, classes: DataFrame, keys: list[str] = KEYS, name: str = "player") -> DataFrame:
    return rows.join(classes.withColumnRenamed("name", name), [*keys, name], "left")


def update_class_cache(cache: DataFrame, fresh: DataFrame, key: str = "name") -> DataFrame:
    """Fresh non-empty classes replace cached ones; the cache fills unknown names."""
    f = fresh.filter(F.size("classes") > 0).select(key, F.col("classes").alias("_f"))
    return cache.select(key, "classes").join(f, key, "full_outer").select(key, F.coalesce("_f", "classes").alias("classes"))


def active_casts(events: DataFrame, as_of: int, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """Last cast of each player when it is under ten seconds old."""
    last = events.filter(F.col("k") == "cast").groupBy(*keys, F.col("src").alias("player")).agg(F.max_by(F.struct("sp", "ts"), order).alias("c"))
    return last.select(*keys, "player", "c.sp", "c.ts").filter(F.lit(as_of) - F.col("ts") < CAST_SECS)


def headline_mob(events: DataFrame, players: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The attacked name with most distinct attackers that is no player itself."""
    rows = damage_rows(events).filter(~F.col("tgt").endswith("'s corpse")).select(*keys, F.col("tgt").alias("name"), "src").distinct()
    per = rows.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("attackers"))
    if players is not None:
        per = per.join(players.select(*keys, "name"), [*keys, "name"], "left_anti")
    best = per.groupBy(*keys).agg(F.max_by(F.struct("name", "attackers"), F.struct("attackers", F.col("name"))).alias("b"))
    return best.select(*keys, "b.*")


# Tables over stored batches and the stream registry.


def stream_stats(batches: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Batches, and first and last times; the log time falls back to the arrival time."""
    log = F.coalesce("log_ts", "wall_ts")
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"), F.min_by("wall_ts", "id").alias("first_wall"), F.max_by("wall_ts", "id").alias("last_wall"),
        F.min_by(log, "id").alias("first_log"), F.max_by(log, "id").alias("last_log"))


def liveness(batches: DataFrame, now: int, idle: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """Idle seconds by the log's own clock."""
    out = batches.groupBy(*keys).agg(F.max_by(F.coalesce("log_ts", "wall_ts"), "id").alias("last_log"))
    out = out.withColumn("idle_secs", F.greatest(F.lit(now) - F.col("last_log"), F.lit(0)))
    return out.withColumn("active", F.col("idle_secs") <= idle)


def stream_rollup(streams: DataFrame, stats: DataFrame) -> DataFrame:
    """Streams per game, server and player (any case), and the two levels above, with the newest
    log time; names show in the form of the lowest stream id."""
    rows = streams.join(stats, "stream_id", "left")
    low = [F.lower(c).alias(f"_{c}") for c in ("game", "server", "player")]
    rows = rows.select("stream_id", "game", "server", "player", "last_log", *low)
    lev = rows.rollup("_game", "_server", "_player").agg(
        F.count(F.lit(1)).alias("streams"), F.max("last_log").alias("last_log"),
        F.min_by("game", "stream_id").alias("game"), F.min_by("server", "stream_id").alias("server"), F.min_by("player", "stream_id").alias("player"),
        F.grouping_id().alias("_g"),
    )
    return lev.select(
        (3 - F.when(F.col("_g") == 0, 0).when(F.col("_g") == 1, 1).when(F.col("_g") == 3, 2).otherwise(3)).alias("level"),
        F.when(F.col("_g") < 7, F.col("game")).alias("game"), F.when(F.col("_g") < 3, F.col("server")).alias("server"),
        F.when(F.col("_g") < 1, F.col("player")).alias("player"), "streams", "last_log")


def siblings(streams: DataFrame, live: DataFrame) -> DataFrame:
    """Other streams of the same owner, with how idle they are.

    One row per (stream, sibling): the result itself is pairs, of the few characters one
    person owns.
    """
    rows = streams.filter(F.coalesce("owner_key", F.lit("")) != "").join(live, "stream_id", "left")
    me = rows.select("stream_id", "owner_key")
    other = rows.select(F.col("stream_id").alias("sibling"), "owner_key", "player", "server", "game", "idle_secs", "active")
    return me.join(other, "owner_key").filter(F.col("stream_id") != F.col("sibling")).drop("owner_key")


def find_stream(streams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Streams by (game, server, player) in any case."""
    key = lambda d: d.withColumns({f"_{c}": F.lower(c) for c in ("game", "server", "player")})
    w = key(wanted).select("_game", "_server", "_player").distinct()
    return key(streams).join(w, ["_game", "_server", "_player"], "left_semi").drop("_game", "_server", "_player")


def since_reset(events: DataFrame, ts: int) -> DataFrame:
    """Rows counted after a reset at ``ts``.  Classes, levels and pet owners outlive a reset: they
    come from :func:`class_list` and the pet tables over all rows, so they are kept here too."""
    return events.filter((F.col("ts") >= ts) | F.col("k").isin("who", "pet"))
