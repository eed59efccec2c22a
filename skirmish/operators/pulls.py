"""Pulls: mob instances fought as one unit; and which mobs are named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.instances import GAP, PARK_SECS
from skirmish.operators.ordered import SPAN, Carry, scan, stage

KEYS = ["stream_id"]

# Fixed value: two deaths of one name within this many seconds make it trash.
CORPSE_SECS = 90

_FOREVER = 1 << 40


def pulls(
    instances: DataFrame, loots: DataFrame | None = None, heartbeats: DataFrame | None = None, gap: int = GAP,
    keys: list[str] = KEYS, order: str = "mob", span: int = SPAN,
) -> DataFrame:
    """Add ``pull`` (number within the stream) to each instance.

    Definition used here.  Instances in order of opening chain while each opens at most ``gap``
    seconds after everything before it ended.  A mob parked at its last line counts as lasting
    300 more seconds, and a heartbeat counts as activity at its second but opens nothing.
    Inside a chain a new pull also starts when every mob before was slain and something was
    looted between the last of those deaths and the new mob.
    """
    end = F.col("last_ts") + F.when(F.col("parked"), F.lit(PARK_SECS)).otherwise(F.lit(0))
    end = F.greatest(end, F.coalesce("slain_ts", "last_ts"))
    none = F.lit(None).cast("long")
    # Heartbeat and loot lines are positioned by their line number among the opening lines.
    rows = instances.withColumns({"_pos": F.col(order) * 2 + 1, "_end": end, "_loot": none, "_is": F.lit(True)})
    marks = []
    if heartbeats is not None:
        marks.append(heartbeats.select(*keys, (F.col("line_no") * 2).alias("_pos"), F.col("ts").alias("first_ts"), F.col("ts").alias("_end"), none.alias("_loot")))
    if loots is not None:
        marks.append(loots.select(*keys, (F.col("line_no") * 2).alias("_pos"), none.alias("first_ts"), none.alias("_end"), F.col("ts").alias("_loot")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks, rows)
    mob = F.col("_is").isNotNull()
    rows = scan(rows, keys, "_pos", [
        Carry("_reach", "max", F.col("_end"), inclusive=False),
        Carry("_looted", "max", F.col("_loot"), inclusive=False),
    ], span * 2)
    rows = stage(rows)
    gap_cut = F.col("_reach").isNull() | (F.col("first_ts") - F.col("_reach") > gap)
    rows = rows.withColumn("_chain_cut", F.when(F.col("first_ts").isNotNull(), gap_cut.cast("long")).otherwise(F.lit(0).cast("long")))
    rows = scan(rows, keys, "_pos", [Carry("_chain", "sum", F.col("_chain_cut"))], span * 2).filter(mob)
    died = F.coalesce("slain_ts", F.lit(_FOREVER))
    rows = scan(rows, [*keys, "_chain"], "_pos", [Carry("_all_dead", "max", died, inclusive=False)], span * 2)
    rows = stage(rows)
    corpse_cut = (F.col("_all_dead") <= F.col("first_ts")) & (F.col("_looted") >= F.col("_all_dead"))
    opens = F.col("_all_dead").isNull() | F.coalesce(corpse_cut, F.lit(False))
    rows = scan(rows.withColumn("_open", opens.cast("long")), keys, "_pos", [Carry("pull", "sum", F.col("_open"))], span * 2)
    return rows.drop("_pos", "_end", "_loot", "_is", "_reach", "_looted", "_chain_cut", "_chain", "_all_dead", "_open")


def pull_summary(members: DataFrame, damage: DataFrame | None = None, named: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """One row per pull: members, composition, span, damage, rate and the named mobs in it.

    ``damage`` holds ``(keys, mob, dmg)`` per instance.
    """
    rows = members
    rows = rows.join(damage.select(*keys, "mob", F.col("dmg").alias("_d")), [*keys, "mob"], "left") if damage is not None else rows.withColumn("_d", F.lit(0).cast("long"))
    rows = rows.withColumn("_name", F.lower("name"))
    if named is not None:
        rows = rows.join(named.select(*keys, F.col("name").alias("_name"), "is_named"), [*keys, "_name"], "left")
    else:
        rows = rows.withColumn("is_named", F.lit(False))
    per = rows.groupBy(*keys, "pull", "_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_ts").alias("s"), F.max("last_ts").alias("e"), F.sum("_d").alias("d"),
        F.max(F.coalesce("is_named", F.lit(False))).alias("named"), F.min_by("name", "mob").alias("display"),
    )
    out = per.groupBy(*keys, "pull").agg(
        F.sum("n").alias("members"), F.min("s").alias("start_ts"), F.max("e").alias("end_ts"), F.coalesce(F.sum("d"), F.lit(0)).alias("dmg"),
        F.array_join(F.array_sort(F.collect_list(F.concat("_name", F.lit(" x"), F.col("n").cast("string")))), ", ").alias("composition"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("named"), F.col("display")))), " + ").alias("named"),
    )
    return out.withColumn("dps", F.round(F.col("dmg") / F.greatest((F.col("end_ts") - F.col("start_ts")).cast("double"), F.lit(0.001))).cast("long"))


def corpse_concurrency(slays: DataFrame, secs: int = CORPSE_SECS, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """Names with two deaths at most ``secs`` apart."""
    rows = slays.withColumn("name", F.lower("tgt"))
    rows = scan(rows, [*keys, "name"], order, [Carry("_before", "last", F.col("ts"), inclusive=False)], span)
    return rows.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("deaths"),
        F.max(F.coalesce(F.col("ts") - F.col("_before") <= secs, F.lit(False))).alias("concurrent"),
    )


def named_mobs(events: DataFrame, mob: Column, keys: list[str] = KEYS, secs: int = CORPSE_SECS, span: int = SPAN) -> DataFrame:
    """Mob names with ``is_named``: never seen lowercase, and never two corpses at once.

    ``mob`` gives the mob name of a row as written in the line (null for other rows).
    """
    seen = events.select(*keys, mob.alias("_n")).filter(F.col("_n").isNotNull())
    grammar = seen.groupBy(*keys, F.lower("_n").alias("name")).agg(
        F.max(F.col("_n").rlike(r"^\p{Ll}")).alias("lowercase"), F.count(F.lit(1)).alias("lines"))
    dead = corpse_concurrency(events.filter(F.col("k") == "slay").select(*keys, "line_no", "ts", "tgt"), secs, keys, span=span)
    out = grammar.join(dead, [*keys, "name"], "left")
    return out.select(
        *keys, "name", "lines", "lowercase", F.coalesce("concurrent", F.lit(False)).alias("concurrent"),
        (~F.col("lowercase") & ~F.coalesce("concurrent", F.lit(False))).alias("is_named"))


def apply_mob_overrides(named: DataFrame, overrides: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The owner's own verdict (named or trash) beats the computed one; of two on one name the later in the alphabet holds."""
    o = overrides.groupBy(*keys, F.lower("name").alias("name")).agg(F.max("kind").alias("_kind"))
    return named.join(o, [*keys, "name"], "left").withColumn(
        "is_named", F.coalesce(F.col("_kind") == "named", F.col("is_named"))).drop("_kind")
