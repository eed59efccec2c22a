"""Who is a mob and who is a player, per line; and who owns which pet.

The log never says what a name is.  A name becomes a *player* for good once it is seen
dealing player-side damage, and a *mob* once it attacks a player, is attacked by one, or burns
one.  Every decision uses only earlier lines, so the first telling line of a name settles it.
That makes an exact set form possible: one aggregate finds the first telling lines of each
name, and only names whose first swing depends on somebody else's status are settled by a
loop over a small table, until nothing changes.  No step holds a stream in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import names as nm
from skirmish.operators.once import in_turn, once
from skirmish.operators.ordered import SPAN, Carry, scan, small, stage

KEYS = ["stream_id"]

# Seconds in which a pet shows up after its owner's cast.
BUFF_SECS = 10
SUMMON_SECS = 60

_ALWAYS_PLAYER = ("dot", "shield_proc", "extra_damage")
_EITHER = ("hit_by_spell", "melee", "riposte", "damage_shield", "has_taken")
_WARDER = ("hit_by_spell", "melee", "riposte", "damage_shield", "miss", "has_taken")


def _as_of_cast(parsed: DataFrame, cast: Column, seen: Column, keys: list[str], order: str, secs: int, span: int) -> DataFrame:
    """Pet sightings with the latest such cast before them, within ``secs``, by someone else."""
    hint = F.when(cast, F.struct(F.col(order).alias("line"), F.col("src").alias("owner"), F.col("ts").alias("ts")))
    rows = parsed.filter(cast | seen).select(*keys, order, "ts", "src", hint.alias("_cast"))
    out = scan(rows, keys, order, [Carry("_by", "last", F.col("_cast"), inclusive=False)], span)
    by = F.col("_by")
    return out.filter(
        F.col("_cast").isNull() & (F.greatest(F.col("ts") - by["ts"], F.lit(0)) <= secs) & (by["owner"] != F.col("src"))
    ).select(*keys, order, "ts", F.col("src").alias("name"), by["owner"].alias("owner"), by["line"].alias("cast_line"))


def pet_hints() -> dict[str, Column]:
    """Flags of a parsed row: a cast that buffs a pet or summons one, and a pet seen after such a cast."""
    p, src = F.col("pattern"), F.col("src")
    cast = (p == "cast") & ~F.contains(src, F.lit(" "))
    flags = {
        "buff_cast": cast & nm.is_pet_buff_spell(F.col("sp")), "summon_cast": cast & nm.is_pet_summon_spell(F.col("sp")),
        "buff_seen": (p == "berserk") & nm.is_generated_pet_name(src), "summon_seen": p.isin("melee", "miss") & nm.is_generated_pet_name(src),
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}


def pet_owner_by_buff(parsed: DataFrame, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """A generated-name pet going berserk right after a pet-buff cast; a cast is used once."""
    hint = pet_hints()
    hits = _as_of_cast(parsed, hint["buff_cast"], hint["buff_seen"], keys, order, BUFF_SECS, span)
    first = hits.groupBy(*keys, "cast_line").agg(F.min_by(F.struct(order, "ts", "name", "owner"), order).alias("p"))
    return first.select(*keys, "p.*")


def pet_owner_by_summon(
    parsed: DataFrame, known: DataFrame | None = None, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN
) -> DataFrame:
    """First swing of a never-owned generated pet soon after a summon cast; a cast is used once.

    ``known`` holds pets owned earlier for another reason (name, line).
    """
    hint = pet_hints()
    hits = _as_of_cast(parsed, hint["summon_cast"], hint["summon_seen"], keys, order, SUMMON_SECS, span)
    hits = stage(hits.groupBy(*keys, "cast_line", "name").agg(
        F.min_by(F.struct(order, "ts", "owner"), order).alias("p")).select(*keys, "cast_line", "name", "p.*"))
    before = None
    if known is not None:
        before = known.groupBy(*keys, "name").agg(F.min(order).alias("_k"))
    owned = hits.select(*keys, "name", F.col(order).alias("_own")).limit(0)
    while True:
        rows = hits.join(owned, [*keys, "name"], "left")
        rows = rows.join(before, [*keys, "name"], "left") if before is not None else rows.withColumn("_k", F.lit(None).cast("long"))
        free = rows.filter((F.col("_own").isNull() | (F.col(order) <= F.col("_own"))) & (F.col("_k").isNull() | (F.col(order) < F.col("_k"))))
        won = free.groupBy(*keys, "cast_line").agg(F.min_by(F.struct(order, "ts", "name", "owner"), order).alias("p")).select(*keys, "p.*")
        new = stage(won.groupBy(*keys, "name").agg(F.min_by(F.struct(order, "ts", "owner"), order).alias("p")).select(*keys, "name", "p.*"))
        nxt = new.select(*keys, "name", F.col(order).alias("_own"))
        if nxt.exceptAll(owned).isEmpty() and owned.exceptAll(nxt).isEmpty():
            return new.select(*keys, order, "ts", "name", "owner")
        owned = nxt


def warders(parsed: DataFrame, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """Pets named after their owner, at their first line."""
    owner = nm.warder_owner(F.col("src"))
    rows = parsed.filter(F.col("pattern").isin(*_WARDER) & owner.isNotNull())
    first = rows.groupBy(*keys, F.col("src").alias("name")).agg(F.min_by(F.struct(order, "ts", "pattern"), order).alias("p"))
    return first.select(*keys, f"p.{order}", "p.ts", "name", nm.warder_owner(F.col("name")).alias("owner"), "p.pattern")


def pet_events(parsed: DataFrame, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """All ``pet`` events: buff landings, summons and warders, with how each was learned."""
    buff = stage(pet_owner_by_buff(parsed, keys, order, span))
    summon = pet_owner_by_summon(parsed, buff, keys, order, span)
    ward = warders(parsed, keys, order).filter(F.col("pattern") != "has_taken").drop("pattern")
    cols = [*keys, order, "ts", "name", "owner"]
    return (
        buff.select(*cols, F.lit("buff").alias("how"))
        .unionByName(summon.select(*cols, F.lit("summon").alias("how")))
        .unionByName(ward.select(*cols, F.lit("warder").alias("how")))
    )


def attribute_spell(parsed: DataFrame, keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN) -> DataFrame:
    """Caster of spell lines that name only the spell: its latest caster before the line.

    ``Denon's Discord hit X`` is tried as one spell name first; only without such a cast does
    the possessive name the caster.  Adds ``caster``.

    Where lines were parsed with ``spell_before_melee``, a plain hit by a name that no one has cast as a spell
    becomes the melee swing it reads as.
    """
    p = F.col("pattern")
    spell = F.when(p == "spell_attr", F.concat("src", F.lit("'s "), "sp")).when(p.isin("spell_hit", "cast"), F.col("sp"))
    rows = parsed.withColumn("_spell", spell)
    out = scan(rows, [*keys, "_spell"], order, [Carry("caster", "last", F.when(p == "cast", F.col("src")), inclusive=False)], span)
    mine = p.isin("spell_attr", "spell_hit")
    whole = (p == "spell_attr") & F.col("caster").isNotNull()
    out = out.withColumns({
        "sp": F.when(whole, F.col("_spell")).otherwise(F.col("sp")),
        "src": F.when(mine & F.col("caster").isNotNull(), F.col("caster")).otherwise(F.col("src")),
        "caster": F.when(mine, F.col("caster")),
    }).drop("_spell")
    if "plain" in parsed.columns:
        swing = F.coalesce((p == "spell_hit") & F.col("caster").isNull() & F.col("plain").isNotNull(), F.lit(False))
        new = {c: F.when(swing, F.col(f"plain.{c}")).otherwise(F.col(c)) for c in ("src", "tgt", "dmg", "typ", "verb")}
        new |= {"pattern": F.when(swing, "melee").otherwise(p), "k": F.when(swing, "melee").otherwise(F.col("k")), "sp": F.when(swing, F.lit(None)).otherwise(F.col("sp"))}
        out = once(out, **new).select(*[c for c in parsed.columns if c != "plain"], "caster")
    return out


def _category(parsed: DataFrame) -> Column:
    """What a row says about its source: a player for sure (U), a mob by its verb (H), a swing (C), a spell that was cast (S), a miss (M), a burn (B)."""
    p, src = F.col("pattern"), F.col("src")
    caster = F.col("caster").isNotNull() if "caster" in parsed.columns else F.lit(False)
    warder = p.isin(*_WARDER) & nm.warder_owner(src).isNotNull()
    return (
        F.when(p.isin(*_ALWAYS_PLAYER) | warder | ((p == "has_taken") & (src == F.col("player"))) | ((p == "spell_attr") & caster), "U")
        .when((p == "melee") & F.col("verb").isin("hit", "hits"), "H")
        .when(p.isin(*_EITHER) & src.isNotNull(), "C")
        .when((p == "spell_hit") & caster, "S")
        .when(p == "miss", "M")
        .when(p == "shield_burn", "B")
    )


def _evidence(parsed: DataFrame, pets: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    p = F.col("pattern")
    out = parsed.select(*keys, order, _category(parsed).alias("cat"), "src", "tgt", "player", (p != "miss").alias("hurts")).filter(F.col("cat").isNotNull())
    if pets is not None:
        none = F.lit(None).cast("string")
        out = out.unionByName(pets.select(*keys, order, F.lit("U").alias("cat"), F.col("name").alias("src"), none.alias("tgt"), none.alias("player"), F.lit(False).alias("hurts")))
    return out


def known_players(parsed: DataFrame, pets: DataFrame | None = None, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """First line from which each name is a player: ``(keys, name, k)``."""
    ev = _evidence(parsed, pets, keys, order)
    line = F.col(order)
    swing = F.col("cat").isin("H", "C", "S")
    mine = F.coalesce(F.col("tgt") == F.col("player"), F.lit(False))
    open_swing = (F.col("cat") == "S") | ((F.col("cat") == "C") & ~mine)
    # Only numbers and flags in the buffers, so that this pass over all rows is a hash aggregate.
    names = stage(ev.groupBy(*keys, F.col("src").alias("name")).agg(
        F.min(F.when(F.col("cat") == "U", line)).alias("u"),
        F.min(F.when(F.col("cat") == "B", line)).alias("b"),
        F.min(F.when(swing, line)).alias("sl"),
        F.min_by(open_swing, F.when(swing, line)).alias("so"),
    ))
    is_open = F.coalesce(F.col("so"), F.lit(False)) & ~F.contains("name", F.lit(" ")) & (F.col("u").isNull() | (F.col("u") > F.col("sl")))
    names = names.withColumn("open", is_open)
    unsure = names.filter("open").select(*keys, "name", "sl", "b")

    # What can unsettle them, in one small table.  Attacks, per attacker: the first of all, and the
    # first once the attacker is a player for an unconditional reason (a name with a blank in it
    # has no other).  Swings that missed before the first hit, which tell when the target was a
    # player by then.
    who = names.select(*keys, F.col("name").alias("src"), "u", F.col("open").alias("src_open"), "sl")
    hits = F.col("hurts") & F.col("cat").isin("U", "H", "C", "S") & ~F.coalesce(F.col("tgt").endswith("'s corpse"), F.lit(True))
    pairs = ev.filter(hits | (F.col("cat") == "M")).join(who, [*keys, "src"]).filter(
        F.when(F.col("cat") == "M", F.col("src_open") & (line < F.col("sl"))).otherwise(F.col("src_open") | (line >= F.col("u"))))
    pairs = pairs.join(unsure.select(*keys, F.col("name").alias("tgt"), F.lit(True).alias("tgt_open")), [*keys, "tgt"], "left")
    first = F.col("src_open") & (line == F.col("sl"))
    pairs = pairs.filter((F.col("cat") == "M") | F.col("tgt_open") | first)
    pairs = stage(pairs.groupBy(*keys, "src", "tgt", (F.col("cat") == "M").alias("miss")).agg(
        F.min(order).alias("m_all"), F.min(F.when(line >= F.col("u"), line)).alias("m_u"), F.max(order).alias("ml"),
        F.max(mine).alias("mine"), F.max(first & (F.col("cat") != "S")).alias("first")))
    unsure = unsure.join(pairs.filter("first").select(*keys, F.col("src").alias("name"), F.col("tgt").alias("st")), [*keys, "name"], "left")
    attack = pairs.filter(~F.col("miss")).select(*keys, "src", "tgt", "m_all", "m_u")
    miss = pairs.filter("miss").select(*keys, F.col("src").alias("name"), F.col("tgt").alias("mt"), "ml", "mine")

    verdict = unsure.select(*keys, "name", F.lit(True).alias("flag"))
    while True:
        k = names.join(verdict, [*keys, "name"], "left").select(
            *keys, "name", F.least("u", F.when(F.coalesce("flag", F.lit(False)), F.col("sl"))).alias("k"))
        hit = attack.join(verdict.withColumnRenamed("name", "src"), [*keys, "src"], "left").groupBy(*keys, F.col("tgt").alias("name")).agg(
            F.min(F.when(F.coalesce("flag", F.lit(False)), F.col("m_all")).otherwise(F.col("m_u"))).alias("hit_at"))
        bad = miss.join(k.withColumnRenamed("name", "mt"), [*keys, "mt"], "left").groupBy(*keys, "name").agg(
            F.max(F.col("mine") | F.coalesce(F.col("k") < F.col("ml"), F.lit(False))).alias("missed_player"))
        sl = F.col("sl")
        less = lambda c: F.coalesce(F.col(c) < sl, F.lit(False))
        mob = less("kt") | less("hit_at") | less("b") | F.coalesce("missed_player", F.lit(False))
        new = stage(
            unsure.join(verdict.withColumnRenamed("flag", "was"), [*keys, "name"])
            .join(k.select(*keys, F.col("name").alias("st"), F.col("k").alias("kt")), [*keys, "st"], "left")
            .join(hit, [*keys, "name"], "left").join(bad, [*keys, "name"], "left")
            .select(*keys, "name", "was", (~mob).alias("flag"))
        )
        changed = not new.filter("flag <> was").isEmpty()
        verdict = new.drop("was")
        if not changed:
            return k.filter(F.col("k").isNotNull())


def classify(
    parsed: DataFrame, pets: DataFrame | None = None, keys: list[str] = KEYS, order: str = "line_no"
) -> DataFrame:
    """Direction of every row, and which mob it touches.

    Adds ``src_is_mob``, ``tank``, ``mob_name`` (the mob this row is about) and ``touch`` (the
    row keeps that mob's instance open); ``k``, ``sp`` and ``typ`` become those of the final
    event.  ``k`` turns null for rows that emit none.
    """
    parsed = _attributed(parsed, keys, order)
    k = known_players(parsed, pets, keys, order)
    return direct(parsed, k, keys, order)


def explain_events(parsed: DataFrame, pets: DataFrame | None = None, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """:func:`classify` with ``direction_rule``: what decided who the mob is, null where nothing had to."""
    parsed = _attributed(parsed, keys, order)
    return direct(parsed, known_players(parsed, pets, keys, order), keys, order, reasons=True)


def _attributed(parsed: DataFrame, keys: list[str], order: str) -> DataFrame:
    return stage(attribute_spell(parsed, keys, order)) if "plain" in parsed.columns else parsed


def _sides(rows: DataFrame, names: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Who strikes in every row, as flags, from a table of names (``k``: player from that line on; other columns join by source)."""
    more = [c for c in names.columns if c not in (*keys, "name", "k")]
    rows = rows.join(small(names.select(*keys, F.col("name").alias("src"), F.col("k").alias("_ks"), *more)), [*keys, "src"], "left")
    rows = rows.join(small(names.filter("k is not null").select(*keys, F.col("name").alias("tgt"), F.col("k").alias("_kt"))), [*keys, "tgt"], "left")
    return _flags(rows, order)


def _flags(rows: DataFrame, order: str) -> DataFrame:
    """Who strikes, from the lines since which source (``_ks``) and target (``_kt``) are players."""
    line, p = F.col(order), F.col("pattern")
    src, tgt = F.col("src"), F.col("tgt")
    not_player = F.col("_ks").isNull() | (line < F.col("_ks"))
    caster = F.col("caster").isNotNull() if "caster" in rows.columns else F.lit(False)
    swing = p.isin(*_EITHER) & src.isNotNull() & ~((p == "has_taken") & (src == F.col("player")))
    lost = p.isin("spell_attr", "spell_hit") & ~caster & ((p == "spell_hit") | not_player)
    sure_player = p.isin(*_ALWAYS_PLAYER) | (p == "spell_attr") | ((p == "has_taken") & (src == F.col("player")))
    mob_hit = ((swing | (p == "spell_hit")) & not_player) & ~lost
    player_hit = ((swing | sure_player | (p == "spell_hit")) & ~mob_hit) & ~lost
    return in_turn(rows, {"_mob_hit": F.coalesce(mob_hit, F.lit(False))}, {"_player_hit": F.coalesce(player_hit, F.lit(False))}, {
        "_lost": F.coalesce(lost, F.lit(False)), "_np": not_player, "_tp": F.coalesce(F.col("_kt") < line, F.lit(False)), "_swing": swing, "_sure": sure_player,
        "_spaced": F.coalesce(F.contains(src, F.lit(" ")), F.lit(False)), "_mine": F.coalesce(tgt == F.col("player"), F.lit(False)),
    })


def direct(parsed: DataFrame, k: DataFrame, keys: list[str] = KEYS, order: str = "line_no", reasons: bool = False) -> DataFrame:
    """:func:`classify` with the player table given."""
    line, p = F.col(order), F.col("pattern")
    src, tgt = F.col("src"), F.col("tgt")
    k = stage(k.select(*keys, "name", "k"))
    # First the line from which each name is a mob, from the few columns that tell, then all that is known
    # of the names in one table, which the whole rows meet twice: as source and as target.
    some = [*keys, order, "pattern", "src", "tgt", "player", "caster", "verb"]
    told = _sides(parsed.select(*[c for c in some if c in parsed.columns]), k, keys, order)
    on_src = F.col("_mob_hit") | (p == "shield_burn") | ((p == "miss") & F.col("_np") & (F.col("_spaced") | F.col("_tp") | F.col("_mine")))
    on_tgt = F.col("_player_hit") & ~F.coalesce(tgt.endswith("'s corpse"), F.lit(True))
    seen = told.select(*keys, order, F.when(on_src, src).when(on_tgt, tgt).alias("name")).filter(F.col("name").isNotNull())
    mobs = seen.groupBy(*keys, "name").agg(F.min(order).alias("_e"))
    known = stage(k.join(mobs, [*keys, "name"], "full_outer"))
    return _directed(_sides(parsed, known, keys, order), parsed.columns, order, reasons)


def _directed(rows: DataFrame, columns: list[str], order: str, reasons: bool = False) -> DataFrame:
    """The columns of :func:`classify` from the flags and ``_e``, the line from which the source is a mob."""
    line, p = F.col(order), F.col("pattern")
    src, tgt = F.col("src"), F.col("tgt")
    spaced, mine, swing, sure_player = F.col("_spaced"), F.col("_mine"), F.col("_swing"), F.col("_sure")
    earlier = F.coalesce(F.col("_e") < line, F.lit(False))
    is_mob = (
        F.when(p == "shield_burn", F.lit(True))
        .when(p == "miss", F.col("_np") & (spaced | earlier | F.col("_tp") | mine))
        .when(p == "heal", F.col("_np") & (earlier | (spaced & (src == tgt))))
        .otherwise(F.col("_mob_hit"))
    )
    rows = once(rows, src_is_mob=F.coalesce(is_mob, F.lit(False)))
    m = F.col("src_is_mob")
    # A name that is a player by now is no mob; that includes one who just struck itself.
    tracked = ~F.coalesce(tgt.endswith("'s corpse"), F.lit(True)) & ~F.coalesce(F.col("_kt") <= line, F.lit(False))
    about = (
        F.when(m & (p != "spell_hit"), F.when(F.col("_np") & ~src.endswith("'s corpse"), src))
        .when(F.col("_player_hit") & tracked, tgt)
        .when(p.isin("cc_park", "cc_wake") & tracked, tgt)
    )
    dmg_mob = m & F.col("_mob_hit")
    kind = (
        F.when(F.col("_lost") | (dmg_mob & (p == "spell_hit")), F.lit(None))
        .when(m & (p == "heal"), F.lit(None))
        .when(p.isin("cc_park", "cc_wake") & ~tracked, F.lit(None))
        .when(dmg_mob & p.isin("riposte", "damage_shield", "has_taken"), "spell")
        .otherwise(F.col("k"))
    )
    rule = (
        F.when(p == "shield_burn", "burns the owner")
        .when(sure_player, "only players do this")
        .when(~(swing | p.isin("miss", "heal", "spell_hit")), F.lit(None))
        .when(F.col("_ks") < line, "known player")
        .when((p == "melee") & F.col("verb").isin("hit", "hits") & m, "verb of mobs")
        .when(spaced & m, "blank in the name")
        .when(earlier & m, "seen as a mob")
        .when(F.col("_tp") & m, "target is a player")
        .when(mine & m, "target is the owner")
        .when(F.col("_player_hit"), "first swing of a player")
        .otherwise("no evidence")
    )
    rows = in_turn(rows, {"mob_name": about}, {"k": kind}, {
        "tank": dmg_mob | (p == "shield_burn"),
        "sp": F.when(dmg_mob & (p == "riposte"), "riposte").when(dmg_mob & (p == "damage_shield"), "ds").otherwise(F.col("sp")),
        "typ": F.when(dmg_mob & (p == "hit_by_spell"), "hit").otherwise(F.col("typ")),
    }, {"direction_rule": rule} if reasons else {})
    return rows.withColumn("touch", F.col("mob_name").isNotNull()).select(*columns, "src_is_mob", "tank", "mob_name", "touch", *(["direction_rule"] if reasons else []))


def confirmed_mobs(classified: DataFrame, k: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Names seen in a mob position that never became players."""
    hit = F.col("dmg").isNotNull() & ~F.col("tank") & ~F.coalesce(F.col("tgt").endswith("'s corpse"), F.lit(True))
    name = F.when(F.col("src_is_mob") & (F.col("pattern") != "heal"), F.col("src")).when(hit, F.col("tgt"))
    seen = classified.select(*keys, name.alias("name")).filter(F.col("name").isNotNull()).distinct()
    return seen.join(k, [*keys, "name"], "left_anti")
