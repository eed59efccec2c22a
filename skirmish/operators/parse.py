"""Lines to typed rows: a pattern name per line, then its captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import chatter, mods, names, times
from skirmish.operators.once import in_turn, once
from skirmish.operators.patterns import FIELDS, LOGIN_LINE, ZONE_PATTERNS, Pattern, cascade

_SEP = "\u0001"
# Patterns tested in one place of the generated code.
_FEW = 4


def _test(line: Column, p: Pattern) -> Column:
    checks = [F.contains(line, F.lit(g)) for g in p.guards] + [line.rlike("(?d)" + p.regex)]
    return reduce(lambda a, b: a & b, checks)


def _captures(line: Column, p: Pattern) -> Column:
    """All fields with one run of the regex: rewrite the line to the groups, then split."""
    if not p.fields:
        return F.array_repeat(F.lit(""), len(FIELDS))
    whole = p.regex if p.regex.endswith("$") else p.regex + ".*$"
    rewrite = _SEP.join(f"${p.fields[f]}" if f in p.fields else "" for f in FIELDS)
    return F.split(F.regexp_replace(line, "(?ds)" + whole, rewrite), _SEP)


def match_lines(lines: DataFrame, raw: str = "raw", spell_before_melee: bool = False, owner_death: bool = False) -> DataFrame:
    """Add ``body``, ``mods``, ``pattern`` and the captured fields to every line.

    ``pattern`` is null where nothing matched.  The work is one projection; no shuffle.
    """
    combat = cascade(spell_before_melee, owner_death)
    out = once(lines, body=times.strip_prefix(F.col(raw)))
    body = F.col("body")
    out = once(out, mods=mods.suffix_mods(body))
    out = once(out, _line=mods.strip_mods(body, F.col("mods")))
    line = F.col("_line")

    name = F.when(body == LOGIN_LINE, "login")
    for p in ZONE_PATTERNS:
        name = name.when(_test(body, p), p.name)
    out = once(out, pattern=name.when(chatter.is_chat(body), "chat"))
    pat = F.col("pattern")
    # A few patterns at a time, as in ``in_turn``.
    for i in range(0, len(combat), _FEW):
        name = F.when(pat.isNotNull(), pat)
        for p in combat[i:i + _FEW]:
            name = name.when(_test(line, p), p.name)
        out = once(out, pattern=name)

    caps = F
    for p in ZONE_PATTERNS:
        caps = caps.when(pat == p.name, _captures(body, p))
    out = once(out, _caps=caps)
    for i in range(0, len(combat), _FEW):
        caps = F.when(F.col("_caps").isNotNull(), F.col("_caps"))
        for p in combat[i:i + _FEW]:
            caps = caps.when(pat == p.name, _captures(line, p))
        out = once(out, _caps=caps)
    fields = [F.nullif(F.col("_caps")[i], F.lit("")).alias(f"c_{f}") for i, f in enumerate(FIELDS)]
    if spell_before_melee:
        # What the line says as plain melee, for when its words name no spell that anybody cast.
        melee = next(p for p in combat if p.name == "melee")
        out = once(out, _plain=F.when((pat == "spell_hit") & _test(line, melee), _captures(line, melee)))
        fields.append(F.when(F.col("_plain").isNotNull(), F.struct(*[F.col("_plain")[i].alias(f) for i, f in enumerate(FIELDS)])).alias("c_plain"))
        return out.select(*[c for c in out.columns if c not in ("_line", "_caps", "_plain")], *fields)
    return out.select(*[c for c in out.columns if c not in ("_line", "_caps")], *fields)


def parse_lines(
    lines: DataFrame,
    player: str = "player",
    raw: str = "raw",
    zone: str | Column = "UTC",
    skew: int = 0,
    only: list[str] | None = None,
    **options: bool,
) -> DataFrame:
    """Typed rows before attribution, one per line (:func:`match_lines` plus meaning).

    Columns added: ``ts`` (epoch seconds, null for a line without a time), ``k`` (event kind,
    direction still open), ``src``, ``tgt``, ``dmg``, ``amt``, ``typ``, ``sp``, ``item``,
    ``qty``, ``copper``, ``result``, ``name``, ``classes``, ``level``, ``kind``, ``label``,
    ``off``, ``mods``.  The option ``spell_before_melee`` adds ``plain``, which
    :func:`skirmish.operators.classify.attribute_spell` uses up.  With ``only``, no other of these columns are made; a caller
    who needs few saves the rest, since what ``once`` makes is made whole.
    """
    m = match_lines(lines, raw, **options)
    who = F.col(player)
    pat, num = F.col("pattern"), F.col("c_num").try_cast("long")
    c = {f: F.col(f"c_{f}") for f in FIELDS}
    n = lambda x: names.norm(F.trim(x), who)
    is_ = lambda *p: pat.isin(*p)

    by, your = c["x"], c["y"].isNotNull()
    by_name = F.nullif(F.regexp_replace(F.trim(by), r"\.+$", ""), F.lit(""))
    taken_spell = F.regexp_replace(F.trim(c["sp"]), r"\.+$", "")
    named = F.col("_src")
    src = (
        F.when(is_("has_taken"), F.when(your, who).when(by.isNotNull(), n(by_name)).otherwise(named))
        .when(is_("extra_damage"), F.when(your, who).otherwise(named))
        .when(is_("shield_proc", "resist"), F.coalesce(named, who))
        .when(is_("fizzle", "slay_you"), who)
        .when(is_("slain_by", "owner_slain"), names.article_case(F.trim(c["src"])))
        .when(is_("berserk", "who", "instance_create"), c["src"])
        .when(is_("slay_has", "cast", "absorb_skin", "miss", "heal", "hit_by_spell", "melee", "spell_attr", "dot",
                  "riposte", "damage_shield", "shield_burn", "cc_wake"), named)
    )
    tgt_raw = F.when(is_("heal"), F.regexp_replace(F.trim(c["tgt"]), r"( over time)+$", "")).otherwise(c["tgt"])
    tgt = (
        F.when(is_("shield_burn"), who)
        .when(is_("absorb_skin"), F.coalesce(n(c["tgt"]), who))
        .when(is_("heal") & tgt_raw.isin("himself", "herself", "itself", "yourself"), named)
        .when(is_("slay_you", "slay_has", "slain_by", "died", "resist", "loot_kept", "loot_sold", "loot_hoard", "loot_enhance"),
              names.article_case(c["tgt"]))
        .when(tgt_raw.isNotNull(), n(tgt_raw))
    )
    heal_spell = F.regexp_replace(F.regexp_replace(c["sp"], r"\.+$", ""), r"( over time)+$", "")
    sp = (
        F.when(is_("has_taken"), F.when(~your & by.isNotNull() & c["src"].isNotNull(),
                                       F.concat(c["src"], F.lit("'s "), taken_spell)).otherwise(taken_spell))
        .when(is_("heal"), F.coalesce(heal_spell, F.lit("Unknown")))
        .when(is_("extra_damage", "resist"), F.trim(c["sp"]))
        .when(is_("hit_by_spell", "spell_attr", "spell_hit", "dot", "cast", "fizzle"), c["sp"])
    )
    typ = (
        F.when(is_("melee"), names.normalize_verb(c["x"]))
        .when(is_("miss"), names.normalize_miss(c["x"]))
        .when(is_("dot", "has_taken"), "dot")
        .when(is_("riposte"), "riposte")
        .when(is_("damage_shield", "shield_proc", "shield_burn"), "ds")
    )
    attacker = ~is_("has_taken") | src.isNotNull()
    k = (
        F.when(is_("hit_by_spell", "spell_attr", "spell_hit", "extra_damage"), "spell")
        .when(is_("melee", "shield_burn"), "melee")
        .when(is_("dot"), "dot")
        .when(is_("has_taken") & attacker, "dot")
        .when(is_("riposte"), "rip")
        .when(is_("damage_shield", "shield_proc"), "ds")
        .when(is_("cc_park", "cc_wake"), "cc")
        .when(is_("heartbeat"), "hb")
        .when(is_("cast", "fizzle", "miss", "resist", "heal", "login"), pat)
        .when(is_("slay_you", "slay_has", "slain_by", "died", "owner_slain"), "slay")
        .when(is_("currency"), "currency_loot")
        .when(is_("loot_kept"), "item_loot")
        .when(is_("loot_sold"), "item_sell")
        .when(is_("loot_hoard"), "item_hoard")
        .when(is_("loot_enhance"), "item_enhance")
        .when(is_("merge"), "item_merge")
        .when(is_("absorb_skin", "absorb_rune"), "absorb")
    )
    chat = F.col("_chat")
    mark = F.when(is_("chat") & (chat["speaker"] == "You"), chatter.raid_mark(chat["msg"]))
    classes = F.when(is_("who"), names.parse_who_classes(c["sp"]))
    damage = is_("hit_by_spell", "melee", "spell_attr", "spell_hit", "dot", "riposte", "damage_shield",
                 "shield_proc", "shield_burn", "has_taken", "extra_damage")
    out = once(m, _src=n(c["src"]), _chat=F.when(is_("chat"), chatter.chat_parts(F.col("body"))))
    out = once(once(out, _mark=mark), classes=classes)
    mark = F.col("_mark")
    kept = F.size(F.col("classes")) > 0
    cols = {
        "ts": times.line_epoch(F.col(raw), zone, skew),
        "k": F.when(mark.isNotNull(), "raid_mark").when(is_("who"), F.when(kept, "who")).otherwise(k),
        "src": src,
        "tgt": tgt,
        "dmg": F.when(damage & attacker, F.coalesce(num, F.lit(0).cast("long"))),
        "amt": F.when(is_("heal"), F.coalesce(num, F.lit(0).cast("long"))),
        "typ": typ,
        "sp": sp,
        "item": F.when(is_("loot_kept", "loot_sold", "loot_hoard", "loot_enhance"), c["sp"]),
        "qty": F.when(is_("loot_kept"), F.lit(1).cast("long")).when(is_("loot_sold"), F.coalesce(num, F.lit(1).cast("long"))),
        "copper": F.when(is_("currency"), names.parse_copper(c["x"])).when(is_("loot_sold"), names.parse_copper(c["x"])),
        "result": F.when(is_("loot_enhance", "merge"), F.trim(c["x"])),
        "name": F.when(is_("who") & kept, c["src"]),
        "level": F.when(is_("who") & kept, num.cast("int")),
        "kind": mark["kind"],
        "label": mark["label"],
        "off": F.when(is_("cc_park"), F.lit(False)).when(is_("cc_wake"), F.lit(True)),
        "zone_text": F.when(is_("instance_create", "instance_enter", "zone_enter"), c["sp"]),
        "zone_num": F.when(is_("instance_create"), num),
        "verb": F.when(is_("melee"), c["x"]),
    }
    if "c_plain" in m.columns:
        v = F.col("c_plain")
        cols["plain"] = F.when(v.isNotNull(), F.struct(
            n(v["src"]).alias("src"), n(v["tgt"]).alias("tgt"), F.coalesce(v["num"].try_cast("long"), F.lit(0).cast("long")).alias("dmg"),
            names.normalize_verb(v["x"]).alias("typ"), v["x"].alias("verb")))
    drop = {"_mark", "_chat", "_src", "c_plain", *[f"c_{f}" for f in FIELDS]}
    if only is not None:
        cols = {n: x for n, x in cols.items() if n in only}
        drop |= {"classes"} - set(only)
    apart = [n for n in ("ts", "k", "src", "tgt", "sp", "typ") if n in cols]
    rest = {n: x for n, x in cols.items() if n not in apart}
    made = in_turn(out, *[{n: cols[n]} for n in apart], rest)
    return made.select(*[c for c in made.columns if c not in cols], *cols).drop(*drop)


def carry_ts(parsed: DataFrame, keys: list[str] | None = None, order: str = "line_no", **kw) -> DataFrame:
    """A line without a time takes the last one seen in its stream, 0 at the start."""
    from skirmish.operators.ordered import Carry, scan

    out = scan(parsed, keys or ["stream_id"], order, [Carry("ts", "last", F.col("ts"))], **kw)
    return out.withColumn("ts", F.coalesce("ts", F.lit(0).cast("long")))


def explain_lines(matched: DataFrame, keywords: list[str] | None = None, only_matched: bool = False, max_lines: int | None = None) -> DataFrame:
    """Trace of :func:`match_lines`: which pattern took each line, and its captures.

    ``max_lines`` is for a look at a few; :func:`skirmish.operators.classify.explain_events` goes on
    with the direction of each row.
    """
    out = matched
    if only_matched:
        out = out.filter(F.col("pattern").isNotNull())
    for word in keywords or []:
        out = out.filter(F.contains(F.lower("body"), F.lit(word.lower())))
    return out if max_lines is None else out.limit(max_lines)


def parse_coverage(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines per pattern; the row with a null pattern counts the unmatched ones."""
    return matched.groupBy(*(by or []), "pattern").agg(F.count(F.lit(1)).alias("lines"))
