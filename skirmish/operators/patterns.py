"""The line patterns, as data.

Each entry: name, substrings a line must hold before the regex is tried, the regex, and
which group fills which field.  Order is meaning: the first match wins.
"""

from __future__ import annotations

from typing import NamedTuple

from skirmish.functions.names import VERBS


class Pattern(NamedTuple):
    name: str
    guards: tuple[str, ...]
    regex: str
    fields: dict[str, int]


# Character classes of names and spells as the log writes them.
NAME = r"[A-Za-z][A-Za-z`', -]*"
WORD = r"[A-Za-z][A-Za-z`'-]*"
SPELL = r"[A-Za-z][A-Za-z `'-]+"
_VERB = "|".join(f"{third}|{base}" for base, third in VERBS.items())

LOGIN_LINE = "Welcome to EverQuest Legends!"

# Lines about the session and the zone, looked at before chat and combat.
ZONE_PATTERNS = [
    Pattern("instance_create", ("Player ", " creating instance "),
            r"^Player ([A-Za-z]+) creating instance (.+?) (\d+)\.\s*$", {"src": 1, "sp": 2, "num": 3}),
    Pattern("instance_enter", ("You have entered ", "("),
            r"^You have entered (.+ \d+ \([A-Za-z ]+\))\.\s*$", {"sp": 1}),
    Pattern("zone_enter", ("You have entered ",), r"^You have entered (.+?)\.\s*$", {"sp": 1}),
]

# Combat, loot and roster lines, in matching order.
PATTERNS = [
    Pattern("hit_by_spell", (" hit ", " damage by "),
            rf"^({NAME}?) hit ({NAME}?) for (\d+) points? of [\p{{L}}\p{{N}}_]+ damage by ({SPELL}?)\.*$",
            {"src": 1, "tgt": 2, "num": 3, "sp": 4}),
    Pattern("melee", (" for ", " point"),
            rf"^({NAME}?) ({_VERB}) (?:on )?({NAME}?) for (\d+) point",
            {"src": 1, "x": 2, "tgt": 3, "num": 4}),
    Pattern("spell_attr", (" hit ", " point"),
            rf"^({WORD})'s ({SPELL}?) hit ({NAME}?) for (\d+) point", {"src": 1, "sp": 2, "tgt": 3, "num": 4}),
    Pattern("spell_hit", (" hit ", " point"),
            rf"^({SPELL}?) hit ({NAME}?) for (\d+) point", {"sp": 1, "tgt": 2, "num": 3}),
    Pattern("dot", (" has been damaged by ",),
            rf"^({NAME}?) has been damaged by ({WORD})'s ({SPELL}?) for (\d+)",
            {"tgt": 1, "src": 2, "sp": 3, "num": 4}),
    Pattern("riposte", ("'s riposte for ",),
            rf"^({NAME}?) was injured by ({WORD})'s riposte for (\d+)", {"tgt": 1, "src": 2, "num": 3}),
    Pattern("damage_shield", ("'s damage shield for ",),
            rf"^({NAME}?) was struck by ({WORD})'s damage shield for (\d+)", {"tgt": 1, "src": 2, "num": 3}),
    Pattern("shield_proc", (" is ", " of non-melee damage."),
            rf"^({NAME}?) is [\p{{L}}\p{{N}}_]+ by (?:({WORD})'s|YOUR) [\p{{L}}\p{{N}}_]+ for (\d+) points? of non-melee damage\.",
            {"tgt": 1, "src": 2, "num": 3}),
    Pattern("shield_burn", ("YOU are ", " of non-melee damage"),
            rf"^YOU are [\p{{L}}\p{{N}}_]+ by ({NAME}?)'s [\p{{L}}\p{{N}}_]+ for (\d+) points? of non-melee damage[.!]",
            {"src": 1, "num": 2}),
    Pattern("cc_park", (" has been ",), rf"^({NAME}?) has been (?:mesmerized|enthralled|entranced)[.!]$", {"tgt": 1}),
    Pattern("cc_wake", (" has been awakened",),
            rf"^({NAME}?) has been awakened(?: by ([A-Za-z`'-]+))?[.!]$", {"tgt": 1, "src": 2}),
    Pattern("heartbeat", (),
            r"^(?:You are stunned!|You are no longer stunned\.|You can't cast spells while stunned!"
            r"|You regain your concentration and continue your casting\.|You feel your life force drain away\."
            r"|Insufficient Mana to cast this spell!|Your [A-Za-z `'-]+ spell is interrupted\.)$", {}),
    Pattern("cast", (" casting ",), rf"^({NAME}) begins? casting ([A-Za-z][A-Za-z `':-]+?)\.", {"src": 1, "sp": 2}),
    Pattern("fizzle", (" spell fizzles!",), r"^Your ([A-Za-z][A-Za-z `':-]+?) spell fizzles!$", {"sp": 1}),
    Pattern("berserk", (" goes berserk.",), r"^([A-Z][a-z]+) goes berserk\.$", {"src": 1}),
    Pattern("slay_you", ("You have slain ",), r"^You have slain ([A-Za-z][A-Za-z `',-]+)!", {"tgt": 1}),
    Pattern("slay_has", (" has slain ",), rf"^({NAME}?) has slain ([A-Za-z][A-Za-z `',-]+)!", {"src": 1, "tgt": 2}),
    Pattern("slain_by", (" slain by ",),
            rf"^({NAME}?) (?:was|has been) slain by ([A-Za-z][A-Za-z `',-]+?)!?\s*$", {"tgt": 1, "src": 2}),
    Pattern("died", (" died.",), r"^([A-Za-z][A-Za-z `',-]+) died\.$", {"tgt": 1}),
    Pattern("currency", ("You receive ", " from the corpse."), r"^You receive (.+?) from the corpse\.$", {"x": 1}),
    Pattern("loot_kept", ("--You have looted ",),
            r"^--You have looted (.+?) from (.+?)'s corpse\.--$", {"sp": 1, "tgt": 2}),
    Pattern("loot_sold", ("You looted ", "'s corpse and sold it for "),
            r"^You looted (?:(\d+) )?(.+?) from (.+?)'s corpse and sold it for (.+?)\.$",
            {"num": 1, "sp": 2, "tgt": 3, "x": 4}),
    Pattern("loot_hoard", ("You looted ", "'s corpse and stored it in your Dragon Hoard"),
            r"^You looted (.+?) from (.+?)'s corpse and stored it in your Dragon Hoard", {"sp": 1, "tgt": 2}),
    Pattern("loot_enhance", ("You looted ", "'s corpse to create "),
            r"^You looted (.+?) from (.+?)'s corpse to create (.+?)\.?$", {"sp": 1, "tgt": 2, "x": 3}),
    Pattern("merge", ("You have successfully merged two items together",),
            r"^You have successfully merged two items together to create a new item: (.+?)\.?$", {"x": 1}),
    Pattern("has_taken", (" taken ", " damage from "),
            rf"^(.+?) (?:has|have) taken (\d+) damage from (?:({WORD})'s |(your) )?(.+?)(?: by (.+?))?\.?\s*$",
            {"tgt": 1, "num": 2, "src": 3, "y": 4, "sp": 5, "x": 6}),
    Pattern("extra_damage", (" has taken an extra ",),
            rf"^(.+?) has taken an extra (\d+) points? of non-melee damage from (?:({WORD})'s |(your) )(.+?) spell\.$",
            {"tgt": 1, "num": 2, "src": 3, "y": 4, "sp": 5}),
    Pattern("miss", (" tr", ", but "),
            rf"^({NAME}?) tr(?:y|ies) to [\p{{L}}\p{{N}}_]+ ({NAME}?), but .*?"
            r"(dodge[sd]?|parr(?:ied|ies|y)|miss(?:ed|es)?|block(?:ed|s)?|ripost(?:ed|es)?|INVULNERABLE|absorbs?)",
            {"src": 1, "tgt": 2, "x": 3}),
    Pattern("absorb_skin", (" magical skin absorbs the damage of ",),
            rf"^(?:({WORD})'s|YOUR) magical skin absorbs the damage of ({NAME}?)'s .+$", {"tgt": 1, "src": 2}),
    Pattern("absorb_rune", (" has shielded ",),
            rf"^({NAME}?) has shielded [\p{{L}}\p{{N}}_]+ from \d+ points? of damage\.", {"tgt": 1}),
    Pattern("resist", (" resisted ",),
            rf"^({NAME}?) resisted (?:your|({WORD})'s) ([A-Za-z][A-Za-z `'.-]+?)!$", {"tgt": 1, "src": 2, "sp": 3}),
    Pattern("who", ("[", "] "), r"^\[(\d+) ([A-Za-z][A-Za-z /]+?)\] ([A-Za-z][A-Za-z`'-]+) \(", {"num": 1, "sp": 2, "src": 3}),
    Pattern("heal", ("healed ",),
            rf"^([A-Za-z][A-Za-z `'-]*?) (?:has )?healed ({NAME}?) for (\d+)(?: \(\d+\))? hit points?(?: by ({SPELL}))?\.?$",
            {"src": 1, "tgt": 2, "num": 3, "sp": 4}),
]

FIELDS = ["src", "tgt", "num", "sp", "x", "y"]


def cascade(spell_before_melee: bool = False, owner_death: bool = False) -> list[Pattern]:
    """The combat patterns in order.

    In the default order every line of ``spell_attr`` and ``spell_hit`` is taken by ``melee``;
    ``spell_before_melee`` tries those two first.  ``owner_death`` adds "You have been slain
    by X!", which no default pattern reads.
    """
    out = list(PATTERNS)
    if spell_before_melee:
        spells = [p for p in out if p.name in ("spell_attr", "spell_hit")]
        rest = [p for p in out if p not in spells]
        # They also take plain swings; attribution gives back those whose words name no spell cast before.
        at = next(i for i, p in enumerate(rest) if p.name == "melee")
        out = rest[:at] + spells + rest[at:]
    if owner_death:
        at = next(i for i, p in enumerate(out) if p.name == "died")
        out.insert(at, Pattern("owner_slain", ("You have been slain by ",),
                               r"^(You) have been slain by ([A-Za-z][A-Za-z `',-]+?)!?\s*$", {"tgt": 1, "src": 2}))
    return out
