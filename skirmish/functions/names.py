"""Names of players, mobs, pets, verbs, classes and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attack verbs, first person and third person.
VERBS = {
    "hit": "hits", "slash": "slashes", "backstab": "backstabs", "bash": "bashes",
    "kick": "kicks", "crush": "crushes", "pierce": "pierces", "punch": "punches",
    "frenzy": "frenzies", "strike": "strikes", "slay": "slays", "maul": "mauls",
    "bite": "bites", "claw": "claws", "sting": "stings", "rend": "rends",
    "scratch": "scratches", "gore": "gores", "cleave": "cleaves", "smite": "smites",
    "smash": "smashes", "shoot": "shoots", "slam": "slams", "slice": "slices",
    "stab": "stabs", "sweep": "sweeps",
}

# How an avoided swing is worded, by prefix.
AVOIDS = {
    "dodge": "dodge", "parr": "parry", "miss": "miss", "block": "block",
    "ripost": "riposte", "INVULN": "invulnerable", "absorb": "absorb",
}

# Class names and codes.
CLASSES = {
    "warrior": "WAR", "cleric": "CLR", "paladin": "PAL", "ranger": "RNG",
    "shadow knight": "SHD", "druid": "DRU", "monk": "MNK", "bard": "BRD",
    "rogue": "ROG", "shaman": "SHM", "necromancer": "NEC", "wizard": "WIZ",
    "magician": "MAG", "enchanter": "ENC", "beastlord": "BST", "berserker": "BER",
}

# The syllables of generated pet names, and two ordinary words they also spell.
PET_HEAD = ["G", "J", "K", "L", "V", "X", "Z"]
PET_MIDDLE = ["ab", "ar", "as", "eb", "en", "ib", "ob", "on"]
PET_SECOND = ["an", "ar", "ek", "ob"]
PET_TAIL = ["er", "ab", "n", "tik"]
PET_BLOCKED = ["Laser", "Ektik"]


def article_case(name: Column) -> Column:
    """``A rat`` and ``An orc`` open a sentence; the name itself is ``a rat``, ``an orc``."""
    return F.when(name.startswith("A ") | name.startswith("An "), F.concat(F.lit("a"), F.substring(name, 2, 1 << 30))).otherwise(name)


def norm(name: Column, player: Column) -> Column:
    """``You`` in any case is the log owner; other names get :func:`article_case`."""
    return F.when((F.lower(name) == "you") & (F.coalesce(player, F.lit("")) != ""), player).otherwise(article_case(name))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_verb(verb: Column) -> Column:
    forms = {form: base for base, third in VERBS.items() for form in (base, third)}
    return F.coalesce(F.element_at(_literal_map(forms), verb), F.lit("hit"))


def normalize_miss(word: Column) -> Column:
    out = F
    for prefix, kind in AVOIDS.items():
        out = out.when(word.startswith(prefix), kind)
    return out.otherwise("miss")


def class_code(name: Column) -> Column:
    """Class name or code in any case to its code; null when unknown."""
    known = dict(CLASSES) | {"shadowknight": "SHD"} | {c.lower(): c for c in CLASSES.values()}
    return F.element_at(_literal_map(known), F.lower(F.trim(name)))


def parse_who_classes(text: Column) -> Column:
    """At most three class codes.  ``PAL/MNK`` is taken as written, words are looked up."""
    slashed = F.filter(
        F.transform(F.slice(F.split(text, "/"), 1, 3), lambda x: F.upper(F.trim(x))), lambda x: x != ""
    )
    words = F.split(F.trim(F.regexp_replace(text, r"(?i)\bshadow\s+knight\b", "shadowknight")), r"\s+")
    named = F.slice(F.filter(F.transform(words, class_code), lambda c: c.isNotNull()), 1, 3)
    return F.when(F.contains(text, F.lit("/")), slashed).otherwise(named)


def warder_owner(name: Column) -> Column:
    """``Rysk`s warder`` belongs to Rysk; null for any other name."""
    return F.nullif(F.regexp_extract(name, r"^([^ ]+)['`]s warder$", 1), F.lit(""))


def is_generated_pet_name(name: Column) -> Column:
    middle, second = "|".join(PET_MIDDLE), "|".join(PET_SECOND)
    rx = f"^[{''.join(PET_HEAD)}](?:(?:{middle})(?:{second})?|(?:{second}))(?:{'|'.join(PET_TAIL)})$"
    return name.rlike(rx) & ~name.isin(PET_BLOCKED)


def is_pet_buff_spell(spell: Column) -> Column:
    return spell.startswith("Burnout")


def is_pet_summon_spell(spell: Column) -> Column:
    return F.contains(spell, F.lit("Summoning:")) | spell.endswith(" Animation")


def instance_label(zone: Column) -> Column:
    """Zone text without its last `` (...)``."""
    return F.regexp_replace(zone, r"^(.*) \(.*\)$", "$1")


def parse_copper(text: Column) -> Column:
    """Money in copper: ``2 platinum, 1 gold`` is 2100; null where the sum passes what a long holds."""
    worth = F.create_map(*[F.lit(x) for kv in (("platinum", 1000), ("gold", 100), ("silver", 10), ("copper", 1)) for x in kv])
    rx = r"(\d+)\s*(platinum|gold|silver|copper)"
    part = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rx), 1).alias("n"), F.regexp_extract_all(text, F.lit(rx), 2).alias("u")
    )
    total = F.aggregate(
        part, F.lit(0).cast("decimal(38,0)"),
        lambda acc, p: F.try_add(acc, F.try_multiply(p["n"].try_cast("decimal(32,0)"), F.element_at(worth, p["u"]).cast("decimal(4,0)"))).cast("decimal(38,0)"),
    )
    return total.try_cast("long")


def player_from_filename(path: Column) -> Column:
    """``eqlog_<Player>_<Server>.txt``: the second part; null with fewer than three parts."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)[^/_]*_([^/_]*)_[^/]*?(?:\.[^/.]*)?$", 1), F.lit(""))


def server_from_filename(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|/)[^/_]*_[^/_]*_([^/]*?)(?:\.[^/.]*)?$", 1), F.lit(""))
