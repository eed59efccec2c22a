"""Chat lines: their parts, channels, raid calls, message classes and context labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: "<speaker> <verb phrase>, '<message>'".
CHAT = r"(?d)^([A-Za-z`'-]+) ([a-z][^,]*), '(.*)'$"

# Words of each message class.
REAL_LIFE = [
    "brb", "afk", "back", "bio", "bathroom", "phone", "irl", "food",
    "snack", "drink", "water", "eat", "pizza", "waffle", "kitchen",
    "wife", "gf", "boyfriend", "husband", "kid", "dog", "cat", "baby",
    "stepping out", "gonna grab", "gotta go", "distract", "interrupt",
    "someone at the", "at the door",
]
TACTICAL = [
    "incoming", "inc", "pulling", "pull", "slow", "mezz", "mez", "mezzing",
    "root", "rooting", "charm", "fd", "feign", "camp", "safe", "clear",
    "assist", "adds", "add", "train", "aggro", "agro", "snare", "kite",
    "burn", "main assist", "don't break", "dont break", "hold cc",
]


def is_chat(line: Column) -> Column:
    return F.contains(line, F.lit(", '")) & line.rlike(CHAT)


def chat_parts(line: Column) -> Column:
    """Struct of speaker, verb and msg; null when the line is not chat."""
    part = lambda i: F.regexp_extract(line, CHAT, i)
    return F.when(is_chat(line), F.struct(part(1).alias("speaker"), part(2).alias("verb"), part(3).alias("msg")))


def raid_mark(msg: Column) -> Column:
    """Struct of kind and label when the whole message calls a raid boundary, else null."""
    rx = r"(?s)^\s*(?i:raid ?(start|end))\s*(?:[-—:]+(.*))?$"
    return F.when(
        msg.rlike(rx),
        F.struct(
            F.concat(F.lit("raid_"), F.lower(F.regexp_extract(msg, rx, 1))).alias("kind"),
            F.trim(F.coalesce(F.regexp_extract(msg, rx, 2), F.lit(""))).alias("label"),
        ),
    )


def channel_matches(channel: str, custom: str, verb: Column) -> Column:
    """Whether the verb phrase belongs to the channel; the message text never decides."""
    has = lambda w: F.contains(verb, F.lit(w))
    ooc, guild, raid = has("out of character"), has("guild"), has("raid")
    group = has("party") | has("group")
    if channel == "custom":
        return F.contains(F.lower(verb), F.lit(custom.lower())) if custom else F.lit(False)
    return {
        "any": F.lit(True),
        "ooc": ooc,
        "guild": guild,
        "raid": raid,
        "group": group,
        "auction": has("auction"),
        "shout": verb.startswith("shout"),
        "tell": (verb == "tells you") | verb.rlike(r"^told [\p{IsAlphabetic}'`]+$"),
        "say": verb.startswith("say") & ~ooc & ~guild & ~raid & ~group,
    }[channel]


def _has_word(lower: Column, words: list[str]) -> Column:
    """A listed word stands alone, first, last or between blanks."""
    padded = F.concat(F.lit(" "), lower, F.lit(" "))
    return reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {w} ")) for w in words])


def message_class(text: Column, has_event: Column) -> Column:
    """loot, real_life, tactical, reactive or social, first match wins."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    last = F.regexp_replace(F.element_at(words, -1), r"^[+-]+", "")
    bid = F.size(words).between(2, 7) & last.rlike(r"^\d+$") & F.element_at(words, 1).rlike(r"^\p{Lu}")
    lower = F.lower(text)
    return (
        F.when(bid, "loot")
        .when(_has_word(lower, REAL_LIFE), "real_life")
        .when(_has_word(lower, TACTICAL), "tactical")
        .when(has_event, "reactive")
        .otherwise("social")
    )


def _latest(context: Column, kinds: list[str]) -> Column:
    """The most recent context entry of one of the kinds; null when there is none."""
    found = F.filter(context, lambda e: e["kind"].isin(kinds))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _count(context: Column, *kinds: str) -> Column:
    return F.size(F.filter(context, lambda e: e["kind"].isin(*kinds)))


def classify_trigger(context: Column) -> Column:
    """What set the message off, by the most recent telling event."""
    kind = _latest(context, ["slay", "death", "death_self", "resist", "big_hit", "oom", "level", "loot", "cast"])["kind"]
    return (
        F.when(kind == "slay", "MobKilled")
        .when(kind.isin("death", "death_self"), F.when(_count(context, "death", "death_self") >= 2, "Wipe").otherwise("PlayerDied"))
        .when(kind == "resist", "SpellResisted")
        .when(kind == "big_hit", F.when(_count(context, "big_hit") >= 2, "NearDeath").otherwise("BigHit"))
        .when(kind == "oom", "CasterOom")
        .when(kind == "level", "LevelUp")
        .when(kind == "loot", "Loot")
        .when(kind == "cast", "Incoming")
        .otherwise("Banter")
    )


def classify_register(context: Column) -> Column:
    """Mood of the message, by the most recent decisive event."""
    kind = _latest(context, ["death", "death_self", "level", "slay", "oom", "resist", "big_hit", "cast", "loot"])["kind"]
    return (
        F.when(kind.isin("death", "death_self", "resist"), "Frustrated")
        .when(kind.isin("level", "slay", "loot"), "Elated")
        .when(kind == "oom", "Tired")
        .when(kind.isin("big_hit", "cast"), "Engaged")
        .otherwise("Neutral")
    )


# For each trigger, the context kinds and the summary shape its entity comes from.
_SLOTS = {
    "MobKilled": (["slay"], r"(?s)^.*? slew (.*)$"),
    "BigHit": (["big_hit"], r"(?s)^.*? hit (.*?) for .*$"),
    "NearDeath": (["big_hit"], r"(?s)^.*? hit (.*?) for .*$"),
    "PlayerDied": (["death", "death_self"], r"(?s)^.*? slain by (.*)$"),
    "Wipe": (["death", "death_self"], r"(?s)^.*? slain by (.*)$"),
    "SpellResisted": (["resist"], r"(?s)^.*?: (.*)$"),
    "CasterOom": (["oom"], r"(?s)^(.*) OOM$"),
    "Incoming": (["cast"], r"(?s)^.*? casting (.*)$"),
}


def slot_text(context: Column, trigger: Column) -> Column:
    """Entity named by the latest fitting summary; null when none fits."""
    out = F
    for name, (kinds, rx) in _SLOTS.items():
        fits = F.filter(context, lambda e: e["kind"].isin(kinds) & e["summary"].rlike(rx))
        out = out.when(trigger == name, F.when(F.size(fits) > 0, F.regexp_extract(F.element_at(fits, -1)["summary"], rx, 1)))
    return out.otherwise(F.lit(None).cast("string"))


def personality_buckets(verbosity: Column, humor: Column, patience: Column) -> Column:
    """Zero to three bucket tokens."""
    return F.array_compact(F.array(
        F.when(verbosity > 0.55, "[VERBOSE]").when(verbosity < 0.40, "[TERSE]"),
        F.when(humor > 0.55, "[HUMOROUS]").when(humor < 0.35, "[SERIOUS]"),
        F.when(patience > 0.65, "[PATIENT]").when(patience < 0.50, "[IMPATIENT]"),
    ))
