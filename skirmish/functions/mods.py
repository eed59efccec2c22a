"""Hit modifiers: the trailing ``(Lucky Critical)`` of a line, as bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit per flag and the words that set it.
FLAGS = {
    "critical": (0x0001, ["Critical", "Deadly Strike", "Crippling Blow", "Finishing Blow"]),
    "twincast": (0x0002, ["Twincast"]),
    "lucky": (0x0004, ["Lucky"]),
    "rampage": (0x0008, ["Rampage"]),
    "strikethrough": (0x0010, ["Strikethrough"]),
    "riposte": (0x0020, ["Riposte"]),
    "assassinate": (0x0040, ["Assassinate"]),
    "headshot": (0x0080, ["Headshot"]),
    "slay_undead": (0x0100, ["Slay Undead"]),
    "double_bow": (0x0200, ["Double Bow Shot"]),
    "flurry": (0x0400, ["Flurry"]),
}

_SUFFIX = r"(?s)^(.*?)\s*(\([^(]*\))$"


def parse_mods(suffix: Column) -> Column:
    bits = []
    for bit, words in FLAGS.values():
        hit = reduce(lambda a, b: a | b, [F.contains(suffix, F.lit(w)) for w in words])
        bits.append(F.when(hit, F.lit(bit)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a + b, bits)


def suffix_mods(line: Column) -> Column:
    """Modifier bits of the last ``(...)`` at the end of the line, 0 when there are none."""
    return F.when(F.rtrim(line).endswith(")"), parse_mods(F.regexp_extract(F.rtrim(line), _SUFFIX, 2))).otherwise(F.lit(0))


def strip_mods(line: Column, mods: Column) -> Column:
    """The line without that suffix; only a suffix holding a known flag is cut."""
    return F.when(mods != 0, F.regexp_extract(F.rtrim(line), _SUFFIX, 1)).otherwise(F.rtrim(line))


def has_flag(mods: Column, flag: str) -> Column:
    return F.coalesce(mods, F.lit(0)).bitwiseAND(F.lit(FLAGS[flag][0])) != 0
