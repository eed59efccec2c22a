import pytest
from pyspark.sql import functions as F

from skirmish.functions import chatter, mods, names, templates, times
from skirmish.operators.parse import parse_lines

# One literal line per pattern: pattern, kind, source, target, amount, extra.
GOLDEN = [
    ("Rysk slashes a goblin for 150 points of damage.", "melee", "melee", "Rysk", "a goblin", 150, "slash"),
    ("Rysk frenzies on a goblin for 1 point of damage.", "melee", "melee", "Rysk", "a goblin", 1, "frenzy"),
    ("A goblin hits YOU for 5 points of damage.", "melee", "melee", "a goblin", "Izzin", 5, "hit"),
    ("Innoruuk, the Prince of Hate smites Rysk for 900 points of damage.", "melee", "melee", "Innoruuk, the Prince of Hate", "Rysk", 900, "smite"),
    ("Rysk hit a gnoll for 77 points of fire damage by Burst of Flame.", "hit_by_spell", "spell", "Rysk", "a gnoll", 77, "Burst of Flame"),
    ("A gnoll has been damaged by Rysk's Sting for 9 points of damage.", "dot", "dot", "Rysk", "a gnoll", 9, "Sting"),
    ("A gnoll was injured by Rysk's riposte for 12 points of damage.", "riposte", "rip", "Rysk", "a gnoll", 12, None),
    ("A gnoll was struck by Rysk's damage shield for 7 points.", "damage_shield", "ds", "Rysk", "a gnoll", 7, None),
    ("A gnoll is burned by YOUR flames for 6 points of non-melee damage.", "shield_proc", "ds", "Izzin", "a gnoll", 6, None),
    ("A gnoll is pierced by Rysk's thorns for 6 points of non-melee damage.", "shield_proc", "ds", "Rysk", "a gnoll", 6, None),
    ("YOU are burned by orc centurion's flames for 6 points of non-melee damage!", "shield_burn", "melee", "orc centurion", "Izzin", 6, "ds"),
    ("A gnoll has taken 50 damage from your Sting.", "has_taken", "dot", "Izzin", "a gnoll", 50, "Sting"),
    ("A gnoll has taken 50 damage from Denon's Disruptive Discord by Rysk.", "has_taken", "dot", "Rysk", "a gnoll", 50, "Denon's Disruptive Discord"),
    ("A gnoll has taken 50 damage from Rysk's Sting.", "has_taken", "dot", "Rysk", "a gnoll", 50, "Sting"),
    ("A gnoll has taken 50 damage from Sting.", "has_taken", None, None, "a gnoll", None, "Sting"),
    ("A gnoll has taken an extra 8 points of non-melee damage from Rysk's Bane spell.", "extra_damage", "spell", "Rysk", "a gnoll", 8, "Bane"),
    ("orc centurion has been mesmerized.", "cc_park", "cc", None, "orc centurion", None, None),
    ("Orc centurion has been awakened by Rysk!", "cc_wake", "cc", "Rysk", "Orc centurion", None, None),
    ("You are stunned!", "heartbeat", "hb", None, None, None, None),
    ("Your Ice Comet spell is interrupted.", "heartbeat", "hb", None, None, None, None),
    ("Ruin begins casting Lesser Summoning: Water.", "cast", "cast", "Ruin", None, None, "Lesser Summoning: Water"),
    ("You begin casting Ice Comet.", "cast", "cast", "Izzin", None, None, "Ice Comet"),
    ("Your Light Healing spell fizzles!", "fizzle", "fizzle", "Izzin", None, None, "Light Healing"),
    ("Labarer goes berserk.", "berserk", None, "Labarer", None, None, None),
    ("You have slain a gnoll!", "slay_you", "slay", "Izzin", "a gnoll", None, None),
    ("Rysk has slain a gnoll!", "slay_has", "slay", "Rysk", "a gnoll", None, None),
    ("Orc legionnaire was slain by Rysk!", "slain_by", "slay", "Rysk", "Orc legionnaire", None, None),
    ("You have been slain by a gnoll!", None, None, None, None, None, None),
    ("An orc pawn died.", "died", "slay", None, "an orc pawn", None, None),
    ("You try to slash royal guard, but miss!", "miss", "miss", "Izzin", "royal guard", None, "miss"),
    ("A gnoll tries to bite YOU, but YOU parry!", "miss", "miss", "a gnoll", "Izzin", None, "parry"),
    ("A gnoll tries to bite Rysk, but Rysk's magical skin absorbs the blow!", "miss", "miss", "a gnoll", "Rysk", None, "absorb"),
    ("YOUR magical skin absorbs the damage of a gnoll's thorns.", "absorb_skin", "absorb", "a gnoll", "Izzin", None, None),
    ("Rysk has shielded himself from 40 points of damage.", "absorb_rune", "absorb", None, "Rysk", None, None),
    ("A gnoll resisted your Tashania!", "resist", "resist", "Izzin", "a gnoll", None, "Tashania"),
    ("A gnoll resisted Rysk's Tashania!", "resist", "resist", "Rysk", "a gnoll", None, "Tashania"),
    ("Rysk healed himself over time for 40 (60) hit points by Chloroblast.", "heal", "heal", "Rysk", "Rysk", 40, "Chloroblast"),
    ("Rysk has healed you for 1 hit point.", "heal", "heal", "Rysk", "Izzin", 1, "Unknown"),
    ("Zyro says, 'you slash it for 90 points of damage'", "chat", None, None, None, None, None),
    ("Emperor Crush says, 'you slash it for 90'", None, None, None, None, None, None),
    ("Welcome to EverQuest Legends!", "login", "login", None, None, None, None),
    ("You feel better.", None, None, None, None, None, None),
]


def test_golden_lines(lines):
    df = parse_lines(lines([g[0] for g in GOLDEN])).orderBy("line_no")
    got = [(r.pattern, r.k, r.src, r.tgt, r.dmg if r.dmg is not None else r.amt) for r in df.collect()]
    assert got == [g[1:6] for g in GOLDEN]
    extra = [r.sp or r.typ for r in df.collect()]
    for g, e in zip(GOLDEN, extra):
        if g[6] is not None:
            assert e == g[6], g[0]


def test_loot_lines(lines):
    rows = parse_lines(lines([
        "--You have looted a Crystallized Sulfur from an abhorrent's corpse.--",
        "You looted 4 Giant Bat Fur from a sonic bat's corpse and sold it for 8 silver and 4 copper.",
        "You looted a Bat Meat from a sonic bat's corpse and sold it for free.",
        "You looted a Throwing Boulder +1 from a fire giant warrior's corpse and stored it in your Dragon Hoard",
        "You looted a Darkbrood Mask +1 from Innoruuk, the Prince of Hate's corpse to create a Darkbrood Mask +2",
        "You have successfully merged two items together to create a new item: Boots of the Long Road +2",
        "You receive 6 platinum, 1 gold, 8 silver and 3 copper from the corpse.",
    ])).orderBy("line_no").collect()
    assert [(r.k, r.item, r.qty, r.copper, r.result, r.tgt) for r in rows] == [
        ("item_loot", "a Crystallized Sulfur", 1, None, None, "an abhorrent"),
        ("item_sell", "Giant Bat Fur", 4, 84, None, "a sonic bat"),
        ("item_sell", "a Bat Meat", 1, 0, None, "a sonic bat"),
        ("item_hoard", "a Throwing Boulder +1", None, None, None, "a fire giant warrior"),
        ("item_enhance", "a Darkbrood Mask +1", None, None, "a Darkbrood Mask +2", "Innoruuk, the Prince of Hate"),
        ("item_merge", None, None, None, "Boots of the Long Road +2", None),
        ("currency_loot", None, None, 6183, None, None),
    ]


def test_who_and_mods(lines):
    rows = parse_lines(lines([
        "[65 Warrior Shadow Knight Rogue] Bob (Troll)", "[65 pal/MNK/BER/WAR] Bob (Troll)", "[12 Tinker] Bob (Gnome)",
        "Rysk slashes a rat for 1 point of damage. (Lucky Critical Twincast)", "Rysk slashes a rat for 1 point of damage. (sort of)",
    ])).orderBy("line_no").collect()
    assert rows[0].classes == ["WAR", "SHD", "ROG"] and rows[0].level == 65
    assert rows[1].classes == ["PAL", "MNK", "BER"]
    assert rows[2].k is None
    assert rows[3].mods == 7 and rows[4].mods == 0


def test_order_option(lines):
    text = ["Denon's Discord hit a gnoll for 5 points of damage."]
    assert parse_lines(lines(text)).first().pattern == "melee"
    assert parse_lines(lines(text), spell_before_melee=True).first().pattern == "spell_attr"
    assert parse_lines(lines(["You have been slain by a gnoll!"]), owner_death=True).first().tgt == "Izzin"


@pytest.mark.parametrize("raw,epoch", [
    ("[Fri Feb 27 22:00:07 2026] x", 1772229607), ("[Tue Jan 01 00:00:01 2000] x", 946684801), ("[Tue Jan  1 00:00:01 2000] x", 946684801),
    ("[Tue Foo 01 00:00:01 2000] x", None), ("[Mon Feb 30 00:00:01 2026] x", None), ("no prefix at all in this line", None), ("[x", None),
])
def test_times(spark, raw, epoch):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(times.line_epoch(F.col("raw"))).first()[0] == epoch


def test_zones(spark):
    df = spark.createDataFrame([("[Sun Oct 25 02:30:00 2026] x",), ("[Sun Mar 29 02:30:00 2026] x",)], "raw string")
    got = [r[0] for r in df.select(times.line_epoch(F.col("raw"), "Europe/Berlin")).collect()]
    assert got == [1792888200, 1774747800]  # repeated hour: the earlier; missing hour: shifted forward


def test_display(spark):
    df = spark.createDataFrame([(950,), (1150,), (1250,), (1350,), (3_000_000,), (2_345_678,)], "n long")
    assert [r[0] for r in df.select(times.fmt_k(F.col("n"))).collect()] == [f"{950}", "1.1K", "1.2K", "1.4K", "3M", "2.3M"]
    df = spark.createDataFrame([(45,), (125,)], "n long")
    assert [r[0] for r in df.select(times.fmt_duration(F.col("n"))).collect()] == ["45s", "2:05"]


def test_pet_names(spark):
    ns = ["Labarer", "Gobaner", "Xobtik", "Laser", "Ektik", "Ger", "Gaber", "Rysk", "Gabann"]
    df = spark.createDataFrame([(n,) for n in ns], "n string")
    got = [r[0] for r in df.select(names.is_generated_pet_name(F.col("n"))).collect()]
    heads, mid, sec, tail = names.PET_HEAD, ["", *names.PET_MIDDLE], ["", *names.PET_SECOND], names.PET_TAIL
    full = {a + b + c + d for a in heads for b in mid for c in sec for d in tail if b or c} - set(names.PET_BLOCKED)
    assert got == [n in full for n in ns]


def test_files(spark):
    df = spark.createDataFrame([("/a/eqlog_Rysk_test.txt",), ("eqlog_Rysk_two_words.txt",), ("/a/eqlog_Rysk.txt",)], "p string")
    got = [(r[0], r[1]) for r in df.select(names.player_from_filename(F.col("p")), names.server_from_filename(F.col("p"))).collect()]
    assert got == [("Rysk", "test"), ("Rysk", "two_words"), (None, None)]


@pytest.mark.parametrize("msg,want", [
    ("raid start", ("raid_start", "")), (" RaidStart ", ("raid_start", "")), ("raid start -- Vox D3", ("raid_start", "Vox D3")),
    ("raid end---wiped", ("raid_end", "wiped")), ("raid start: Nagafen", ("raid_start", "Nagafen")), ("raid start — x", ("raid_start", "x")),
    ("raid start now?", None), ("when does the raid start", None), ("raid starting", None),
])
def test_raid_mark(spark, msg, want):
    got = spark.createDataFrame([(msg,)], "m string").select(chatter.raid_mark(F.col("m"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,event,want", [
    ("Sword 100", False, "loot"), ("Sword +20", False, "loot"), ("sword 100", False, "social"), ("brb dog", False, "real_life"), ("inc adds", True, "tactical"),
    ("nice one", True, "reactive"), ("nice one", False, "social"), ("feedback welcome", False, "social"),
])
def test_message_class(spark, text, event, want):
    df = spark.createDataFrame([(text, event)], "t string, e boolean")
    assert df.select(chatter.message_class(F.col("t"), F.col("e"))).first()[0] == want


def test_context_labels(spark):
    ctx = [
        [], [("slay", "Rysk slew a gnoll")], [("death", "Bob slain by a gnoll"), ("death_self", "You slain by a rat")], [("big_hit", "Bob hit a gnoll for 9"), ("big_hit", "You hit a rat for 3")],
        [("oom", "Bob OOM")], [("slay", "x slew y"), ("zone", "zone: z")], [("resist_other", "resist_other")], [("cast", "Bob casting Ice Comet")], [("level", "You reached level 9")],
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(ctx)], "i int, c array<struct<kind:string,summary:string>>")
    trig = chatter.classify_trigger(F.col("c"))
    rows = df.select(trig, chatter.classify_register(F.col("c")), chatter.slot_text(F.col("c"), trig)).collect()
    assert [tuple(r) for r in rows] == [
        ("Banter", "Neutral", None), ("MobKilled", "Elated", "a gnoll"), ("Wipe", "Frustrated", "a rat"), ("NearDeath", "Engaged", "a rat"),
        ("CasterOom", "Tired", "Bob"), ("MobKilled", "Elated", "y"), ("Banter", "Neutral", None), ("Incoming", "Engaged", "Ice Comet"), ("LevelUp", "Elated", None),
    ]


@pytest.mark.parametrize("pattern,want", [
    (r"damage\. (Critical)", r"damage\. \(Critical\)"), (r"(\d+) points", r"(\d+) points"), (r"(a|b) (c)", r"(a|b) \(c\)"), (r"(?P<x>abc)", r"(?P<x>abc)"),
    (r"(?:abc) (x(y))", r"(?:abc) \(x\(y\)\)"), (r"[(](.+)", r"[(](.+)"), (r"(unclosed", r"(unclosed"),
])
def test_escape(pattern, want):
    assert templates.escape_literal_groups(pattern) == want


def test_glob():
    assert templates.glob_to_regex("{who} hits * for ? (x)") == r"(?P<who>.+?) hits .* for . \(x\)"
    assert templates.glob_to_regex("{a b}") == r"\{a b\}"


def test_mod_flags(spark):
    df = spark.createDataFrame([(5,)], "m int")
    assert df.select(*[mods.has_flag(F.col("m"), f) for f in ("critical", "twincast", "lucky")]).first() == (True, False, True)


def test_long_names_and_large_amounts(spark):
    from skirmish.functions import names
    from skirmish.plans.render import _cap

    name = "a " + "very " * 40 + "long name"
    texts = [("99999999999 copper",), ("9000000 platinum",), ("12345678901234567 silver",), ("9" * 30 + " platinum",), ("5" * 60 + " gold",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(names.parse_copper(F.col("t"))).collect()]
    assert got == [99999999999, 9000000000, 123456789012345670, None, None, 0, None]
    assert spark.createDataFrame([(name,)], "n string").select(_cap(F.col("n"))).first()[0] == name[0].upper() + name[1:]


def test_generated_code_reads_the_same(spark, lines):
    df = lines([g[0] for g in GOLDEN])
    plain = sorted(map(str, parse_lines(df).collect()))
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        assert sorted(map(str, parse_lines(df).collect())) == plain
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_only_the_columns_asked_for_are_made(spark):
    raw = "[Mon Jan 01 00:00:00 2024] --You have looted a gem from a rat's corpse.--"
    lines = spark.createDataFrame([(raw, "Izzin")], "raw string, player string")
    few, every = parse_lines(lines, only=["k", "item", "tgt"]), parse_lines(lines)
    assert {"k", "item", "tgt"} <= set(few.columns) and not {"src", "copper", "classes"} & set(few.columns)
    assert few.select("k", "item", "tgt").collect() == every.select("k", "item", "tgt").collect()
