import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from skirmish.operators import classify as C
from skirmish.operators import instances as I
from skirmish.operators import pulls as P
from skirmish.operators import sessions as S
from skirmish.operators.parse import parse_lines

OWNER = "Own"
NAMES = ["Own", "Aa", "Bb", "Cc", "Dd", "Ee", "Ff", "a rat", "Big Orc"]


def random_log(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.sample(NAMES, 2)
        src = "You" if a == OWNER else a
        tgt = "YOU" if b == OWNER else b
        kind = r.choice(["slash", "slash", "slash", "hit", "dot", "miss", "miss", "burn", "heal", "rip", "spell", "taken"])
        one = " " not in a
        line = {
            "slash": f"{src} slashes {tgt} for 5 points of damage.",
            "hit": f"{src} hits {tgt} for 5 points of damage.",
            "dot": f"{b} has been damaged by {a}'s Sting for 5 points of damage." if one else None,
            "miss": f"{src} tries to slash {tgt}, but misses!",
            "burn": f"YOU are burned by {a}'s flames for 5 points of non-melee damage!" if a != OWNER else None,
            "heal": f"{src} healed {r.choice([tgt, 'itself'])} for 5 hit points by Cure.",
            "rip": f"{b} was injured by {a}'s riposte for 5 points of damage." if one else None,
            "spell": f"{src} hit {tgt} for 5 points of fire damage by Bolt.",
            "taken": f"{b} has taken 5 damage from Sting by {a}.",
        }[kind]
        if line and not (kind in ("dot", "rip", "taken") and b == OWNER and False):
            out.append((kind, a, b, line))
    return out


def replay_by_hand(log):
    """The sequential machine, line by line."""
    players, mobs, attacked = set(), set(), set()
    out = []
    for kind, a, b, line in log:
        mob, about, matched = False, None, True
        if kind == "dot":
            players.add(a)
            attacked.add(b)
            about = None if b in players else b
        elif kind == "burn":
            mob = True
            mobs.add(a)
            about = None if a in players else a
        elif kind == "heal":
            tgt = a if "healed itself" in line else b
            mob = a not in players and (a in mobs or (" " in a and tgt == a))
            about = a if mob else None
            matched = False
        elif kind == "miss":
            mob = a not in players and (" " in a or a in mobs or b in players or b == OWNER)
            if mob:
                mobs.add(a)
                about = a
            matched = False
        else:
            sure = kind == "taken" and a == OWNER
            mob = not sure and a not in players and (
                (kind == "hit") or " " in a or a in mobs or (kind in ("slash", "hit", "spell") and a in attacked) or b in players or b == OWNER)
            if mob:
                mobs.add(a)
                about = a
            else:
                players.add(a)
                attacked.add(b)
                about = None if b in players else b
        if matched:
            for t in attacked:
                if t in players:
                    mobs.discard(t)
                else:
                    mobs.add(t)
        out.append((mob, about))
    return out


def test_direction_rules_match_the_sequential_machine(spark):
    rows, want = [], {}
    for seed in range(40):
        log = random_log(seed)
        for i, (w, entry) in enumerate(zip(replay_by_hand(log), log)):
            rows.append((f"s{seed}", OWNER, i + 1, "[Fri Feb 27 22:00:00 2026] " + entry[3]))
            want[(f"s{seed}", i + 1)] = (*w, entry[3])
    df = spark.createDataFrame(rows, "stream_id string, player string, line_no long, raw string").repartition(4)
    parsed = parse_lines(df).cache()
    got = {(r.stream_id, r.line_no): (r.src_is_mob, r.mob_name) for r in C.classify(parsed).collect()}
    wrong = [(k, got[k], w) for k, w in want.items() if got[k] != (w[0], w[1])]
    assert not wrong, wrong[:5]


def pets(parsed):
    return {(r.name, r.owner, r.how) for r in C.pet_events(parsed).collect()}


def test_pets(lines):
    p = parse_lines(lines([
        (0, "Ruin begins casting Burnout II."), (4, "Labarer goes berserk."), (5, "Xobtik goes berserk."),
        (60, "Ruin begins casting Burnout."), (89, "Gaber goes berserk."),
        (100, "Marrowbane begins casting Lesser Summoning: Water."), (119, "Gobaner slashes a gnoll for 12 points of damage."), (120, "Zarab slashes a gnoll for 12 points of damage."),
        (200, "Sis begins casting Sisna's Animation."), (201, "Gobaner slashes a gnoll for 12 points of damage."), (202, "Zarab slashes a gnoll for 1 points of damage."),
        (300, "Bob`s warder bites a gnoll for 3 points of damage."),
    ]))
    assert pets(p) == {("Labarer", "Ruin", "buff"), ("Gobaner", "Marrowbane", "summon"), ("Zarab", "Sis", "summon"), ("Bob`s warder", "Bob", "warder")}


def run(lines, bodies, player="Izzin", span=1 << 20):
    parsed = parse_lines(lines(bodies, player)).cache()
    return I.assign_instances(C.classify(parsed, C.pet_events(parsed)), span=span).cache()


HIT = "Rysk slashes a goblin for 150 points of damage."


CASES = [
    ([(0, HIT), (20, HIT)], 2), ([(0, HIT), (5, HIT)], 1), ([(0, HIT), (15, HIT)], 2), ([(0, HIT), (14, HIT)], 1),
    ([(0, HIT), (1, "A goblin was slain by Rysk!"), (2, HIT)], 2),
    ([(0, "orc centurion has been mesmerized."), (30, "Orc centurion has been awakened by Rysk!"), (31, "Rysk slashes orc centurion for 5 points of damage.")], 1),
    ([(0, "You slash orc slaver for 1 points of damage."), (1, "Orc slaver hits YOU for 1 points of damage.")], 1),
]


def streams(lines, cases, player="Izzin"):
    frames = [lines(c, player, f"s{i}") for i, c in enumerate(cases)]
    return parse_lines(reduce(lambda a, b: a.unionByName(b), frames)).cache()


def test_instances(lines):
    ins = I.mob_instances(I.assign_instances(C.classify(streams(lines, [c for c, _ in CASES])))).collect()
    assert [sum(i.stream_id == f"s{n}" for i in ins) for n in range(len(CASES))] == [n for _, n in CASES]
    assert not any(i.parked for i in ins)


def test_display_name_and_mob_self_heal(lines):
    ev = run(lines, [(0, "Orc slaver hits YOU for 1 points of damage."), (5, "You slash orc slaver for 1 points of damage."),
                     (12, "an orc thaumaturgist healed itself for 11 hit points by Lifespike."), (20, "an orc thaumaturgist healed itself for 11 hit points by Lifespike.")])
    ins = {i.name: (i.first_ts, i.last_ts) for i in I.mob_instances(ev).collect()}
    assert set(ins) == {"orc slaver", "an orc thaumaturgist"}
    assert ev.filter("k = 'heal'").count() == 0
    assert ins["an orc thaumaturgist"][1] - ins["an orc thaumaturgist"][0] == 8


def test_loot_attribution(lines):
    ev = run(lines, [
        (0, HIT), (1, "Rysk has slain a goblin!"), (2, "--You have looted a Tooth from A goblin's corpse.--"), (3, "--You have looted a Tooth from a stranger's corpse.--"),
        (4, "You receive 4 silver from the corpse."), (200, "--You have looted a Tooth from a stranger's corpse.--"), (201, "Bob healed Rysk for 5 hit points by Cure."),
    ])
    got = {r.line_no: r.mob for r in ev.filter("k in ('item_loot', 'currency_loot', 'heal', 'slay')").collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: None, 7: 1}


def test_spell_before_melee_attribution(lines):
    df = lines(["Rysk begins casting Denon's Discord.", "Denon's Discord hit a gnoll for 5 points of damage.", "Flame Lick hit a gnoll for 5 points of damage.", "Bob begins casting Flame Lick.", "Flame Lick hit a gnoll for 7 points of damage."])
    parsed = C.attribute_spell(parse_lines(df, spell_before_melee=True)).cache()
    rows = C.classify(parsed).orderBy("line_no").collect()
    # Before anyone has cast Flame Lick the line reads as a swing.
    assert [(r.k, r.src, r.sp) for r in rows if r.pattern != "cast"] == [("spell", "Rysk", "Denon's Discord"), ("melee", "Flame Lick", None), ("spell", "Bob", "Flame Lick")]


@pytest.mark.parametrize("before", [True, False])
def test_plain_hits_survive_spell_before_melee(lines, before):
    df = lines(["Rysk hit a rat for 7 points of damage.", "You hit a rat for 9 points of damage.", "a rat hits YOU for 3 points of damage."])
    rows = C.classify(parse_lines(df, spell_before_melee=before)).orderBy("line_no").collect()
    assert [(r.pattern, r.k, r.src, r.tgt, r.dmg, r.typ) for r in rows] == [
        ("melee", "melee", "Rysk", "a rat", 7, "hit"), ("melee", "melee", "Izzin", "a rat", 9, "hit"), ("melee", "melee", "a rat", "Izzin", 3, "hit")]


def test_direction_joins_whole_rows_twice(lines):
    parsed = parse_lines(lines([HIT, "You hit a rat for 9 points of damage."]))
    k = C.known_players(parsed)
    plan = C.direct(parsed, k)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


@pytest.mark.parametrize("span", [3])
def test_chunks_change_nothing(lines, span):
    r = random.Random(5)
    bodies, t = [], 0
    for _ in range(80):
        t += r.choice([0, 1, 4, 16])
        bodies.append((t, r.choice([HIT, "A goblin was slain by Rysk!", "Rysk slashes a rat for 3 points of damage.", "Bob healed Rysk for 5 hit points by Cure.", "a rat has been mesmerized."])))
    parsed = parse_lines(lines(bodies)).cache()
    ev = C.classify(parsed).cache()
    one = {x.line_no: x.mob for x in I.assign_instances(ev).collect()}
    assert {x.line_no: x.mob for x in I.assign_instances(ev, span=span).collect()} == one
    ins = I.mob_instances(I.assign_instances(ev)).cache()
    a = {x.mob: x.pull for x in P.pulls(ins).collect()}
    assert {x.mob: x.pull for x in P.pulls(ins, span=span).collect()} == a


def test_pulls(spark):
    cols = "stream_id string, mob long, name string, first_ts long, last_ts long, slain_ts long, parked boolean"
    ins = spark.createDataFrame([
        ("s", 10, "a", 0, 10, None, False), ("s", 20, "b", 20, 30, 30, False), ("s", 30, "c", 46, 50, 50, False), ("s", 40, "d", 100, 110, None, True), ("s", 50, "e", 400, 410, None, False),
    ], cols)
    assert [r.pull for r in P.pulls(ins).orderBy("mob").collect()] == [1, 1, 2, 3, 3]
    hb = spark.createDataFrame([("s", 25, 40)], "stream_id string, line_no long, ts long")
    assert [r.pull for r in P.pulls(ins, heartbeats=hb).orderBy("mob").collect()] == [1, 1, 1, 2, 2]
    dead = spark.createDataFrame([("s", 10, "a", 0, 5, 5, False), ("s", 20, "b", 7, 9, 9, False), ("s", 30, "c", 12, 15, None, False)], cols)
    loot = spark.createDataFrame([("s", 25, 10)], "stream_id string, line_no long, ts long")
    assert [r.pull for r in P.pulls(dead).orderBy("mob").collect()] == [1, 1, 1]
    assert [r.pull for r in P.pulls(dead, loot).orderBy("mob").collect()] == [1, 1, 2]


def test_named(lines):
    ev = run(lines, ["Rysk slashes Marrowbane for 5 points of damage.", "Marrowbane hits Rysk for 5 points of damage.", "Orc pawn hits Rysk for 1 points of damage.", "Rysk slashes orc pawn for 1 points of damage.",
                     "Rysk slashes Elite for 1 points of damage.", "Elite was slain by Rysk!", "Rysk slashes Elite for 1 points of damage.", "Elite was slain by Rysk!"])
    rows = P.named_mobs(ev, F.coalesce("mob_name", F.when(F.col("k") == "slay", F.col("tgt")))).collect()
    assert {r.name: r.is_named for r in rows} == {"marrowbane": True, "orc pawn": False, "elite": False}


def test_zone_marks(lines):
    guk = "You have entered Guk 4 (Refined)."
    cases = [
        (["Player Izzin creating instance The Plane of Hate 5255.", "You have entered The Plane of Hate 2 (Adaptive)."], ["The Plane of Hate 2 #5255"]),
        (["You have entered The City of Guk 4 (Refined).", "You have entered East Freeport.", "You have entered The City of Guk 4 (Refined).", "You have entered Befallen 4 (Refined)."], ["The City of Guk 4", "Befallen 4"]),
        (["Player Izzin creating instance The Plane of Sky 7.", "You have entered East Freeport.", "You have entered The Plane of Sky.", "You have entered The Plane of Sky."], ["The Plane of Sky #7"]),
        (["Player Other creating instance The Plane of Sky 7.", "You have entered The Plane of Sky."], []),
        ([(0, "Player Izzin creating instance The Plane of Sky 7."), (600, "You have entered The Plane of Sky.")], []),
        (["Player Izzin creating instance Guk 1.", guk, "Player Izzin creating instance Guk 2.", guk, guk], ["Guk 4 #1", "Guk 4 #2"]),
    ]
    rows = S.zone_instance_changes(streams(lines, [c for c, _ in cases])).orderBy("line_no").collect()
    assert [[r.label for r in rows if r.stream_id == f"s{i}"] for i in range(len(cases))] == [w for _, w in cases]


def test_raid_marks(lines):
    rows = S.marks(parse_lines(lines(["You say to your guild, 'raid start'", "Kermitzalot tells the raid, 'raid end'", "You shout, 'raid end'"]))).collect()
    assert sorted(r.kind for r in rows) == ["raid_end", "raid_start"]
