import random
import re

import pytest
from pyspark.sql import functions as F

from skirmish.operators import chat as C
from skirmish.operators import rules as R
from skirmish.functions import times


def rule(conds, actions=None, logic="all", rid=1, **kw):
    return {"rule_id": rid, "name": f"r{rid}", "logic": logic, "conditions": conds, "actions": actions or [{"type": "alert", "message": "hit"}], **kw}


def match(pattern, kind="regex"):
    return {"type": "match", "match_type": kind, "pattern": pattern}


def fire(lines, bodies, rules, **kw):
    df = lines(bodies).withColumn("ts", times.line_epoch(F.col("raw")))
    return [(r.line_no, r.rule_id, r.message) for r in R.apply_rules(df, rules, **kw).orderBy("line_no", "rule_id", "action").collect()]


@pytest.mark.parametrize("conds,logic,body,fires", [
    ([match(r"^You slash (.+) for")], "all", "You slash a rat for 5 points of damage.", True),
    ([match(r"^You have slain")], "all", "Bob says, 'You have slain a rat!'", False),
    ([match("You have slain", "exact")], "all", "Bob says, 'You have slain a rat!'", True),
    ([match(r"damage\. (Critical)")], "all", "You slash a rat for 5 points of damage. (Critical)", True),
    ([match("{a} slashes * for ? points", "glob")], "all", "Bob slashes a rat for 5 points of damage.", True),
    ([match("(unclosed")], "all", "(unclosed", False), ([match("(?=look)x")], "all", "x", False),
    ([match("zzz"), match("rat", "exact")], "any", "a rat", True), ([match("zzz"), match("rat", "exact")], "all", "a rat", False),
    ([], "any", "x", True), ([], "all", "x", True),
    ([{"type": "chat", "channel": "guild", "match_type": "exact", "pattern": "raid"}], "all", "Bob tells the guild, 'raid now'", True),
    ([{"type": "chat", "channel": "say", "match_type": "exact", "pattern": "raid"}], "all", "You say to your guild, 'raid now'", False),
    ([{"type": "chat", "channel": "tell", "match_type": "exact", "pattern": "hi"}], "all", "Bob tells you, 'hi'", True),
    ([{"type": "chat", "channel": "tell", "match_type": "exact", "pattern": "hi"}], "all", "Bob tells the guild, 'hi'", False),
    ([{"type": "chat", "channel": "custom", "custom_channel": "General", "match_type": "exact", "pattern": "hi"}], "all", "Zyro tells general:1, 'hi'", True),
    ([{"type": "chat", "channel": "any", "match_type": "exact", "pattern": "guild"}], "all", "Bob tells the guild, 'hi'", False),
    ([match(r"for (?P<n>\d+) p"), {"type": "var", "var_name": "n", "op": "gt", "value": "{limit}"}], "all", "You slash a rat for 51 points", True),
    ([match(r"for (?P<n>\d+) p"), {"type": "var", "var_name": "n", "op": "gt", "value": "{limit}"}], "all", "You slash a rat for 50 points", False),
    ([match(r"for (\d+) p"), {"type": "var", "var_name": "1", "op": "matches", "value": "^5.$"}], "all", "for 51 points", True),
    ([{"type": "var", "var_name": "limit", "op": "isset"}], "all", "x", True), ([{"type": "var", "var_name": "other", "op": "isset"}], "all", "x", False),
    ([match(r"(?P<w>\w+) hit"), {"type": "var", "var_name": "w", "op": "equals", "value": "BOB"}], "all", "Bob hit it", True),
    ([match(r"(?P<w>\w+) hit"), {"type": "var", "var_name": "w", "op": "gt", "value": "3"}], "all", "Bob hit it", False),
])
def test_conditions(lines, conds, logic, body, fires):
    assert bool(fire(lines, [body], [rule(conds, logic=logic)], seeds={"limit": "50"})) == fires


def test_templates_and_actions(lines):
    r = rule([match(r"^(?P<who>\w+) hits (?P<what>.+)$")], [
        {"type": "alert", "message": "{who}/{1}/{2}/{nobody}"}, {"type": "voice", "tts_text": ""}, {"type": "sound", "sounds": []}, {"type": "notice", "message": "n", "delay_secs": 3}])
    assert fire(lines, ["Bob hits a rat"], [r]) == [(1, 1, "Bob/Bob/a rat/{nobody}"), (1, 1, "n")]
    assert fire(lines, ["Bob hits a rat"], [rule([], enabled=False)]) == []


def test_variables_carry_over(lines):
    rules = [
        rule([match("now", "exact")], [{"type": "alert", "message": "{target}"}], rid=1),
        rule([match(r"^target (?P<t>\w+)")], [{"type": "store", "var_name": "target", "value": "{t}"}, {"type": "alert", "message": "was {target}"}], rid=2),
        rule([match("now", "exact"), {"type": "var", "var_name": "target", "op": "equals", "value": "bob"}], [{"type": "alert", "message": "it is {target}"}], rid=3),
    ]
    got = fire(lines, ["now", "target Bob now", "x", "now", "target Al", "now"], rules, span=2)
    # The first rule reads the variable before the second one stores it on the same line.
    assert got == [(1, 1, "{target}"), (2, 1, "{target}"), (2, 2, "was Bob"), (2, 3, "it is Bob"), (4, 1, "Bob"), (4, 3, "it is Bob"), (5, 2, "was Al"), (6, 1, "Al")]


def model(bodies, rules, seeds):
    """The rules line by line, for conditions on text by search and on variables by equality or being set."""
    state, out = dict(seeds), []
    for line_no, body in enumerate(bodies, 1):
        body = body[1] if isinstance(body, tuple) else body
        for r in rules:
            caps, holds = {}, []
            fill = lambda t: re.sub(r"\{(\w+)\}", lambda m: caps.get(m[1]) or state.get(m[1]) or m[0], t)  # noqa: B023, E731
            for c in r["conditions"]:
                if c["type"] == "var":
                    v = caps.get(c["var_name"]) or state.get(c["var_name"])
                    holds.append(v is not None and (c["op"] == "isset" or v.lower() == fill(c["value"]).lower()))
                else:
                    m = re.search(c["pattern"], body)
                    holds.append(m is not None)
                    caps.update(m.groupdict() if m else {})
            if all(holds) if r["logic"] == "all" else (not holds or any(holds)):
                for a in r["actions"]:
                    if a["type"] == "store":
                        state[a["var_name"]] = fill(a["value"])
                    else:
                        out.append((line_no, r["rule_id"], fill(a["message"])))
    return out


def var(name, value=None):
    return {"type": "var", "var_name": name, "op": "isset" if value is None else "equals", "value": value or ""}


def store(name, value):
    return {"type": "store", "var_name": name, "value": value}


def alert(message):
    return {"type": "alert", "message": message}


DISARM = [
    rule([match("pull"), var("armed", "yes")], [alert("once, not {armed} again"), store("armed", "no")], rid=1),
    rule([match("reset")], [store("armed", "yes")], rid=2),
    rule([match("pull")], [alert("{armed}")], rid=3),
]
TOGGLE = [
    rule([match("flip"), var("lamp", "off")], [store("next", "on")], rid=1),
    rule([match("flip"), var("lamp", "on")], [store("next", "off")], rid=2),
    rule([match("flip"), var("next")], [store("lamp", "{next}"), alert("lamp {lamp}")], rid=3),
    rule([match("look")], [alert("{lamp} by {who}")], rid=4),
    rule([match(r"who (?P<w>\w+)")], [store("who", "{w}")], rid=5),
]
GROWING = [rule([match("add"), var("s")], [store("s", "{s}x"), alert("{s}")], rid=1), rule([match("add|cut")], [store("s", "a")], rid=2, logic="any", ) | {"conditions": [match("cut")]}]
CHAIN = [
    rule([match(r"take (?P<n>\w+)"), var("held", "{last}")], [store("last", "{n}"), alert("{held} again")], rid=1),
    rule([match(r"take (?P<n>\w+)")], [store("held", "{n}"), store("both", "{held} {last}")], rid=2),
    rule([match("take"), var("flag", "up")], [alert("{both}")], rid=3, logic="any"),
    rule([var("held", "c"), var("flag", "up")], [store("flag", "down"), alert("down")], rid=4),
    rule([match("up")], [store("flag", "up")], rid=5),
]


@pytest.mark.parametrize("rules,words,seeds", [
    (DISARM, ["pull", "pull", "reset", "x"], {"armed": "yes"}), (TOGGLE, ["flip", "flip", "look", "who Al", "who Bo", "x"], {"lamp": "off"}),
    (GROWING, ["add", "add", "add", "cut", "x"], {}), (CHAIN, ["take a", "take b", "take c", "up", "x"], {"last": "a", "held": "b"}),
])
def test_variables_that_decide_their_own_values(lines, rules, words, seeds):
    """As line by line, whatever the chunk width; more chunks than states, so tables have to be composed."""
    r = random.Random(str(words))
    bodies = [r.choice(words) for _ in range(45)]
    want = model(bodies, rules, seeds)
    assert len(want) > 10
    for span in (4, 1000):
        assert fire(lines, bodies, rules, seeds=seeds, span=span) == want


def test_loops_of_several_streams(lines):
    """Streams don't mix; a stream without a line of interest and empty input give nothing."""
    one, two = lines(["reset", "pull", "pull"], stream="a"), lines(["pull", "reset", "pull", "x"], stream="b")
    df = one.unionByName(two).unionByName(lines(["x"], stream="c")).withColumn("ts", F.lit(0).cast("long"))
    got = R.apply_rules(df, DISARM[:2], span=2).select("stream_id", "line_no", "message")
    assert sorted(map(tuple, got.collect())) == [("a", 2, "once, not yes again"), ("b", 3, "once, not yes again")]
    assert R.apply_rules(df.limit(0), DISARM, span=2).collect() == []


def test_levels():
    assert R.variable_levels(TOGGLE) == [(["who"], False), (["lamp", "next"], True)] and R.variable_levels(DISARM) == [(["armed"], True)]
    assert R.variable_levels([rule([match("x")], [store("a", "1"), store("b", "2")])]) == [(["a", "b"], False)]


def test_discover_and_presets():
    rules = [rule([match(r"(?P<b>x)(?<a>y)")], enabled=False), rule([match("{zed} *", "glob"), match("{no}", "exact")])]
    assert R.discover_variables(rules) == ["a", "b", "zed"]
    assert len(R.preset_rules()) == 16 and all(c["compiled"] for r in R.compile_rules(R.preset_rules()) for c in r["conditions"])


@pytest.mark.parametrize("pattern,want", [
    (r"You (?:have )?looted (?P<item>.+?) from (?P<mob>.+?)'s corpse", [" from ", "'s corpse", "You ", "looted "]), (r"(abc|xyz) def", [" def"]), (r"(?i)abcdef", []), (r"(abc)+d?efg", ["abc", "efg"]), (r"^abc{2}d$", []),
])
def test_required_texts(pattern, want):
    from skirmish.functions.templates import required_texts

    assert required_texts(pattern) == sorted(want)


def test_chat_corpus(lines, spark):
    df = lines([
        (0, "You have slain a gnoll!"), (10, "Bob tells the group, 'nice'"), (50, "Al says out of character, 'hm'"), (61, "Bob says, \"late\""), (62, "Bob begins casting Ice Comet."), (62, "You tell your party, 'go'"), (63, "Al tells the raid, 'no'"),
    ])
    labels = spark.createDataFrame([("Bob", "RaidLeader"), ("Izzin", "QuietAnchor")], "speaker string, archetype string")
    rows = C.extract_corpus(df, labels).orderBy("line_no").collect()
    assert [(r.speaker, r.channel, r.text, [tuple(c) for c in r.context]) for r in rows] == [
        ("Bob", "group", "nice", [("slay", "You slew a gnoll")]), ("Bob", "say", "late", []), ("Izzin", "group", "go", [("cast", "Bob casting Ice Comet")])]
    assert C.extract_corpus(df, labels, include_unknown=True).count() == 4


def test_correlate(lines):
    df = lines([(0, "You have slain a gnoll!"), (30, "Bob tells the group, 'grats'"), (31, "Bob tells the raid, 'hello there'"), (40, "Bob died."), (41, "You tell your party, 'oh no'"), (42, "You tell your guild, 'x'")])
    rows = C.correlate_chat(df, span=2).orderBy("line_no").collect()
    assert [(r.speaker, r.channel, r.msg_class, r.event_kind, r.event_detail, r.event_lag_secs) for r in rows] == [
        ("Bob", "group", "reactive", "slay", "a gnoll", 30), ("Bob", "raid", "social", None, None, None), ("Izzin", "group", "reactive", "player_death", "Bob", 1)]
    stats = {r.speaker: r for r in C.speaker_stats(C.correlate_chat(df)).collect()}
    assert stats["Bob"].median_reaction_secs == 30 and stats["Bob"].avg_msg_len == 8.0


def test_ngrams(spark):
    h = spark.createDataFrame([(1, "the cat the cat"), (2, "x"), (3, "")], "id long, text string")
    r = spark.createDataFrame([(1, 1, "the cat sat"), (1, 2, "the the dog"), (2, 1, "y")], "id long, ref_id long, text string")
    assert {x.id: x.precision for x in C.ngram_precision(h, r, 1).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {x.id: round(x.precision, 3) for x in C.ngram_precision(h, r, 2).collect()} == {1: 0.333, 2: 0.0, 3: 0.0}


def test_training_set_cuts_the_response(spark):
    ctx = "array<struct<kind:string,summary:string>>"
    df = spark.createDataFrame([(i, "RaidLeader", "w " * 200, [("slay", "You slew a rat")]) for i in range(40)], f"line_no long, archetype string, text string, context {ctx}")
    rows = C.training_set(C.training_prefix(df), lambda s: [1] * len(s.split()), 100, 2, 0, max_len=32, val_frac=0.1).collect()
    assert all(len(r.seq) == 32 for r in rows) and sum(r.split == "val" for r in rows) == 4
    assert {r.prefix_len for r in rows} == {11}  # six labels, two buckets, two slot words, the response mark


def test_training_set_at_full_length(spark):
    ctx = "array<struct<kind:string,summary:string>>"
    df = spark.createDataFrame([(i, "RaidLeader", "w " * 300, [("slay", "You slew a rat")]) for i in range(3)], f"line_no long, archetype string, text string, context {ctx}")
    rows = C.training_set(C.training_prefix(df), lambda s: [1] * len(s.split()), 100, 2, 0).collect()
    assert {(len(r.seq), r.prefix_len, r.full_len) for r in rows} == {(312, 11, 312)}
    cut = C.training_set(C.training_prefix(df), lambda s: [1] * len(s.split()), 100, 2, 0, max_len=5).collect()
    assert {(len(r.seq), r.prefix_len, r.full_len) for r in cut} == {(5, 5, 312)}


def test_templated_patterns_that_are_none(spark):
    from skirmish.functions import templates

    rows = [("abc", "b"), ("abc", "a(b"), ("abc", "(?=a)"), ("ABC", "(?P<x>B)"), (None, "a"), ("a", None), ("x.y", r"x\\.y")]
    df = spark.createDataFrame(rows, "t string, p string")
    assert [r[0] for r in df.select(templates.matches(F.col("t"), F.col("p"))).collect()] == [True, False, False, True, False, False, False]
    numbers = [("5", "4"), (" 5 ", "4"), ("5.", ".5"), ("1e1", "9"), ("x", "1"), ("5d", "4"), (None, "1"), ("inf", "9")]
    df = spark.createDataFrame(numbers, "a string, b string")
    assert [r[0] for r in df.select(templates.cmp_numeric(F.col("a"), F.col("b"), "gt")).collect()] == [True, False, True, True, False, False, False, True]


def test_escaped_backslash_is_no_reference():
    from skirmish.functions.templates import to_java

    assert to_java(r"a\\1")[0] == r"(?d)a\\1"
    with pytest.raises(ValueError):
        to_java(r"(a)\1")


def test_facts_hold_only_what_a_rule_reads(spark):
    from skirmish.operators.rules import rule_facts

    rule = {"rule_id": 1, "name": "x", "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": r"(?P<who>\w+) hits (?P<mob>\w+) for (\d+)"}],
            "actions": [{"type": "alert", "message": "{who} {3}"}, {"type": "store", "var_name": "last", "value": "{who}"}]}
    df = spark.createDataFrame([("Pab hits rat for 7",), ("nothing",)], "raw string")
    (row,) = rule_facts(df, [rule])[0].collect()
    assert '"who":"Pab"' in row.facts and '"3":"7"' in row.facts and "rat" not in row.facts


def test_lines_that_say_nothing_are_left_out_before_the_scans(spark):
    """Only lines on which a rule may fire go through the scans of variables; an any-rule with a variable keeps all."""
    from pyspark.sql import functions as F

    from skirmish.operators.rules import _may_fire, compile_rules

    text = {"type": "match", "match_type": "exact", "pattern": "hit"}
    var = {"type": "var", "var_name": "v", "op": "isset"}
    rules = compile_rules([{"name": str(i), "logic": logic, "conditions": c, "actions": []} for i, (logic, c) in enumerate([("all", [text, var]), ("any", [text, var]), ("any", [text]), ("all", [var]), ("any", [])])])
    df = spark.createDataFrame([("a hit",), ("none",)], "raw string")
    rows = df.select(*[_may_fire(r, F.col("raw")).alias(str(i)) for i, r in enumerate(rules)]).collect()
    assert [tuple(r) for r in rows] == [(True,) * 5, (False, True, False, True, True)]
