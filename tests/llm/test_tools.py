import json

import pytest
from skirmish.llm import tools
from skirmish.llm.tools import Arg

SCHEMAS = {
    "find": {"q": Arg("string"), "n": Arg("integer", required=False, least=1, most=9), "kind": Arg("string", required=False, among=("a", "b"))},
    "sum": {"xs": Arg("array"), "f": Arg("number", required=False), "o": Arg("object", required=False), "ok": Arg("boolean", required=False)},
}
CALLS = "conv long, turn long, call_id string, tool string, args string, uses array<string>"


def run(spark, calls, results=()):
    """Results are (conv, call_id, result)."""
    out = tools.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), "conv long, call_id string, result string"), SCHEMAS)
    return {(r.conv, r.turn, r.call_id): r for r in out.collect()}


@pytest.mark.parametrize(
    "tool,args,want",
    [
        ("find", '{"q":"x","n":3,"kind":"a"}', []), ("find", '{"n":3}', ["q: missing"]), ("find", '{"q":null}', ["q: missing"]), ("find", '{"q":5}', ["q: not string"]),
        ("find", '{"q":"x","n":10}', ["n: out of range"]), ("find", '{"q":"x","n":"3"}', ["n: not integer"]), ("find", '{"q":"x","n":1.5}', ["n: not integer"]), ("find", '{"q":"x","kind":"c"}', ["kind: out of range"]),
        ("find", '{"q":"x","zz":1,"aa":2}', ["aa: unknown", "zz: unknown"]), ("sum", '{"xs":[1,"a"],"f":1.5,"o":{},"ok":true}', []), ("sum", '{"xs":{},"f":true,"o":[],"ok":0}', ["f: not number", "o: not object", "ok: not boolean", "xs: not array"]),
        ("nope", "{}", ["unknown tool"]), ("find", "{q", ["arguments are not a JSON object"]), ("find", "[1]", ["arguments are not a JSON object"]), ("find", None, ["arguments are not a JSON object"]), (None, '{"q":"x"}', ["unknown tool"]),
    ],
)
def test_validation(spark, tool, args, want):
    assert run(spark, [(1, 0, "a", tool, args, [])], [(1, "a", "r")])[1, 0, "a"].problems == want


def test_canonical_json(spark):
    got = run(spark, [(1, 0, "a", "find", '{ "q" : "é\\n\\"x\\"" , "n":2, "b": {"z":1,"a":[ 1 , 2 ]} }', [])], [(1, "a", "li\nne")])[1, 0, "a"]
    assert got.json == '{"arguments":{"b":{"a":[1,2],"z":1},"n":2,"q":"é\\n\\"x\\""},"call_id":"a","result":"li\\nne","tool":"find"}'
    assert json.loads(got.json)["result"] == "li\nne"
    lone = run(spark, [(1, 0, None, None, None, None)])[1, 0, None]
    assert json.loads(lone.json) == {"arguments": None, "call_id": None, "result": None, "tool": None} and not lone.valid


def test_links(spark):
    args = '{"q":"x"}'
    got = run(spark, [(1, 0, "a", "find", args, []), (1, 1, "b", "find", args, []), (2, 0, "c", "find", args, [])], [(1, "a", "2"), (1, "a", "1"), (2, "c", None), (1, "zzz", "x"), (1, None, "y"), (None, "b", "z"), (2, "b", "z")])
    assert got[1, 0, "a"].problems == ["result: repeated"] and json.loads(got[1, 0, "a"].json)["result"] == "1"
    assert got[1, 1, "b"].problems == ["result: missing"] and got[2, 0, "c"].valid


def test_identifiers_repeat_between_conversations(spark):
    a = '{"q":"x"}'
    got = run(spark, [(c, 0, "call_1", "find", a, []) for c in (1, 2, None)] + [(3, 0, None, "find", a, []), (4, 0, None, "find", a, [])], [(1, "call_1", "one"), (2, "call_1", "two"), (3, None, "x"), (None, "call_1", "y")])
    assert [json.loads(got[c, 0, "call_1"].json)["result"] for c in (1, 2, None)] == ["one", "two", None] and got[1, 0, "call_1"].valid and got[2, 0, "call_1"].valid
    assert got[None, 0, "call_1"].problems == got[3, 0, None].problems == got[4, 0, None].problems == ["result: missing"]


def test_numbers_have_one_form(spark):
    same = [("1", "1.0", "1e0", "10E-1", "1.000"), ("1500", "1.5e3", "1500.00"), ("0", "-0", "0.0", "-0.0", "0e5"), ("-2.5", "-25e-1", "-2.500"), ("10000000000", "1e10", "10000000000.0"), ("10000000000000000000000", "1e22"), ("0.00001", "1e-5"), ("1e60", "10E59"), ("1.5e-40", "15E-41")]
    rows = [(k, '{"b":[%s,"1.0 \\"2e0"],"a":"-0.0"}' % x) for k, group in enumerate(same) for x in group]
    df = spark.createDataFrame(rows, "k int, j string")
    got = {}
    for r in df.select("k", tools.canonical(df.j).alias("c")).collect():
        got.setdefault(r.k, set()).add(r.c)
    assert got == {k: {'{"a":"-0.0","b":[%s,"1.0 \\"2e0"]}' % group[0]} for k, group in enumerate(same)}
    long = spark.createDataFrame([("12345678901234567890123456789012345678",), ("not json",), (None,), ('["' + '\\"x1.5' * 200_000 + '",1.50]',)], "j string")
    out = [r[0] for r in long.select(tools.canonical(long.j)).collect()]
    assert out[:3] == ["12345678901234567890123456789012345678", None, None] and out[3].endswith('x1.5",1.5]')


def test_extra_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    calls = spark.createDataFrame([(1, 0, "a", "find", json.dumps({"q": "long " * 200_000}), [])], CALLS).withColumns({c: F.lit("x") for c in ("n", "rank", "result", "n_results", "given", "used", "missing", "problems")})
    results = spark.createDataFrame([(1, "a", "r" * 1_000_000)], "conv long, call_id string, result string").withColumns({c: F.lit("x") for c in ("turn", "n_results", "tool")})
    (got,) = tools.format_calls(calls, results, SCHEMAS).collect()
    assert got.valid and len(json.loads(got.json)["result"]) == 1_000_000 and len(json.loads(got.json)["arguments"]["q"]) == 1_000_000


def test_order_is_topological(spark):
    import random

    r = random.Random(3)
    calls, want = [], {}
    for conv in range(30):
        n = r.randint(1, 12)
        turns = r.sample(range(40), n)
        # Uses follow a hidden order, so there is no cycle, but may point forward in turns.
        uses = [[f"k{conv}_{j}" for j in range(k) if r.random() < 0.25] for k in range(n)]
        calls += [(conv, turns[k], f"k{conv}_{k}", "find", '{"q":"x"}', uses[k]) for k in range(n)]
        rank = []
        for k in range(n):
            best = (turns[k], 0)
            for u in uses[k]:
                t, h = rank[int(u.split("_")[1])]
                best = max(best, (t, h + 1))
            rank.append(best)
            want[conv, turns[k], f"k{conv}_{k}"] = best
    got = run(spark, calls)
    assert {k: (r.rank_turn, r.rank_hops) for k, r in got.items()} == want
    for conv, turn, cid, _, _, uses in calls:
        assert all(want[next(k for k in want if k[2] == u)] < want[conv, turn, cid] for u in uses)


def test_cycles_gaps_and_repeats(spark):
    a = '{"q":"x"}'
    got = run(spark, [(1, 0, "a", "find", a, ["b"]), (1, 1, "b", "find", a, ["a"]), (1, 2, "c", "find", a, ["a", "gone"]), (1, 3, "d", "find", a, None), (2, 0, "s", "find", a, ["s"]),
                      (3, 0, "x", "find", a, []), (3, 1, "x", "find", a, []), (3, 2, "y", "find", a, ["x", "x", None])], [(c, k, "r") for c in (1, 2, 3) for k in "abcdsxy"])
    assert all("uses: cycle" in got[k].problems and got[k].rank_hops is None for k in ((1, 0, "a"), (1, 1, "b"), (2, 0, "s")))
    assert "uses gone: missing" in got[1, 2, "c"].problems and got[1, 3, "d"].valid
    assert got[3, 2, "y"].problems == ["uses x: missing"]


def test_empty_tables(spark):
    assert run(spark, []) == {}


def test_conversations(spark):
    turns = [(1, 0, "user", "a b c d e"), (1, 1, "assistant", "ok"), (1, 2, "user", "one two"), (1, 3, "assistant", None), (1, 4, "user", None), (2, 0, "system", "s"), (2, 1, "user", "word " * 35), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {(r.conv, r.turn): r for r in tools.format_calls(*tools.calls_of(df), tools.SCHEMAS).collect()}
    assert len(out) == 5
    assert (out[1, 0].rank_turn, out[1, 0].rank_hops) == (2, 1) and (out[1, 2].rank_turn, out[1, 2].rank_hops) == (2, 0)
    assert out[1, 0].valid and "query: missing" in out[1, 4].problems and '"tool":"summarise"' in out[2, 1].json
