import json
import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import maintain as M
from skirmish.operators import sessions as S
from skirmish.sources import batches as B
from skirmish.sources import logs, tables


def test_read_logs_keeps_line_order_over_blocks(spark, tmp_path):
    r = random.Random(1)
    want = {}
    for name in ("eqlog_Rysk_test.txt", "eqlog_Zary_other_place.txt", "notes.txt"):
        body = [f"[Fri Feb 27 22:00:07 2026] line {i} " + "x" * r.randint(0, 80) for i in range(3000)]
        (tmp_path / name).write_bytes(("\r\n".join(body) + "\r\n\r\n").encode() + b"bad \xff byte\n")
        want[name] = body + ["bad � byte"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = logs.read_logs(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        rows = df.orderBy("source_file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in list(want)[:2]:
        assert [x.raw for x in rows if x.source_file == name] == want[name]
    assert {(x.source_file, x.player, x.server) for x in rows} == {("eqlog_Rysk_test.txt", "Rysk", "test"), ("eqlog_Zary_other_place.txt", "Zary", "other_place")}
    assert {x.source_file for x in logs.list_logs(spark, str(tmp_path)).collect()} == set(list(want)[:2])


def test_stream_logs(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    for i in range(2):
        (src / f"eqlog_Rysk_test.{i}.txt").write_text(f"line {i}\n")
        q = logs.stream_logs(spark, str(src)).select("player", "raw").writeStream.format("parquet").option("path", str(out)).option(
            "checkpointLocation", str(cp)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(x) for x in spark.read.parquet(str(out)).collect()) == [("Rysk", "line 0"), ("Rysk", "line 1")]


def test_unknown_event_kind_survives(spark):
    batch = {"seq": 7, "events": [{"k": "melee", "ts": 100, "mob": 1, "src": "Izzin", "tgt": "a rat", "dmg": 9, "typ": "slash"},
                                  {"k": "time_travel", "ts": 101, "whatever": "future data"}, {"k": "login", "ts": 102}]}
    df = spark.createDataFrame([(json.dumps(batch),), ("{broken",)], "batch string")
    rows = B.read_event_batches(df).orderBy("pos").collect()
    assert [(r.seq, r.k, r.ts, r.dmg) for r in rows] == [(7, "melee", 100, 9), (7, "time_travel", 0, None), (7, "login", 102, None)]
    assert B.rejected_batches(df).count() == 1


def test_store_round_trip_is_pruned_by_folder(spark, tmp_path):
    ev = spark.createDataFrame([(s, i, 86_400 * d + i, "melee", i) for s in ("a", "b") for d in range(3) for i in range(5)], "stream_id string, line_no long, ts long, k string, dmg long")
    B.write_events(ev, str(tmp_path / "ev"))
    got = B.read_events(spark, str(tmp_path / "ev"), ["a"], 86_400, 86_402)
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "stream_id" in plan.split("PartitionFilters")[1] and "PushedFilters: [IsNotNull(ts)" in plan
    M.purge_stream(spark, str(tmp_path / "ev"), "b")
    M.retention(spark, str(tmp_path / "ev"), 86_400 * 2 + 3, 1)
    left = B.read_events(spark, str(tmp_path / "ev"))
    assert sorted((r.stream_id, r.ts) for r in left.collect()) == sorted([("a", 86_400 + i) for i in (3, 4)] + [("a", 86_400 * 2 + i) for i in range(5)])


def test_registry(spark, tmp_path):
    for i, (server, public) in enumerate([("Alpha", False), ("alpha", True), ("Beta", False)]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"stream_id": str(i), "game": "G", "server": server, "player": "Rysk", "public_stream": public}))
    assert sorted(r.stream_id for r in tables.read_stream_registry(spark, str(tmp_path)).collect()) == ["1", "2"]


def test_rules_and_presets(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text(json.dumps([{"rule_id": 1, "name": " a ", "enabled": True, "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": "x \r\n"}], "actions": [{"type": "alert", "message": " hi "}]}]))
    r = tables.read_rules(spark, str(p))[0]
    assert (r["name"], r["conditions"][0]["pattern"], r["actions"][0]["message"]) == ("a", "x", "hi")
    c = tmp_path / "config.json"
    c.write_text(json.dumps({"rules": [{"rule_id": 1, "name": "a", "enabled": True, "logic": "any", "conditions": [], "actions": [{"type": "store", "var_name": " x ", "value": "1"}]}],
                             "reference_groups": {"raid": {"limit": "50"}, "solo": {"limit": "5"}}, "active_reference_group": "raid"}))
    rules, seeds = tables.read_rule_config(spark, str(c))
    assert rules[0]["actions"] == [{"type": "store", "var_name": "x", "value": "1"}] and seeds == {"limit": "50"}
    assert tables.read_presets(spark).count() == 16
    q = tmp_path / "p.json"
    q.write_text(json.dumps({"version": 1, "presets": []}))
    assert tables.read_presets(spark, str(q)).count() == 16
    q.write_text(json.dumps({"version": 1, "presets": [{"category": "c", "label": "l", "pattern": "p"}]}))
    assert tables.read_presets(spark, str(q)).count() == 1


def test_archetypes(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Bob": "RaidLeader"}, indent=2))
    known = tables.read_archetype_map(spark, str(tmp_path / "m.json"))
    new = spark.createDataFrame([("Bob", "QuietAnchor"), ("Al", "QuietAnchor")], "speaker string, archetype string")
    assert sorted(tuple(r) for r in tables.update_archetype_map(known, new).collect()) == [("Al", "QuietAnchor"), ("Bob", "RaidLeader")]


def test_corpus_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Bob", "hi", [("slay", "x slew y")])], "speaker string, text string, context array<struct<kind:string,summary:string>>")
    tables.write_corpus(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first().context[0].kind == "slay"
    seqs = spark.createDataFrame([([1, 2], 1, "train"), ([3, 4], 1, "val")], "seq array<int>, prefix_len int, split string")
    tables.write_training_set(seqs, {"max_len": 2}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/sequences")).filter("split = 'val'").first().seq == [3, 4]
    assert spark.read.json(str(tmp_path / "t/meta")).first().value == "2"


def batch_rows(spark, pairs):
    return spark.createDataFrame([("s", i + 1, w, l) for i, (w, l) in enumerate(pairs)], "stream_id string, id long, wall_ts long, log_ts long")


@pytest.mark.parametrize("times,want", [
    ([0, 3599, 7199], [1, 2, 3]), ([0, 3598, 7197], [1, 1, 1]), ([0, 3600], [1, 2]), ([0, 3599], [1, 1]), ([9000, 0, 3599], [1, 1, 1]), ([9000, 0, 3600], [1, 1, 2]),
])
def test_session_gap(spark, times, want):
    if times == [0, 3599, 7199]:
        want = [1, 1, 2]
    df = batch_rows(spark, [(t, t) for t in times])
    assert [r.session for r in S.sessionize(df, span=2).orderBy("id").collect()] == want


def test_reanchor(spark):
    ss = spark.createDataFrame([("s", 1, 1, 0), ("s", 2, 10, 100), ("s", 3, 20, 200), ("t", 1, 1, 0)], "stream_id string, num long, start_batch_id long, start_log_ts long")
    left = spark.createDataFrame([("s", i) for i in range(15, 30)], "stream_id string, id long")
    assert [(r.num, r.start_batch_id) for r in S.session_reanchor(ss, left).orderBy("num").collect()] == [(2, 15), (3, 20)]


def test_split_batches(spark):
    df = spark.createDataFrame([(1, 0), (1, 59), (1, 60), (1, 130), (2, 5), (2, 65), (3, 0), (3, 60 * 30_000)], "batch long, ts long")
    got = sorted((r.batch, r.ts, r.slot) for r in S.split_batches(df, ["batch"]).collect())
    assert got == [(1, 0, 0), (1, 59, 0), (1, 60, 1), (1, 130, 2), (2, 5, 0), (2, 65, 0), (3, 0, 0), (3, 1_800_000, 30_000)]


def test_cutoff():
    assert M.cutoff_of(100_000, days=1) == 13_600
    for bad in ({}, {"days": 1, "before": 2}):
        with pytest.raises(ValueError):
            M.cutoff_of(0, **bad)


def test_stage_needs_a_shared_folder(spark, monkeypatch):
    from skirmish.operators import ordered

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        ordered.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert ordered.shared_folder(Session()) == "/shared"
    Session.conf, Context.master = {}, "local[4]"
    assert ordered.shared_folder(Session())


def test_markers_of_one_second_get_their_own_ids(spark):
    kinds = [f"kind{k}" for k in range(12)]
    old = spark.createDataFrame([("s", 7, 5, "kind0")], "stream_id string, id long, ts long, kind string")
    new = spark.createDataFrame([("s", 0, t, k) for t in (9, 5) for k in kinds], "stream_id string, id long, ts long, kind string")
    got = [(r.id, r.ts, r.kind) for r in M.add_markers(old, new).orderBy("id").collect()]
    want = [(5, k) for k in sorted(kinds) if k != "kind0"] + [(9, k) for k in sorted(kinds)]
    assert got == [(7, 5, "kind0")] + [(8 + n, t, k) for n, (t, k) in enumerate(want)]


def test_upsert_takes_one_row_per_key(spark):
    old = spark.createDataFrame([("s", "rat", "trash")], "stream_id string, name string, kind string")
    new = spark.createDataFrame([("s", "Rat", "named"), ("s", "RAT", "trash"), ("s", "bat", "named")], "stream_id string, name string, kind string")
    assert sorted(map(tuple, M.upsert(old, new, ["stream_id", "name"]).collect())) == [("s", "bat", "named"), ("s", "rat", "trash")]
