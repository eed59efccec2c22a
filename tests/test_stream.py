import random
import tempfile
import time

from skirmish.operators import classify as C
from skirmish.operators import rules as R
from skirmish.operators.parse import parse_lines
from skirmish.streaming import live
from tests.test_attribution import OWNER, random_log

LINES = "stream_id string, player string, line_no long, raw string"


def feed(spark, parts, build, schema):
    """Each part one micro-batch of a stream that is stopped and started again in between."""
    live.use_rocksdb(spark)
    src, out, cp = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    for part in parts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        s = build(spark.readStream.schema(schema).parquet(src))
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


PETS = ["Ruin begins casting Burnout II.", "Labarer goes berserk.", "Gaber goes berserk.", "Aa begins casting Lesser Summoning: Water.", "Gobaner slashes a rat for 12 points of damage.",
        "Zarab slashes Bb for 12 points of damage.", "Zarab tries to slash Own, but misses!", "Bb`s warder bites Cc for 3 points of damage.", "Cc begins casting Sisna's Animation.", "a rat slashes Gobaner for 2 points of damage."]


def test_direction_in_a_stream_equals_batch(spark):
    """Random logs with pets, cut into three micro-batches whose rows come in any order."""
    rows = []
    for seed in range(12):
        r = random.Random(seed)
        log = [x[3] for x in random_log(seed, 50)]
        for _ in range(25):
            log.insert(r.randrange(len(log)), r.choice(PETS))
        rows += [(f"s{seed}", OWNER, i + 1, f"[Fri Feb 27 22:{i // 4 % 60:02d}:{i * 13 % 60:02d} 2026] {x}") for i, x in enumerate(log)]
    parts = [[x for x in rows if a <= x[2] < b] for a, b in ((0, 25), (25, 26), (26, 10**6))]
    for p in parts:
        random.Random(1).shuffle(p)
    names = ["src_is_mob", "tank", "mob_name", "touch", "k", "sp", "typ", "dmg", "ts"]
    parsed = parse_lines(spark.createDataFrame(rows, LINES)).filter("pattern is not null")
    pets = C.pet_events(parsed)
    want = {(r.stream_id, r.line_no): [r[c] for c in names] for r in C.classify(parsed, pets).collect()}
    found = feed(spark, parts, live.stream_events, LINES).collect()
    got = {(r.stream_id, r.line_no): [r[c] for c in names] for r in found}
    assert len(found) == len(want) and got == want
    owned = {(r.stream_id, r.name, r.owner) for r in pets.filter("how <> 'warder'").collect()}
    assert owned and {(r.stream_id, r.src, r.pet_owner) for r in found if r.pet_owner} <= owned


def test_alert_with_a_delay_leaves_by_its_timer(spark):
    rules = [
        {"rule_id": 1, "name": "pull", "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": r"pull (?P<n>\d+)"}, {"type": "var", "var_name": "armed", "op": "equals", "value": "YES"}],
         "actions": [{"type": "alert", "message": "now {n}"}, {"type": "notice", "message": "late {n} of {armed}", "delay_secs": 1.5}, {"type": "store", "var_name": "armed", "value": "no"}, {"type": "sound", "sounds": []}]},
        {"rule_id": 2, "name": "reset", "logic": "all", "conditions": [{"type": "match", "match_type": "exact", "pattern": "reset"}], "actions": [{"type": "store", "var_name": "armed", "value": "yes"}]},
        {"rule_id": 3, "name": "none", "logic": "any", "conditions": [], "actions": [{"type": "voice", "tts_text": ""}]},
    ]
    schema = "stream_id string, line_no long, ts long, raw string"
    parts = [[("a", 2, 11, "pull 2"), ("a", 1, 10, "pull 1"), ("b", 1, 5, "pull 9")], [("a", 4, 13, "pull 4"), ("a", 3, 12, "reset"), ("b", 2, 6, "pull 8")]]
    live.use_rocksdb(spark)
    src, cp = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    seen = {}

    def keep(df, epoch):
        for r in df.select("stream_id", "line_no", "rule_id", "action", "message", "fire_ts").collect():
            seen[tuple(r)] = epoch

    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        s = live.stream_rules(spark.readStream.schema(schema).parquet(src), rules, seeds={"armed": "yes"})
        q = s.writeStream.foreachBatch(keep).option("checkpointLocation", cp).trigger(availableNow=True).start()
        live.stop_when_idle(q, 1.6)
    df = spark.createDataFrame([x for p in parts for x in p], schema)
    want = {tuple(r) for r in R.apply_rules(df, rules, seeds={"armed": "yes"}, span=2).select("stream_id", "line_no", "rule_id", "action", "message", "fire_ts").collect()}
    assert set(seen) == want and len(want) == 6
    # What waits leaves in a later micro-batch than its line, in the same run of the stream.
    epoch = {x[4]: e for x, e in seen.items()}
    assert epoch["now 1"] < epoch["late 1 of yes"] < epoch["now 4"] < epoch["late 4 of yes"] and epoch["now 9"] == epoch["now 1"]


def test_state_is_forgotten(spark):
    """Keys of many rounds: what was resent in time is dropped, and the state stays flat."""
    schema = "stream_id string, run long, seq long, log_ts long, body string"
    live.use_rocksdb(spark)
    src, out, cp = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("a", 1, 0, 0, "x"), ("a", 1, 0, 0, "again"), ("a", 2, 0, 0, "other run"), ("a", None, 0, 0, "null"), ("a", None, 0, 0, "null")])
    s = live.drop_resent(spark.readStream.schema(schema).parquet(src), keep=3)
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
    held, sent = [], 5
    for n in range(1, 5):
        while sum(p.numInputRows for p in q.recentProgress) < sent:
            time.sleep(0.05)
        done = q.lastProgress.batchId
        time.sleep(3.5)
        while q.lastProgress.batchId < done + 2:
            time.sleep(0.05)
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)
        rows = [("a", 1, 100 * n + i, 0, str(i)) for i in range(40)]
        write(rows + rows)
        sent += 80
    while sum(p.numInputRows for p in q.recentProgress) < sent:
        time.sleep(0.05)
    live.stop_when_idle(q, 0)
    got = [r.body for r in spark.read.parquet(out).collect()]
    assert len(got) == 3 + 4 * 40 and sorted(got)[-2:] == ["other run", "x"]
    assert max(held) < 40


def test_sessions_of_many_streams_in_few_groups(spark):
    """Streams that share a group keep their own sessions, as in batch; times, logins and whole streams may be null."""
    from skirmish.operators.sessions import sessionize

    schema = "stream_id string, id long, log_ts long, login boolean"
    r = random.Random(3)
    rows = [(None if s == 20 else f"s{s}", i, None if r.random() < 0.2 else r.randrange(60), r.choice([True, False, False, False, None])) for s in range(21) for i in range(12)]
    rows += [("late", 11, None, False), ("none", 1, None, True), ("none", 9, None, None)]
    r.shuffle(rows)
    parts = [[x for x in rows if a <= x[1] < b] for a, b in ((0, 4), (4, 5), (5, 12))]
    got = {(x.stream_id, x.id): x.session for x in feed(spark, parts, lambda s: live.stream_sessions(s, 20, slices=3), schema).collect()}
    df = spark.createDataFrame(rows, schema).fillna("null", ["stream_id"])
    want = {(None if x.stream_id == "null" else x.stream_id, x.id): x.session for x in sessionize(df, 20, login=df["login"], span=4).collect()}
    assert got == want and len(got) == len(rows) and max(got.values()) > 3


def test_lines_fed_in_order_and_in_bounded_runs(spark):
    """Runs hold about as many rows as asked for, in the order of the lines, and no row is lost."""
    from pyspark.sql import functions as F

    from skirmish.plans import q_stream

    n, runs = 90, []

    def build(s):
        runs.append(0)
        return s.withColumn("run", F.lit(len(runs)))

    df = spark.range(n).select(F.lit("a").alias("stream_id"), ((F.col("id") * 37) % n).alias("line_no"))
    out = sorted((r.line_no, r.run) for r in q_stream._in_order(spark, df, build, rows=30).collect())
    assert [x for x, _ in out] == list(range(n)) and [x for _, x in out] == sorted(x for _, x in out)
    assert len(runs) == 3 and max(sum(x == i for _, x in out) for i in (1, 2, 3)) <= 40


class _Map(dict):
    """A map state as the states use it."""

    def exists(self):
        return bool(self)

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.made = {}

    def getMapState(self, name, *_):
        return self.made.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.made.setdefault(name, _Value())


def _told_one_by_one(rows, names, casts):
    """The rules of direction, a line at a time: (player from, mob from, owner) per name, and what is known at each line."""
    out = []
    for line, src, tgt, ts, cat, mine, corpse, hurts, buff_cast, summon_cast, buff_seen, summon_seen in sorted(rows):
        s, t = (names.setdefault(x, [None, None, None]) if x is not None else [None, None, None] for x in (src, tgt))
        for kind, cast in (("buff", buff_cast), ("summon", summon_cast)):
            if cast:
                casts[kind] = [src, ts, False]
        kind = "buff" if buff_seen else "summon" if summon_seen and s[2] is None else None
        owner, at, used = casts.get(kind) or (None, None, True)
        if kind and src is not None and not used and owner != src and max(ts - at, 0) <= (live.BUFF_SECS if kind == "buff" else live.SUMMON_SECS):
            casts[kind][2] = True
            if owner is not None:
                s[2], s[0] = owner, line if s[0] is None else s[0]
        known, met = s[0] is not None, t[0] is not None and t[0] < line
        struck = False
        if cat == "U":
            s[0], struck = line if s[0] is None else s[0], hurts
        elif cat in ("H", "C", "S"):
            mob = not known and (cat == "H" or " " in (src or "") or (cat == "C" and mine) or s[1] is not None or met)
            s[1 if mob else 0] = line if s[1 if mob else 0] is None else s[1 if mob else 0]
            struck = not mob
        elif cat == "A":
            struck = known
        elif cat == "B" or (cat == "M" and not known and (" " in (src or "") or mine or met)):
            s[1] = line if s[1] is None else s[1]
        if struck and not corpse and tgt is not None:
            t[1] = line if t[1] is None else t[1]
        s, t = names.get(src, [None, None, None]), names.get(tgt, [None, None, None])
        out.append((line, s[0], t[0], s[1], s[2]))
    return out


def test_direction_goes_through_the_lines_that_tell_alone():
    """Blocks of rows in any order, looked at in stretches of many lengths, against one line at a time."""
    import pandas as pd
    import pyarrow as pa

    for seed in range(30):
        r = random.Random(seed)
        people = ["Aa", "Bb", "Cc", "Gober", "Kabn", "a rat", "an orc", None]
        rows = []
        for line in range(300):
            flags = [r.random() < p for p in (0.2, 0.1, 0.8, 0.02, 0.02, 0.02, 0.05)]
            rows.append((line, r.choice(people[: 2 + line // 30]) if r.random() < 0.9 else None, r.choice(people), line // 3, r.choice(["", "U", "H", "C", "C", "S", "M", "B", "A"]) if r.random() < 0.7 else "", *flags))
        names, casts, handle = {}, {}, _Handle()
        state = live._Direction(stretch=1 + seed % 7)
        state.init(handle)
        for low, high in ((0, 120), (120, 121), (121, 300)):
            part = rows[low:high]
            want = _told_one_by_one(part, names, casts)
            r.shuffle(part)
            cols = dict(zip(["line_no", "src", "tgt", *live._TELLS], zip(*part)))
            kinds = {"line_no": pa.int64(), "src": pa.string(), "tgt": pa.string(), "_ts": pa.int64(), "_cat": pa.string()}
            table = pa.table({n: pa.array(v, kinds.get(n, pa.bool_())) for n, v in cols.items()})
            blocks = [live._block(table.slice(i, 50)) for i in range(0, len(part), 50)]
            found = [live._rows(b) for x in state.handleInputRows(("s",), iter([pd.DataFrame({"block": blocks})]), None) for b in x["block"]]
            got = [tuple(x[c] for c in ("line_no", *live._TOLD)) for t in found for x in t.to_pylist()]
            assert [x[0] for x in got] == [x[0] for x in part] and sorted(got, key=lambda x: x[0]) == want


def test_instances_of_blocks_as_one_by_one():
    """Touches, kills and parked mobs in micro-batches of many sizes, against one row at a time; a row without a time is no gap."""
    import pandas as pd
    import pyarrow as pa

    for seed in range(30):
        r = random.Random(seed)
        rows, ts = [], 0
        for line in range(200):
            ts += r.choice([0, 1, 5, 20])
            touch, slay = r.choice([(True, False), (True, False), (True, False), (False, True), (True, True)])
            rows.append((line, None if seed % 2 and r.random() < 0.2 else ts, touch, slay, touch and r.random() < 0.2))
        want, open_ = [], None
        for line, ts, touch, slay, park in rows:
            if slay and open_ is not None:
                open_ = (*open_[:3], True)
            if touch:
                idle = open_ is not None and None not in (ts, open_[1]) and ts - open_[1] >= 15
                new = open_ is None or open_[3] or (not open_[2] and idle)
                open_ = (line if new else open_[0], ts, park, False)
            want.append((line, open_[0] if open_ is not None else None))
        handle = _Handle()
        state, got = live._Instances(15, None), []
        state.init(handle)
        cuts = [0, 1, 2, 5, 60, 61, 200]
        for low, high in zip(cuts, cuts[1:]):
            part = rows[low:high]
            r.shuffle(part)
            kinds = {"line_no": pa.int64(), "ts": pa.int64(), "touch": pa.bool_(), "slay": pa.bool_(), "park": pa.bool_()}
            table = pa.table({n: pa.array(v, k) for (n, k), v in zip(kinds.items(), zip(*part))})
            blocks = [live._block(table.slice(i, 20)) for i in range(0, len(part), 20)]
            for x in state.handleInputRows(("s", "a rat"), iter([pd.DataFrame({"block": blocks})]), None):
                got += [(line, None if pd.isna(mob) else mob) for line, mob in zip(x["line_no"], x["mob"])]
        assert got == want and len({m for _, m in want}) > 10


def test_no_row_comes_alone_to_a_state(spark):
    """What is handed to Python state is blocks, one per key and task, that hold all rows in order."""
    rows = [("a" if i % 5 else None, i, [str(i)], {"x": i}) for i in range(3000)]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, words array<string>, more map<string, int>").coalesce(2)
    blocks = live.packed(df, ["stream_id"])
    assert blocks.count() <= 4
    assert sorted((x.stream_id or "", x.line_no, x.words, x.more) for x in live.unpacked(blocks, df.schema).collect()) == sorted((x[0] or "", *x[1:]) for x in rows)


def test_generated_code_is_short_enough_to_be_compiled(spark, capsys):
    """The JVM never compiles a method of over 8,000 bytes, so none of parsing or direction may be that long."""
    import re

    from pyspark.sql import functions as F

    lines = spark.createDataFrame([("s", "Own", 1, "x")], LINES)
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        events = parse_lines(lines, only=["off", *live._PARSED]).withColumns({"_ks": F.col("line_no"), "_kt": F.col("line_no"), "_e": F.col("line_no")})
        for df in (parse_lines(lines), C._directed(C._flags(events, "line_no"), events.columns, "line_no")):
            df.explain("codegen")
            assert 0 < max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
