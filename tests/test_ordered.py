import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators.ordered import Carry, as_of, ranked, scan, segment


def rows_for(seed, n=200):
    r = random.Random(seed)
    return [(r.choice("ab"), i * 3 + r.randint(0, 2), r.choice([None, r.randint(0, 50)]), r.random() < 0.2) for i in range(n)]


@pytest.mark.parametrize("span", [1, 7, 50, 10_000])
def test_scan_matches_a_loop(spark, span):
    data = rows_for(1)
    df = spark.createDataFrame(data, "k string, o long, v long, b boolean").repartition(5)
    got = {(r.k, r.o): r for r in scan(df, ["k"], "o", [
        Carry("last", "last", F.col("v")), Carry("before", "last", F.col("v"), inclusive=False), Carry("next", "next", F.col("v")),
        Carry("sum", "sum", F.col("v")), Carry("max", "max", F.col("v"), inclusive=False), Carry("min", "min", F.col("v"))], span).collect()}
    assert len(got) == len(data)
    for k in "ab":
        seq = [d for d in data if d[0] == k]
        for i, (_, o, v, _b) in enumerate(seq):
            past = [x[2] for x in seq[:i] if x[2] is not None]
            upto = past + ([v] if v is not None else [])
            rest = [x[2] for x in seq[i + 1:] if x[2] is not None]
            g = got[(k, o)]
            assert (g["last"], g["before"], g["next"]) == (upto[-1] if upto else None, past[-1] if past else None, rest[0] if rest else None)
            assert (g["sum"], g["max"], g["min"]) == (sum(upto) if upto else None, max(past) if past else None, min(upto) if upto else None)


@pytest.mark.parametrize("span", [1, 7, 50, 10_000])
def test_segment_matches_a_loop(spark, span):
    data = rows_for(2)
    df = spark.createDataFrame(data, "k string, o long, v long, b boolean").repartition(5)
    out = segment(df, ["k"], "o", F.struct(F.col("v")), lambda p, c: c["v"] - p["v"] > 20, member=F.col("v").isNotNull(), breaker=F.col("b"), span=span)
    got = {(r.k, r.o): (r.seg_start, r.seg_num) for r in out.collect()}
    for k in "ab":
        start, num, last, broken = None, 0, None, False
        for _, o, v, b in [d for d in data if d[0] == k]:
            if v is not None:
                if last is None or v - last > 20 or broken:
                    start, num = o, num + 1
                last, broken = v, False
            broken = broken or b
            assert got[(k, o)] == (start, num)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    left = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 3)], "k string, o long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, r long, v string")
    got = {(r.k, r.o): r.v for r in as_of(left, right, ["k"], "o", "r", "v", F.col("v"), span=3, strict=strict).collect()}
    off = 1 if strict else 0
    for o in range(10):
        assert got[("a", o)] == ("y" if o >= 5 + off else "x" if o >= 2 + off else None)
    assert got[("b", 3)] is None


def test_ranked_pushes_the_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = ranked(df, ["k"], [F.col("id").desc()], 2)
    assert out.count() == 6
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split(spark):
    """A scan over one key runs in as many tasks as it has chunks."""
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    out = scan(df, ["k"], "o", [Carry("n", "sum", F.lit(1).cast("long"))], 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning" in x and "_chunk" in x for x in plan.splitlines())
    assert out.agg(F.max("n")).first()[0] == 10_000


def test_totals_of_overlapping_scopes_equal_rows_met(spark):
    """Sums and counts of overlapping, empty, null and endless windows, without any row meeting a window."""
    from skirmish.operators import sessions as S

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice([None, *range(-40, 40)]), r.choice([None, -3, 5, 7])) for _ in range(300)] + [("c", 3, 9), ("d", 1, None), *[("a", -41, 2**62)] * 3]
    scopes = [(r.choice("abc"), i // 2, a, r.choice([None, a, a + r.randrange(-3, 50)])) for i in range(120) for a in [r.randrange(-45, 45)]] + [("a", 500, None, 9), ("d", 501, 0, 5)]
    ev = spark.createDataFrame(rows, "stream_id string, ts long, dmg long")
    sc = spark.createDataFrame(scopes, "stream_id string, raid long, start_ts long, end_ts long")
    want: dict = {}
    for s, raid, a, b in scopes:
        for s2, t, d in rows:
            if s == s2 and None not in (t, a) and t >= a and (b is None or t < b):
                want.setdefault((s, raid), []).append(d)
    want = {k: (len(v), sum(x for x in v if x is not None) if any(x is not None for x in v) else None) for k, v in want.items()}
    want = {k: v for k, v in want.items() if v[1] is None or abs(v[1]) < 2**63}
    keep = spark.createDataFrame(list(want), "stream_id string, raid long")
    got = S.scope_totals(ev, sc.join(keep, ["stream_id", "raid"], "left_semi"), "dmg", span=7, scope="raid").collect()
    assert {(x.stream_id, x.raid): (x.rows, x.total) for x in got} == want and len(got) == len(want) > 30


@pytest.mark.parametrize("seed", [1, 2])
def test_one_window_equals_chunks(spark, seed):
    """Without a span a sequence is one window, with the results of chunks; the span is kept where a key has more rows."""
    from skirmish.operators.ordered import span_for

    df = spark.createDataFrame(rows_for(seed), "k string, pos long, v long, flag boolean")
    carries = [Carry("l", "last", F.col("v")), Carry("p", "last", F.col("v"), inclusive=False), Carry("n", "next", F.col("v")), Carry("s", "sum", F.col("v"), inclusive=False), Carry("m", "max", F.col("v"))]
    seg = lambda d, span: segment(d, ["k"], "pos", F.struct("v"), lambda a, b: b["v"] - a["v"] > 20, member=F.col("v").isNotNull(), breaker=F.col("flag"), span=span)
    for f in (lambda s: scan(df, ["k"], "pos", carries, s), lambda s: seg(df, s), lambda s: as_of(df, df.filter("flag"), ["k"], "pos", "pos", "at", F.col("v"), s)):
        assert sorted(map(str, f(None).collect())) == sorted(map(str, f(16).collect()))
    most = max(r["count"] for r in df.groupBy("k").count().collect())
    assert span_for(df, ["k"], 16, most) is None and span_for(df, ["k"], 16, most - 1) == 16


def test_stage_and_store_leave_no_shuffle_files(spark):
    import time

    from skirmish.operators.ordered import stage, store

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "/shuffle_" in f}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(setting)
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    for keep in (stage, store):
        before = shuffles()
        kept = keep(rows)
        end = time.time() + 10
        while shuffles() - before and time.time() < end:
            time.sleep(0.2)
        assert not shuffles() - before
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get(setting) == asked
