import random

from pyspark.sql import functions as F

from skirmish.operators import sessions as S
from skirmish.sources import batches as B
from skirmish.sources import positions as P

EVENT = "stream_id string, line_no long, ts long, k string"


def test_seek_opens_few_files(spark, tmp_path):
    """Parts in any order, times that step back; the index grows with the store and chooses the files."""
    store, index = str(tmp_path / "store"), str(tmp_path / "index")
    r = random.Random(3)
    rows = [(s, i, 86_000 + i + (r.randint(-40, 40) if s == "b" else 0), "melee") for s in "abc" for i in range(400)]
    parts = [[x for x in rows if x[1] // 20 % 20 == n] for n in r.sample(range(20), 20)]
    for n, part in enumerate(parts):
        B.write_events(spark.createDataFrame(part, EVENT), store)
        if n % 5 == 4:
            assert P.update_index(spark, store, index) > 0
    assert P.update_index(spark, store, index) == 0
    entries = spark.read.parquet(index)
    total = entries.select("file").distinct().count()
    assert entries.agg(F.sum("rows")).first()[0] == 1200 and total >= 60
    for id, ts in ((137, None), (None, 86_137), (None, 86_000), (250, 86_300), (399, None), (0, 90_000)):
        want = {}
        for s, i, t, _ in rows:
            if (id is None or i >= id) and (ts is None or t >= ts) and i <= want.get(s, (10**9,))[0]:
                want[s] = (i, t)
        assert {x.stream_id: (x.position, x.ts) for x in P.seek(spark, store, index, id, ts).collect()} == want
    for at in ({"id": 137}, {"ts": 86_137}):
        files = P._holding(entries, at.get("id"), at.get("ts")).count()
        assert files <= 15 < total
    got = P.read_range(spark, store, index, from_id=100, to_id=120, from_ts=86_100)
    assert len(got.inputFiles()) <= 15
    assert sorted((x.stream_id, x.line_no) for x in got.collect()) == sorted((s, i) for s, i, t, _ in rows if 100 <= i <= 120 and t >= 86_100)
    assert P.read_range(spark, store, index, from_id=10**6).count() == 0 and P.seek(spark, store, index, id=10**6, streams=["a"]).count() == 0


def test_all_scopes_against_all_pairs(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice([None, r.randint(-50, 5000)]), i) for i in range(300)]
    windows = [(r.choice("abc"), a, r.choice([None, a, a - 3, a + 1, a + r.randint(1, 9), a + r.randint(1, 4000), a + 1024]), i) for i in range(60) for a in [r.randint(-100, 5000)]]
    windows += [("a", None, 5, 98), ("a", None, None, 99)]
    want = sorted((k, t, i, n) for k, t, i in rows if t is not None for s, a, b, n in windows if s == k and a is not None and a <= t and (b is None or t < b))
    left = spark.createDataFrame(rows, "stream_id string, ts long, i int")
    right = spark.createDataFrame(windows, "stream_id string, start_ts long, end_ts long, segment int")
    got = S.all_scopes(left, right).select("stream_id", "ts", "i", "segment")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert S.all_scopes(left, right.limit(0)).count() == 0 and S.all_scopes(left.limit(0), right).count() == 0
