import re

import pytest
from conftest import prose
from pyspark.sql import functions as F
from skirmish.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    stopped = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        of = sum(weight[s] for s in names if s not in stopped)
        t = {s: 2 * sizes[s] if s in stopped else left * weight[s] / of for s in names}
        new = {s for s in names if s not in stopped and t[s] > 2 * sizes[s]}
        if not new:
            return t
        stopped |= new


@pytest.fixture(scope="module")
def rows(odd):
    out = [(100 + k, prose(20 + k * 7 % 90, k), "en", ["a", "b", "Z", "é", "z", "hot", "hot", "hot"][k % 8]) for k in range(160)]
    return out + odd + [(400, prose(900, 400), "en", "tiny"), (401, None, "en", "empty")]


def test_contract(make, rows):
    mix = mixing.plan_mix(make(rows), block_words=16, shard_slots=64)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    assert sorted((r.key, r.size) for r in got if r.key is not None) == sorted((r[0], size(r[1])) for r in rows if r[0] is not None)
    sizes, taken = {}, {}
    for r in rows:
        s = r[3] if len(r) > 3 else "web"
        sizes[s] = sizes.get(s, 0) + size(r[1])
    want = targets(sizes)
    by = {s.sid: s for s in mix.sources.collect()}
    assert {s.source: s.target for s in by.values()} == pytest.approx(want)
    for r in mix.taken().join(mix.docs.select("row", "sid"), "row").collect():
        assert r.taken <= 2 * r.size and r.target == pytest.approx(want[by[r.sid].source]) and r.source_size == sizes[by[r.sid].source]
        taken[by[r.sid].source] = taken.get(by[r.sid].source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 16 for s in want)


def test_reruns_and_partitions_agree(make, rows):
    runs = [sorted(map(str, mixing.plan_mix(make(rows).repartition(n), block_words=16, shard_slots=64).taken().drop("row").collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_shards_are_multinomial_draws(make, rows):
    mix = mixing.plan_mix(make(rows), block_words=4, shard_slots=64)
    slots = mix.slots.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.max("place").alias("m"), F.count_distinct("sid").alias("k")).orderBy("shard").collect()
    assert all(r.n == r.d == r.m + 1 and r.n <= 64 for r in slots) and all(r.n == 64 for r in slots[:-1]) and max(r.k for r in slots) > 4
    share = {r.sid: r.quota for r in mix.sources.collect()}
    one = {r.sid: r.n for r in mix.slots.filter("shard < 8").groupBy("sid").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    for s, q in share.items():
        p = q / total
        assert abs(one.get(s, 0) - 512 * p) <= 5 * (512 * p * (1 - p)) ** 0.5 + 1
    uses = mix.slots.groupBy("sid", "block").agg(F.count("*").alias("n"))
    assert uses.agg(F.max("n")).first()[0] <= 2


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 3).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(257))


def test_blocks_hold_what_the_plan_counts(make, rows):
    docs = make(rows)
    mix = mixing.plan_mix(docs, block_words=16, shard_slots=64)
    blocks = mixing.mixed_blocks(docs, mix).collect()
    assert len(blocks) == mix.slots.count() == len({(b.shard, b.place) for b in blocks})
    assert all(size(b.text) == b.n_words <= 16 for b in blocks)
    assert sum(b.n_words for b in blocks) == mix.taken().agg(F.sum("taken")).first()[0]
    texts = {r[0]: set((r[1] or "").split()) for r in rows if r[0] is not None}
    assert all(set(b.text.split()) <= set().union(*(texts.get(d, set()) for d in b.doc_ids)) for b in blocks if None not in b.doc_ids)


def test_empty_and_clashing(make, rows):
    assert mixing.plan_mix(make([])).taken().count() == 0
    only = mixing.plan_mix(make([(1, None), (2, "")]))
    assert [(r.key, r.size, r.taken) for r in only.taken().orderBy("key").collect()] == [(1, 0, 0), (2, 0, 0)]
    df = make(rows, clash=True)
    mix = mixing.plan_mix(df, block_words=16)
    assert mix.taken().count() == len(rows) and mixing.mixed_blocks(df, mix).count() == mix.slots.count()
