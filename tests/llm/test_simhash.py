import random
import re

import numpy as np
import xxhash
from conftest import prose
from skirmish.llm import base, simhash


def fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def classes(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def brute(rows):
    prints = [fp(r[1]) for r in rows]
    groups = classes(prints)
    least = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, groups)), key=str)


def test_same_hash_as_sql(spark):
    text = "Ünï code words 日本"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_matches_brute_force(make, odd):
    rows = [r for r in odd if r[0] != 7] + [(30 + i, " ".join([*prose(300, 3).split()[:-1], f"end{i}"])) for i in range(25)] + [(60, "One TWO"), (61, "one two"), (62, "one")]
    out = simhash.near_duplicates(make(rows))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()), key=str) == brute(rows)


def links_of(spark, values, **kw):
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    df = spark.createDataFrame(signed, "fp long").distinct()
    roots = {r.node: r.root for r in base.components(simhash.close_links(base.stage(df), **kw)).collect()}
    return [roots.get(v[0], v[0]) for v in signed]


def test_links_are_complete_in_buckets_and_beyond_their_limit(spark):
    r = random.Random(4)
    centers = [r.getrandbits(64) for _ in range(4)]
    values = list({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centers for _ in range(60)} | {r.getrandbits(64) for _ in range(100)} | {0, 3 << 62, (1 << 64) - 1})
    want = classes(values)
    for limit in (1024, 8, 1):
        got = links_of(spark, values, max_bucket=limit)
        pair = {}
        assert all(pair.setdefault(a, b) == b for a, b in zip(want, got)) and len(set(want)) == len(set(got))


def test_table_never_discards_a_close_pair():
    r = random.Random(1)
    for _ in range(200):
        x = r.getrandbits(64)
        y = x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        t = simhash.distance_table(np.array([x, y], np.uint64))
        assert np.abs(t[0] - t[1]).max() <= 2


def test_long_chain_of_links(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in base.components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[501] == 500


def test_one_per_class(make, odd):
    rows = odd + [(40, prose(60, 5)), (41, "other words here " + prose(90, 9))]
    df = make(rows)
    kept = simhash.one_per_class(df).collect()
    assert sorted(kept[0].asDict()) == sorted(df.columns)
    want = {(i, c) for i, _, c in brute(rows)}
    ids = [r.doc_id for r in kept]
    assert sorted(x for x in ids if x is not None) == sorted({c for _, c in want if c is not None})
    assert len(kept) == len(set(classes([fp(r[1]) for r in rows])))


def test_empty_and_clashing(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.one_per_class(make([])).count() == 0
    rows = [(1, "a b c d"), (2, "A B C D"), (3, None)]
    out = simhash.near_duplicates(make(rows, clash=True))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)] and {r.fp for r in out.collect()} == {"x"}
    assert sorted(r.doc_id for r in simhash.one_per_class(make(rows, clash=True)).collect()) == [1, 3]
