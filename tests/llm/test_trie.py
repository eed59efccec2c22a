import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skirmish.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def lists(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32]))
        convs[c] = [(r, x) for _, _, r, x in turns]
    return convs


def regrafted(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = (convs.get(c - c % 5, [])[:h]) + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def got(spark, rows, regraft=False, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ["path", "key", "n", "t", "turns", "digest", "base", "h", "ends", "parent", "depth", "at", "shared"]:
            df = df.withColumn(c, F.lit("x"))
    seq = trie.turn_lists(df)
    seq = trie.regraft(seq) if regraft else seq
    out = trie.prefix_trie(seq)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def random_rows(seed, n, depth):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(0, depth)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", ""])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,depth", [(1, 60, 4), (2, 25, 9)])
def test_random(spark, seed, n, depth):
    rows = random_rows(seed, n, depth)
    assert got(spark, rows) == brute(lists(rows))


def test_regrafted(spark):
    rows = random_rows(3, 60, 6) + [(1003, t, "user", f"t{t}") for t in range(12)]
    assert got(spark, rows, regraft=True, clash=True) == brute(regrafted(lists(rows)))


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "", ""), (2, 0, None, "x"),
            (None, 0, "user", "lost"), (3, 1, "user", "b"), (3, 0, "user", "a"), (-4, 0, "user", "a"), (5, 0, "user", "long " * 50_000)]
    assert got(spark, rows) == brute(lists(rows))


def test_long_conversations_alone_and_together(spark):
    """Two that part after 40 of 130 turns, one alone with 90, short ones around."""
    rows = [(c, t, "user", f"t{t}" if t < 40 else f"{c} {t}") for c in (1, 2) for t in range(130)] + [(3, t, "user", f"t{t}" if t < 2 else f"own {t}") for t in range(90)]
    rows += [(4, t, "user", f"t{t}") for t in range(3)] + [(5, 0, "user", "t0")]
    assert got(spark, rows) == brute(lists(rows))


def test_many_ends_at_one_node(spark):
    """More ids than one block holds, out of order."""
    rows = [(c, 0, "user", "same") for c in range(3000, -3, -1)]
    assert got(spark, rows) == brute(lists(rows))


def test_empty_and_turnless(spark):
    assert got(spark, []) == []
    seq = spark.createDataFrame([(7, []), (3, [])], "conv_id long, turns array<struct<digest:string,bytes:long>>")
    assert [tuple(r) for r in trie.prefix_trie(seq).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
