import re
from itertools import combinations

from conftest import prose
from skirmish.llm import decontam
from skirmish.llm.decontam import MISSES, SEEDS, WINDOW


def tok(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for i, t, *_ in docs:
        d = tok(t)
        for j, u in items:
            b = tok(u)
            if len(b) < WINDOW and len("".join(b)) >= 12:
                for s in range(len(d) - len(b) + 1):
                    if d[s : s + len(b)] == b:
                        f, la, best = out.get((i, j), (s, s - WINDOW + len(b), len(b)))
                        out[i, j] = (min(f, s), max(la, s - WINDOW + len(b)), max(best, len(b)))
            for s in range(len(d) - WINDOW + 1):
                for q in range(len(b) - WINDOW + 1):
                    n = sum(x == y for x, y in zip(d[s : s + WINDOW], b[q : q + WINDOW]))
                    if n >= WINDOW - MISSES:
                        f, la, best = out.get((i, j), (s, s, n))
                        out[i, j] = (min(f, s), max(la, s), max(best, n))
    return sorted(((i, j, f, la + WINDOW - 1, n) for (i, j), (f, la, n) in out.items()), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.item_id, r.first_word, r.last_word, r.best) for r in df.collect()), key=str)


def test_seeds_catch_any_two_replacements():
    for lost in combinations(range(WINDOW), MISSES):
        assert any(all(o + p not in lost for p in mask) for mask in SEEDS for o in range(WINDOW - mask[-1]))


def cases():
    item = prose(30, 100)
    w = item.split()
    edit = lambda *at: " ".join("zzz" if k in at else x for k, x in enumerate(w))
    docs = [
        (1, prose(60, 1) + " " + item + " " + prose(20, 2)), (2, edit(3, 9, 15, 21, 27)), (3, edit(*range(0, 30, 4))), (4, prose(300, 3)), (5, " ".join(w[:12])), (6, " ".join(w[:11])),
        (7, " ".join(w[5:17]).upper().replace(" ", " -- ")), (8, None), (9, ""), (None, item), (10, item), (10, item), (11, edit(2, 5)), (12, "the " * 40),
    ]
    return docs, [(0, item), (1, prose(14, 101)), (2, None), (3, "short one"), (4, item), (5, "the " * 13), (None, prose(20, 102))]


def test_short_items_are_found_whole(spark, make):
    six = "Name the tallest mountain on Earth"
    docs = [(1, prose(40, 1) + " " + six.lower() + ", " + prose(40, 2)), (2, six.replace("tallest", "oldest")), (3, six), (4, six + " " + six), (5, "我们的世界很大而且非常美丽，其他"), (6, "the end of it"), (7, None), (8, ""), (None, six)]
    items = [(1, six), (2, "我们的世界很大而且非常美丽"), (3, "the end"), (4, ""), (5, None), (6, six), (7, prose(30, 9)), (8, "tallest mountain on Earth")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.find_overlaps(make(docs), bench))
    assert got == brute(docs, items) and (1, 1, 40, 45, 6) in got and (4, 6, 0, 11, 6) in got and (5, 2, 0, 0, 1) in got
    assert {r[1] for r in got} == {1, 2, 6, 8} and {r[0] for r in got} == {1, 3, 4, 5, None, 2} - {2}
    assert rows_of(decontam.find_overlaps(make(docs), bench, block_seeds=1)) == got
    assert sorted(r.doc_id for r in decontam.decontaminate(make(docs), bench).collect()) == [2, 6, 7, 8]


def test_matches_brute_force(spark, make):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {r[0] for r in want} >= {1, 2, 5, 7, 10, 11, 12, None} and not {r[0] for r in want} & {3, 4, 6}
    assert rows_of(decontam.find_overlaps(make(docs), bench)) == want
    assert rows_of(decontam.find_overlaps(make(docs), bench, block_seeds=20)) == want


def test_filter_keeps_clean_rows(spark, make, odd):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.decontaminate(make(docs + [(100 + k, *r[1:]) for k, r in enumerate(odd)], clash=True), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([3, 4, 6, 8, 9] + [100 + k for k in range(len(odd))])


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_overlaps(make([(1, prose(40, 1))]), none).count() == 0
    assert decontam.decontaminate(make([(1, prose(40, 1))]), none).count() == 1
    assert decontam.find_overlaps(make([]), spark.createDataFrame([(1, prose(40, 1))], "item_id long, text string")).count() == 0


def test_plan_never_shuffles_documents(spark, make):
    docs, items = cases()
    plan = decontam.find_overlaps(make(docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
