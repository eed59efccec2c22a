import math
import re
from collections import Counter

from pyspark.sql import functions as F

from skirmish.llm import search
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    counted = [(d[0], Counter(terms(d[1]))) for d in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        want, scored = Counter(terms(text)), []
        for doc, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, total)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in want.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if none else doc, -s) for n, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, prose(30, 100)), (2, "the The THE of of"), (3, None), (4, ""), (5, "日本語 ÉTÉ x9"), (5, "it is"), (6, "nowhere"), (None, "was for")]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("rank", F.lit("x"))


def run(df, items, **kw):
    out = search.search(df, items, **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_against_brute_force(spark, make, odd):
    docs = odd + [(20 + i, prose(20 + 7 * i, i)) for i in range(60)] + [(90, "ÉTÉ été 日本語 X9 x9"), (91, "ÉTÉ 日本語")] + [(100 + i, "it is the same") for i in range(40)]
    assert run(make(docs, clash=True).repartition(5), items_of(spark, ITEMS), k=7) == brute(docs, ITEMS, 7)


def test_blocks_and_small_tables(spark, make, monkeypatch):
    """Items in several blocks and score tables of a few rows give the same."""
    docs = [(i, prose(40, i)) for i in range(50)]
    monkeypatch.setattr(search, "_CELLS", 16)
    assert run(make(docs), items_of(spark, ITEMS), k=5, block=20, block_items=2) == brute(docs, ITEMS, 5)


def test_empty_tables(spark, make):
    assert run(make([]), items_of(spark, ITEMS)) == []
    assert run(make([(1, "the")]), items_of(spark, [])) == []
    assert run(make([(1, None), (2, " ")]), items_of(spark, ITEMS)) == []
