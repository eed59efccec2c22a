import math
import re
from collections import Counter

import pytest
import xxhash
from conftest import prose
from skirmish.llm import loglik

B = 256


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    w = words(t)
    n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {x for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def shaped(t):
    out = "".join("^" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c for c in t or "")
    out = re.sub(r"\^{2,}", "^^", out)
    out = re.sub(r"a+", "a", re.sub(r"0+", "0", re.sub(r"(?<!\^)\^(?!\^)", "A", out)))
    return words(re.sub(r"([^a-zA0\s])\1+", r"\1\1", out))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(t):
    h = lambda *x: _chain(x) % (B // 2)
    s = shaped(t)
    return [h(x) for x in words(t)] + [B // 2 + h(a, b) for a, b in zip(s, s[1:])]


def _chain(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return signed(seed)


def brute(rows, good, min_score):
    n, t = Counter(), Counter()
    for i, x, *_ in rows:
        n.update(grams(x))
        if i in good:
            t.update(grams(x))
    out = []
    total = lambda c, lo: sum(v for k, v in c.items() if lo <= k < lo + B // 2) + B // 2
    weight = {b: math.log((t[b] + 1) / total(t, b // (B // 2) * (B // 2))) - math.log((n[b] + 1) / total(n, b // (B // 2) * (B // 2))) for b in range(B)}
    for i, x, *_ in rows:
        c = counts(x)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        score = sum(weight[g] for g in grams(x)) / (2 * c[0] - 1) if c[0] else 0.0
        out.append((i, *c, failed, score, not failed and score >= min_score))
    return out


def test_matches_brute_force(spark, make, odd):
    junk = [(200 + k, " ".join(w.upper() + "!!" for w in prose(40, k).split())) for k in range(6)] + [(210, "a b c d e f g h i " * 9), (211, "line one here\n" * 3 + prose(30, 2)), (212, "| # $ 12 " * 12)]
    rows = [(300 + k, prose(50, k)) for k in range(20)] + junk + odd
    good = {*range(300, 315), 1, 7}
    trusted = spark.createDataFrame([(g,) for g in good] + [(300,), (None,)], "doc_id long")
    got = loglik.judge(make(rows), trusted, min_score=-0.2, buckets=B).collect()
    key = lambda x: str(x[:6])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.score, r.kept) for r in got), key=key)
    want = sorted(brute(rows, good, -0.2), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and g[7] == pytest.approx(w[7], abs=1e-9) and g[8] == w[8]
    assert {r[0] for r in want if r[8]} >= set(range(300, 320)) and not {r[0] for r in want if r[8]} & set(range(200, 206))


def test_empty_and_clashing(spark, make):
    none = spark.createDataFrame([], "doc_id long")
    assert loglik.judge(make([]), none).count() == 0
    df = make([(1, prose(30, 1)), (2, None)], clash=True)
    out = loglik.judge(df, none)
    assert set(out.columns) == set(df.columns) | {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"}
    assert [(r.doc_id, r.kept, r.score, r.w) for r in out.orderBy("doc_id").collect()] == [(1, True, 0.0, "x"), (2, False, 0.0, "x")]


def test_generated_code_gives_the_same(spark, make):
    rows = [(k, prose(60, k) + " " + prose(20, 3) * 2) for k in range(8)]
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id long")
    plain = sorted(map(str, loglik.judge(make(rows), trusted).collect()))
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        assert sorted(map(str, loglik.judge(make(rows), trusted).collect())) == plain
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
