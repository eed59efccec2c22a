"""Quality rules: base counts and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import fresh, small, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BUCKETS = 8192
MIN_SCORE = -0.25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _neighbors(a: Column, body: Callable[[Column, Column], Column], gap: int = 1) -> Column:
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), body)


def _halves(width: int) -> Callable[[Column], Column]:
    return lambda a: _neighbors(a, lambda x, y: F.xxhash64(x, y), width)


def windows(hashes: Column) -> Column:
    """A 64-bit hash of every run of ``WINDOW`` words, from the words' hashes: runs of one word are joined in pairs to runs of two, four and eight."""
    width = 1
    while width < WINDOW:
        hashes = _let(hashes, _halves(width))
        width *= 2
    return hashes


def repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes.

    Most texts repeat nothing, which a set size tells.  In the others sorted (hash, place) pairs bring equal windows together,
    and each repeated place covers words up to the next one, ``WINDOW`` at most.
    """
    places = lambda s: F.array_sort(F.array_distinct(F.flatten(_neighbors(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))
    covered = lambda p: F.aggregate(_neighbors(p, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda n, x: n + x)
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(pairs, places), covered)).otherwise(0).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def shapes(text: Column) -> Column:
    """A text with every run of capitals, other letters or digits as one sign, and runs of one mark as two."""
    # Small letters first: what is left is short.
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")
    out = F.regexp_replace(out, r"\p{Lu}{2,}", "^^")
    out = F.regexp_replace(out, r"\p{Lu}", "A")
    out = F.regexp_replace(out, r"\p{N}+", "0")
    return F.regexp_replace(out, r"([^\p{L}\p{N}\s])\1+", "$1$1")


def _bucket(n: int, first: int, *parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(n)) + first).cast("int")


def _log_ratio(hashes: Column, s: Column, weight: Column, buckets: int) -> Column:
    """The summed weights of a text's n-grams: its words (by their hashes) in the lower half of the buckets, pairs of neighboring word shapes in the upper."""
    half = buckets // 2
    of_words = F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(weight, F.pmod(h, F.lit(half)).cast("int")))
    pairs = _neighbors(s, lambda x, y: F.get(weight, _bucket(half, half, x, y)))
    return of_words + F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | all) per bucket, each half its own multinomial, add-one smoothed.

    Counts cover all ``docs`` and all of them whose key is in ``trusted``.  The driver gets one row per bucket.
    Without trusted documents every ratio is 0.
    """
    half = buckets // 2
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(small(trusted.select(F.col(key).alias("good")).distinct()), F.col("key") == F.col("good"), "left")
    grams = marked.select(F.col("good").isNotNull().cast("int").alias("good"), words(F.col("text")).alias("w"), words(shapes(F.col("text"))).alias("s"))
    # Words and shapes have the same places, and unrolled places keep the hashing in generated code.
    placed = grams.filter("size(w) > 0").select("good", "w", "s", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    at = lambda c, k: F.get(F.col(c), F.col("i") + k)
    pair = F.when(F.col("i") + 1 < F.size("s"), _bucket(half, half, at("s", 0), at("s", 1)))
    rows = placed.select("good", F.explode(F.array(_bucket(half, 0, at("w", 0)), pair)).alias("b")).filter("b is not null").groupBy("b").agg(F.count("*").alias("n"), F.sum("good").alias("t")).collect()
    n, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        n[r.b], t[r.b] = r.n, r.t
    if not t.any():
        return np.zeros(buckets)
    out = np.empty(buckets)
    for part in (slice(0, half), slice(half, buckets)):
        out[part] = [math.log((x + 1) / (t[part].sum() + half)) - math.log((y + 1) / (n[part].sum() + half)) for x, y in zip(t[part], n[part])]
    return out


def judge(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, buckets: int = BUCKETS) -> DataFrame:
    """Add the base counts, ``base_failed``, ``score`` and ``kept`` to every row of ``docs``.

    ``score`` is the mean log-likelihood ratio of the text's n-grams between the trusted documents (keys in ``trusted``)
    and the whole corpus; a text is kept when it passes the base rules and scores ``min_score`` or more.  Base rules
    fail texts under 20 words and texts of which over 30 % of the words stand in repeated 8-word windows.

    Null and empty texts have no words, fail and score 0.  Null keys are never trusted; repeated rows and keys are judged one
    by one.  Added columns replace those of the same name; others pass through.  Rows are never shuffled: the ratios,
    one number per bucket, travel to them.
    """
    weight = F.lit(ratios(docs, trusted, key, text, buckets))
    w, s, hashes, runs, total = fresh(docs, "w", "s", "hashes", "runs", "total")
    raw = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({w: words(F.col(text)), s: words(shapes(F.col(text)))})
    out = out.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(runs, windows(F.col(hashes)))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(raw, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": duplicate_lines(F.col(text)),
        "n_repeat_words": repeated_words(F.col(runs)),
        total: _log_ratio(F.col(hashes), F.col(s), weight, buckets),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "score": F.when(F.col("n_words") > 0, F.col(total) / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score)).drop(w, s, hashes, runs, total)
