"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import fresh, stage

WINDOW = 12
MISSES = 2
# The token places that each seed compares.  Whichever two tokens of a window of twelve are replaced, one of the
# two masks fits somewhere in the window without touching them (tested exhaustively).
SEEDS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
_REACH = WINDOW - 1
LEAST_CHARS = 12


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per token place and mask of ``rows`` (``words`` and ``keep``): ``hash``, ``at``, ``words``.

    Places too near the end for a mask hash fewer tokens than the others and are left out.
    """
    w = F.col("words")
    placed = rows.filter(F.size("words") >= WINDOW).select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    hashes = [F.when(F.col("at") + mask[-1] < F.size("words"), F.xxhash64(F.lit(n), *(F.get(w, F.col("at") + p) for p in mask))) for n, mask in enumerate(SEEDS)]
    return placed.select(*keep, "words", "at", F.explode(F.array(*hashes)).alias("hash")).filter("hash is not null")


def _around(words: Column, at: Column) -> Column:
    """The tokens within reach of a seed, as (tokens before ``at``, tokens)."""
    before = F.least(at, F.lit(_REACH))
    return F.struct(before.alias("before"), F.slice(words, at - before + 1, before + _REACH + 1).alias("part"))


def _fits(doc: str, item: str) -> Column:
    """The windows around a hit with at most ``MISSES`` differing tokens: structs (start, same), start relative to the hit."""
    return F.filter(
        F.transform(
            F.sequence(F.lit(-_REACH), F.lit(0)),
            lambda start: F.struct(
                start.alias("start"),
                F.aggregate(
                    F.sequence(start, start + F.lit(WINDOW - 1)), F.lit(0),
                    lambda n, k: n + F.when(
                        (F.col(f"{doc}.before") + k >= 0) & (F.col(f"{item}.before") + k >= 0)
                        & (F.get(F.col(f"{doc}.part"), F.col(f"{doc}.before") + k) == F.get(F.col(f"{item}.part"), F.col(f"{item}.before") + k)), 1).otherwise(0),
                ).alias("same"),
                (
                    (F.col(f"{doc}.before") + start >= 0) & (F.col(f"{item}.before") + start >= 0)
                    & (F.col(f"{doc}.before") + start + WINDOW <= F.size(F.col(f"{doc}.part")))
                    & (F.col(f"{item}.before") + start + WINDOW <= F.size(F.col(f"{item}.part")))
                ).alias("inside"),
            ),
        ),
        lambda x: x["inside"] & (x["same"] >= WINDOW - MISSES),
    )


def _whole(ids: DataFrame, items: DataFrame, least_chars: int, block_seeds: int) -> list[DataFrame]:
    """Overlaps (key, item, first, last, best) with items shorter than a window, found as a whole: one hash of the item against one of every run of as many tokens."""
    short = stage(items.filter((F.size("words") < WINDOW) & (F.length(F.array_join("words", "")) >= least_chars)).select("item", "words").distinct())
    lengths = [r[0] for r in short.groupBy(F.size("words")).count().orderBy(F.size("words")).collect()]
    if not lengths:
        return []
    blocks = max(1, -(-short.count() // block_seeds))
    seeds = short.select("item", F.col("words").alias("there"), F.xxhash64("words").alias("hash")).withColumn("block", F.pmod(F.xxhash64("item", "there"), F.lit(blocks)))
    w = F.col("words")
    placed = ids.filter(F.size(w) >= lengths[0]).select("key", "words", F.explode(F.sequence(F.lit(0), F.size(w) - 1)).alias("at"))
    runs = placed.select("key", "words", "at", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter(F.col("at") + F.col("n") <= F.size(w))
    hashed = runs.select("key", "at", "n", F.slice(w, F.col("at") + 1, F.col("n")).alias("here")).withColumn("hash", F.xxhash64("here"))
    found = []
    for block in range(blocks):
        hits = hashed.join(F.broadcast(seeds.filter(F.col("block") == block).drop("block")), "hash").filter("here = there")
        found.append(hits.groupBy("key", "item").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("n") - 1).alias("last"), F.max("n").alias("best")))
    return found


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_seeds: int = 1_000_000, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Overlaps of documents with benchmark items: one row (key, item_id, first_word, last_word, best).

    An overlap is ``WINDOW`` tokens in line of which at most ``MISSES`` differ.  ``first_word`` and ``last_word`` bound
    the overlapping windows in the document's tokens, from 0; ``best`` is the largest number of equal tokens in one.
    Documents and items are hashed at every token under every mask, joined on the hash and
    verified token by token around each hit, so the result is exact.

    The benchmark's seeds are taken in blocks of at most ``block_seeds`` rows; each is broadcast, its size
    bounded by that number, and joined with all documents while they stream by.  A small benchmark is one block.  Documents
    are never shuffled, only found overlaps are.

    An item of under ``WINDOW`` tokens overlaps where all its tokens stand in line, none replaced; ``best`` is their number.
    With under ``least_chars`` letters and digits in all it is too common to tell anything and overlaps nothing, as
    do null and empty items.  Texts that are null or empty overlap nothing.  Null keys and repeated keys are grouped as one
    document each; repeated items and ties are harmless.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("words"))
    seeds = stage(_seeded(items, ["item"]).select("hash", "item", _around(F.col("words"), F.col("at")).alias("there")))
    blocks = max(1, -(-seeds.count() // block_seeds))
    ids = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    # The hash of the seed spreads equal seeds together; numbering within the rows bounds a block whatever they hold.
    numbered = seeds if blocks == 1 else stage(seeds.withColumn("block", F.pmod(F.xxhash64("item", "there"), F.lit(blocks))))
    found = []
    for n in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.col("block") == n).drop("block")
        hits = _seeded(ids, ["key"]).join(F.broadcast(part), "hash").select("key", "item", "at", _around(F.col("words"), F.col("at")).alias("here"), "there")
        fits = hits.select("key", "item", "at", F.explode(_fits("here", "there")).alias("fit"))
        found.append(fits.groupBy("key", "item").agg(F.min(F.col("at") + F.col("fit.start")).alias("first"), F.max(F.col("at") + F.col("fit.start") + _REACH).alias("last"), F.max("fit.same").alias("best")))
    found += _whole(ids, items, least_chars, block_seeds)
    both = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        both = both.groupBy("key", "item").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("best").alias("best"))
    return both.select(F.col("key").alias(key), F.col("item").alias(item), F.col("first").alias("first_word"), F.col("last").alias("last_word"), "best")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows whose key has an overlap with the benchmark.

    Rows with a null key share their fate: one overlap among them removes them all.
    """
    (gone,) = fresh(docs, "gone")
    bad = find_overlaps(docs, benchmark, key, text, **names).select(F.col(key).alias(gone)).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col(gone)), "left_anti")
