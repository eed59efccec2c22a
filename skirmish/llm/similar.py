"""One document per group of near copies: Jaccard similarity of word shingles, found by MinHash bands and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import components, fresh, small, stage
from skirmish.llm.grams import chunks, flatten, word_hashes
from skirmish.llm.passages import SIMILARITY, _forest, _mix

WIDTH = 5
# At similarity 0.8 a pair is missed with probability (1 - 0.8**5) ** 24, about 7 in 100,000.
BANDS, ROWS = 24, 5
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of the runs of ``width`` words of every text; a shorter text is one run, an empty one has none."""
    flat = flatten(texts)
    words = word_hashes(flat)
    heads = np.cumsum(flat.lengths) - flat.lengths
    out = []
    for head, n in zip(heads, flat.lengths):
        w = words[head : head + n]
        k = min(width, n)
        code = w.copy()
        for j in range(1, k):
            code[: n - j] = _mix(code[: n - j]) + w[j:]
        out.append(np.unique(_mix(code[: n - k + 1] + np.uint64(k))) if n else code)
    return out


def _signed(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, band keys per text); equal sets have equal codes and bands."""
    codes, bands = np.zeros(len(sets), np.uint64), []
    for n, s in enumerate(sets):
        codes[n] = _mix(np.array([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            least = [_mix(s * np.uint64(int(_P) * (2 * (k * ROWS + r) + 1) % (1 << 64)) + np.uint64(k * ROWS + r)).min() if len(s) else np.uint64(0) for k in range(BANDS)]
            key = _mix(key * _Q + np.array(least, np.uint64))
        bands.append(key.view(np.int64))
    return codes.view(np.int64), bands


def _same(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_links(members: DataFrame, sets: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) that connect what pairs of ``SIMILARITY`` or more among ``members`` (band, code) of a band connect.

    First all members of a bucket are compared with its smallest.  Buckets whose members are then joined, a group of near copies
    say, are done; in the others all pairs are compared, in blocks of at most ``bucket`` members, so no group is gathered whole.
    """
    star = members.join(members.groupBy("band").agg(F.min("code").alias("a")), "band").filter("a <> code").select("a", F.col("code").alias("b")).distinct()
    pairs = star.join(sets.select(F.col("code").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("code").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [_same(np.asarray(x), np.asarray(y), SIMILARITY) for x, y in zip(b["x"], b["y"])]
            yield b.loc[good, ["a", "b"]]

    first = stage(pairs.mapInPandas(compare, "a long, b long"))
    placed = members.join(components(first), F.col("code") == F.col("node"), "left").select("band", "code", F.coalesce("root", "code").alias("root"))
    split = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band", F.ceil(F.col("n") / bucket).alias("blocks"))
    left = members.join(split, "band").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("x"), F.greatest(x, F.col("block")).alias("y")))
    dealt = left.select("band", "code", "block", F.explode(meet).alias("pair"))
    rows = dealt.join(sets, "code").groupBy("band", "pair").agg(F.sort_array(F.collect_list(F.struct("block", "code", "set"))).alias("members")).select("members")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for m in b["members"] for x in _forest([r["code"] for r in m], [np.asarray(r["set"]) for r in m], [r["block"] for r in m])]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return first.unionByName(rows.mapInPandas(verify, "a long, b long")).distinct()


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps one: the document with its smallest key.

    Near copies have a Jaccard similarity of ``SIMILARITY`` or more over runs of ``WIDTH`` words (lower-cased, split at blanks);
    groups are the components of such pairs.  Texts without words are one group.  Where rows repeat the smallest key (or a
    group has none) the one with the smallest text hash stays, then the least row.
    """
    of, nil, place = fresh(docs, "of", "nil", "place")
    none = F.lit("0").cast(docs.schema[key].dataType)
    keyed = docs.select("*", F.coalesce(F.col(key), none).alias(of), F.col(key).isNull().alias(nil), F.xxhash64(text).alias(place))
    row = keyed.select(F.col(of).alias("of"), F.col(nil).alias("nil"), F.col(place).alias("place"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for run in chunks(list(b["text"])):
                codes, bands = _signed(shingle_sets(run))
                yield b.iloc[at : at + len(run)][["of", "nil", "place"]].assign(code=codes, bands=bands)
                at += len(run)

    prints = stage(row.mapInPandas(sign, f"of {kind}, nil boolean, place long, code long, bands array<long>"))
    # Equal sets meet here, so copies cost one row; rows with a key come first.
    distinct = stage(prints.groupBy("code").agg(F.min(F.struct("nil", "of", "place")).alias("first"), F.min("bands").alias("bands")))
    spread = distinct.select("code", F.explode("bands").alias("band"))
    members = stage(spread.join(spread.groupBy("band").count().filter("count > 1").select("band"), "band"))
    wanted = distinct.join(members.select("code").distinct(), "code", "left_semi").select("code", "first.*")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for run in chunks(list(b["text"])):
                yield pd.DataFrame({"code": b["code"].to_numpy()[at : at + len(run)], "set": [s.view(np.int64) for s in shingle_sets(run)]})
                at += len(run)

    texts = row.join(small(wanted), ["of", "nil", "place"]).select("code", "text")
    sets = stage(texts.mapInPandas(spell, "code long, set array<long>").dropDuplicates(["code"]))
    roots = components(similar_links(members, sets, bucket))
    chosen = distinct.join(roots, F.col("code") == F.col("node"), "left").groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.of").alias(of), F.col("first.nil").alias(nil), F.col("first.place").alias(place))
    return keyed.join(chosen, [of, nil, place]).groupBy(of, nil, place).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
