"""SimHash near-duplicates found with distance tables to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import components, fresh, stage

# The references: zero, the 32 pairs of neighboring bits, and some fixed pseudorandom fingerprints.
_PAIRS = [3 << (2 * j) for j in range(32)]
_RANDOM = [xxhash.xxh64_intdigest(f"reference {n}") for n in range(16)]
REFERENCES = np.array([0, *_PAIRS, *_RANDOM], np.uint64)
_EVEN = 0x5555
MAX_BITS = 2


def _shingle_bits(text: str | None, width: int, seed: int) -> int:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    parts = map(b" ".join, zip(*(tokens[k:] for k in range(width)))) if len(tokens) >= width else [b" ".join(tokens)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text over shingles of ``width`` words, A-Z lower-cased, as a long; zero without words."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_bits(t, width, seed) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _close_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket within ``MAX_BITS``: the table discards, the fingerprints verify."""
    table = distance_table(fps)
    left, right = [], []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= MAX_BITS)
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= MAX_BITS]
        left.append(np.full(len(near), i))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the close pairs of a bucket connect, fewer than it has members."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*_close_pairs(fps)):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def close_links(fps: DataFrame, max_bucket: int = 1024) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` joined by steps of 2 bits or fewer.

    The distances to zero and to a pair of neighboring bits give the number of ones in that pair: 32
    coordinates, of which at most two differ between fingerprints within two bits.  Of four groups of eight coordinates two
    agree, so joining on any two groups (six keys) misses nothing.  Inside a bucket pairs whose tables
    differ by more than two in any coordinate are discarded and the rest verified; a bucket yields a forest, not its
    pairs.  Buckets over ``max_bucket`` members go another exact way: two fingerprints are within two
    bits just when both are within one bit of a third, so each is listed under its 65 near ones, where at most 65 meet.
    """
    bits = [F.shiftrightunsigned("fp", 16 * g).bitwiseAND(F.lit(0xFFFF)) for g in range(4)]
    groups = [x.bitwiseAND(F.lit(_EVEN)) + F.shiftright(x, 1).bitwiseAND(F.lit(_EVEN)) for x in bits]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(groups[x], 16)).bitwiseOR(groups[y]) for n, (x, y) in enumerate(combinations(range(4), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    members = stage(keyed.join(sizes, "key"))
    buckets = members.filter(F.col("count") <= max_bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(x[i], x[j]) for x in b["fps"] for i, j in _forest(np.asarray(x, np.int64).view(np.uint64))]
            yield pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    def signed(b: int) -> int:
        return (1 << b) - (1 << 64 if b == 63 else 0)

    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(b))) for b in range(64)))
    stars = (
        members.filter(F.col("count") > max_bucket).select("fp").distinct().select("fp", F.explode(near).alias("z"))
        .groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("a", F.explode("fps").alias("b")).filter("a <> b")
    )
    return buckets.mapInPandas(link, "a long, b long").unionByName(stars).distinct()


def near_classes(prints: DataFrame, key: str = "doc_id", max_bucket: int = 1024) -> DataFrame:
    """One row (fp, root, component_id) per distinct fingerprint of ``prints`` (key, fp), given stored.

    ``root`` is the smallest fingerprint of the class and ``component_id`` the smallest key reachable over links of two bits
    or fewer.  Equal fingerprints meet in an aggregate first, so copies cost one row.  A class whose keys are all null
    has a null id.
    """
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(close_links(least.select("fp"), max_bucket))
    placed = stage(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, max_bucket: int = 1024) -> DataFrame:
    """Give every row of ``docs`` (key and any columns) its ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts have fingerprint zero and link like others.  Keys may be null or repeat; nulls never name a
    class unless it has no other key.  Columns named ``fingerprint`` or ``component_id`` are replaced; all
    other columns but the text pass through.
    """
    keep = [c for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    fp, root = fresh(docs, "fp", "root")
    prints = stage(docs.withColumn(fp, fingerprint(F.col(text), width, seed)).select(*keep, fp))
    classes = near_classes(prints.select(key, F.col(fp).alias("fp")), key, max_bucket).withColumnsRenamed({"fp": fp, "root": root})
    hexed = F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")
    return prints.join(classes, fp).select(*keep, hexed, "component_id")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, max_bucket: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one: the document with its smallest key.

    Where rows repeat that key (or the class has none) the one with the smallest text hash stays, then the least row.
    Texts are read twice and shuffled once, for the rows that stay.
    """
    prints = stage(docs.select(key, F.xxhash64(text).alias("place"), fingerprint(F.col(text), width, seed).alias("fp")))
    classes = near_classes(prints, key, max_bucket)
    chosen = prints.join(classes, "fp").filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("place", key)).alias("first"))
    # Grouping by the join's own keys and the class needs no other shuffle of the texts.
    root, of, nil, place = fresh(docs, "root", "of", "nil", "place")
    none = F.lit("0").cast(docs.schema[key].dataType)
    by = lambda k, p: [F.coalesce(k, none).alias(of), k.isNull().alias(nil), p.alias(place)]
    chosen = chosen.select(F.col("root").alias(root), *by(F.col(f"first.{key}"), F.col("first.place")))
    kept = docs.select("*", *by(F.col(key), F.xxhash64(text))).join(chosen, [of, nil, place])
    return kept.groupBy(of, nil, place, root).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
