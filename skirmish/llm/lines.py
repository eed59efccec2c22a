"""Line deduplication with two Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.base import BLANKS, fresh, stage

_SEGMENT = 1 << 16
# Copies of each repeated key in the join with its holders, so that a line of very many documents meets in many tasks.
_SALTS = 8
_STRIP = BLANKS.encode()


def _keys(text: str | None) -> list[bytes]:
    return [x.strip(_STRIP).lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _eligible(text: str | None, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough, in code points."""
    return {k for k in _keys(text) if len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars}


def _places(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """Two bit positions per hash."""
    mask = np.uint64((1 << log2_bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(64 - log2_bits)) & mask])


def repeated_filter(texts: DataFrame, min_chars: int, log2_bits: int) -> np.ndarray:
    """The filter of the keys seen at least twice, as ``2**log2_bits`` packed bits.

    Each task fills its own pair of filters, once seen and twice seen, and sends the set bits, two
    bytes each, by segment.  Merging keeps a bit as twice seen when one task had it so or
    when two tasks had it once: no repeated key is missed.  Merging streams, holding the segments of
    one partition only; the driver gets the one filter, whose size is the parameter.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.fromiter((xxhash.xxh64_intdigest(k) for t in b["text"] for k in _eligible(t, min_chars)), np.uint64) for b in batches]
        hashes, seen = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        once, twice = np.unique(_places(hashes, log2_bits)), np.unique(_places(hashes[seen > 1], log2_bits))
        segments = once >> np.uint64(16)
        names, starts = np.unique(segments, return_index=True)
        cut = np.searchsorted(twice >> np.uint64(16), names), np.searchsorted(twice >> np.uint64(16), names, "right")
        low = [(x & np.uint64(_SEGMENT - 1)).astype(np.uint16) for x in (once, twice)]
        ends = np.append(starts[1:], len(once))
        yield pd.DataFrame({
            "segment": names.astype(np.int64),
            "once": [low[0][i:j].tobytes() for i, j in zip(starts, ends)],
            "twice": [low[1][i:j].tobytes() for i, j in zip(*cut)],
        })

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, once, twice in zip(b["segment"], b["once"], b["twice"]):
                bits = have.setdefault(segment, np.zeros((2, _SEGMENT), bool))
                at = np.frombuffer(once, np.uint16)
                bits[1, at[bits[0, at]]] = True
                bits[0, at] = True
                bits[1, np.frombuffer(twice, np.uint16)] = True
        rows = [(s, np.packbits(x[1]).tobytes()) for s, x in have.items() if x[1].any()]
        yield pd.DataFrame(rows, columns=["segment", "bits"]).astype({"segment": np.int64})

    parts = texts.mapInPandas(fill, "segment long, once binary, twice binary").repartition("segment").mapInPandas(merge, "segment long, bits binary")
    out = np.zeros((1 << log2_bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row.segment * (_SEGMENT // 8) : (row.segment + 1) * (_SEGMENT // 8)] = np.frombuffer(row.bits, np.uint8)
    return out


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, log2_bits: int = 28, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop lines that many documents hold, but for the document with the largest ``key``.

    A line's key is the line without blanks at both ends and with A-Z lower-cased.  Keys of ``min_chars`` code
    points found in ``min_docs`` (two or more) distinct documents lose their lines everywhere else.  ``docs``
    returns with ``text`` rewritten and with ``n_lines``, ``n_dropped`` (long).  The twice-seen filter has
    ``2**log2_bits`` bits (32 MB by default) and is the only thing broadcast.  Only lines it suspects are
    shuffled and counted by their exact key, so a full filter costs shuffle, never results.

    A null or empty text is one empty line and stays as it is.  Rows with a null key never count as holders and
    never keep a repeated line.  Rows that repeat a key are one document.  Columns named ``n_lines`` or ``n_dropped``
    are replaced; other columns pass through.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeated_filter(docs.select(F.col(text).alias("text")), min_chars, log2_bits))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b["id"], b["text"]):
                found = list(_eligible(t, min_chars))
                at = _places(np.fromiter((xxhash.xxh64_intdigest(k) for k in found), np.uint64, len(found)), log2_bits)
                hit = ((bits.value[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)
                got = [found[n] for n in np.flatnonzero(hit)]
                keys += got
                ids += [i] * len(got)
            yield pd.DataFrame({"id": ids, "line": keys})

    kind = docs.schema[key].dataType
    ids = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    found = stage(ids.mapInPandas(suspects, "id string, line binary").withColumn("id", F.col("id").cast(kind)))
    repeated = found.groupBy("line").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    names = fresh(docs, "drop_id", "drop_lines", "rewritten")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    holders = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    drops = holders.join(salted, ["line", "salt"]).filter(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias(names[0])).agg(F.collect_set("line").alias(names[1]))

    def rewrite(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for t, d in zip(texts, dropped):
            lines = (t or "").split("\n")
            gone = set(map(bytes, d)) if d is not None and len(d) else ()
            kept = [x for x, k in zip(lines, _keys(t)) if k not in gone] if gone else lines
            rows.append(("\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    rewritten = F.pandas_udf(rewrite, T.StructType.fromDDL("text string, n_lines long, n_dropped long"))
    out = docs.join(drops, F.col(key).eqNullSafe(F.col(names[0])), "left").withColumn(names[2], rewritten(F.col(text), F.col(names[1])))
    return out.withColumns({text: F.col(names[2] + ".text"), "n_lines": F.col(names[2] + ".n_lines"), "n_dropped": F.col(names[2] + ".n_dropped")}).drop(*names)
