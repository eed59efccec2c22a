"""Ranked lexical search, reversed: documents stream through an index of the items."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import stage
from skirmish.operators.ordered import ranked

# A term is a run of ASCII letters and digits and of all bytes beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Cells of a table of scores (documents by items), and postings met, that a task handles at once.
_CELLS = 1 << 21
# Tasks' heaps merge within so many groups per item, then these among themselves.
_GROUPS = 64


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of items ``(item, text)``, text as binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, n) for i, text in zip(b["item"].to_pylist(), b["text"].to_pylist()) for t, n in Counter(terms(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["item", "term", "times"])

    return items.mapInArrow(count, "item long, term binary, times long")


def _matched(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its number of terms, and those of the vocabulary with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in batches:
            rows, sizes, ends, found, times = [], [], [0], [], []
            for row, text in enumerate(b["text"]):
                words = terms(text.as_py())
                if words:
                    rows.append(row)
                    sizes.append(len(words))
                    got = Counter(filter(lambda t: t is not None, map(number, words)))
                    found += got.keys()
                    times += got.values()
                    ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            kept = b.select(["id", "no_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["id"], kept["no_id"], pa.array(sizes, pa.int64()), *lists], names=["id", "no_id", "n", "terms", "times"])

    return docs.mapInArrow(count, "id long, no_id boolean, n long, terms array<int>, times array<int>")


def _heaps(counts: DataFrame, names: np.ndarray, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, repeats: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item among those of a task, as (item, id, no_id, score)."""
    index = counts.sparkSession.sparkContext.broadcast((weights, starts, items, repeats))
    n_items = len(names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item, repeat = index.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_items)]
        # What a document must reach to enter a heap; nothing enters with a score of 0.
        floor = np.ones(n_items, np.int64)
        for b in batches:
            ids, no_id, n = b["id"].to_numpy(), b["no_id"].to_numpy(zero_copy_only=False), b["n"].to_numpy()
            ends = b["terms"].offsets.to_numpy().astype(np.int64)
            term, times = b["terms"].values.to_numpy(), b["times"].values.to_numpy().astype(np.int64)
            met = start[term + 1] - start[term]
            reach = np.append(0, np.cumsum(met))[ends]
            at = 0 if n_items else len(n)
            while at < len(n):
                # At least one document, and then as many as the table and its postings allow.
                to = min(len(n), at + max(1, _CELLS // n_items), max(at + 1, int(np.searchsorted(reach, reach[at] + _CELLS, "right")) - 1))
                lo, hi = ends[at], ends[to]
                row = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                length = 75 + (25 * n[at:to] * n_docs) // n_terms
                part = weight[term[lo:hi]] * ((1_000_000_000 * times[lo:hi]) // (1000 * times[lo:hi] + 12 * length[row]))
                many = met[lo:hi]
                place = np.repeat(start[term[lo:hi]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                scores = np.zeros((to - at) * n_items, np.int64)
                np.add.at(scores, np.repeat(row, many) * n_items + item[place], np.repeat(part, many) * repeat[place])
                scores = scores.reshape(to - at, n_items)
                need = np.maximum(floor, np.partition(scores, to - at - k, axis=0)[to - at - k]) if to - at > k else floor
                for r, i in zip(*np.nonzero(scores >= need)):
                    entry = (int(scores[r, i]), not no_id[at + r], -int(ids[at + r]))
                    heap = best[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        floor[i] = max(1, heap[0][0])
                at = to
        rows = [(int(names[i]), -e[2], not e[1], e[0]) for i, heap in enumerate(best) for e in heap]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item", "id", "no_id", "score"])

    return counts.mapInArrow(stream, "item long, id long, no_id boolean, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", block: int = 1_000_000, block_items: int = 4096) -> DataFrame:
    """The ``k`` best documents for each item: (item_id, rank, doc_id, score), every row of ``docs`` a candidate.

    The items' terms are an inverted index, broadcast in blocks of about ``block`` postings and ``block_items`` items.  Documents stream by
    twice: once to count the terms of the block, with each document's length, and once, as stored counts, through the
    index with the weights that the first pass gave.  A task keeps a heap of ``k`` documents per item; heaps merge by item.
    No text is shuffled, and no pair of item and document is ever a row unless it is in a heap.

    Scores are integers: a term weighs ``floor(1000 ln((2N+2)/(2df+1)))``; it counts by its saturated frequency in the
    document and its number in the item.  Equal scores are ranked by ascending ``key``.  ``key`` is integral.

    A null or empty text has no terms: such a document is never found and counts in no statistic, such an item has no rows.  Every
    row is a document of its own, so a repeated row is found as often as it stands there; null keys come
    after all others of the same score.  Every row of ``items`` is an item, also if it repeats another's id.  Empty tables
    give no rows.  Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_id"), F.col(text).cast("binary").alias("text")))
    postings = stage(item_terms(numbered.select("item", "text")))
    size = postings.agg(F.count("*"), F.count_distinct("item")).first()
    blocks = max(1, math.ceil(size[0] / block), math.ceil(size[1] / block_items))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(key).isNull().alias("no_id"), F.col(text).cast("binary").alias("text"))
    found = None
    for nth in range(blocks):
        mine = postings.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == nth).toPandas()
        names, item = np.unique(mine["item"].to_numpy(np.int64), return_inverse=True)
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(mine["term"].map(bytes)))}
        term = np.fromiter((vocabulary[bytes(t)] for t in mine["term"]), np.int64, len(mine))
        order = np.lexsort((item, term))
        starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        counts = stage(_matched(rows, vocabulary))
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        heaps = _heaps(counts, names, weights, starts, item[order], mine["times"].to_numpy(np.int64)[order], n_docs, n_terms or 1, k)
        found = heaps if found is None else found.unionByName(heaps)
    best = [F.col("score").desc(), F.col("no_id"), F.col("id")]
    groups = ranked(found.withColumn("task", F.spark_partition_id() % _GROUPS), ["item", "task"], best, k).drop("rank", "task")
    top = ranked(groups, ["item"], best, k)
    doc = F.when(~F.col("no_id"), F.col("id"))
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", doc.alias("doc_id"), "score")
