"""Passages repeated across documents, by MinHash banding of their paragraphs and by shared word runs at any place."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.base import components, fresh, small, stage
from skirmish.llm.grams import Flat, chunks, flatten, powers, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
MIN_RUN = 30
_LONG = 10
# A passage of WHOLE words that another document holds is found wherever it starts: word runs of GRAM words are compared, and of
# every _SPREAD neighboring ones at least one is an anchor (GRAM + _SPREAD - 1 words, fewer than WHOLE).
WHOLE = 50
GRAM = 8
_SPREAD = 32
# Words between two shared runs that may differ.
GAP = 4
# Bits of a stretch's hash that hold its length, at most _SPREAD.
_STEP = 63
# Characters hashed at once; arrays of so many stay in a processor's cache.
_RUN = 1 << 18
# Paragraphs to look up in their documents that may be broadcast, 8 bytes each; more are joined by document.
_BROADCAST = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
# Marks that end a sentence, and marks that do not count in comparisons.
_ENDS = np.frombuffer(b".!?", np.uint8)
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()", np.uint8))


def tune(similarity: float = SIMILARITY, recall: float = 0.99, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the fewest bands that catch pairs of ``similarity`` with probability ``recall``, and the longest rows for them."""
    for bands in range(1, most + 1):
        fit = [rows for rows in range(1, 9) if 1 - (1 - similarity**rows) ** bands >= recall]
        if fit:
            return bands, max(fit)
    return most, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts: ``flat``, ``code`` (a 64-bit hash of each, case and marks aside) and ``heads`` (first word of every text)."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = texts
        self.flat = flatten(texts)
        letters = np.where(_MARKS[self.flat.data], np.uint8(32), self.flat.data)
        self.code = word_hashes(Flat(letters, self.flat.starts, self.flat.doc, self.flat.lengths, self.flat.bounds))
        self.heads = np.cumsum(self.flat.lengths) - self.flat.lengths


class Paragraphs:
    """The paragraphs of some texts, as flat arrays: ``doc``, ``number`` in the document, ``first`` word, ``size`` in words,
    ``code`` (a 64-bit hash of the words), and the shingle hashes with their owners.

    A sentence ends at a mark or a line end.  A paragraph is a run of sentences that ends after one of ``_LONG`` words or more, or
    after one whose last words hash to an even number: its bounds depend on its own sentences only, so a passage
    falls into the same paragraphs wherever it stands, but for its first and last.
    """

    def __init__(self, texts: list[str | None] | Words) -> None:
        given = texts if isinstance(texts, Words) else Words(texts)
        flat, words, heads = given.flat, given.code, given.heads
        n = len(flat.starts)
        self.doc, self.number, self.first, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.code, self.shingles, self.owner = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not n:
            return
        raw = b" " + b" ".join((t.lower() if t else "").encode("utf-8", "surrogatepass") for t in given.texts) + b" "
        gaps = np.flatnonzero(flat.data == 32)
        last_letter = gaps[np.searchsorted(gaps, flat.starts)] - 1
        ends = np.isin(flat.data[last_letter], _ENDS)
        newlines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        ends[np.searchsorted(flat.starts, newlines[newlines > flat.starts[0]], "right") - 1] = True
        tails = heads + flat.lengths - 1
        ends[tails[flat.lengths > 0]] = True
        close = np.flatnonzero(ends)
        length = np.diff(np.concatenate([[-1], close]))
        # The word before the first of a text is none, not that of the text before.
        tail = _mix(words[close] + np.where(close > heads[flat.doc[close]], words[close - 1], np.uint64(0)) * _Q)
        cut = (length >= _LONG) | (tail % np.uint64(2) == 0)
        cut[np.isin(close, tails[flat.lengths > 0])] = True
        last = close[cut]
        first = np.concatenate([[0], last[:-1] + 1])
        size = last - first + 1
        # The order of the words counts: positions weigh in.
        sh = words.copy()
        for k in range(1, min(SHINGLE, n)):
            sh[: n - k] = _mix(sh[: n - k]) + words[k:]
        sh = _mix(sh)
        para = np.repeat(np.arange(len(first)), size)
        place = np.arange(n) - first[para]
        whole = place + SHINGLE <= size[para]
        weight = _mix(place.astype(np.uint64) * _Q + np.uint64(1))
        code = _mix(np.add.reduceat(_mix(words * weight + weight), first) + size.astype(np.uint64))
        big = size >= SHINGLE
        index = np.cumsum(big) - 1
        doc = flat.doc[first]
        self.doc, self.first, self.size, self.code = doc[big], first[big] - heads[doc[big]], size[big], code[big]
        self.number = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc, "left")
        self.shingles, self.owner = sh[whole], index[para[whole]]

    def minhashes(self, count: int) -> list[np.ndarray]:
        """The least value of each of ``count`` hash functions over a paragraph's shingles."""
        if not len(self.code):
            return [np.zeros(0, np.uint64) for _ in range(count)]
        starts = np.searchsorted(self.owner, np.arange(len(self.code)))
        return [np.minimum.reduceat(_mix(self.shingles * np.uint64(int(_P) * (2 * k + 1) % (1 << 64)) + np.uint64(k)), starts) for k in range(count)]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """A list per text from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _marks(ids: DataFrame) -> DataFrame:
    """One stored row per document of ``ids`` (key, text), all that is compared first: its paragraphs (``first``, ``size``, ``para``, a hash
    for every band) and its anchors (``at``, ``code``, and ``link``, the hash of the words from an anchor to the end of the next, 0 for the last)."""
    bands, rows = tune()
    names = [f"b{k}" for k in range(bands)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for run in chunks(b.column("text").to_pylist(), _RUN):
                w = Words(run)
                p = Paragraphs(w)
                least = p.minhashes(bands * rows)
                keys = []
                for k in range(bands):
                    key = np.full(len(p.code), k, np.uint64)
                    for m in least[k * rows : (k + 1) * rows]:
                        key = _mix(key * _Q + m)
                    keys.append(key.view(np.int64))
                every = np.arange(len(run) + 1)
                paras = np.searchsorted(p.doc, every)
                doc, place, code = _grams(w)
                some = _anchors(doc, code)
                doc, place, code = doc[some], place[some], code[some]
                grams = np.searchsorted(doc, every)
                columns = [p.first.astype(np.int32), p.size.astype(np.int32), p.code.view(np.int64), *keys]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(at, len(run)), *(_lists(c, paras) for c in columns)]
                    + [_lists(c, grams) for c in (place.astype(np.int32), code.view(np.int64), _stretches(w, doc, place).view(np.int64))],
                    ["doc", "first", "size", "para", *names, "at", "code", "link"],
                )
                at += len(run)

    kind = ids.schema["key"].dataType.simpleString()
    arrays = ", ".join(f"{n} array<long>" for n in names)
    return stage(ids.mapInArrow(mark, f"doc {kind}, first array<int>, size array<int>, para array<long>, {arrays}, at array<int>, code array<long>, link array<long>"))


def _forest(codes: list[int], sets: list[np.ndarray], groups: list[int]) -> list[tuple[int, int]]:
    """Links between the paragraphs of one bucket of Jaccard similarity ``SIMILARITY`` or more that join parts not joined yet.

    ``groups`` tells the two halves of a block pair apart; pairs inside a half are looked at when it meets itself.
    """
    root = list(range(len(codes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    parts = [set(s.tolist()) for s in sets]
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            x, y = find(i), find(j)
            if x == y or (groups[i] == groups[j]) != (groups[0] == groups[-1]):
                continue
            a, b = parts[i], parts[j]
            if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
                continue
            both = len(a & b)
            if both >= SIMILARITY * (len(a) + len(b) - both):
                root[max(x, y)] = min(x, y)
                out.append((codes[i], codes[j]))
    return out


def _paragraphs(marks: DataFrame) -> DataFrame:
    names = [c for c in marks.columns if c in ("first", "size", "para") or c[0] == "b"]
    return marks.select("doc", F.posexplode(F.arrays_zip(*names)).alias("number", "x")).select("doc", "number", "x.*")


def _members(marks: DataFrame) -> DataFrame:
    """(band, code): the distinct paragraphs that share a band with another one."""
    paras = _paragraphs(marks)
    keyed = paras.select(F.col("para").alias("code"), F.explode(F.array(*(c for c in paras.columns if c[0] == "b"))).alias("band"))
    shared = stage(keyed.groupBy("band").agg(F.min("code").alias("low"), F.max("code").alias("high")).filter("low <> high").select("band"))
    return stage(keyed.join(small(shared), "band").select("band", "code").distinct())


def _links(docs: DataFrame, members: DataFrame, distinct: DataFrame, bucket: int) -> DataFrame:
    """Verified links (a, b) between distinct paragraphs that share a band.

    A bucket is compared within one row of at most ``bucket`` paragraphs; larger ones are cut into blocks by code and every
    pair of blocks is such a row, so all pairs are compared and no group is gathered whole.
    """
    sizes = members.groupBy("band").count()
    members = members.join(sizes, "band").withColumn("blocks", F.ceil(F.col("count") / bucket))
    wanted = distinct.filter("near").select(F.col("least").alias("of"), F.col("code").alias("want"))
    exemplars = wanted.groupBy("of").agg(F.collect_list("want").alias("want"))
    if wanted.limit(_BROADCAST + 1).count() <= _BROADCAST:
        exemplars = F.broadcast(exemplars)

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for run in chunks(list(b["text"]), _RUN):
                p = Paragraphs(run)
                # Equal codes are equal words, so any paragraph of the run with a wanted code will do.
                want = np.concatenate([np.asarray(w, np.int64) for w in b["want"].iloc[at : at + len(run)]])
                code = p.code.view(np.int64)
                codes, some = np.unique(code, return_index=True)
                some = some[np.isin(codes, want)]
                starts = np.append(np.searchsorted(p.owner, np.arange(len(code))), len(p.owner))
                sets = [np.unique(p.shingles[starts[k] : starts[k + 1]]).view(np.int64) for k in some]
                yield pd.DataFrame({"code": code[some], "set": pd.Series(sets, dtype=object)})
                at += len(run)

    sets = docs.join(exemplars, docs["key"] == F.col("of")).select("text", "want").mapInPandas(shingle, "code long, set array<long>")
    sets = stage(sets.dropDuplicates(["code"]))
    block = F.pmod(F.xxhash64("code"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("x"), F.greatest(x, F.col("block")).alias("y")))
    dealt = members.withColumn("block", block).select("band", "code", "block", F.explode(pairs).alias("pair"))
    rows = dealt.join(sets, "code").groupBy("band", "pair").agg(F.sort_array(F.collect_list(F.struct("block", "code", "set"))).alias("members")).select("members")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for m in b["members"] for x in _forest([r["code"] for r in m], [np.asarray(r["set"]) for r in m], [r["block"] for r in m])]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(verify, "a long, b long").distinct()


def repeated_passages(docs: DataFrame, min_words: int = MIN_RUN, bucket: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that repeat across documents: one row (key, first_word, last_word, n_words, removed_words, kept_in).

    Paragraphs are exact copies, or linked by a Jaccard similarity of ``SIMILARITY`` or more over 5-word shingles, found by MinHash bands and
    verified; classes are the components of such links.  Neighboring paragraphs whose classes span documents form a
    passage; passages of ``min_words`` words or more are reported in every document that holds them.  The copy in
    the class's smallest key stays: ``kept_in`` lists those keys, ``removed_words`` counts the words whose copy stays elsewhere.  Words are counted from 0.

    Null keys take no part, rows that repeat a key are one document, null and empty texts have no paragraph.
    Paragraphs are told apart by 64-bit hashes; those under ``SHINGLE`` words are left out.
    """
    ids = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _similar_runs(ids, _marks(ids), min_words, bucket).withColumnRenamed("doc", key)


def _similar_runs(ids: DataFrame, marks: DataFrame, min_words: int, bucket: int) -> DataFrame:
    """``repeated_passages`` of ``ids`` (key, text) by their ``_marks``."""
    members = _members(marks)
    near = small(members.select("code").distinct()).withColumn("near", F.lit(True))
    paras = _paragraphs(marks).select("doc", "number", "first", "size", F.col("para").alias("code"))
    # Only what another document or another paragraph's band may share.
    distinct = stage(paras.groupBy("code").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).join(near, "code", "left").filter("near or least <> most"))
    roots = components(_links(ids, members, distinct, bucket))
    placed = distinct.select("code", "least", "most").join(roots, F.col("code") == F.col("node"), "left").select("code", "least", "most", F.coalesce("root", "code").alias("root"))
    linked = placed.join(roots.select("root").distinct(), "root", "left_semi")
    classes = linked.groupBy("root").agg(F.min("least").alias("keeper"), F.max("most").alias("most")).filter("keeper <> most").select("root", "keeper")
    near = linked.join(classes, "root").select("code", "keeper")
    exact = placed.join(roots.select("root").distinct(), "root", "left_anti").filter("least <> most").select("code", F.col("least").alias("keeper"))
    shared = stage(near.unionByName(exact))
    held = paras.join(small(shared), "code").drop("code").distinct()
    run = F.col("number") - F.row_number().over(Window.partitionBy("doc").orderBy("number"))
    passages = held.withColumn("run", run).groupBy("doc", "run").agg(
        F.min("first").alias("first_word"), F.max(F.col("first") + F.col("size") - 1).alias("last_word"), F.sum("size").alias("n_words"),
        F.sum(F.when(F.col("keeper") != F.col("doc"), F.col("size")).otherwise(0)).alias("removed_words"), F.sort_array(F.collect_set("keeper")).alias("kept_in"),
        F.sort_array(F.collect_list(F.when(F.col("keeper") != F.col("doc"), F.struct("first", (F.col("first") + F.col("size") - 1).alias("last"))))).alias("removed"),
    )
    return passages.filter(F.col("n_words") >= min_words).select("doc", "first_word", "last_word", "n_words", "removed_words", "kept_in", "removed")


def _grams(given: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, hash) of every run of ``GRAM`` words, case and marks aside, in order; places are word numbers."""
    words, docs = given.code, given.flat.doc
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = words.copy()
    for k in range(1, GRAM):
        code[: len(words) - k] = _mix(code[: len(words) - k]) + words[k:]
    inside = np.flatnonzero(docs[:n] == docs[GRAM - 1 :])
    doc = docs[inside]
    return doc, inside - given.heads[doc], _mix(code[inside])


def _stretches(given: Words, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each anchor the hash of all words from its first to the last of the document's next anchor, the words between the two
    places in its lowest bits; 0 if there is none."""
    out = np.zeros(len(doc), np.uint64)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    up, down = powers(len(given.code) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(given.code * up[: len(given.code)], dtype=np.uint64)])
    first = given.heads[doc[at]] + place[at]
    step = place[at + 1] - place[at]
    out[at] = _mix((total[first + step + GRAM] - total[first]) * down[first]) & ~np.uint64(_STEP) | step.astype(np.uint64)
    return out


def _anchors(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Indexes of the grams that are the least of some ``_SPREAD`` neighbors of their document: of equal stretches the same ones."""
    n = len(code) - _SPREAD + 1
    if n < 1:
        return np.zeros(0, np.int64)
    low = code
    width = 1
    while width < _SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.where(doc[:n] == doc[_SPREAD - 1 :], low, np.uint64(0))
    high = np.concatenate([np.zeros(_SPREAD - 1, np.uint64), low, np.zeros(_SPREAD - 1, np.uint64)])
    width = 1
    while width < _SPREAD:
        high = np.maximum(high[:-width], high[width:])
        width *= 2
    return np.flatnonzero(high == code)


def _beside(hits: np.ndarray, left: np.ndarray, right: np.ndarray, places: int) -> np.ndarray:
    """Of ``places`` grams of a document those within ``_SPREAD + GAP`` of a shared anchor on a side where its stretch is not shared by all (0)."""
    edge = np.zeros(places + 1, np.int64)
    for first, last in ((hits[left == 0] - _SPREAD - GAP, hits[left == 0]), (hits[right == 0] + 1, hits[right == 0] + _SPREAD + GAP + 1)):
        np.add.at(edge, np.clip(first, 0, places), 1)
        np.add.at(edge, np.clip(last, 0, places), -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc, keeper, first, last) sorted by these, merged where they meet; what two batches hold of one stays in two."""
    for b in batches:
        first, last = b.column("first").to_numpy(), b.column("last").to_numpy()
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = False
        for name in ("doc", "keeper"):
            code = b.column(name).dictionary_encode().indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        # Ends so far, each (doc, keeper) above all of the one before.
        base = np.cumsum(new) * (int(last.max()) + 2 + GRAM)
        reach = np.maximum.accumulate(last + base)
        new[1:] |= first[1:] + base[1:] > reach[:-1] + 1
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(new)) - 1
        out = b.take(pa.array(heads))
        yield pa.RecordBatch.from_arrays([out.column("doc"), out.column("keeper"), out.column("first"), pa.array((reach[ends] - base[ends]).astype(np.int32))], ["doc", "keeper", "first", "last"])


def shared_runs(ids: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Runs of words (doc, keeper, first, last) of ``ids`` (key, text) that another document holds too, ``keeper`` the smallest.

    Anchors are compared first.  Where all places of a shared anchor go on alike to the next anchor (or back to the one before), one hash
    tells that all words between are shared.  On the other sides every gram is compared, so a stretch of ``GRAM + _SPREAD - 1`` shared
    words or more is covered from its first to its last word, whatever its marks.
    Only hashes, documents and places are shuffled, and counted by hash, so no group is gathered and no pair is made.
    """
    kind = ids.schema["key"].dataType.simpleString()
    marks = _marks(ids) if marks is None else marks
    before = F.concat(F.array(F.lit(0).cast("long")), "link")
    each = marks.filter("size(code) > 0").select("doc", F.explode(F.arrays_zip("at", "code", F.col("link").alias("right"), before.alias("left"))).alias("x")).filter("x.code is not null").select("doc", "x.*")
    ends = [f(c).alias(f"{c}_{n}") for c in ("left", "right") for n, f in (("low", F.min), ("high", F.max))]
    steps = [F.when(F.col(f"{c}_low") == F.col(f"{c}_high"), F.col(f"{c}_low").bitwiseAND(_STEP)).otherwise(0).cast("int").alias(c) for c in ("left", "right")]
    # Stored, so that the join with all places has an exchange of its own, whose large partitions Spark splits: a hash may be in very many documents.
    common = stage(each.groupBy("code").agg(F.min("doc").alias("keeper"), F.max("doc").alias("most"), *ends).filter("keeper <> most").select("code", "keeper", *steps))
    hits = stage(each.select("doc", "at", "code").join(common, "code").select("doc", "at", "keeper", "left", "right"))
    marked = hits.filter("left = 0 or right = 0").groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("at", "left", "right")).alias("hits"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            lists = b.column("hits")
            at, left, right = (lists.flatten().field(k).to_numpy() for k in range(3))
            limits = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for run in chunks(b.column("text").to_pylist(), _RUN):
                doc, _, code = _grams(Words(run))
                bounds = np.searchsorted(doc, np.arange(len(run) + 1))
                places = []
                for x, y, i, j in zip(bounds[:-1], bounds[1:], limits[n:], limits[n + 1 :]):
                    places.append(_beside(at[i:j], left[i:j], right[i:j], y - x))
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in places])])
                flat = np.concatenate(places)
                code = code[flat + np.repeat(bounds[:-1], np.diff(cuts))]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(n, len(run)), _lists(flat.astype(np.int32), cuts), _lists(code.view(np.int64), cuts)], ["doc", "at", "code"])
                n += len(run)

    spelled = stage(ids.join(marked, F.col("key") == F.col("of")).select("key", "text", "hits").mapInArrow(spell, f"doc {kind}, at array<int>, code array<long>"))
    known = stage(spelled.select("doc", F.explode("code").alias("code")).groupBy("code").agg(F.min("doc").alias("keeper"), F.max("doc").alias("most")).filter("keeper <> most").select("code", "keeper"))
    wanted = spelled.select("doc", F.explode(F.arrays_zip("at", "code")).alias("x")).select("doc", "x.at", "x.code")
    found = wanted.join(known, "code").select("doc", "keeper", F.col("at").alias("first"), (F.col("at") + GRAM - 1).alias("last"))
    sure = hits.select("doc", "keeper", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right") + GRAM - 1).alias("last"))
    spans = sure.unionByName(found).repartition("doc").sortWithinPartitions("doc", "keeper", "first")
    return stage(spans.mapInArrow(_unite, f"doc {kind}, keeper {kind}, first int, last int"))


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans (first, last) merged where at most ``GAP`` words lie between them."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1 + GAP:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def whole_passages(docs: DataFrame, least: int = WHOLE, min_words: int = MIN_RUN, bucket: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that repeat across documents, from their first to their last word; columns as ``repeated_passages`` has them.

    Paragraphs' passages (``repeated_passages``) and ``shared_runs`` are merged where at most ``GAP`` words, edits say, lie between them.
    What has ``least`` words or more is reported, and what holds a paragraphs' passage of ``min_words``.  A passage that
    starts or ends inside a sentence, or has no marks at all, is found like any.  ``n_words`` counts all words from first to
    last; ``removed`` are the words whose copies stay in smaller keys, with the edits between them.  Null keys take no
    part, rows that repeat a key are one document.
    """
    ids = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = ids.schema["key"].dataType.simpleString()
    mine = F.col("keeper") == F.col("doc")
    marks = _marks(ids)
    runs = shared_runs(ids, marks).groupBy("doc", "keeper").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    runs = runs.select("doc", "spans", F.when(mine, F.array().cast("array<struct<first:int,last:int>>")).otherwise(F.col("spans")).alias("removed"), F.array("keeper").alias("kept_in"), F.lit(False).alias("sure"))
    near = _similar_runs(ids, marks, 1, bucket).select(
        "doc", F.array(F.struct(F.col("first_word").alias("first"), F.col("last_word").cast("int").alias("last"))).alias("spans"),
        F.col("removed").cast("array<struct<first:int,last:int>>").alias("removed"), "kept_in", (F.col("n_words") >= min_words).alias("sure"),
    )
    parts = runs.unionByName(near).groupBy("doc").agg(F.collect_list(F.struct("spans", "removed", "kept_in", "sure")).alias("parts"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, parts in zip(b["doc"], b["parts"]):
                whole = _joined([(s["first"], s["last"]) for p in parts for s in p["spans"]])
                heads = np.array([w[0] for w in whole])
                keepers, gone, sure = [set() for _ in whole], [[] for _ in whole], [False] * len(whole)
                for p in parts:
                    for s in p["spans"]:
                        k = int(np.searchsorted(heads, s["first"], "right")) - 1
                        keepers[k].update(p["kept_in"])
                        sure[k] |= bool(p["sure"])
                    for s in p["removed"]:
                        gone[int(np.searchsorted(heads, s["first"], "right")) - 1].append((s["first"], s["last"]))
                for (first, last), kept, cuts, safe in zip(whole, keepers, gone, sure):
                    if safe or last - first + 1 >= least:
                        cuts = _joined(cuts)
                        out.append((doc, first, last, last - first + 1, sum(y - x + 1 for x, y in cuts), sorted(kept), [{"first": x, "last": y} for x, y in cuts]))
            yield pd.DataFrame(out, columns=["doc", "first_word", "last_word", "n_words", "removed_words", "kept_in", "removed"])

    made = parts.mapInPandas(merge, f"doc {kind}, first_word int, last_word int, n_words long, removed_words long, kept_in array<{kind}>, removed array<struct<first:int,last:int>>")
    return made.withColumnRenamed("doc", key)


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words that ``repeated_passages`` marks as removed; untouched texts stay as they are."""
    of, cuts = fresh(docs, "of", "cuts")
    marked = passages.filter("removed_words > 0").groupBy(F.col(key).alias(of)).agg(F.flatten(F.collect_list("removed")).alias(cuts))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None and len(s):
                at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                for x in sorted(s, key=lambda x: -x["first"]):
                    t = t[: at[x["first"]][0]] + t[at[x["last"]][1] :].lstrip(" ") if x["last"] < len(at) else t
            out.append(t)
        return pd.Series(out)

    return docs.join(marked, F.col(key) == F.col(of), "left").withColumn(text, F.pandas_udf(cut, "string")(F.col(text), F.col(cuts))).drop(of, cuts)
