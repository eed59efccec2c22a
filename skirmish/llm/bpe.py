"""Byte-pair encoding with an index of where each pair stands, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

# Chunks of text that a task remembers; beyond that it forgets them all and starts anew.
_REMEMBERED = 1 << 19
# Characters of text whose new pieces are indexed together.
_INDEXED = 1 << 23
# Bits of a symbol; the largest is a mark between pieces that belongs to no rule.
_BITS = 24
_WALL = (1 << _BITS) - 1


class Merges:
    """The merge rules of a vocabulary file: per pair of symbols its rank and the symbol it becomes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain BPE vocabulary is expected")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        # By both symbols in one number.
        self.rank: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, into = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left << _BITS | right] = rank
            self.pairs.append((left, right, into))
        part_of: dict[int, int] = {}
        for rank, (left, right, _) in reversed([*enumerate(self.pairs)]):
            part_of[left] = part_of[right] = rank
        # Rules whose symbol has a part in a rule of lower rank.
        self.late = {rank for rank, (_, _, into) in enumerate(self.pairs) if part_of.get(into, rank) < rank}
        self.keys, at = np.unique(np.array(list(self.rank), np.int64), return_index=True)
        self.ranks = np.array(list(self.rank.values()), np.int64)[at]

    def symbols(self, piece: str) -> list[int]:
        """The symbols of a piece, its last with the mark of a word's end; those the vocabulary lacks are left out."""
        if not piece:
            return []
        got = map(self.ids.get, [*piece[:-1], piece[-1] + self.suffix])
        return [i for i in got if i is not None]

    def _ranked(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
        """The places ``at`` whose pair of symbols has a rule, and the ranks."""
        if not len(self.keys):
            return [], []
        keys = left << _BITS | right
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[near] == keys
        return at[hit].tolist(), self.ranks[near[hit]].tolist()

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece.

        All pieces stand in one line of symbols, with walls between.  An index maps each pair that has a
        rule to all places where it stands; the active ranks are applied in ascending order, each to all its places at
        once, overlapping ones from the left, and the merges add the pairs they make to the index; places that no longer hold their pair are
        passed over.  A rule whose symbol also has a part in rules of lower rank is applied once per piece at a time, so
        that these come first, as they would if the piece were encoded alone.
        """
        flat: list[int] = [_WALL]
        starts: list[int] = []
        for piece in pieces:
            starts.append(len(flat))
            flat += self.symbols(piece)
            flat.append(_WALL)
        sym, begins = np.array(flat, np.int64), np.array(starts, np.int64)
        del flat
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        places: dict[int, list[int]] = {}
        active: list[int] = []

        def add(found: tuple[list[int], list[int]]) -> None:
            for place, rank in zip(*found):
                if rank in places:
                    places[rank].append(place)
                else:
                    places[rank] = [place]
                    heapq.heappush(active, rank)

        add(self._ranked(np.arange(len(sym) - 1), sym[:-1], sym[1:]))
        while active:
            rank = heapq.heappop(active)
            left, right, into = self.pairs[rank]
            i = np.unique(np.array(places.pop(rank)))
            j = after[i]
            holds = (sym[i] == left) & (sym[j] == right)
            i, j = i[holds], j[holds]
            if rank in self.late and len(i):
                first = np.unique(np.searchsorted(begins, i, "right"), return_index=True)[1]
                rest = np.delete(i, first).tolist()
                if rest:
                    add((rest, [rank] * len(rest)))
                i, j = i[first], j[first]
            elif left == right and len(i) > 1:
                # In a run of equal symbols every second place.
                run = np.maximum.accumulate(np.where(np.append(True, j[:-1] != i[1:]), np.arange(len(i)), 0))
                odd = (np.arange(len(i)) - run) % 2 == 0
                i, j = i[odd], j[odd]
            k = after[j]
            sym[i], sym[j] = into, -1
            after[i], before[k] = k, i
            h = before[i]
            add(self._ranked(h, sym[h], np.full(len(h), into)))
            # A pair of two new symbols was added from its right one.
            open_ = sym[k] != into
            add(self._ranked(i[open_], np.full(int(open_.sum()), into), sym[k[open_]]))
        # What is left of the line, cut at its walls.
        rest = sym[sym != -1]
        return np.split(rest[rest != _WALL].astype(np.int32), (np.flatnonzero(rest == _WALL) - np.arange(len(pieces) + 1))[1:-1]) if pieces else []


class _Coder:
    """Texts to ids, with the chunks seen so far remembered."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        self.merges = Merges(parsed)
        added = parsed["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens are expected to match as they stand")
        self.added = {t["content"]: np.array([t["id"]], np.int32).tobytes() for t in added}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        # Only the file's rules for normal forms and for word bounds are left to the library.
        rest = Tokenizer.from_str(json.dumps({**parsed, "added_tokens": [], "model": {**parsed["model"], "vocab": {}, "merges": []}}))
        self.normal, self.split = rest.normalizer.normalize_str, rest.pre_tokenizer.pre_tokenize_str
        blanks = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and c != 32 and self.normal(chr(c)) == " "]
        self.blank = regex.compile("[" + "".join(map(regex.escape, blanks)) + "]")
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Chunks between blanks, and added tokens.  No piece and no normal form reaches over a blank."""
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for n, part in enumerate(parts):
            out += [part] if n % 2 else self.blank.sub(" ", part).split(" ")
        return [c for c in out if c]

    def pieces(self, chunks: list[str]) -> list[list[str]]:
        """The pieces of each chunk, all chunks in one line."""
        line = self.normal(" ".join(chunks))
        ends = list(accumulate(len(c) + 1 for c in line.split(" ")))
        if len(ends) != len(chunks):
            # Some chunk became a blank or several chunks.
            return [[p for p, _ in self.split(self.normal(c))] for c in chunks]
        out: list[list[str]] = [[] for _ in chunks]
        at = 0
        for piece, (start, _) in self.split(line):
            while start >= ends[at]:
                at += 1
            out[at].append(piece)
        return out

    def learn(self, texts: list[str]) -> None:
        """Remember all chunks of the texts."""
        used: set[str] = set()
        for t in texts:
            used.update(self.segments(t))
        if len(self.known) + len(used) > _REMEMBERED:
            self.known = {c: self.known[c] for c in used if c in self.known}
        self.known.update(self.added)
        new = [c for c in used if c not in self.known]
        del used
        split = self.pieces(new)
        pieces = list({p for ps in split for p in ps})
        ids = {p: i.tobytes() for p, i in zip(pieces, self.merges.encode(pieces))}
        self.known.update((c, b"".join([ids[p] for p in ps])) for c, ps in zip(new, split))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.learn(texts)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, self.segments(t))), np.int32) for t in texts]


@lru_cache(maxsize=2)
def _coder(spec: str) -> _Coder:
    return _Coder(spec)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read by the driver and broadcast (a few MB), so that only the driver needs it."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows in parts of about ``_INDEXED`` characters, with their texts."""
    for b in batches:
        texts = [t or "" for t in b[text].to_pylist()]
        start, size = 0, 0
        for n, t in enumerate(texts):
            size += len(t)
            if size >= _INDEXED or n == len(texts) - 1:
                yield b.slice(start, n + 1 - start), texts[start : n + 1]
                start, size = n + 1, 0


def _with(b: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, name])


def _encoded(batches: Iterator[pa.RecordBatch], spec: Broadcast, text: str, out: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(spec.value)
    for b, texts in _parts(batches, text):
        ids = coder.encode(texts)
        ends = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
        yield _with(b, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))


def _decoded(batches: Iterator[pa.RecordBatch], spec: Broadcast, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    token = _tokens(spec.value)
    for b in batches:
        rows = b[ids].to_numpy(zero_copy_only=False)
        known = [x[(x >= 0) & (x < len(token))] if x is not None else () for x in rows]
        yield _with(b, out, pa.array([" ".join(filter(None, token[x].tolist())) if len(x) else "" for x in known], pa.string()))


def _run(docs: DataFrame, spec: Broadcast, steps: list[tuple[Callable, str, str, str]]) -> DataFrame:
    """Each step (function, input, output, its type) adds a column, one after the other in the same task."""
    rest = docs.drop(*[out for _, _, out, _ in steps])
    kinds = T.StructType([*rest.schema.fields, *[T.StructField(out, T.DataType.fromDDL(kind)) for _, _, out, kind in steps]])

    def all_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fn, source, out, _ in steps:
            batches = fn(batches, spec, source, out)
        return batches

    return rest.mapInArrow(all_steps, kinds)


def encode(docs: DataFrame, spec: Broadcast, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``out`` (array of int), which replaces a column of that name.

    Added tokens that stand in a text become their ids; none are put around it; nothing is cut or padded.  A null or empty text has no ids.
    Rows are independent: repeats, other columns and empty tables pass through.  A task remembers up to 2^19 chunks of
    text between blanks and indexes the new pieces of about eight million characters together; a longer text is one such part.
    """
    return _run(docs, spec, [(_encoded, text, out, "array<int>")])


def decode(docs: DataFrame, spec: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids as ``out``, special tokens included; ids the vocabulary lacks are left out.

    The file has no decoder, so tokens stand as they are, with one space between.  Null or no ids give an empty text.
    """
    return _run(docs, spec, [(_decoded, ids, out, "string")])


def round_trip(docs: DataFrame, spec: Broadcast, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """:func:`encode` and then :func:`decode`, in the same tasks."""
    return _run(docs, spec, [(_encoded, text, ids, "array<int>"), (_decoded, ids, out, "string")])


@lru_cache(maxsize=2)
def _tokens(spec: str) -> np.ndarray:
    parsed = json.loads(spec)
    if parsed.get("decoder"):
        raise ValueError("a vocabulary without a decoder is expected")
    tokens = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
    table = np.full(max(tokens) + 1, None, object)
    table[list(tokens)] = list(tokens.values())
    return table
