"""Texts of a batch as flat byte arrays, for models on character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


@dataclass(frozen=True)
class Flat:
    """Lower-cased UTF-8 of some texts with blanks as spaces, one before each text and one at the end.

    ``starts``: first byte of every word; ``doc``: the text of every word; ``lengths``: words per text; ``bounds``: first
    byte of every text, its leading space, and the end.
    """

    data: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


def flatten(texts: list[str | None], lower: bool = True) -> Flat:
    parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8).copy()
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data[blank] = 32
    starts = 1 + np.flatnonzero(blank[:-1] & ~blank[1:])
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    doc = np.searchsorted(bounds, starts - 1, "right") - 1
    return Flat(data, starts, doc, np.bincount(doc, minlength=len(texts)), bounds)


def chunks(texts: Iterable[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts in runs of about ``most`` characters; a longer one is a run of its own."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def ngram_rows(data: np.ndarray, n: int, rows: int) -> np.ndarray:
    """For every byte, a row in 1 to ``rows`` for the ``n`` bytes that end there; 0 where a space lies between two letters.

    Runs that begin or end with a space are affixes.
    """
    code = np.zeros(len(data), np.uint64)
    inner = np.zeros(len(data), bool)
    space = data == 32
    for k in range(n):
        code[k:] = code[k:] * np.uint64(256) + data[: len(data) - k] if k else data
        if 0 < k < n - 1:
            inner[k:] |= space[: len(data) - k]
    out = ((code * _P) >> np.uint64(40)).astype(np.int64) % rows + 1
    out[inner] = 0
    out[: n - 1] = 0
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers (at least) of a fixed odd number and of its inverse, in 64 bits; kept for the next call."""
    if len(_POWERS[0]) < n:
        size = 1 << max(10, n.bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(flat: Flat) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(flat.starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(flat.data))
    letters = np.where(flat.data == 32, np.uint8(0), flat.data)
    out = np.add.reduceat(letters * up[: len(letters)], flat.starts) * down[flat.starts]
    return (out ^ (out >> np.uint64(29))) * _P


def sums(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (rows) from each of the ``n`` starts to the next; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.append(starts[1:], len(values))
    return total[ends] - total[starts[:n]]
