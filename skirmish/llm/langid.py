"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.base import fresh
from skirmish.llm.grams import Flat, chunks, flatten, ngram_rows, sums, word_hashes

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SIZES = {2: 1 << 14, 3: 1 << 16, 4: 1 << 17}
_PIECE = 128


@dataclass(frozen=True)
class Crf:
    """``grams``: weights (row, language) of the n-grams of each length; ``lexicon``: sorted hashes of frequent words, with weights;
    ``step``: transition scores; ``start``: scores of the first word."""

    langs: list[str]
    grams: dict[int, np.ndarray]
    lexicon: np.ndarray
    known: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, flat: Flat) -> np.ndarray:
        """Score of every language for every word."""
        per_byte = sum(w[ngram_rows(flat.data, n, _SIZES[n])] for n, w in self.grams.items())
        out = sums(per_byte, flat.starts, len(flat.starts)).astype(np.float32)
        row, found = _lookup(self.lexicon, word_hashes(flat))
        out[found] += self.known[row[found]]
        return out


def _lookup(lexicon: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    row = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return row, lexicon[row] == hashes


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def posteriors(model: Crf, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact forward-backward over sequences of ``lengths`` words laid end to end: P(language) per word.

    Sequences are cut into pieces of ``_PIECE`` words.  The transfer matrices of all pieces are multiplied side by side, messages
    pass from piece to piece through them, and a second pass fills in the words, so the number of steps does not follow
    the longest text.
    """
    n_langs = len(model.langs)
    if not len(scores):
        return np.zeros((0, n_langs))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(model.step - model.step.max())
    pieces = -(-lengths // _PIECE)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    seq = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(seq)) - first[seq]
    begin = (np.concatenate([[0], np.cumsum(lengths)[:-1]]))[seq] + place * _PIECE
    size = np.minimum(lengths[seq] - place * _PIECE, _PIECE)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(_PIECE), "left")  # pieces with more than t words
    through = np.broadcast_to(np.eye(n_langs), (len(seq), n_langs, n_langs)).copy()
    for t in range(_PIECE):
        at = order[: active[t]]
        if not len(at):
            break
        m = (through[at].reshape(-1, n_langs) @ a).reshape(-1, n_langs, n_langs) * e[begin[at] + t][:, None, :]
        through[at] = m / m.max(axis=(1, 2), keepdims=True)
    # The state before the first word: a vector that one transition turns into the start scores is not always there, so
    # the first word of a sequence is handled apart.
    first_scores = np.exp(model.start - model.start.max())
    ahead = np.ones((len(seq), n_langs))  # message into each piece, before its transition
    behind = np.ones((len(seq), n_langs))  # message into each piece from its right
    head = _head_products(through, e, a, begin, size, place, first_scores)
    by_place = _split(place)
    for k, at in enumerate(by_place[:-1]):
        nxt = by_place[k + 1]
        left = nxt - 1
        msg = head[left] if k == 0 else np.einsum("pi,pij->pj", ahead[left], through[left])
        ahead[nxt] = _norm(msg)
    for k in range(len(by_place) - 1, 0, -1):
        at = by_place[k]
        behind[at - 1] = _norm(np.einsum("pij,pj->pi", through[at], behind[at]))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    state = ahead.copy()
    for t in range(_PIECE):
        at = order[: active[t]]
        if not len(at):
            break
        moved = state[at] @ a
        if t == 0:
            moved[place[at] == 0] = first_scores
        state[at] = _norm(moved * e[begin[at] + t])
        alpha[begin[at] + t] = state[at]
    state = behind
    for t in range(_PIECE - 1, -1, -1):
        at = order[: active[t]]
        if not len(at):
            continue
        beta[begin[at] + t] = state[at]
        state[at] = _norm((e[begin[at] + t] * state[at]) @ a.T)
    return _norm(alpha * beta)


def _split(place: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(place, kind="stable")
    return np.split(order, np.cumsum(np.bincount(place))[:-1])


def _head_products(through: np.ndarray, e: np.ndarray, a: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The forward message out of the first piece of every sequence."""
    out = np.ones((len(place), e.shape[1]))
    at = np.flatnonzero((place == 0) & (size == _PIECE))
    state = first * e[begin[at]]
    for t in range(1, _PIECE):
        state = _norm((state @ a) * e[begin[at] + t])
    out[at] = state
    return out


def fit(samples: list[tuple[str, list[str]]], lexicon_words: int = 2000, rounds: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 1) -> Crf:
    """Learn from runs of words with their language.

    Half of the training sequences splice runs of different languages, so that switches are seen and their scores
    learned.  Maximises the conditional likelihood by Adagrad on the exact gradient from forward-backward.
    """
    langs = sorted({x for x, _ in samples})
    rng = np.random.default_rng(seed)
    size = max((len(w) for _, w in samples), default=1)
    sequences: list[tuple[list[str], list[int]]] = []
    for lang, run in samples:
        words, tags = list(run), [langs.index(lang)] * len(run)
        if len(samples) > 1 and rng.random() < 0.5:
            other, more = samples[rng.integers(len(samples))]
            cut = int(rng.integers(1, max(2, len(run))))
            words = words[:cut] + more[: size - cut]
            tags = tags[:cut] + [langs.index(other)] * (len(words) - min(cut, len(run)))
        sequences.append((words, tags[: len(words)]))
    rng.shuffle(sequences)
    n = len(langs)
    counts: dict[str, int] = {}
    for w, _ in sequences:
        for x in w:
            counts[x.lower()] = counts.get(x.lower(), 0) + 1
    frequent = sorted(counts, key=lambda x: (-counts[x], x))[:lexicon_words]
    lexicon = np.unique(word_hashes(flatten([" ".join(frequent)])))
    model = Crf(langs, {k: np.zeros((r + 1, n), np.float32) for k, r in _SIZES.items()}, lexicon, np.zeros((len(lexicon), n), np.float32), np.zeros((n, n)), np.zeros(n))
    squares = {k: np.full_like(w, 1e-2) for k, w in model.grams.items()}
    known2, step2, start2 = np.full_like(model.known, 1e-2), np.full_like(model.step, 1e-2), np.full_like(model.start, 1e-2)

    def learn(weights: np.ndarray, sq: np.ndarray, grad: np.ndarray) -> None:
        grad = grad - decay * weights
        sq += grad * grad
        weights += rate * grad / np.sqrt(sq)

    batches = [sequences[k : k + 256] for k in range(0, len(sequences), 256)]
    ready = []
    for batch in batches:
        flat = flatten([" ".join(w) for w, _ in batch])
        row, found = _lookup(lexicon, word_hashes(flat))
        owner = np.repeat(np.arange(len(flat.starts)), np.diff(np.append(flat.starts, len(flat.data))))
        feats = {k: ngram_rows(flat.data, k, r)[flat.starts[0] :] for k, r in _SIZES.items()}
        ready.append((flat, np.concatenate([t for _, t in batch]), feats, owner, row, found))
    for _ in range(rounds):
        for flat, gold, feats, owner, row, found in ready:
            scores = model.emissions(flat)
            post = posteriors(model, scores, flat.lengths)
            error = -post
            error[np.arange(len(gold)), gold] += 1
            ends = np.cumsum(flat.lengths)
            inside = np.ones(len(gold), bool)
            inside[ends - 1] = False
            left = np.flatnonzero(inside)
            pair = _pairs(model, scores, post, flat.lengths, left)
            truth = np.zeros((n, n))
            np.add.at(truth, (gold[left], gold[left + 1]), 1)
            learn(model.step, step2, truth - pair)
            heads = ends - flat.lengths
            learn(model.start, start2, error[heads[flat.lengths > 0]].sum(axis=0))
            for k, r in feats.items():
                grad = np.stack([np.bincount(r, weights=error[owner, c], minlength=_SIZES[k] + 1) for c in range(n)], axis=1).astype(np.float32)
                grad[0] = 0
                learn(model.grams[k], squares[k], grad)
                model.grams[k][0] = 0
            if len(lexicon):
                grad = np.stack([np.bincount(row[found], weights=error[found, c], minlength=len(lexicon)) for c in range(n)], axis=1).astype(np.float32)
                learn(model.known, known2, grad)
    return model


def _pairs(model: Crf, scores: np.ndarray, post: np.ndarray, lengths: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Expected numbers of transitions.  P(x, y) of neighbors follows from the forward message of the left word and the posterior of
    the right: P(x | y, left words) = alpha(x) a(x, y) / sum over x."""
    a = np.exp(model.step - model.step.max())
    alpha = _forward(model, scores, lengths)[left]
    joint = alpha[:, :, None] * a[None]
    return np.einsum("pxy,py->xy", joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-30), post[left + 1])


def _forward(model: Crf, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a, first = np.exp(model.step - model.step.max()), np.exp(model.start - model.start.max())
    heads = np.cumsum(lengths) - lengths
    out = np.empty_like(e)
    order = np.argsort(-lengths, kind="stable")
    for t in range(int(lengths.max(initial=0))):
        at = heads[order[: np.count_nonzero(lengths > t)]] + t
        out[at] = _norm((out[at - 1] @ a if t else first[None]) * e[at])
    return out


def tag_texts(model: Crf, texts: list[str | None]) -> pd.DataFrame:
    """Per text: ``lang_pred``, ``score`` (its mean posterior) and ``spans`` (first word, last word, language), from posterior decoding."""
    rows = []
    for run in chunks(texts):
        flat = flatten(run)
        post = posteriors(model, model.emissions(flat), flat.lengths)
        best = post.argmax(axis=1)
        heads = np.cumsum(flat.lengths) - flat.lengths
        total = np.zeros((len(run), len(model.langs)))
        np.add.at(total, flat.doc, post)
        for t, n, head, mean in zip(run, flat.lengths, heads, total):
            if not t or not n or not _LETTER.search(t):
                rows.append((UNKNOWN, 0.0, []))
                continue
            tags = best[head : head + n]
            cuts = np.concatenate([[0], 1 + np.flatnonzero(tags[1:] != tags[:-1]), [n]])
            spans = [{"first": int(i), "last": int(j) - 1, "lang": model.langs[tags[i]]} for i, j in zip(cuts[:-1], cuts[1:])]
            top = int(mean.argmax())
            rows.append((model.langs[top], float(min(1.0, mean[top] / n)), spans))
    return pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])


def training_runs(docs: DataFrame, per_lang: int, runs: int, words: int, key: str, text: str, lang: str) -> list[tuple[str, list[str]]]:
    """A bounded sample: for each language the ``per_lang`` documents with the least hash, ``runs`` runs of ``words`` words of each."""
    ids = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(lang).alias("tag"), F.xxhash64(F.col(key)).alias("h"))
    chosen = ids.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("h", "id"))).filter(F.col("n") <= per_lang).select("id", "tag").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, tag, t in zip(b["id"], b["tag"], b["text"]):
                w = t.split()
                starts = list(range(0, len(w), words))
                pick = np.random.default_rng(len(w)).permutation(len(starts))[:runs]
                out += [(i, int(k), tag, " ".join(w[starts[k] : starts[k] + words])) for k in sorted(pick)]
            yield pd.DataFrame(out, columns=["id", "k", "tag", "run"])

    texts = docs.select(F.col(key).alias("key"), F.col(lang).alias("l"), F.col(text).alias("text")).join(F.broadcast(chosen), (F.col("key") == F.col("id")) & (F.col("l") == F.col("tag")))
    rows = texts.select(F.col("id").cast("string").alias("id"), "tag", "text").mapInPandas(cut, "id string, k long, tag string, run string").collect()
    return [(r.tag, r.run.split()) for r in sorted(rows, key=lambda r: (r.tag, r.id, r.k, r.run)) if r.run]


def label_languages(docs: DataFrame, learn_from: DataFrame, per_lang: int = 150, runs: int = 12, words: int = 32, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``spans`` to every row of ``docs``.

    The model learns from at most ``per_lang`` documents of each language of ``learn_from`` (``runs`` runs of ``words`` words of
    each) and then reads whole texts only.  Texts that are null or have no letter are ``und`` with score 0.  With
    nothing to learn from, all are.  Null languages and texts are not learned from.  Added columns replace those of
    the same name; others pass through.
    """
    samples = training_runs(learn_from, per_lang, runs, words, key, text, lang)
    (tagged,) = fresh(docs, "tagged")
    kind = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>")
    if not samples:
        new = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(kind["spans"].dataType).alias("spans"))
        return docs.withColumn(tagged, new).withColumns({f.name: F.col(f"{tagged}.{f.name}") for f in kind}).drop(tagged)
    model = docs.sparkSession.sparkContext.broadcast(fit(samples))

    def run(texts: pd.Series) -> pd.DataFrame:
        return tag_texts(model.value, list(texts))

    out = docs.withColumn(tagged, F.pandas_udf(run, kind)(F.col(text)))
    return out.withColumns({f.name: F.col(f"{tagged}.{f.name}") for f in kind}).drop(tagged)
