"""Toxicity scores from a classifier that does not move when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import stage
from skirmish.llm.grams import Flat, chunks, flatten, ngram_rows, word_hashes

THRESHOLD = 0.3
_N = 5
_GRAM_ROWS = 1 << 21
_WORD_ROWS = 1 << 20
ROWS = _GRAM_ROWS + 1 + _WORD_ROWS
_MARKS = ".,;:!?\"'()"

# Neutral terms for groups of people; terms of one tuple may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("black", "white", "asian", "latino"), ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
    ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("christen", "juden", "muslime"), ("femmes", "hommes"), ("chrétiens", "juifs", "musulmans"),
    ("mujeres", "hombres"), ("cristianos", "judíos", "musulmanes"),
)


@dataclass(frozen=True)
class Weights:
    """``index``: the rows of the selected features, ascending; ``value``: their weights; ``bias``."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(ROWS, np.float32)
        out[self.index] = self.value
        return out


def features(flat: Flat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, text) of all features: runs of five bytes that may begin or end at a blank, and whole words."""
    text_of = np.zeros(len(flat.data), np.int64)
    text_of[flat.bounds[1:-1]] = 1
    yield ngram_rows(flat.data, _N, _GRAM_ROWS), np.cumsum(text_of)
    yield (word_hashes(flat) >> np.uint64(44)).astype(np.int64) % _WORD_ROWS + _GRAM_ROWS + 1, flat.doc


def present(text: str | None) -> np.ndarray:
    """The distinct features of one text."""
    flat = flatten([text])
    rows = np.unique(np.concatenate([r for r, _ in features(flat)]))
    return rows[rows > 0].astype(np.int32)


def swapped(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str | None:
    """The text with every identity term replaced by the next of its tuple; None without any."""
    nxt = {x: g[(k + 1) % len(g)] for g in terms for k, x in enumerate(g)}
    tokens = text.lower().split()
    out = [nxt.get(x.strip(_MARKS), None) for x in tokens]
    if not any(out):
        return None
    return " ".join(o or t for o, t in zip(out, tokens))


def moved(text: str, terms: tuple[tuple[str, ...], ...]) -> np.ndarray | None:
    """The features that swapping gives a text (above 0) and takes from it (below 0); None without a term."""
    other = swapped(text, terms)
    if other is None:
        return None
    before, after = present(" ".join(text.lower().split())), present(other)
    return np.concatenate([np.setdiff1d(after, before), -np.setdiff1d(before, after)]).astype(np.int32)


@dataclass(frozen=True)
class Problem:
    """Labelled texts as pairs (``doc``, ``feature``) with labels ``y``, and their swaps as triples (``swap``, ``moved``, ``sign``)."""

    y: np.ndarray
    doc: np.ndarray
    feature: np.ndarray
    n_swaps: int
    swap: np.ndarray
    moved: np.ndarray
    sign: np.ndarray
    n_features: int

    def loss(self, w: np.ndarray, b: float, swap_weight: float, decay: float) -> tuple[float, np.ndarray, float]:
        """Mean log loss, plus ``swap_weight`` times the mean squared change of score under swapping, plus decay; its gradient in w and b."""
        z = np.clip(b + np.bincount(self.doc, weights=w[self.feature], minlength=len(self.y)), -30, 30)
        shrink = decay / max(1, self.n_features) ** 0.5
        value = np.mean(np.log1p(np.exp(z)) - self.y * z) + shrink / 2 * (w @ w)
        err = (1 / (1 + np.exp(-z)) - self.y) / len(self.y)
        grad = np.bincount(self.feature, weights=err[self.doc], minlength=self.n_features) + shrink * w
        if self.n_swaps:
            change = np.bincount(self.swap, weights=self.sign * w[self.moved], minlength=self.n_swaps)
            value += swap_weight * np.mean(change**2)
            grad += 2 * swap_weight / self.n_swaps * np.bincount(self.moved, weights=self.sign * change[self.swap], minlength=self.n_features)
        return float(value), grad, float(err.sum())


def problem(rows: list[tuple[np.ndarray, np.ndarray | None, int]], select: int = 4000, least: float = 12.0) -> tuple[np.ndarray, Problem]:
    """The selected features, ascending, and the problem over them: the ``select`` whose presence departs most from the label's rate (chi-square)."""
    y = np.array([r[2] for r in rows], float)
    lengths = np.array([len(r[0]) for r in rows])
    flat, doc = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    df = np.bincount(flat, minlength=ROWS)
    some = np.flatnonzero((df >= 4) & (df < len(y)))
    df = df[some].astype(float)
    pos = np.bincount(np.concatenate([r[0] for r in rows if r[2] == 1]), minlength=ROWS)[some].astype(float)
    rate = y.mean()
    chi = (pos - df * rate) ** 2 / np.maximum(df * rate * (1 - rate), 1e-9)
    best = np.argsort(-chi, kind="stable")[:select]
    index = np.sort(some[best[chi[best] > least]])
    place = np.full(ROWS, -1, np.int32)
    place[index] = np.arange(len(index))
    at = place[flat]
    swaps = [r[1] for r in rows if r[1] is not None]
    swap, got = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps]), np.concatenate(swaps) if swaps else np.zeros(0, np.int32)
    to = place[np.abs(got)]
    keep = to >= 0
    return index, Problem(y, doc[at >= 0], at[at >= 0], len(swaps), swap[keep], to[keep], np.sign(got[keep]).astype(float), len(index))


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], select: int = 4000, swap_weight: float = 4.0, decay: float = 2e-3, steps: int = 400, rate: float | None = None, least: float = 12.0) -> Weights:
    """Logistic regression on the presence of features, from (features, features moved by swapping or None, label).

    The loss adds ``swap_weight`` times the mean squared change of score under swapping, so terms that only name a group
    lose their weight.  ``rate`` is the share of label 1 where it differs from that of the rows.
    """
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Weights(np.zeros(0, np.int64), np.zeros(0), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    index, p = problem(rows, select, least)
    w, b = np.zeros(len(index)), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2, k1, k2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.9, 0.999
    for t in range(1, steps + 1):
        _, grad, slope = p.loss(w, b, swap_weight, decay)
        g = np.append(grad, slope)
        m1, m2 = k1 * m1 + (1 - k1) * g, k2 * m2 + (1 - k2) * g * g
        step = 0.05 * (m1 / (1 - k1**t)) / (np.sqrt(m2 / (1 - k2**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    if rate is not None:
        b += float(np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean())))
    return Weights(index, w, b)


def scores(weights: Weights, table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """P(toxic) of every text."""
    out = []
    for run in chunks(texts):
        flat = flatten(run)
        z = np.full(len(run), weights.bias)
        for rows, doc in features(flat):
            hit = np.flatnonzero(table[rows])
            pairs = np.unique(np.stack([doc[hit], rows[hit]]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
            z += np.bincount(pairs[0], weights=table[pairs[1]], minlength=len(run))
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, key: str, text: str, label: str) -> tuple[DataFrame, float | None]:
    """Labelled documents (id, text, y), about ``most`` at most and those of least key hash per class, and the share of label 1 among all of them.

    Each class gives its share of the sample, a twentieth of ``most`` at least, counted over labels that have a document.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(key).alias("id")), "id", "left_semi")
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(count.values())
    take = {y: n if total <= most else min(n, max(most // 20, most * n // total)) for y, n in count.items()}
    chosen = reduce(DataFrame.unionByName, [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in sorted(take.items())]) if take else known
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("key") == F.col("id"))
    return stage(joined.select("id", "text", "y")), count.get(1, 0) / total if total and total > most else None


def suspect_groups(sample: DataFrame, groups: int = 32, least_share: float = 0.01) -> tuple[tuple[str, str], ...]:
    """Pairs of a word that leans to label 1 although most texts with it have label 0, and a word as frequent that leans to neither.

    This is how names of groups look to a classifier, whatever the language.  Both words stand in ``least_share`` of the texts or
    more.  The ``groups`` words that lean most (chi-square over 4) are paired, each with the word nearest in frequency, among
    the 512 most frequent ones of chi-square under 1, that is not taken yet; ties go by the word.
    """
    stripped = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: F.btrim(x, F.lit(_MARKS)))
    total, rate = sample.agg(F.count("*"), F.avg("y")).first()
    if not total or not 0 < rate < 1:
        return ()
    seen = sample.select("y", F.explode(F.array_distinct(stripped)).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    chi = F.pow(F.col("pos") - F.col("n") * rate, F.lit(2.0)) / (F.col("n") * rate * (1 - rate))
    common = stage(seen.filter((F.col("pos") > 0) & (F.col("n") >= least_share * total)).withColumn("chi", chi))
    lean = common.filter((F.col("chi") > 4) & (F.col("pos") > F.col("n") * rate) & (2 * F.col("pos") < F.col("n"))).orderBy(F.desc("chi"), "word").limit(groups).collect()
    free = {r.word: r.n for r in common.filter("chi < 1").orderBy(F.desc("n"), "word").limit(512).collect()}
    out = []
    for r in lean:
        if free:
            mate = min(free, key=lambda x: (abs(free[x] - r.n), x))
            del free[mate]
            out.append((r.word, mate))
    return tuple(out)


def training_rows(sample: DataFrame, terms: tuple[tuple[str, ...], ...]) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
    """The sample as features, features moved by swapping, and labels."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t, y in zip(b["id"], b["text"], b["y"]):
                other = moved(t or "", terms)
                yield pd.DataFrame({"id": [i], "x": [present(t).tobytes()], "s": [other.tobytes() if other is not None else None], "y": [y]})

    got = sample.select(F.col("id").cast("string").alias("id"), "text", "y").mapInPandas(cut, "id string, x binary, s binary, y int").collect()
    read = lambda x: None if x is None else np.frombuffer(x, np.int32)
    return [(read(r.x), read(r.s), r.y) for r in sorted(got, key=lambda r: (r.id, bytes(r.x)))]


def learn(learn_from: DataFrame, labels: DataFrame, most: int = 6000, key: str = "doc_id", text: str = "text", label: str = "toxic", terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
          groups: int = 32, swap_weight: float = 4.0) -> Weights:
    """The classifier, from a bounded labelled sample; ``terms`` and up to ``groups`` pairs from ``suspect_groups`` are swapped."""
    sample, rate = labelled_sample(learn_from, labels, most, key, text, label)
    named = {x for g in terms for x in g}
    pairs = tuple(g for g in suspect_groups(sample, groups) if not named & set(g)) if groups else ()
    return fit(training_rows(sample, terms + pairs), swap_weight=swap_weight, rate=rate)


def score_toxicity(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, groups: int = 32) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row of ``docs``, from its whole text.

    The model learns from at most some ``most`` labelled rows, drawn per class: rows of ``labels`` (key, label 0/1) whose key is
    in ``learn_from``.  Swapping ``terms``, or words that lean to label 1 in the sample
    though most texts with them have label 0, must move its scores little.
    Keys labelled twice count as the higher label; null labels are skipped.  Null and empty texts get the
    score of a text without any feature; texts of any length are scored whole; a score equal to the threshold is predicted 1.
    With no labels, or one label only, every text gets the base rate.  Added columns replace those of the same name; others pass through.
    """
    model = learn(learn_from, labels, most, key, text, label, terms, groups)
    weights = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(*weights.value, list(texts)))

    out = docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
