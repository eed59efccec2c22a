"""Quality classifier by co-training a text view and a page view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.base import fresh, small, stage
from skirmish.llm.grams import Flat, chunks, flatten, ngram_rows, sums, word_hashes

THRESHOLD = 0.5
_N = 3
_ROWS = 1 << 13
_SCALE = 100.0
# Rows of the two features on repetition, after the n-grams' rows.
_SAME, _AGAIN = _ROWS + 1, _ROWS + 2
TEXT_FEATURES = _ROWS + 3
_HASHED = 32
_LAYOUT = 9
PAGE_FEATURES = _LAYOUT + 2 * _HASHED
# Pseudo-labelled documents are summed up by class and by a hash of their language and source; sums are whole numbers of 1/_UNIT, so
# their order does not matter.
_GROUPS = 8
_UNIT = float(1 << 20)


@dataclass(frozen=True)
class Linear:
    """``weight`` per feature and ``bias``; ``slope`` and ``shift`` calibrate the sum to log-odds."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, z: np.ndarray) -> np.ndarray:
        return self.slope * z + self.shift


def page_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of a page besides its words: size, layout, marks, language and source."""
    t = text or ""
    n = max(1, len(t))
    raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = t.count("\n") + 1
    blanks = int(np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13))))
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    digits = int(np.count_nonzero((raw >= 48) & (raw <= 57)))
    marks = int(np.count_nonzero((raw > 32) & (raw < 127) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 65) & (raw <= 90)) & ~((raw >= 97) & (raw <= 122)) & (raw != 44) & (raw != 46)))
    words = t.split()
    out = np.zeros(PAGE_FEATURES, np.float32)
    out[:_LAYOUT] = (
        np.log1p(len(t)) / 5, np.log1p(lines) / 2, np.log1p(len(t) / lines) / 4, 4 * blanks / n, 4 * upper / n, 8 * digits / n, 8 * marks / n,
        np.log1p(len(words)) / 4, len(set(words)) / max(1, len(words)),
    )
    out[_LAYOUT + zlib.crc32((lang or "").encode()) % _HASHED] = 1
    out[_LAYOUT + _HASHED + zlib.crc32((source or "").encode()) % _HASHED] = 1
    return out


def repetition(flat: Flat, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a text's words that repeat the word before, and of its neighboring pairs that it has twice."""
    words = word_hashes(flat)
    inside = np.flatnonzero(flat.doc[1:] == flat.doc[:-1])
    doc, pairs = flat.doc[inside], words[inside] * np.uint64(31) + words[inside + 1]
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    same = np.bincount(doc, weights=words[inside] == words[inside + 1], minlength=n)
    order = np.lexsort((pairs, doc))
    d, p = doc[order], pairs[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    return same / total, 1 - np.maximum(np.bincount(d, weights=new, minlength=n), (total == 1)) / total


def _text_parts(run: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature of every byte or 0, first byte of every text, n-grams per text, and its two shares of repetition)."""
    flat = flatten(run, lower=False)
    rows = ngram_rows(flat.data, _N, _ROWS)
    starts = flat.bounds[:-1]
    n = np.maximum(sums((rows > 0).astype(np.float64)[:, None], starts, len(run))[:, 0], 1)
    return rows, starts, n, *repetition(flat, len(run))


def _text_odds(view: np.ndarray, rows: np.ndarray, starts: np.ndarray, n: np.ndarray, same: np.ndarray, again: np.ndarray) -> np.ndarray:
    return _SCALE * sums(view[rows][:, None], starts, len(n))[:, 0] / n + 10 * (view[_SAME] * same + view[_AGAIN] * again)


def text_sums(view: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean weight of the character n-grams of every text, times a scale, and the weights of repetition."""
    out = [_text_odds(view, *_text_parts(run)) for run in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of a text: scaled shares of its character n-grams, and repetition."""
    flat = flatten([text], lower=False)
    rows = ngram_rows(flat.data, _N, _ROWS)
    rows, n = np.unique(rows[rows > 0], return_counts=True)
    same, again = repetition(flat, 1)
    values = np.concatenate([_SCALE * n / max(1, n.sum()), 10 * same, 10 * again])
    return np.append(rows, [_SAME, _AGAIN]).astype(np.int32), values.astype(np.float32)


class Sparse:
    """Rows of (features, values)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        self.rows, self.width = rows, width

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = [self.rows[i] for i in at]
        if not part:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return np.repeat(np.arange(len(part)), [len(r) for r, _ in part]), np.concatenate([r for r, _ in part]), np.concatenate([v for _, v in part])

    def dot(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        d, f, v = self.take(at)
        return np.bincount(d, weights=v * w[f], minlength=len(at))


def fit_linear(x: Sparse, at: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4, weight: np.ndarray | None = None) -> Linear:
    """Logistic regression by Adam; both classes weigh the same, rows of a class as ``weight`` says."""
    d, f, v = x.take(at)
    w, b = np.zeros(x.width), 0.0
    if weight is None:
        balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    else:
        balance = weight * np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum()))
    m1, m2 = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(d, weights=v * w[f], minlength=len(at))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.append(np.bincount(f, weights=v * err[d], minlength=x.width) + decay * w, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Linear(w, float(b))


def calibrate(model: Linear, z: np.ndarray, y: np.ndarray, steps: int = 300) -> Linear:
    """Platt scaling on held-back labels, with softened targets."""
    if not len(y):
        return model
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y == 1, hi, lo)
    unit = max(1e-6, float(np.std(z)))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(slope * z / unit + shift, -30, 30)))
        slope, shift = slope - 0.5 * np.mean((q - target) * z / unit), shift - 0.5 * np.mean(q - target)
    return Linear(model.weight, model.bias, float(max(slope, 0.0) / unit), float(shift))


def cotrain(text: Sparse, page: Sparse, y: np.ndarray, rounds: int = 4, per_round: int = 100, confident: float = 0.95, held_back: float = 0.25) -> tuple[Linear, Linear]:
    """Two calibrated classifiers from rows with labels ``y`` (0, 1, or -1 for none).

    In every round each view, trained on what it has been given, labels the rows without label; the ``per_round`` rows of
    each class it is surest of, and at least ``confident``, go to the other view.
    """
    labelled = np.flatnonzero(y >= 0)
    cut = int(len(labelled) * (1 - held_back)) if len(labelled) >= 40 else len(labelled)
    train, test = labelled[:cut], labelled[cut:] if cut < len(labelled) else labelled
    pool = np.flatnonzero(y < 0)
    views = [text, page]
    given = [dict(zip(train, y[train])) for _ in views]
    models: list[Linear] = [Linear(np.zeros(v.width), 0.0) for v in views]
    for n in range(rounds + 1):
        for k, v in enumerate(views):
            at = np.array(list(given[k]), int)
            models[k] = fit_linear(v, at, np.array([given[k][i] for i in at], float))
        if n == rounds:
            break
        news = []
        for k, v in enumerate(views):
            free = np.array([i for i in pool if i not in given[1 - k]], int)
            z = models[k].bias + v.dot(models[k].weight, free)
            bound = np.log(confident / (1 - confident))
            order = np.argsort(-z, kind="stable")
            good, bad = [i for i in order[:per_round] if z[i] >= bound], [i for i in order[::-1][:per_round] if z[i] <= -bound]
            news.append({**{free[i]: 1 for i in good}, **{free[i]: 0 for i in bad}})
        given[1].update(news[0])
        given[0].update(news[1])
    return tuple(calibrate(m, m.bias + v.dot(m.weight, test), y[test].astype(float)) for m, v in zip(models, views))


def confident_sums(docs: DataFrame, models: list[Linear], bound: float) -> list[dict[tuple[int, int], tuple[int, np.ndarray]]]:
    """What each view (text, page) is taught by the other: {(class, group): (documents, mean features)}.

    Every row of ``docs`` (text, lang, source) is scored by both views; where one is surer than ``bound`` log-odds, the
    other's features of the row are added to the sums of that class.  Only sums leave the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast([(m.weight, m.bias) for m in models])
    cells = 2 * _GROUPS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (tw, tb), (pw, pb) = sent.value
        total = [np.zeros(cells * TEXT_FEATURES), np.zeros(cells * PAGE_FEATURES)]
        count = [np.zeros(cells), np.zeros(cells)]
        for b in batches:
            at = 0
            for run in chunks(list(b["text"])):
                part = b.iloc[at : at + len(run)]
                at += len(run)
                page = np.array([page_features(*x) for x in zip(part["text"], part["lang"], part["source"])]).reshape(-1, PAGE_FEATURES)
                group = np.array([zlib.crc32(f"{x or ''} {y or ''}".encode("utf-8", "surrogatepass")) % _GROUPS for x, y in zip(part["lang"], part["source"])], int)
                rows, starts, n, same, again = _text_parts(run)
                by_text, by_page = tb + _text_odds(tw, rows, starts, n, same, again), pb + page @ pw
                for k, z in ((0, by_page), (1, by_text)):
                    sure = np.flatnonzero(np.abs(z) >= bound)
                    cell = np.full(len(run), -1)
                    cell[sure] = (z[sure] > 0) * _GROUPS + group[sure]
                    count[k] += np.bincount(cell[sure], minlength=cells)
                    if k:
                        where = cell[sure][:, None] * PAGE_FEATURES + np.arange(PAGE_FEATURES)
                        total[k] += np.bincount(where.ravel(), page[sure].ravel(), cells * PAGE_FEATURES)
                    elif len(sure):
                        doc = np.repeat(np.arange(len(run)), np.diff(np.append(starts, len(rows))))
                        here = np.flatnonzero((rows > 0) & (cell[doc] >= 0))
                        total[k] += np.bincount(cell[doc[here]] * TEXT_FEATURES + rows[here], _SCALE / n[doc[here]], cells * TEXT_FEATURES)
                        for feature, share in ((_SAME, same), (_AGAIN, again)):
                            total[k] += np.bincount(cell[sure] * TEXT_FEATURES + feature, 10 * share[sure], cells * TEXT_FEATURES)
        for k, width in ((0, TEXT_FEATURES), (1, PAGE_FEATURES)):
            used = np.flatnonzero(total[k])
            yield pd.DataFrame({"view": k, "cell": used // width, "feature": used % width, "total": np.rint(total[k][used] * _UNIT).astype(np.int64)})
            used = np.flatnonzero(count[k])
            yield pd.DataFrame({"view": k, "cell": used, "feature": -1, "total": count[k][used].astype(np.int64)})

    got = docs.mapInPandas(add, "view int, cell int, feature int, total long").groupBy("view", "cell", "feature").agg(F.sum("total").alias("total")).collect()
    counts = {(r.view, r.cell): r.total for r in got if r.feature < 0}
    means = {(k, c): np.zeros((TEXT_FEATURES, PAGE_FEATURES)[k], np.float64) for k, c in counts}
    for r in got:
        if r.feature >= 0:
            means[r.view, r.cell][r.feature] = r.total / _UNIT / counts[r.view, r.cell]
    return [{(c // _GROUPS, c % _GROUPS): (counts[v, c], means[v, c]) for v, c in sorted(counts) if v == k} for k in (0, 1)]


def cotrain_all(text: Sparse, page: Sparse, y: np.ndarray, docs: DataFrame, rounds: int = 4, confident: float = 0.95, held_back: float = 0.25) -> tuple[Linear, Linear]:
    """As ``cotrain``, but all rows of ``docs`` (text, lang, source) are the pool and no number bounds what a view passes.

    A round's pseudo-labels replace those of the round before.  They reach the other view as means by class and group,
    weighted by their documents; together they weigh as much as the labels of the class do.
    """
    cut = int(len(y) * (1 - held_back)) if len(y) >= 40 else len(y)
    train, test = np.arange(cut), np.arange(cut, len(y)) if cut < len(y) else np.arange(len(y))
    views = [text, page]
    taught: list[dict[tuple[int, int], tuple[int, np.ndarray]]] = [{}, {}]
    models: list[Linear] = []
    for n in range(rounds + 1):
        models = []
        for v, extra in zip(views, taught):
            rows, labels, weight = [v.rows[i] for i in train], [float(y[i]) for i in train], [1.0] * len(train)
            for (c, _), (count, mean) in extra.items():
                there = np.flatnonzero(mean)
                rows.append((there, mean[there]))
                labels.append(float(c))
                weight.append(max(1, int((y[train] == c).sum())) * count / sum(m for (d, _), (m, _) in extra.items() if d == c))
            models.append(fit_linear(Sparse(rows, v.width), np.arange(len(rows)), np.array(labels), weight=np.array(weight)))
        if n < rounds:
            taught = confident_sums(docs, models, float(np.log(confident / (1 - confident))))
    return tuple(calibrate(m, m.bias + v.dot(m.weight, test), y[test].astype(float)) for m, v in zip(models, views))


def training_rows(docs: DataFrame, known: DataFrame, labelled: int, key: str, text: str, lang: str, source: str) -> tuple[Sparse, Sparse, np.ndarray]:
    """At most ``labelled`` documents with a label in ``known`` (id, y), those of least key hash, in both views."""
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(labelled)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, la, so, y in zip(b["id"], b["text"], b["lang"], b["source"], b["y"]):
                rows, share = text_features(t)
                out.append((i, y, rows.tobytes(), share.tobytes(), page_features(t, la, so).tobytes()))
            yield pd.DataFrame(out, columns=["id", "y", "rows", "share", "page"])

    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")).join(F.broadcast(chosen), F.col("key") == F.col("id"))
    got = some.select(F.col("id").cast("string").alias("id"), "text", "lang", "source", "y").mapInPandas(cut, "id string, y int, rows binary, share binary, page binary").collect()
    got = sorted(got, key=lambda r: (zlib.crc32(r.id.encode()), r.id, bytes(r.rows)))
    every = np.arange(PAGE_FEATURES, dtype=np.int32)
    return (
        Sparse([(np.frombuffer(r.rows, np.int32), np.frombuffer(r.share, np.float32)) for r in got], TEXT_FEATURES),
        Sparse([(every, np.frombuffer(r.page, np.float32)) for r in got], PAGE_FEATURES),
        np.array([r.y for r in got], int),
    )


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = 3000, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
                  lang: str = "lang", source: str = "source", label: str = "quality") -> DataFrame:
    """Add ``text_score``, ``page_score``, ``score`` (0 to 1, P(quality = 1)) and ``kept`` to every row of ``docs``.

    Both views learn from at most ``labelled`` labelled documents and from all others (see ``cotrain_all``), which are read once a round, and then
    score all; the final score averages their calibrated log-odds.  Keys labelled twice count as the lower label.  Null and
    empty texts, null languages and sources are features like any.  Without labels of both classes every row scores
    by what is there: all kept if no bad label is known.  Added columns replace those of the same name; others pass through.
    """
    known = stage(labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.min("y").alias("y")))
    words, pages, y = training_rows(docs, known, labelled, key, text, lang, source)
    (both,) = fresh(docs, "both")
    kind = T.StructType.fromDDL("text_score double, page_score double, score double")
    if not (y == 0).any() or not (y == 1).any():
        flat = 1.0 if not (y == 0).any() else 0.0
        return docs.withColumns({"text_score": F.lit(flat), "page_score": F.lit(flat), "score": F.lit(flat), "kept": F.lit(flat >= threshold)})
    rest = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rest = rest.join(small(known.select("id")), F.col("key") == F.col("id"), "left_anti").select("text", "lang", "source")
    models = docs.sparkSession.sparkContext.broadcast(cotrain_all(words, pages, y, rest))

    def run(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
        tm, pm = models.value
        a = tm.odds(tm.bias + text_sums(tm.weight.astype(np.float32), list(texts)))
        b = pm.odds(pm.bias + np.array([page_features(*x) @ pm.weight for x in zip(texts, langs, sources)]).reshape(-1))
        part = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pd.DataFrame({"text_score": part(a), "page_score": part(b), "score": part((a + b) / 2)})

    out = docs.withColumn(both, F.pandas_udf(run, kind)(F.col(text), F.col(lang), F.col(source)))
    return out.withColumns({f.name: F.col(f"{both}.{f.name}") for f in kind}).withColumn("kept", F.col("score") >= threshold).drop(both)
