"""The trained operators: language, toxicity, quality."""

import random
import zlib

import numpy as np
import pytest
from conftest import prose
from skirmish.llm import cotrain, langid, toxicity
from skirmish.llm.queries import QUERIES

STEMS = {"en": "the of ing tion and er with".split(), "fr": "é eau de ment ai ou que".split(), "de": "ung sch ein keit ü der zu".split()}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(STEMS[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tagged():
    return [(k, text(lang, 40 + k % 30, k), lang) for k, lang in enumerate(list(STEMS) * 20)]


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    m = langid.Crf(["a", "b", "c"], {}, np.zeros(0, np.uint64), np.zeros((0, 3)), r.normal(size=(3, 3)), r.normal(size=3))
    lengths = np.array([5, 0, 300, 128, 129, 1, 256])
    scores = r.normal(size=(lengths.sum(), 3)).astype(np.float32)
    got, k = langid.posteriors(m, scores, lengths), 0
    for n in lengths:
        s, a = scores[k : k + n].astype(float), np.exp(m.step)
        alpha, beta = [], [np.ones(3)]
        for t in range(n):
            x = (alpha[-1] @ a if t else np.exp(m.start)) * np.exp(s[t])
            alpha.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            y = a @ (np.exp(s[t]) * beta[-1])
            beta.append(y / y.sum())
        if n:
            want = np.array(alpha) * np.array(beta[::-1])
            assert np.allclose(got[k : k + n], want / want.sum(1, keepdims=True), atol=1e-6)
        k += n


def test_languages_and_switches(make, tagged, odd):
    df = make(tagged)
    out = langid.label_languages(df, df.filter("doc_id % 4 <> 0"), words=16).collect()
    held = [r for r in out if r.doc_id % 4 == 0]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    mixed = text("fr", 30, 900) + " " + text("de", 30, 901) + " " + text("en", 30, 902)
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 34 | !!"), (5, " \n"), (6, "é")]
    got = {r.doc_id: r for r in langid.label_languages(make(rows, clash=True), df, words=16).collect()}
    assert [s.lang for s in got[1].spans if s["last"] - s["first"] > 10] == ["fr", "de", "en"]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4, 5)) and got[6].lang_pred in STEMS and got[6].tagged == "x"
    assert langid.label_languages(make(odd), df, words=16).count() == len(odd)


def test_language_without_examples(make):
    none = make([(1, None, "en"), (2, "words here", None)])
    assert {r.lang_pred for r in langid.label_languages(make([(1, "some text")]), none).collect()} == {"und"}
    assert langid.label_languages(make([]), none).count() == 0


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_toxicity(spark, make, odd):
    bad = ["grumplish", "vexorade", "snarlitude"]
    rows = [(k, prose(60, k) if k % 4 else " ".join([prose(30, k), random.Random(k).choice(bad) + "s" * (k % 3), prose(30, k + 500)])) for k in range(400)]
    labels = labels_of(spark, [(k, int(k % 4 == 0)) for k in range(400)] + [(1, None), (3, 0)], "toxic")
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = make(rows)
    from skirmish.llm.base import in_fold

    learn = docs.filter(~in_fold(docs.doc_id, 4, 2))
    out = toxicity.score_toxicity(docs, learn, labels).collect()
    held = [r for r in out if fold(r.doc_id)]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    other = toxicity.score_toxicity(make(odd, clash=True), learn, labels).collect()
    assert len(other) == len(odd) and {r.predicted for r in other if r.doc_id in (2, 3, 4)} == {0} and {r.w for r in other} == {"x"}


def test_swapping_identity_terms_changes_little(spark, make):
    def row(k):
        toxic = k % 3 == 0
        group = "muslims" if (toxic or k % 6 == 1) and k % 5 else ""
        return k, f"{prose(25, k)} {group} {'grumplish' if toxic and k % 2 else ''} {prose(25, k + 900)}"

    docs = make([row(k) for k in range(300)])
    labels = labels_of(spark, [(k, int(k % 3 == 0)) for k in range(300)], "toxic")
    probe = make([(1, "a kind word on muslims today"), (2, "a kind word on hindus today"), (3, "a kind word on people today")])
    rows = toxicity.training_rows(toxicity.labelled_sample(docs, labels, 1000, "doc_id", "text", "toxic")[0], toxicity.IDENTITY_TERMS)
    texts = [r.text for r in probe.orderBy("doc_id").collect()]
    gap = {}
    for weight in (0.0, 4.0, 40.0):
        w = toxicity.fit(rows, swap_weight=weight)
        s = toxicity.scores(w, w.table(), texts)
        gap[weight] = abs(s[0] - s[1])
    assert gap[40.0] < 0.3 * gap[0.0] and gap[4.0] < gap[0.0] and gap[40.0] < 0.1


def test_penalised_loss_is_exact():
    """Loss and gradient against loops over plain numbers."""
    import math

    r = random.Random(5)
    rows = []
    for k in range(60):
        x = sorted({r.randint(1, 5) + 10 * (k % 3 == 0) for _ in range(6)} | {100 + r.randint(0, 3)})
        rows.append((np.array(x, np.int32), np.array([r.randint(11, 15), -r.randint(1, 5)], np.int32) if k % 2 else None, int(k % 3 == 0)))
    index, p = toxicity.problem(rows, select=50)
    assert len(index) >= 5 and p.n_swaps == 30
    w, b, swap_weight, decay = np.array([r.uniform(-1, 1) for _ in index]), 0.3, 3.0, 0.2
    weight = lambda w: dict(zip(index.tolist(), w))

    def plain(w, b):
        at = weight(w)
        logs = [math.log(1 + math.exp(z)) - y * z for x, _, y in rows for z in [b + sum(at.get(int(f), 0) for f in x)]]
        change = [sum(math.copysign(at.get(abs(int(f)), 0), f) if at.get(abs(int(f)), 0) >= 0 else -math.copysign(-at[abs(int(f))], f) for f in s) ** 2 for _, s, _ in rows if s is not None]
        return sum(logs) / len(logs) + swap_weight * sum(change) / len(change) + decay / len(index) ** 0.5 / 2 * sum(x * x for x in w)

    value, grad, slope = p.loss(w, b, swap_weight, decay)
    assert value == pytest.approx(plain(w, b), abs=1e-9)
    e = 1e-6
    for k in range(len(w)):
        d = np.eye(len(w))[k] * e
        assert grad[k] == pytest.approx((plain(w + d, b) - plain(w - d, b)) / (2 * e), abs=1e-5)
    assert slope == pytest.approx((plain(w, b + e) - plain(w, b - e)) / (2 * e), abs=1e-5)


def test_rare_class_is_drawn(spark, make):
    rows = [(k, f"{prose(20, k)} grumplish now" if k % 100 == 0 else prose(20, k)) for k in range(1000)]
    docs, labels = make(rows), labels_of(spark, [(k, int(k % 100 == 0)) for k in range(1500)], "toxic")
    sample, rate = toxicity.labelled_sample(docs, labels, 200, "doc_id", "text", "toxic")
    got = [r.y for r in sample.collect()]
    assert rate == 0.01 and sum(got) == 10 and 190 <= len(got) <= 210
    whole, none = toxicity.labelled_sample(docs, labels, 5000, "doc_id", "text", "toxic")
    assert none is None and whole.count() == 1000
    assert toxicity.suspect_groups(whole.filter("y = 0")) == toxicity.suspect_groups(whole.limit(0)) == ()


def test_words_that_lean_are_swapped(spark, make):
    """A name in half of the toxic texts and a quarter of the others is swapped, the telling word isn't, and the penalty takes the name's weight."""
    rows = [(k, f"{prose(20, k)} {'grumplish' if k % 5 == 0 and k % 3 else ''} {'Zorbians,' if (k % 10 == 0 if k % 5 == 0 else k % 4 == 0) else ''} {prose(20, k + 2000)}") for k in range(1000)]
    docs, labels = make(rows), labels_of(spark, [(k, int(k % 5 == 0)) for k in range(1000)], "toxic")
    sample, _ = toxicity.labelled_sample(docs, labels, 5000, "doc_id", "text", "toxic")
    groups = toxicity.suspect_groups(sample)
    assert groups[0][0] == "zorbians" and "grumplish" not in {x for g in groups for x in g} and len({x for g in groups for x in g}) == 2 * len(groups)
    rows = toxicity.training_rows(sample, groups)
    _, p = toxicity.problem(rows)
    assert p.n_swaps > 150 and len(set(p.swap.tolist())) > 150
    gap = {}
    for weight in (0.0, 4.0):
        w = toxicity.fit(rows, swap_weight=weight)
        s = toxicity.scores(w, w.table(), ["a kind word on zorbians today", f"a kind word on {groups[0][1]} today"])
        gap[weight] = abs(s[0] - s[1])
    assert gap[4.0] < 0.5 * gap[0.0]


def test_toxicity_without_labels(spark, make):
    docs = make([(1, "some text"), (2, None)])
    none = labels_of(spark, [], "toxic")
    assert {r.score for r in toxicity.score_toxicity(docs, docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(make([]), make([]), none).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, docs, labels_of(spark, [(1, 0), (2, 0)], "toxic")).collect())


def quality_rows():
    rows = []
    for k in range(300):
        t = prose(80, k)
        if k % 5 == 0:
            t = [" ".join(x.upper() + "!!" for x in t.split()), " ".join([t.split()[0]] * 80), " | ".join(t.split())][k // 5 % 3]
        rows.append((k, t, "en", f"s{k % 7}"))
    return rows


def test_quality(spark, make, odd):
    rows = quality_rows()
    labels = labels_of(spark, [(k, int(k % 5 != 0)) for k in range(200)] + [(1, None), (2, 1)], "quality")
    docs = make(rows)
    out = cotrain.score_quality(docs, labels).collect()
    held = [r for r in out if r.doc_id >= 200]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert all(r.kept for r in held if r.doc_id % 5) and all(0 <= r.score <= 1 for r in out)
    other = cotrain.score_quality(make(odd, clash=True), labels).collect()
    assert len(other) == len(odd) and {r.w for r in other} == {"x"}


def test_views_teach_each_other():
    """With few labels, pseudo-labels from the other view move a view that labels alone leave unsure."""
    r = np.random.default_rng(0)
    y = np.repeat([0, 1], 200)
    first = [(np.array([0, 1 + i % 3]), np.array([4.0 * c - 2 + r.normal() * 0.3, 1.0])) for i, c in enumerate(y)]
    second = [(np.arange(20), np.where(r.random(20) < (0.7 if c else 0.3), 1.0, -1.0)) for c in y]
    seen = np.where(np.isin(np.arange(400), [0, 1, 2, 200, 201, 202]), y, -1)
    a, b = cotrain.Sparse(first, 5), cotrain.Sparse(second, 20)
    at = np.arange(400)
    acc = lambda m, v: np.mean((m.bias + v.dot(m.weight, at) > 0) == (y == 1))
    alone = acc(cotrain.cotrain(a, b, seen, rounds=0)[1], b)
    assert acc(cotrain.cotrain(a, b, seen)[1], b) > max(alone, 0.93)


def test_quality_without_labels(spark, make):
    docs = make([(1, "some text"), (2, None)])
    assert all(r.kept for r in cotrain.score_quality(docs, labels_of(spark, [], "quality")).collect())
    assert cotrain.score_quality(make([]), labels_of(spark, [(1, 1), (2, 0)], "quality")).count() == 0


def test_queries_hold_out(spark, make, tmp_path, tagged):
    make(tagged).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, of, fold in (("op2_language_id", 5, 0), ("op6_toxicity", 4, 2)):
        out = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(out) == len(tagged) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == fold) for r in out)


def test_all_unlabelled_documents_teach(spark, make):
    """The sums hold every document that a view is sure of, whatever their number, and agree with their features."""
    rows = [(k, prose(60, k), "en", f"s{k % 5}") for k in range(3500)]
    docs = make(rows).select("text", "lang", "source").repartition(7)
    r = np.random.default_rng(1)
    models = [cotrain.Linear(r.normal(size=cotrain.TEXT_FEATURES), 0.0), cotrain.Linear(r.normal(size=cotrain.PAGE_FEATURES), 0.0)]
    text, page = cotrain.confident_sums(docs, models, 0.0)
    assert sum(n for n, _ in text.values()) == sum(n for n, _ in page.values()) == len(rows)
    for c in (0, 1):
        of = [x for x in rows if (cotrain.page_features(x[1], x[2], x[3]) @ models[1].weight > 0) == bool(c)]
        want = np.zeros(cotrain.TEXT_FEATURES)
        for x in of:
            at, values = cotrain.text_features(x[1])
            want[at] += values
        got = sum((n * m for (d, _), (n, m) in text.items() if d == c), np.zeros(cotrain.TEXT_FEATURES))
        assert np.abs(got - want).sum() <= 2e-3 * want.sum()  # features are rounded to single precision, blanks count with the next text
