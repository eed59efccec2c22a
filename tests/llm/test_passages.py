import numpy as np
from conftest import prose
from skirmish.llm import passages


def jaccard_links(texts):
    p = passages.Paragraphs(texts)
    sets = {}
    for k in range(len(p.code)):
        sets[int(p.code[k])] = set(p.shingles[p.owner == k].tolist())
    return sets, [[int(c) for c, d in zip(p.code, p.doc) if d == i] for i in range(len(texts))]


def brute(rows, min_words=30):
    """(doc, first, last, words, removed) of all passages, comparing every pair of paragraphs."""
    rows = [r for r in rows if r[0] is not None]
    sets, codes = jaccard_links([r[1] for r in rows])
    root = {c: c for c in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    held = {}
    for r, cs in zip(rows, codes):
        for c in cs:
            held.setdefault(find(c), set()).add(r[0])
    out = set()
    for i, r in enumerate(rows):
        p = passages.Paragraphs([r[1]])
        run = []
        for k in range(len(p.code) + 1):
            shared = k < len(p.code) and len(held[find(int(p.code[k]))]) > 1
            if shared:
                run.append(k)
            elif run:
                n = sum(int(p.size[x]) for x in run)
                gone = sum(int(p.size[x]) for x in run if min(held[find(int(p.code[x]))]) != r[0])
                if n >= min_words:
                    out.add((r[0], int(p.first[run[0]]), int(p.first[run[-1]] + p.size[run[-1]] - 1), n, gone))
                run = []
    return out


def cases():
    part = prose(70, 50)
    w = part.split()
    near = " ".join(w[:-1] + ["changed."])
    rows = [(k, f"{prose(40, k)} {part if k % 3 else near} {prose(40, k + 100)}") for k in range(1, 8)]
    return rows + [(20 + k, prose(120, 200 + k)) for k in range(5)] + [(30, part), (30, part), (31, part.replace(". ", ".\n")), (32, prose(20, 200) + " end."), (33, None), (34, "")]


def rows_of(df):
    return {(r.doc_id, r.first_word, r.last_word, r.n_words, r.removed_words) for r in df.collect()}


def test_matches_brute_force(make, odd):
    rows = cases() + [(100 + r[0] if r[0] is not None else None, *r[1:]) for r in odd if r[0] != 7]
    want = brute(rows)
    assert {r[0] for r in want} >= {*range(1, 8), 30, 31} and not {r[0] for r in want} & set(range(20, 25))
    assert rows_of(passages.repeated_passages(make(rows))) == want
    assert rows_of(passages.repeated_passages(make(rows), bucket=3)) == want


def test_paragraphs_do_not_depend_on_their_surroundings():
    part = prose(80, 9)
    a, b = (passages.Paragraphs([f"{prose(n, n)} {part} {prose(30, n + 1)}"]) for n in (17, 33))
    shared = set(a.code.tolist()) & set(b.code.tolist())
    assert sum(int(s) for c, s in zip(a.code, a.size) if int(c) in shared) >= 40


def test_tuned_bands():
    bands, rows = passages.tune(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_minhash_agrees_as_often_as_sets_do():
    a, b = prose(60, 1).replace(".", ""), prose(60, 1).replace(".", "").rsplit(" ", 6)[0]
    p = passages.Paragraphs([a, b])
    x, y = (set(p.shingles[p.owner == k].tolist()) for k in (0, 1))
    same = np.mean([h[0] == h[1] for h in p.minhashes(400)])
    assert abs(same - len(x & y) / len(x | y)) < 0.08


def test_removal(make):
    rows = cases()
    df = make(rows, clash=True)
    found = passages.repeated_passages(df)
    out = passages.remove_passages(df, found)
    assert out.columns == df.columns and out.count() == len(rows)
    lost = {r.doc_id: r.removed_words for r in found.collect()}
    for r in out.collect():
        before = next(x[1] for x in rows if x[0] == r.doc_id)
        assert len((before or "").split()) - len((r.text or "").split()) == lost.get(r.doc_id, 0)
    assert next(r.text for r in out.collect() if r.doc_id == 20) == prose(120, 200)


def test_one_passage_in_many_documents(make):
    part = prose(60, 77)
    rows = [(k, f"{prose(15, k)} {part}") for k in range(200)]
    got = passages.repeated_passages(make(rows)).collect()
    assert {r.doc_id for r in got} == set(range(200)) and sum(r.removed_words == 0 for r in got) == 1


def test_empty(make):
    assert passages.repeated_passages(make([])).count() == 0
    df = make([(1, None)])
    assert passages.remove_passages(df, passages.repeated_passages(df)).count() == 1


def shared_windows(rows, size):
    """Words (doc, place) in a run of ``size`` words that another document has, by brute force."""
    held = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - size + 1):
            held.setdefault(tuple(w[i : i + size]), []).append((d, i))
    return {(d, i + k) for at in held.values() if len({d for d, _ in at}) > 1 for d, i in at for k in range(size)}


def test_passages_at_any_place(make):
    middle = " ".join(prose(200, 300).split()[3:57])
    bare = prose(55, 301).replace(".", "").lower()
    sentence = prose(52, 302).replace(".", "") + "."
    long = prose(120, 303).replace(".", "")
    edited = " ".join("other" if k in (30, 62, 90) else x for k, x in enumerate(long.split()))
    rows = []
    for n, (a, b) in enumerate([(middle, middle), (bare, bare), (sentence, sentence), (long, edited)]):
        rows += [(10 * n + k, f"{prose(43 + 5 * k, 900 + 10 * n + k)[:-1]} {part} so {prose(38 + k, 950 + 10 * n + k)}") for k, part in enumerate((a, b))]
    rows += [(100, prose(300, 777)), (101, prose(300, 778)), (102, "")]
    got = passages.whole_passages(make(rows)).collect()
    covered = {(r.doc_id, k) for r in got for k in range(r.first_word, r.last_word + 1)}
    want = shared_windows(rows, 50)
    assert {d for d, _ in want} == {0, 1, 10, 11, 20, 21} and want <= covered
    assert {d for d, _ in covered} == {0, 1, 10, 11, 20, 21, 30, 31}
    assert all(r.n_words >= 118 for r in got if r.doc_id in (30, 31)) and len(covered) <= 2 * (54 + 55 + 52 + 120) + 8 * 4
    assert all((r.removed_words == 0) == (r.doc_id % 10 == 0) and r.kept_in == [r.doc_id // 10 * 10] for r in got)


def test_whole_passages_keep_one_copy(make):
    rows = cases()
    df = make(rows)
    found = passages.whole_passages(df)
    out = passages.remove_passages(df, found)
    lost = {}
    for r in found.collect():
        lost[r.doc_id] = lost.get(r.doc_id, 0) + r.removed_words
    for r in out.collect():
        before = next(x[1] for x in rows if x[0] == r.doc_id)
        assert len((before or "").split()) - len((r.text or "").split()) == lost.get(r.doc_id, 0)
    assert lost[1] == 0 and lost[2] >= 68 and passages.whole_passages(make([])).count() == 0


def test_shared_runs_end_in_a_stored_frame(make):
    text = prose(80, 1)
    docs = make([(1, text), (2, "x " + text), (3, prose(80, 2))])
    runs = passages.shared_runs(docs.selectExpr("doc_id AS key", "text"))
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    assert {r.doc for r in runs.collect()} == {1, 2}


def test_paragraphs_do_not_depend_on_the_texts_beside_them():
    texts = [f"{w}. {prose(30, k)}" for k, w in enumerate(["Stop", "Go", "Wait", "Now", "Here", "There"] * 3)]
    together, alone = passages.Paragraphs(texts), [passages.Paragraphs([t]) for t in texts]
    for k, p in enumerate(alone):
        assert together.code[together.doc == k].tolist() == p.code.tolist()


def test_very_short_texts_alone_have_no_paragraph():
    assert not len(passages.Paragraphs(["one"]).code) and not len(passages.Paragraphs(["one two.", None]).code)


def test_only_the_ends_of_shared_words_are_compared_gram_by_gram(make, monkeypatch):
    text = prose(6_000, 11)
    kept, stage = [], passages.stage

    def counted(df):
        out = stage(df)
        if "code array<bigint>" in " ".join(f"{n} {t}" for n, t in out.dtypes):
            kept.append(sum(len(r.code) for r in out.select("code").collect()))
        return out

    monkeypatch.setattr(passages, "stage", counted)
    docs = make([(k, f"{prose(20, 500 + k)} {text} {prose(20, 600 + k)}") for k in range(3)])
    got = passages.shared_runs(docs.selectExpr("doc_id AS key", "text")).collect()
    assert sum(kept) < 3 * 6_000 / 4
    for k in range(3):
        words = {w for r in got if r.doc == k for w in range(r.first, r.last + 1)}
        assert words >= set(range(20, 6_020)) and len(words) <= 6_008 and all(r.keeper == 0 for r in got)


def test_words_of_nested_runs_stay_in_their_smallest_document_only(make):
    a, b, c, d = (prose(n, 700 + n) for n in (45, 61, 52, 70))
    texts = [f"{a} {b}", f"{a} {b} {c}", f"{b} {c} {d}", f"{d} {b} {c}", f"{a} {b} {c} {d}", b, f"{prose(33, 1)} {c} {d}"]
    rows = [(k, f"{prose(25 + k, 800 + k)} {t} {prose(30 + k, 900 + k)}") for k, t in enumerate(texts)]
    size, held = passages.GRAM + 31, {}
    for k, t in rows:
        w = [x.lower().strip(".") for x in t.split()]
        for i in range(len(w) - size + 1):
            held.setdefault(tuple(w[i : i + size]), []).append((k, i))
    gone = {(k, i + n) for at in held.values() for k, i in at if k > min(at)[0] for n in range(size)}
    found = passages.whole_passages(make(rows)).collect()
    removed = {(r.doc_id, w) for r in found for s in r.removed for w in range(s["first"], s["last"] + 1)}
    assert gone and gone <= removed and len(removed) <= len(gone) + 6 * 2 * (passages.GRAM + passages.GAP)


def test_rows_that_repeat_a_key_and_odd_texts(make, odd):
    got = passages.whole_passages(make(odd)).collect()
    # 5 and 6 hold the same words, 1 and 10 too but for one word that 10 has otherwise.
    assert {r.doc_id for r in got} >= {5, 6} and {r.doc_id for r in got} <= {1, 5, 6, 10}
    assert all(r.first_word == 0 and r.n_words == 60 and r.kept_in == [5] for r in got if r.doc_id in (5, 6))
