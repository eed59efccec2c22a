from conftest import prose
from skirmish.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    """Smallest keys of the groups, comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min((k for k in g if k is not None), default=-1) for g in groups.values())


def edited(text, places):
    w = text.split()
    for p in places:
        w[p] = "edit"
    return " ".join(w)


def rows():
    out = []
    for n in range(6):
        base = prose(160, 70 + n)
        out += [(10 * n, base), (10 * n + 1, edited(base, [40])), (10 * n + 2, edited(base, [20, 100])), (10 * n + 3, edited(base, range(5, 155, 12)))]
    chain = prose(200, 90)
    out += [(100 + k, edited(chain, range(3, 3 + 6 * k, 6))) for k in range(8)]
    return out + [(200, None), (201, ""), (202, "few words"), (203, "Few  WORDS"), (None, prose(60, 95)), (204, prose(90, 96)), (204, prose(90, 96))]


def test_edited_copies_are_near_copies(make):
    want = brute(rows())
    assert {0, 10, 20, 3} <= set(want) and not {1, 2} & set(want)
    for bucket in (64, 2):
        kept = similar.one_per_group(make(rows()), bucket=bucket).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == want


def test_empty_and_clashing(make):
    assert similar.one_per_group(make([])).count() == 0
    df = make([(1, "a b c d"), (2, "A B C D"), (3, None)], clash=True)
    out = similar.one_per_group(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
