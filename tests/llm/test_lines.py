import hashlib
from collections import defaultdict

from conftest import CLASHES, prose  # noqa: F401
from skirmish.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= min_chars and i is not None:
                held[low(x)].add(i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if keep.get(low(x), i) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept) if t is not None else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def corpus():
    common, rare, short = "This line is common to many of them.", "  THIS line is in two only, not three. ", "too short"
    rows = [(i, "\n".join([prose(12, i), common if i % 2 else common.upper() + "\t", short, *([rare] if i in (3, 7) else [])])) for i in range(12)]
    return rows + [(20, f"{common}\n{common}\n"), (20, f"{common}\nother text of the same key"), (None, common + "\nÉcole élémentaire de la ville"), (21, None), (22, ""), (23, "\n\n"), (24, "É" * 25), (25, "é" * 25), (26, "É" * 25), (27, "É" * 25)]


def test_matches_brute_force(make, odd):
    rows = corpus() + odd
    assert rows_of(lines.drop_repeated_lines(make(rows), log2_bits=18)) == brute(rows)


def test_full_filter_changes_nothing(make):
    rows = corpus()
    assert rows_of(lines.drop_repeated_lines(make(rows), log2_bits=16, min_docs=2)) == brute(rows, min_docs=2)


def test_one_line_in_every_document(make):
    rows = [(i, "the very same line of text everywhere\n" + prose(6, i)) for i in range(300)]
    got = rows_of(lines.drop_repeated_lines(make(rows).repartition(7), log2_bits=18))
    assert got == brute(rows) and sum(r[2] for r in got) == 299


def test_empty_and_clashing(make):
    assert lines.drop_repeated_lines(make([]), log2_bits=16).count() == 0
    df = make(corpus(), clash=True)
    out = lines.drop_repeated_lines(df, log2_bits=18)
    assert set(out.columns) == set(df.columns) | {"n_lines", "n_dropped"}
    assert rows_of(out) == brute(corpus())
    assert {r.row for r in out.collect()} == {"x"}


def test_query_digest(spark, make, tmp_path):
    from skirmish.llm.queries import QUERIES

    rows = corpus()
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, n, d, t in brute(rows)), key=str)
