import corpus_pipeline
import pytest
from conftest import prose
from test_decontam import brute as overlaps
from test_lines import brute as line_brute
from test_similar import brute as similar
from test_simhash import brute as classes

COMMON = "This line is the same in very many documents."


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = prose(40, 999)
    rows = [(k, "\n".join([prose(50, k), COMMON]), "en", f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, " ".join(x.upper() + "!!" for x in prose(50, k).split()), "en", "s1") for k in range(30)]
    rows += [(300 + k, prose(50, k) + ("\n" + COMMON if k else ""), "en", "s2") for k in range(10)]
    rows += [(400, prose(30, 5000) + " " + item, "en", "s0"), (401, None, "en", "s0"), (402, "", None, None), (None, prose(50, 7000), "en", "s0")]
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k in [*range(0, 100), *range(200, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_against_plain_python(spark, folder, tmp_path):
    item = prose(40, 999)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        rows = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            kept = {r.doc_id for r in rows}
            assert kept >= {*range(120), *range(300, 310), 400, None} and not kept & set(range(200, 230))
        elif n == 1:
            assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((i, t) for i, _, _, t in line_brute(before)), key=str)
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        elif n == 2:
            least = {str(c) for _, _, c in classes(before)}
            left = [(i, t) for i, t, *_ in before if str(i) in least]
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == similar(left)
            # 9 and 309 share 46 of 55 shingles of five words.
            assert not {300, 309} & {r.doc_id for r in rows}
        elif n == 3:
            bad = {i for i, *_ in overlaps(before, [(0, item)])}
            assert 400 in bad and sorted((str(r.doc_id) for r in rows)) == sorted(str(i) for i, *_ in before if i not in bad)
        else:
            total = sum(len((t or "").split()) for _, t, *_ in before)
            assert abs(sum(r.n_words for r in rows) - 1.5 * total) <= 64 * 4
            assert {d for r in rows for d in r.doc_ids} <= {i for i, *_ in before}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["shard", "place", "source", "block", "n_words", "doc_ids", "text"] and out.count() > 0


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and len({n for n, _ in corpus_pipeline.STAGES}) == 5


def test_near_duplicates_store_what_simhash_leaves(spark, folder):
    near = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert near.inputFiles() and all("/stored-" in f for f in near.inputFiles())
