import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skirmish.llm import bpe
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive(merges, piece):
    """One piece alone: the lowest rank first, its leftmost place first."""
    ids = merges.symbols(piece)
    while True:
        rules = {(a, b): (rank, into) for rank, (a, b, into) in enumerate(merges.pairs)}
        found = [(rules[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]
        if not found:
            return ids
        i = min(found)[1]
        ids[i : i + 2] = [rules[ids[i], ids[i + 1]][1]]


def spec_of(merges, letters="abc"):
    vocab = {}
    for t in [*letters, *[x + "." for x in letters], *[a + b for a, b in merges]]:
        vocab.setdefault(t, len(vocab))
    return {"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "."}}


def test_index_equals_one_by_one():
    """Random rules, some of which make pairs of lower rank than their own."""
    r = random.Random(4)
    lower = late = 0
    for _ in range(150):
        tokens, merges = [*"abc", "a.", "b.", "c."], []
        for _ in range(14):
            pair = (r.choice([t for t in tokens if not t.endswith(".")]), r.choice(tokens))
            if pair not in merges and len("".join(pair)) < 7:
                merges.append(pair)
                tokens.append("".join(pair))
        r.shuffle(merges)
        m = bpe.Merges(spec_of(merges))
        made = {into: rank for rank, (_, _, into) in enumerate(m.pairs)}
        lower += any(made.get(x, -1) > rank for rank, (a, b, _) in enumerate(m.pairs) for x in (a, b))
        pieces = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(25)] + ["", "a", "aaaaaaa", "zaz"]
        assert [i.tolist() for i in m.encode(pieces)] == [naive(m, p) for p in pieces]
        late += len(m.late)
    assert lower > 50 and late > 50


ODD = ["<|endoftext|>a<|startoftext|> <|END|>", "é́ ̈x", "Σας ΟΔΟΣ İ", "日本語 　全角", "'s DON'T we'LL", "😀👍🏽 x‍b", "\x1c\x85\x0b ", "a\u180eb\u1680c\x1fd e", "x\u2000\u0301y\u3000\u0308z", "a" * 3000, prose(30_000, 3)]


def test_against_the_library(spark, make, odd, monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 64)
    monkeypatch.setattr(bpe, "_INDEXED", 500)
    rows = odd + [(100 + i, t) for i, t in enumerate(ODD)]
    library = Tokenizer.from_file(PATH)
    spec = bpe.vocabulary(spark, PATH)
    docs = make(rows, clash=True).withColumn("ids", F.lit(0))
    out = bpe.round_trip(docs, spec).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted(out, key=str) == sorted(bpe.decode(bpe.encode(docs, spec), spec).select("doc_id", "text", "ids", "decoded").collect(), key=str)
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_empty_and_unknown(spark, make):
    spec = bpe.vocabulary(spark, PATH)
    assert bpe.encode(make([]), spec).collect() == []
    ids = spark.createDataFrame([(1, [320, -1, 10**6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, spec).orderBy("doc_id").collect()] == ["a</w>", "", ""]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges(json.loads(json.dumps(spec_of([]))) | {"model": {"type": "BPE", "unk_token": "?", "vocab": {}, "merges": []}})
