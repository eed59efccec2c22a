import random

import pytest

WORDS = "the of and a to in is you that it he was for on are as with his they I at be this have from or one had by word but not what all were we when".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or add.
CLASHES = ["w", "s", "hashes", "total", "key", "id", "row", "fp", "root", "of", "at", "hash", "words", "line", "lines", "n_lines", "score", "kept", "both", "tagged", "drop_id", "gone", "stay", "place", "component_id", "block", "sid"]


def prose(n, seed):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(5, 14)
        s = [r.choice(WORDS) + (r.choice("abcdefgh") * r.randint(0, 2)) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]])."""

    def f(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for c in CLASHES:
                df = df.withColumn(c, F.lit("x"))
        return df

    return f


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must take: nulls, blanks, repeats, ties, a null key, a very long text."""
    same = prose(60, 5)
    return [
        (1, prose(80, 1)), (2, None), (3, ""), (4, " \n\t \n"), (5, same), (5, same), (6, same), (None, prose(50, 6)), (None, same),
        (7, prose(30_000, 7)), (8, "ßÉ é 日本語 " + prose(40, 8), None, None), (9, "12 34 | !!", "fr", None), (10, prose(80, 1).replace("of", "off")),
    ]
