"""Five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``docs`` has the columns of
``documents``.  The last returns the mix: blocks of words with the documents they come from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import cotrain, decontam, lines, mixing, similar, simhash
from skirmish.llm.base import read
from skirmish.operators.ordered import shared_folder, shuffles_removed, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; repeated rows, null and empty texts are judged like others, an empty table gives none."""
    return cotrain.score_quality(docs, read(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them hold; ``n_chars`` follows the text.  A null text stays null."""
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    First SimHash classes (two bits of three-word shingles), which take exact copies and all but equal texts; of what is left, documents
    with a Jaccard similarity of 0.8 or more over five-word shingles, every pair verified.  Texts without words are one group; repeated
    rows are copies; a null id never wins over another; nothing comes of an empty table; other columns than those of documents are dropped.
    What the first leaves is stored, since the second reads it three times.
    """
    return similar.one_per_group(store(simhash.one_per_class(docs))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item; null and empty texts have none, and without items all stay."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: one row per output slot with its words and the ids of the documents in it."""
    return mixing.mixed_blocks(docs, mixing.plan_mix(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
]

# Trained scores, 64-bit hashes and pseudorandom draws have no SQL form; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows are written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            with shuffles_removed(spark):
                docs.select("*").write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
