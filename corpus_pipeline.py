"""From raw documents to packed training sequences.

Each stage takes the stored result of the one before and returns the columns of documents;
the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.llm import decontamination, jaccard_join, line_dedup, packing, quality
from lotgrid.llm.common import stored, table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranking classifier accepts.

    A null or empty text is scored as one without words, repeated rows alike; without labels
    of both kinds all documents stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their site's boilerplate lines; ``n_chars`` follows the text.

    The ratio alone decides; a line of a single page is no repetition.  A null text stays
    null, with null ``n_chars``; rows without a source are one site; a repeated row is a page
    of its own.
    """
    return line_dedup.drop_site_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked ones: that of the smallest id, null ids last.

    Documents without words (null and empty texts among them) all stay; of repeated rows one
    stays.
    """
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, and all documents do if the benchmark is empty; repeated rows
    go or stay together.
    """
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in sequences of at most 2048 tokens.

    A null or empty text is its end token alone; repeated rows are packed each; no documents
    give no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# The classifier and the tokenizer have no SQL form; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
