"""A training-corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ocellus.llm import line_dedup, mixing, near_copies, repetition, spm
from ocellus.llm.common import discard, stage, staging

ORACLE_SQL = None  # near copies, the mix and the tokens have no SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, unchanged. Null and empty texts don't pass; repeated rows pass or go alike; null ids and other
    columns are left as they are; an empty table stays empty."""
    return docs.where(repetition.passes(docs["text"]))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that line dedup drops; n_chars follows the text. Null texts stay null. Rows that share an
    id, or have none, count as one document, and each loses only lines of its own. An empty table stays empty."""
    return line_dedup.drop_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, Jaccard similarity 0.8 or more) the row with the smallest doc_id; of rows of the
    group that repeat it, the one with the smallest text.

    SimHash fingerprints within three bits are found by tiles; most near copies are further apart, and are found by shared rare
    shingles. Texts without words are one group; a null id ranks first; rows that share an id in different groups don't touch each
    other; of equal rows one stays. An empty table stays empty.
    """
    return near_copies.survivors(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each time that the mix goes through a document, with the words it takes. Texts without words are never
    taken; a null source is one source, the last; rows that repeat an id are mixed apart. An empty table stays empty."""
    return mixing.mix(docs).documents()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, checked against the library and decoded again. A null text is empty and has no tokens; repeated rows are
    encoded alike; an empty table gives no rows."""
    return spm.encode(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near), ("mixing", mix), ("SentencePiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. What a stage has staged is removed once its result is written, and that
    result once the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        with staging():
            docs = stage(step(spark, docs, sf_dir), name.split()[0].lower(), keep=True)
        if last is not None:
            discard(last)
        last = docs
    return docs
