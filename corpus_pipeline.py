"""The corpus pipeline: quality, near duplicates, secrets, mixing, BPE. Each stage works on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import bpe_codec, jaccard_join, mixing, quality, secrets
from quillsieve.llm.common import table, written
from quillsieve.llm.queries import tokenizer_file

#: Expected share of tokens that the mixing stage keeps.
KEEP = 0.9


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs`` that are not held out.

    Null and empty texts are judged as texts without words. Repeated rows are judged alike and all stay or go; rows with
    a null id teach nothing but are judged. Without labelled rows every document stays. No rows give no rows.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.8 and more, the document of the smallest id.

    Null and empty texts are linked with nothing and stay. Of rows repeated under an id one stays, that of the longest
    text. Rows with a null id all stay. No rows give no rows.
    """
    return jaccard_join.first_of_each(docs, n=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; ``n_chars`` follows the text.

    Null and empty texts stay as they are; so do repeated rows and null ids, whose texts are scanned too. No rows give
    no rows.
    """
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that are raked to source, language and topic shares.

    Null texts have no tokens, null sources and languages are levels of their own, rows repeated under an id are drawn
    alike, and rows with a null id all share one draw. No rows give no rows.
    """
    return mixing.sampled_rows(docs, keep=KEEP)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of ids and decoded text, a row for each row.

    Null texts count as empty, with no tokens and the digest of nothing. Null ids and repeated rows stay. No rows give
    no rows.
    """
    return bpe_codec.digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_first_copy), ("secrets", hide_secrets), ("mixing", mix), ("encoding", encode)]

#: The classifier, the components and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
