"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, bpe_codec, jaccard_join, lm_scoring, mixing, quality, secrets, suffix_dedup, token_counts, topk_search
from .common import table

#: Folder of the public tokenizer files; None: where their package says.
TOKENIZERS = os.environ.get("TOKENIZER_DIR")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document under the byte-level vocabulary of 50k pieces."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.byte_level_vocabulary(tokenizer_file("byte_bpe_50k.json")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every row whose id 20 divides, against all rows."""
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its repeated strings of 400 bytes, and whether any were found in it."""
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeats"))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose id 20 divides, by learned partitions."""
    return ann_search.search(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingles with a similarity of 0.9 and more."""
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    return mixing.sample(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under the unigram base and the maximum-entropy model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    """Name to query, for the driver's entry file."""
    here = sys.modules[__name__]
    return {name: getattr(here, name) for name in vars(here) if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {"op3_topk_search": topk_search.ORACLE, "op7_secret_scan": secrets.oracle()}
