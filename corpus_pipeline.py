"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.llm.bpe import encode_decode
from duolex.llm.common import Scratch, join_rows, remainder, table
from duolex.llm.decontaminate import drop_leaks
from duolex.llm.nearjoin import drop_near_copies
from duolex.llm.pii import find_personal_data, redact
from duolex.llm.quality import KEEP, score_quality
from duolex.llm.queries import token_digests


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under KEEP go. Labels of documents that the operator's query holds out teach nothing here either.

    Rows are told apart by id and text: other texts of an id are judged for
    themselves. Rows with a null id stay.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    rejected = scored.filter(F.col("score") < KEEP).select("doc_id", "text_key")
    return join_rows(docs, rejected, "doc_id", "text", "left_anti", Scratch(spark), "rejected")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Rows are told apart by id and text."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; other texts of their ids stay, and so do rows with a null id."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets, and n_chars counts the new text."""
    made = redact(find_personal_data(docs, out="__spans"), spans="__spans").drop("__spans")
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens as counts and digests."""
    return token_digests(encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_level_bpe),
]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
