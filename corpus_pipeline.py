"""The corpus pipeline: five stages over documents, each reading what its predecessor kept.

Every stage but the last returns the columns of documents. A stage's decisions take effect: documents without a
language go, of equal texts one stays, of near copies one stays, sources are repeated or thinned to their targets, and
the last stage turns what is left into piece ids.

For every stage: columns beyond those of documents are kept, with their values, whatever they are called; an empty table
gives an empty table; texts of any length are read whole, in memory that is a multiple of the longest one; only text,
doc_id and source decide, so nulls in other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import exact_dedup, language_id, mix_sources, ngram_join, pieces
from fathom.llm.common import discard, staged
from fathom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: a null or empty text, one without a letter, and one that is too far from the
    profiles of all languages, which all labelled documents but those held out make. Rows are judged one by one, so rows that
    repeat share a verdict; of languages at equal distance the first by name is taken, which lets the document stay."""
    return language_id.keep_identified(docs, language_id.MIN_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; null texts equal empty ones. Of rows that repeat id and text one
    stays, the first by its columns as JSON; a null id is smaller than any other."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays, with all rows that repeat this id. Texts without
    words are near to nothing and stay, and so do rows with a null id."""
    return ngram_join.drop_near_copies(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to three times. A null source is a source, a text without words is never taken,
    and documents whose hashes are equal are taken together; rows that repeat are counted and taken one by one."""
    return mix_sources.repeat_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the piece ids of each row and the text decoded from them. A null text has no pieces and decodes to
    an empty one; rows that repeat are encoded alike; equal scores end in the pieces that the library takes."""
    coded = pieces.encode_rows(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "lang", "piece_ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_to_targets),
    ("pieces", encode_pieces),
]

#: Language profiles and merges of pieces are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(docs, "staged_at"):  # its successor is written
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
