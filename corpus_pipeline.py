"""The corpus pipeline: quality selection, near-duplicates, decontamination, redaction, encoding.

Each stage takes the documents that its predecessor kept, as Parquet, and all but the last return the columns
of documents.  ``run`` applies them to the documents of ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, near_dedup, pii, quality
from strandloom.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is 2 (good and clean) with probability 0.5 at least, by the ordinal classifier.

    The labels are joined with the stage's own input; without labels every document stays.
    """
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8): the one of the
    smallest id, and one row of it if the row is repeated (the first in order of its JSON).  Documents without words
    are linked with nothing and stay, as do rows with a null id."""
    return near_dedup.one_of_each(docs, shingle=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks, decided by text alone; null and empty texts stay, ids may be
    null or repeated, and without a benchmark all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text.  Null texts stay null; repeated rows stay."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, n_tokens, the digests of ids and decoded bytes, and the ids themselves; a null text
    counts as empty, ids may be null or repeated."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return bpe.encode_digests(docs, vocabulary, pattern, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("personal data", redacted),
    ("byte-level BPE", encoded),
]

#: Training, sketches and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.put(stage(spark, docs, sf_dir), f"stage-{k}")
        work.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
