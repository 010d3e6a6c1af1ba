"""From documents to token sequences: five stages, each applying one training-data operator.

Counted as part of ``phonoframe.llm``. Documents stand in for utterances; see ``phonoframe.llm.queries``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm import jaccard, leaks, lines, pieces, rules
from phonoframe.llm.sizes import bound_batches
from phonoframe.operators.storage import shared_folder

NAMES = {"doc_id": "utterance_id", "text": "transcript"}


def as_utterances(docs: DataFrame) -> DataFrame:
    """Documents under the names of utterances; other columns get names that clash with nothing. They go to
    workers in batches of bounded size."""
    bound_batches(docs.sparkSession)
    return docs.toDF(*[NAMES.get(c, f"_doc{k}_{c}") for k, c in enumerate(docs.columns)])


def as_documents(utterances: DataFrame, docs: DataFrame, resized: bool = False) -> DataFrame:
    """Back to the columns of ``docs``; ``resized`` brings ``n_chars`` up to date."""
    kept = as_utterances(docs).columns
    size = F.length("transcript")
    return utterances.select(*[
        size.cast(docs.schema[c].dataType).alias(c) if resized and c == "n_chars" else F.col(f"`{k}`")
        for k, c in zip(kept, docs.columns)]).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior of being good is below one half go."""
    return as_documents(rules.keep_good(as_utterances(docs)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents hold stay in one of them only."""
    given = as_utterances(docs)
    return as_documents(lines.apply_bitmaps(given, lines.line_bitmaps(given)), docs, resized=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return as_documents(jaccard.keep_one(as_utterances(docs)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return as_documents(leaks.remove_leaks(as_utterances(docs), items), docs, resized=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    found = pieces.encode_transcripts(as_utterances(docs), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("utterance_id").alias("doc_id"), "n_tokens", "tokens", F.col("decoded").alias("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
ORACLE_SQL = None
"""The posterior of the quality rules and the merges of the tokenizer have no SQL form."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
