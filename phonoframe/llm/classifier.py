"""A quality classifier for transcripts: hashed word n-grams, logistic regression, FTRL updates.

Features of the labelled sample are computed in parallel and kept as arrays; the updates are
sequential by nature, so the sample is bounded and one task follows it. Scoring is a sparse dot
product of every transcript with the weights, which have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import features as FE
from phonoframe.llm import words as WD
from phonoframe.operators.storage import settle

BITS = 18
SAMPLE_ROWS = 10_000
"""Labelled transcripts that training uses at most: those of the smallest hashes of utterance_id."""
PASSES = 4
ALPHA = 2.0


def labelled_sample(utterances: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """``utterance_id``, ``transcript`` and label columns of at most ``rows`` labelled utterances.

    Rows without an id or a label are left out; of several labels of an utterance the smallest holds;
    of several rows of an utterance one is taken.
    """
    known = labels.select("utterance_id", *columns).dropna().groupBy("utterance_id").agg(
        *[F.min(c).alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("utterance_id"), "utterance_id").limit(rows)  # bounded by ``rows``
    text = utterances.select(F.col("utterance_id").alias("_id"), F.col("transcript").cast("string").alias("transcript"))
    return text.join(F.broadcast(chosen), F.col("_id") == F.col("utterance_id")).select(
        "utterance_id", "transcript", *columns).dropDuplicates(["utterance_id"])


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in WD.slices(batch.column(1), 1 << 20):
                row, place, _ = FE.features(texts, bits)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
                     batch.column(2).slice(first, len(texts))], names=["turn", "places", "label"])

    return run


def _fit(bits: int, passes: int, alpha: float):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("turn", kind="stable")
        examples = [(p, np.full(len(p), 1 / np.sqrt(max(1, len(p))))) for p in map(np.asarray, sample.places)]
        weights = FE.train(examples, sample.label.to_numpy(float), np.arange(len(examples)), 1 << bits, passes, alpha=alpha)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})

    return run


def train_quality(
    utterances: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS, passes: int = PASSES,
    alpha: float = ALPHA,
) -> bytes:
    """Weights (2 ** ``bits`` 32-bit floats) of the classifier.

    ``utterances`` has ``utterance_id`` and ``transcript``, ``labels`` has ``utterance_id`` and
    ``label`` (1 good, 0 bad); other columns are ignored. At most ``rows`` labelled utterances are
    used. Without any, all weights are 0 and every score is 0.5.
    """
    sample = labelled_sample(utterances, labels, ["label"], rows).select(
        F.xxhash64("utterance_id").alias("turn"), "transcript", F.col("label").cast("int").alias("label"))
    featured = settle(sample.mapInArrow(_featured(bits), "turn bigint, places array<int>, label int"))
    found = featured.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_fit(bits, passes, alpha), "weights binary").first()
    return bytes(found.weights) if found else bytes(4 << bits)


def score_quality(utterances: DataFrame, weights: bytes) -> DataFrame:
    """``utterance_id`` and ``score`` (0 to 1, higher: good is likelier) of every row.

    Null and empty transcripts have no features and score 0: no words, no quality. Repeated rows and
    null ids are rows like any other; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("utterance_id", utterances.schema["utterance_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    shared = utterances.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, "<f4").astype(float)
        bits = len(w).bit_length() - 1
        for batch in batches:
            for first, texts in WD.slices(batch.column(1), 1 << 20):
                row, place, value = FE.features(texts, bits)
                score = FE.sigmoid(FE.dot(w, row, place, value, len(texts)))
                score[np.bincount(row, minlength=len(texts)) == 0] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(score)], names=["utterance_id", "score"])

    return utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript")).mapInArrow(run, schema)
