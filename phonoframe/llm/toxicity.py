"""Toxicity of transcripts by a classifier chain.

Categories are predicted one after another by linear models over hashed words and heads of words.
Each model also sees the probabilities of the categories before it. While training, these are out of
fold: a labelled transcript's probability comes from models that did not see it, so later models meet
the same kind of input as in scoring. The folds of a category are trained side by side.
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
from phonoframe.llm.classifier import labelled_sample
from phonoframe.operators.storage import settle

BITS = 18
SAMPLE_ROWS = 12_000
"""Labelled transcripts that training uses at most: those of the smallest hashes of utterance_id."""
FOLDS = 3
PASSES = 4
ALPHA, L1 = 1.0, 1.5
# Words whose presence in a toxic transcript names its category.
CATEGORY_WORDS = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "degrading": ["trash", "scum", "worthless", "pathetic", "disgusting"],
}
CATEGORIES = [*CATEGORY_WORDS, "toxic"]


def weak_categories(sample: DataFrame) -> DataFrame:
    """Add a 0/1 column per category of ``CATEGORY_WORDS``: toxic, and one of its words occurs."""
    text = F.lower(F.coalesce("transcript", F.lit("")))
    return sample.withColumns({
        name: F.when((F.col("toxic") == 1) & text.rlike(r"\b(" + "|".join(found) + r")\b"), 1).otherwise(0)
        for name, found in CATEGORY_WORDS.items()})


def _featured(bits: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in WD.slices(batch.column(1), 1 << 20):
                row, place = FE.terms(texts, bits)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
                     *(batch.column(2 + k).slice(first, len(texts)) for k in range(labels))],
                    names=["turn", "places", *(f"y{k}" for k in range(labels))])

    return run


def _example(places, earlier, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words weigh 1; then come a constant and the earlier probabilities."""
    size = 1 << bits
    place = np.concatenate([np.asarray(places, np.int64), size + np.arange(1 + len(earlier))])
    value = np.ones(len(place))
    value[len(place) - len(earlier):] = earlier
    return place, value


def _fit(bits: int, column: str):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        group = key[0]
        rows = rows.sort_values("turn", kind="stable").reset_index(drop=True)
        examples = [_example(p, e, bits) for p, e in zip(rows.places, rows.earlier)]
        inside = np.flatnonzero((rows.fold != group).to_numpy())
        extra = 1 + (len(rows.earlier.iloc[0]) if len(rows) else 0)
        weights = FE.train(examples, rows[column].to_numpy(float), inside, (1 << bits) + extra, PASSES, alpha=ALPHA, l1=L1)
        if group == FOLDS:  # all rows: the model that scores
            return pd.DataFrame({"turn": [None], "p": [None], "weights": [weights.astype("<f4").tobytes()]})
        out = np.flatnonzero((rows.fold == group).to_numpy())
        p = [float(FE.sigmoid(weights[examples[i][0]] @ examples[i][1])) for i in out]
        return pd.DataFrame({"turn": rows.turn.iloc[out], "p": p, "weights": None})

    return run


def train_toxicity(
    utterances: DataFrame, labels: DataFrame, categories: list[str] | None = None, rows: int = SAMPLE_ROWS,
    bits: int = BITS,
) -> list[bytes]:
    """Weights of the chain, one model for each category in order.

    ``utterances`` has ``utterance_id`` and ``transcript``; ``labels`` has ``utterance_id`` and a 0/1
    column for each of ``categories``, or only ``toxic``, whose categories then come from
    ``weak_categories``. At most ``rows`` labelled utterances are used. Without any, every probability
    is 0.5.
    """
    given = ["toxic"] if categories is None else categories
    sample = labelled_sample(utterances, labels, given, rows)
    names = categories or CATEGORIES
    if categories is None:
        sample = weak_categories(sample)
    plain = sample.select(F.xxhash64("utterance_id").alias("turn"), "transcript", *[
        F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(names)])
    featured = settle(plain.mapInArrow(
        _featured(bits, len(names)), "turn bigint, places array<int>, " + ", ".join(f"y{k} int" for k in range(len(names)))))
    fold = F.pmod(F.xxhash64("turn"), F.lit(FOLDS)).cast("int")
    state = featured.withColumns({"fold": fold, "earlier": F.array().cast("array<double>")})
    models = []
    for k in range(len(names)):
        copies = state.withColumn("group", F.explode(F.lit(list(range(FOLDS + 1)))))
        found = settle(copies.select("group", "turn", "fold", "places", "earlier", f"y{k}").groupBy("group").applyInPandas(
            _fit(bits, f"y{k}"), "turn bigint, p double, weights binary"))
        model = found.filter("weights IS NOT NULL").first()
        models.append(bytes(model.weights) if model else bytes(4 * ((1 << bits) + 1 + k)))
        # as many rows as the sample has
        held = found.filter("p IS NOT NULL").select("turn", "p")
        state = state.join(F.broadcast(held), "turn").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
    return models


def score_toxicity(utterances: DataFrame, models: list[bytes], names: list[str] | None = None) -> DataFrame:
    """``utterance_id`` and the probability of each category, the last being the whole chain's.

    A null or empty transcript has no words and gets 0 in every category. Repeated rows and null ids
    are rows like any other; an empty table gives an empty result.
    """
    names = names or CATEGORIES
    schema = T.StructType([T.StructField("utterance_id", utterances.schema["utterance_id"].dataType)]
                          + [T.StructField(n, T.DoubleType()) for n in names])
    shared = utterances.sparkSession.sparkContext.broadcast(models)  # 2 ** bits floats for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.frombuffer(m, "<f4").astype(float) for m in shared.value]
        bits = len(weights[0]).bit_length() - 1
        size = 1 << bits
        for batch in batches:
            for first, texts in WD.slices(batch.column(1), 1 << 20):
                row, place = FE.terms(texts, bits)
                empty = np.bincount(row, minlength=len(texts)) == 0
                chain: list[np.ndarray] = []
                for w in weights:
                    odds = np.bincount(row, weights=w[place], minlength=len(texts)) + w[size]
                    for j, p in enumerate(chain):
                        odds = odds + w[size + 1 + j] * p
                    chain.append(FE.sigmoid(odds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *(pa.array(np.where(empty, 0.0, p)) for p in chain)],
                    names=["utterance_id", *names])

    return utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript")).mapInArrow(run, schema)
