"""Language identification by fusing Bayesian evidence.

Text gives a likelihood for each language from hashed byte trigrams. A page adds the language that its
markup declares and its address: the suffix, the domain below it and the host. How declarations agree
with texts, and how languages are spread over suffixes, domains and hosts, is counted by grouped
aggregation; a host's prior is shrunk towards its domain's, that towards its suffix's and that towards
the whole table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.llm.sizes import small_side
from phonoframe.operators.storage import settle

BITS = 14
LANGUAGES = 256
"""Labels of the training texts that can be told apart at most; more is an error, not a cut."""
SMOOTHING = 0.5
SHRINKAGE = 20.0
TRIGRAM_WEIGHT = 60.0
"""A text counts as this many independent trigrams at most, as neighbours are not independent."""
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(F.regexp_replace(html, MARKUP, " "), r"&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    """Primary language that the markup declares, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, DECLARED, 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram that holds no two blanks side by side."""
    data = b" ".join([b"", *texts, b""]).translate(WD.PLAIN)
    buf = np.frombuffer(data, np.uint8)
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = buf == 32
    pair = blank[:-1] & blank[1:]
    at = np.flatnonzero(~(pair[:-1] | pair[1:]))
    code = (buf[at].astype(np.uint64) << np.uint64(16)) | (buf[at + 1].astype(np.uint64) << np.uint64(8)) | buf[at + 2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    row = np.clip(np.searchsorted(np.cumsum(sizes) - sizes + 1, at + 1, side="right") - 1, 0, None)
    return row, (WD.mix(code) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and bucket, summed over a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in WD.slices(batch.column(0)):
            row, bucket = _trigrams(texts)
            names, code = np.unique(langs[first:first + len(texts)], return_inverse=True)
            both = np.bincount((code[row] << BITS) | bucket, minlength=len(names) << BITS).reshape(len(names), -1)
            for name, counts in zip(names, both):
                total[str(name)] = total.get(str(name), 0) + counts
    for name, counts in total.items():
        bucket = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)),
             pa.array(counts[bucket].astype(np.int64))], names=["lang", "bucket", "n"])


def train_languages(samples: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities of trigram buckets for each language of ``samples`` (``text``, ``lang``).

    All rows are counted; those without a text or a label say nothing. The model has a row of
    2 ** ``BITS`` numbers for each label, of which there may be ``LANGUAGES``.
    """
    labelled = samples.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = labelled.dropna().mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    counts = settle(counts)
    names = [r.lang for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    model = {name: np.full(1 << BITS, SMOOTHING) for name in sorted(names)}
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect():
        model[r.lang][[c.bucket for c in r.c]] += [c.n for c in r.c]
    return {name: np.log(v / v.sum()) for name, v in model.items()}


def _score(matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for first, texts in WD.slices(batch.column(text)):
                row, bucket = _trigrams(texts)
                count = np.bincount(row, minlength=len(texts))
                weight = np.minimum(count, TRIGRAM_WEIGHT) / np.maximum(count, 1)
                scores = np.stack([np.bincount(row, weights=m[bucket], minlength=len(texts)) * weight for m in matrix], 1)
                scores -= scores.max(1, keepdims=True)
                part = batch.slice(first, len(texts)).drop_columns(["text"])
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(texts) + 1) * len(matrix), pa.int32()), pa.array(scores.ravel()))
                yield part.append_column("scores", values)

    return run


def identify_languages(records: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The language of texts and pages.

    The reference's records are English, so this operator is general: ``records`` has ``text``,
    ``declared`` (language of the markup) and ``host``, each of which may be null, and any other
    columns, which are kept except for those named like a result.

    Adds ``text_lang`` (by the text alone), ``lang`` and ``posterior``. ``text`` and ``host`` are
    dropped, ``declared`` stays. Ties go to the first language in alphabetical order.

    Defined cases: without text, declaration and host the table's own prior decides; a declaration
    that is no language of the model says nothing; hosts without a dot are their own domain and have
    the empty suffix; an empty table gives an empty result; a model without languages gives nulls.
    """
    names = sorted(model)
    results = ("text_lang", "lang", "posterior", "scores", "suffix", "domain")
    kept = [c for c in records.columns if c not in ("text", "declared", "host", *results)]
    if not names:
        return records.select(*kept, "declared").withColumns({
            "text_lang": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"),
            "posterior": F.lit(None).cast("double")})
    host = F.coalesce("host", F.lit(""))
    labels = F.split(host, r"\.")
    size = F.size(labels)
    base = records.select(
        *kept, "declared", F.col("text").cast("string").alias("text"), host.alias("host"),
        F.when(size > 1, F.element_at(labels, -1)).otherwise("").alias("suffix"),
        F.when(size > 2, F.concat_ws(".", F.slice(labels, size - 1, 2))).otherwise(host).alias("domain"))
    fields = [f for f in base.schema.fields if f.name != "text"]
    scored = settle(base.mapInArrow(
        _score(np.stack([model[n] for n in names])),
        T.StructType([*fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])))
    code = F.array_position("scores", F.array_max("scores")).cast("int")
    known = F.array_position(F.lit(names), F.col("declared")).cast("int")
    rows = scored.withColumns({"_best": code, "_said": F.coalesce(known, F.lit(0))})

    counts = [F.sum(F.when(F.col("_best") == k + 1, 1).otherwise(0)).alias(f"n{k}") for k in range(len(names))]
    hosts = settle(rows.groupBy("suffix", "domain", "host").agg(*counts))
    up = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]

    def shrunk(frame: DataFrame, parent: str | None, out: str) -> DataFrame:
        total = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
        share = [(F.col(f"n{k}") + SHRINKAGE * (F.col(parent)[k] if parent else F.lit(1.0 / len(names))))
                 / (total + SHRINKAGE) for k in range(len(names))]
        return frame.withColumn(out, F.array(*share)).drop(*[f"n{k}" for k in range(len(names))])

    whole = shrunk(hosts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(names))]), None, "p0")
    suffixes = shrunk(hosts.groupBy("suffix").agg(*up).crossJoin(F.broadcast(whole)), "p0", "p1").drop("p0")
    domains = shrunk(hosts.groupBy("suffix", "domain").agg(*up).join(small_side(suffixes), "suffix"), "p1", "p2").drop("p1")
    priors = shrunk(hosts.join(small_side(domains), ["suffix", "domain"]), "p2", "prior").select("host", "prior")
    # one row: how often a text language k comes with the declaration j, j = 0 being none of the model
    said = rows.agg(*[F.sum(F.when((F.col("_best") == k + 1) & (F.col("_said") == j), 1).otherwise(0)).alias(f"s{k}_{j}")
                      for k in range(len(names)) for j in range(len(names) + 1)]).first()
    table = np.array([[said[f"s{k}_{j}"] or 0 for j in range(len(names) + 1)] for k in range(len(names))], float)
    agree = table[:, 1:] + SMOOTHING
    agree = np.log(agree / agree.sum(1, keepdims=True))
    spoken = F.array(*[F.array(F.lit(0.0), *[F.lit(float(x)) for x in line]) for line in agree])
    joined = rows.join(small_side(settle(priors)), "host")
    odds = F.array(*[
        F.col("scores")[k] + F.log(F.col("prior")[k]) + spoken[k][F.col("_said")] for k in range(len(names))])
    fused = joined.withColumn("_odds", odds).withColumn("_top", F.array_max("_odds"))
    mass = F.aggregate("_odds", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    return fused.select(
        *kept, "declared", F.element_at(F.lit(names), F.col("_best")).alias("text_lang"),
        F.element_at(F.lit(names), F.array_position("_odds", F.col("_top")).cast("int")).alias("lang"),
        (1 / mass).alias("posterior"))
