"""The numbered operators bound to the given tables, with SQL where it can express them.

Documents stand in for utterances (``doc_id`` is ``utterance_id``, ``text`` is ``transcript``,
``source`` is ``corpus``), ``benchmark`` for the items of a take manifest, ``labels`` for labels.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import (
    alignment, classifier, dialogues, jaccard, languages, leaks, licenses, lines, minhash, pieces, rules,
    surrogates, toxicity)
from phonoframe.operators.ranks import join_keys
from phonoframe.operators.storage import settle, store

QUERIES, ORACLE = {}, {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"
PLAIN_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utterances(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("utterance_id"), F.col("text").alias("transcript"))


def components_sql(percent: int, columns: str) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({BLANK_WORDS}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, {columns}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(root) AS root FROM r GROUP BY 1) c USING (doc_id)
"""


@query(components_sql(75, "coalesce(c.root, w.doc_id) AS component_id"))
def op1_ngram_jaccard(spark, sf):
    found = jaccard.jaccard_join(utterances(table(spark, sf, "documents")))
    return found.withColumnRenamed("utterance_id", "doc_id")


def items(spark, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")


@query()
def op2_sentencepiece(spark, sf):
    found = pieces.encode_transcripts(
        utterances(table(spark, sf, "documents")), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        F.col("utterance_id").alias("doc_id"), "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT doc_id, p, line, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY 1
""")
def op8_line_dedup(spark, sf):
    docs = utterances(table(spark, sf, "documents"))
    kept = lines.apply_bitmaps(docs, lines.line_bitmaps(docs))
    return kept.select(
        F.col("utterance_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("transcript", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(f"""
WITH i AS (SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p+m-1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM win),
d AS (SELECT doc_id, coalesce({PLAIN_WORDS}, []) AS w FROM documents),
occ AS (
  SELECT doc_id, p, x.m, item_id FROM (
    SELECT doc_id, m, p, array_to_string(w[p:p+m-1], ' ') AS g FROM (
      SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, m WHERE len(w) >= m)) x
  JOIN win ON win.g = x.g AND win.m = x.m),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM occ) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op10_decontaminate(spark, sf):
    found = leaks.find_leaks(utterances(table(spark, sf, "documents")), items(spark, sf))
    return found.select(
        F.col("utterance_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op7_quality_rules(spark, sf):
    found = rules.judge_quality(utterances(table(spark, sf, "documents")))
    return found.select(
        F.col("utterance_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


@query()
def op4_license_scan(spark, sf):
    found = licenses.scan_licenses(utterances(table(spark, sf, "documents")))
    return found.select(
        F.col("utterance_id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
        "spans")


@query()
def op5_quality_classifier(spark, sf):
    docs = utterances(table(spark, sf, "documents"))
    held_out = F.crc32(F.col("utterance_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("utterance_id"), F.col("quality").alias("label"))
    weights = classifier.train_quality(docs, labels.filter(~held_out))
    return classifier.score_quality(docs, weights).select(
        F.col("utterance_id").alias("doc_id"), held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query()
def op6_toxicity(spark, sf):
    docs = utterances(table(spark, sf, "documents"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("utterance_id"), "toxic")
    found = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    return found.withColumnsRenamed({"utterance_id": "doc_id", "toxic": "score"}).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query()
def op3_language_id(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    model = languages.train_languages(docs.select("text", "lang"))
    none = F.lit(None)
    records = pages.select(
        none.cast("bigint").alias("doc_id"), "page_id", languages.visible_text(F.col("html")).alias("text"),
        languages.declared_language(F.col("html")).alias("declared"), languages.host_of(F.col("url")).alias("host"),
    ).union(docs.select("doc_id", none.cast("bigint"), "text", none.cast("string"), "source"))
    return languages.identify_languages(records, model)


@query()
def op9_pii_surrogates(spark, sf):
    found = surrogates.replace_entities(utterances(table(spark, sf, "documents")), b"an operator's secret")
    return found.select(
        F.col("utterance_id").alias("doc_id"), F.col("transcript").alias("text"),
        F.size("entities").cast("bigint").alias("n_entities"), "entities")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that their keys select."""
    one = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")])
    fault = (F.crc32(key.cast("binary")) % 20).alias("fault")
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault).filter("fault <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text"))


def _line_hashes(batches):
    """SHA-256 of the joined lines of each conversation, whose rows stand in order; no text is held."""
    owner, state = None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done = []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if state is not None and owner == conv:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((owner, state.hexdigest()))
                owner, state = conv, hashlib.sha256()
            state.update(line.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())],
            names=["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([owner], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


@query()
def op12_conversation_repair(spark, sf):
    given = table(spark, sf, "conversations")
    turns = damaged(given)
    plans = settle(dialogues.plan_repairs(turns))
    lines_ = dialogues.apply_repairs(turns, plans).select(
        "conv_id", "part", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = (
        lines_.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "line")
        .mapInArrow(_line_hashes, T.StructType([
            given.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])))
    found = join_keys(dialogues.dialogue_report(plans), hashes, ["conv_id"], "left")
    all_ids = given.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return join_keys(all_ids, found, ["conv_id"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query(components_sql(
    85, "coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept"))
def op13_minhash_dedup(spark, sf):
    return minhash.near_duplicates(utterances(table(spark, sf, "documents"))).withColumnRenamed("utterance_id", "doc_id")


@query()
def op11_tokenizer_alignment(spark, sf):
    aligned = alignment.align_tokens(
        utterances(table(spark, sf, "documents")), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))
    scores = alignment.score_links(aligned, store(alignment.pair_counts(aligned)))
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    shown = aligned.select("row", F.col("utterance_id").alias("doc_id"), *alignment.COUNTS, hashed.alias("groups_sha256"))
    return shown.join(scores, "row", "left").select(
        "doc_id", *alignment.COUNTS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256")


@query(f"""
WITH w AS (SELECT doc_id, coalesce({PLAIN_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS k FROM w),
b AS (SELECT doc_id, k, CASE WHEN w[k + 1] = 'mit' AND w[k + 2] = 'license' THEN 'mit' WHEN w[k + 1] = 'apache' AND w[k + 2] = 'license' THEN 'apache'
  WHEN w[k + 1] = 'general' AND w[k + 2] = 'public' AND w[k + 3] = 'license' THEN 'gpl' END AS label FROM p),
g AS (SELECT doc_id, count(*) AS n, min(k) AS lo, max(k) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b WHERE label IS NOT NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
""")
def license_scan_base(spark, sf):
    """The columns of op4 that SQL can express."""
    return op4_license_scan(spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
v AS (SELECT doc_id, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM
  (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
""")
def quality_rules_base(spark, sf):
    """The columns of op7 that SQL can express."""
    return op7_quality_rules(spark, sf).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
