import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F

SENTENCE = "the quick brown fox of the north and the slow grey bear in the south."


def prose(seed, n):
    return ".\n".join(" ".join(f"the w{seed}x{i}x{j} of v{seed}x{i}x{j}" for j in range(6)) for i in range(n)) + "."


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    item = " ".join(f"secret{k}" for k in range(30))
    shared = "this very line stands in many documents and is long enough to count."
    rows = [(k, prose(k, 12) + ("\n" + shared if k < 6 else "")) for k in range(20)]
    rows += [(100, prose(3, 12) + "\n" + shared), (101, prose(7, 12) + " tail"), (102, "###&&& $$$ ###"), (103, None)]
    rows += [(104, prose(50, 10) + "\n" + item + "\n" + prose(51, 10)), (105, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, utterance_id int, transcript string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r for r in now.collect()}
    assert sorted(kept) == [*range(20), 104]
    assert "secret" not in kept[104].text and "w50x0x0" in kept[104].text and "w51x9x5" in kept[104].text
    assert sum(shared in r.text for r in kept.values()) == 0  # its largest holder, 100, was a near copy of 3
    assert all(r.n_chars == len(r.text) and r.utterance_id == 7 and r.transcript == "x" for r in kept.values())
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in out.items()} == {k: r.text for k, r in kept.items()}
    assert all(len(r.tokens) == 4 * r.n_tokens for r in out.values())


def test_empty_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).filter(F.lit(True)).collect() == []


def test_batches_of_documents_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    def largest():
        return max(r.n for r in P.as_utterances(docs).mapInArrow(sizes, "n bigint").collect())

    spark.conf.unset(key)
    try:
        assert largest() <= 5
        spark.conf.set(key, str(16 << 20))  # a limit of the session's own stays
        assert 10 <= largest() <= 17
    finally:
        spark.conf.unset(key)


def test_near_duplicates_start_no_other_workers(spark, monkeypatch):
    """Frames made of Python rows, even empty ones, have workers of their own beside those of Arrow."""
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(prose(1, 12)).alias("text")).localCheckpoint()

    def refused(*args, **kwargs):
        raise AssertionError("createDataFrame")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert [r.doc_id for r in P.near_duplicates(spark, docs, "").collect()] == [0]
