"""Corpus files, labels, joins, streams and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from phonoframe import schemas
from phonoframe import tables as K
from phonoframe.functions import scalar as S
from phonoframe.operators import content as X
from phonoframe.operators import intervals as I
from phonoframe.operators import labels as L
from phonoframe.operators import records as R
from phonoframe.sources import corpora as C
from phonoframe.sources import files as FI
from phonoframe.sources import sinks
from phonoframe.streaming import records as ST

LONG = '''File type = "ooTextFile"
Object class = "TextGrid"

tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "phones"
        intervals: size = 3
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "sil"
        intervals [2]:
            xmin = 0.5
            xmax = 0.7
            text = "DH,Z,s"
        intervals [3]:
            xmin = 0.7
            xmax = 1.25
            text = "AH0"
    item [2]:
        class = "IntervalTier"
        name = "IPA"
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 1.25
            text = ""
'''


def test_long_textgrid_file(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text(LONG)
    rows = FI.read_textgrid_long(spark, str(tmp_path)).collect()
    assert [(r.tier, r.idx, r.xmin, r.xmax, r.text) for r in rows] == [
        ("phones", 0, 0.0, 0.5, "sil"), ("phones", 1, 0.5, 0.7, "DH,Z,s"), ("phones", 2, 0.7, 1.25, "AH0"),
        ("IPA", 0, 0.0, 1.25, "")]


@pytest.mark.parametrize("text", ["x", LONG.replace("tiers?", "t"), LONG.replace('"IntervalTier"', '"TextTier"'),
                                  LONG.replace("            xmin = 0.7\n", "")])
def test_broken_textgrids_stop(spark, text):
    with pytest.raises(Exception):
        C.parse_textgrid_long(spark.createDataFrame([("p", text)], "path string, value string")).collect()


def test_tags(spark):
    texts = ["sil", "DH,Z,s", "EH1", "T,sil,d", "AH,x,a", "K,G,q", "A,B", "DH,err,S"]
    df = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "utterance_id string, idx int, text string")
    tagged = L.parse_tags(df, "text")
    got = {r.text: (r.state, r.phone, r.label, r.substituted_with) for r in tagged.collect()}
    assert got["DH,Z,s"] == ("kept", "ð", "substituted", "z")
    assert got["T,sil,d"] == ("kept", "t", "deleted", None)
    assert got["DH,err,S"] == ("kept", "ð", "substituted", None)
    assert got["AH,x,a"][0] == got["sil"][0] == "dropped"
    assert got["K,G,q"][0] == got["A,B"][0] == "bad"
    seq = L.token_sequence(tagged, "utterance_id", "idx").orderBy("token_index").collect()
    assert [(r.token_index, r.phone) for r in seq] == [(0, "ð"), (1, "ɛ"), (2, "t"), (3, "ð")]
    with pytest.raises(Exception):
        L.map_arpabet(df.withColumn("t", F.lit("XX")), "t", strict=True).collect()


def test_expert_votes(spark):
    scores = {"u": {"words": [{"text": "THE", "phones": ["DH", "AH0"]}, {"text": "ZEN", "phones": ["Z", "EH1", "N"]}]}}
    detail = {"u": {"words": [{"text": "THE", "phones": ["{DH} AH0"] * 3 + ["DH AH0", "DH"]},
                              {"text": "ZEN", "phones": ["Z EH1 N"] * 5}]}}
    lines = [spark.createDataFrame([(json.dumps(d),)], "value string") for d in (scores, detail)]
    rows = C.parse_phone_scores(*lines).withColumn(
        "votes", L.expert_votes(F.col("experts"), F.col("position"))).orderBy("token_index").collect()
    assert [(r.token_index, r.label, r.votes) for r in rows] == [
        (0, "DH", 3), (1, "AH0", 0), (2, "Z", 0), (3, "EH1", 0), (4, "N", 0)]


def test_vocabularies_cover_the_inventory():
    assert set(K.LONG_MARK_VOCABULARY) == set(K.CANONICAL) == set(K.STRESSLESS_VOCABULARY)
    assert len(K.CANONICAL) == 46
    assert K.STRESSLESS_VOCABULARY["ɑɹ"] == "AA" and K.STRESSLESS_VOCABULARY["ə"] == "AH"


def test_key_value_lines(spark):
    good = spark.createDataFrame([("a b c",)], "value string")
    assert C.parse_kv(good, exact=False).first().value == "b c"
    with pytest.raises(Exception):
        C.parse_kv(good, exact=True).collect()


def test_lookup_is_strict(spark):
    df = spark.createDataFrame([("ABA",), ("ZZZ",)], "speaker string")
    dim = spark.createDataFrame([(s, l1) for s, l1 in K.SPEAKER_L1.items()], "speaker string, l1 string")
    assert R.lookup(df.filter("speaker = 'ABA'"), dim, "speaker", "l1").first().l1 == "arabic"
    with pytest.raises(Exception):
        R.lookup(df, dim, "speaker", "l1").collect()
    assert R.lookup(df, dim, "speaker", "l1", strict=False).count() == 2


def test_overlap_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([("p", 0.0, 9.0, 1), ("p", 2.5, 3.0, 2)], "k string, xmin double, xmax double, i int")
    right = spark.createDataFrame([("p", 1.0, 8.0, 1), ("p", 3.0, 4.0, 2)], "k string, xmin double, xmax double, j int")
    got = I.overlap_join(left, right, "k", width=1.0).select("i", "r_j", F.round("overlap", 4)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0.7778), (1, 2, 0.1111), (2, 1, 1.0)]


def test_units_take_the_last_mark(spark):
    words = [("p", 0, 0.0, 0.3, "\\well"), ("p", 1, 0.3, 0.6, "</now|"), ("p", 2, 0.6, 0.7, "`no|"), ("p", 3, 0.7, 1.4, "=flat")]
    df = spark.createDataFrame(words, "path string, idx int, xmin double, xmax double, text string")
    rows = I.intonation_units(df).collect()
    assert [(r.unit, r.expected_tone, r.nucleus_s, r.transcript) for r in rows] == [(0, "rise", 0.3, "well now")]


def test_reference_paths_stay_inside(spark):
    df = spark.createDataFrame([("audio/a.wav",), ("a/../../x",), ("../a",), ("a/../b",), ("/etc/x",)], "p string")
    assert [r[0] for r in df.select(X.escapes_root(F.col("p"))).collect()] == [False, True, True, False, True]


def test_record_log_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    blank = {f.name: None for f in schemas.TOKEN_RECORD}
    rows = [{**blank, "utterance_id": f"u{k}", "token_index": k, "alignment": "ok"} for k in range(6)]
    df = spark.createDataFrame(rows, schemas.TOKEN_RECORD)
    sinks.append_records(df.filter("token_index < 4"), path)
    done = C.read_records(spark, path)
    assert done.count() == 4
    assert R.pending(df, done, ["utterance_id", "token_index"]).count() == 2


def test_labels_need_both_splits(spark):
    with pytest.raises(ValueError):
        C.guard_splits(spark.createDataFrame([("train",)], "split string"))


def test_stream_scores_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    schema = spark.range(1).schema
    run = lambda: ST.stream_records(
        ST.stream_dedupe(ST.read_stream(spark, src, schema), ["id"]).select("id"), lambda d: d, out, state).awaitTermination()
    spark.range(5).write.json(src)
    run()
    run()
    spark.range(3, 8).write.mode("append").json(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_sql_functions(spark):
    S.register_functions(spark)
    row = spark.sql("SELECT normalize_phone('ˈiː') a, client_split('ABA') b, tone_of('<`/x') c, "
                    "contrast_confusions('ð:z, d') d, round(raw_contrast(map('ð', 0.2D, 'z', 0.7D), 'ð'), 4) e").first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("i", "train", "fall_rise", ["z", "d"], 1.2528)


def test_exports_need_train_and_val_among_any_splits(spark):
    rows = spark.createDataFrame([(f"s{k}",) for k in range(40)] + [("train",), ("val",), (None,)], "split string")
    assert C.guard_splits(rows).count() == 43
    with pytest.raises(ValueError):
        C.guard_splits(rows.filter("split <> 'val' OR split IS NULL"))


def test_contrast_functions_raise_without_a_colon(spark):
    registry_names = S.register_functions(spark)
    assert "contrast_target" in registry_names
    got = spark.sql("SELECT contrast_target('ð: z, d'), contrast_confusions('ð: z, d'), contrast_target(NULL)").first()
    assert tuple(got) == ("ð", ["z", "d"], None)
    for name in ("contrast_target", "contrast_confusions"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT {name}('ð z')").collect()
