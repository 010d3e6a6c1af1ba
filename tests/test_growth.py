"""Steps whose disk and time grow no faster than their input."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoframe.bindings import labels as bound
from phonoframe.functions import scalar as S
from phonoframe.operators import intervals as I
from phonoframe.operators import labels as L
from phonoframe.operators import ranks as R
from phonoframe.operators import records as RC
from phonoframe.operators import splits as SP
from phonoframe.plans import exam
from phonoframe.sources import corpora, files, scores, sinks
from phonoframe import schemas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_keys_are_moved_once_and_hot_ones_by_bucket(spark, monkeypatch):
    rows = [(k, i, i % 5) for k, n in (("a", 3), ("b", 40), (None, 30), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    run = lambda sparse: R.running(df, ["k"], ["id"], {"s": F.col("v")}, F.expr("id div 8"), sparse)
    want = sorted(run(False).collect(), key=str)
    assert plan(run(True)).count("Exchange hashpartitioning") == 1
    assert sorted(run(True).collect(), key=str) == want
    monkeypatch.setattr(R, "HOT_ROWS", 10)
    assert sorted(run(True).select("k", "id", "v", "s").collect(), key=str) == want


def test_records_are_appended_compressed_and_read_beside_plain_ones(spark, tmp_path):
    path = str(tmp_path / "records")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TOKEN_RECORD if f.name not in ("utterance_id", "token_index")]
    rows = spark.range(0, 3000, 1, 1).select(
        F.concat(F.lit("u"), "id").alias("utterance_id"), F.col("id").cast("int").alias("token_index"), *none)
    rows.filter("token_index < 5").write.json(path)
    sinks.append_records(rows.filter("token_index >= 5"), path)
    assert sum(p.suffix == ".gz" for p in (tmp_path / "records").iterdir()) == 1
    assert sorted(corpora.read_records(spark, path).collect(), key=str) == sorted(rows.collect(), key=str)


def test_tokens_are_read_once_and_packed_with_their_targets(spark):
    tokens = spark.createDataFrame(
        [("u1", 1, "ð", "x"), ("u1", 0, "a", "y"), ("u1", 2, "ð", "z"), ("u2", 0, "b", "w"), (None, 0, "ð", "n"), ("u3", 0, None, "q")],
        "utterance_id string, token_index int, phone string, label string")
    utts = spark.createDataFrame(
        [(u, "open", "en", "s1", "") for u in ("u1", "u2", "u3")], "utterance_id string, corpus string, l1 string, speaker string, native_split string")
    roster = utts.select("speaker", "l1").distinct()
    found = RC.collect_tokens(utts, tokens, "ð", ["z"], roster)
    assert len(re.findall(r"Scan ExistingRDD\[utterance_id#\d+L?,token_index", plan(found))) == 1
    assert found.columns == ["utterance_id", "token_index", "phone", "label", "corpus", "l1", "speaker", "native_split", "split", "phones"]
    got = sorted((r.utterance_id, r.token_index, r.label, [(p["index"], p.ph, p.focus) for p in r.phones]) for r in found.collect())
    assert got == [
        ("u1", 1, "x", [(0, "a", False), (1, "ð", True), (2, "ð", False)]),
        ("u1", 2, "z", [(0, "a", False), (1, "ð", False), (2, "ð", True)])]


def test_a_short_roster_is_broadcast(spark, monkeypatch):
    rows = spark.range(100).select(
        F.concat(F.lit("u"), "id").alias("utterance_id"), F.lit("open").alias("corpus"), F.lit("").alias("native_split"),
        F.concat(F.lit("s"), F.col("id") % 9).alias("speaker"), F.lit("en").alias("l1"))
    roster = rows.select("speaker", "l1").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = SP.assign_split(rows, roster)
        assert "BroadcastHashJoin" in plan(few)
        monkeypatch.setattr(SP, "MOST_SPEAKERS", 3)
        many = SP.assign_split(rows, roster)
        assert "BroadcastHashJoin" not in plan(many) and sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_exam_computes_its_cal_and_test_rows_once(spark):
    label = F.when(F.col("id") % 3 == 0, "substituted").otherwise("correct")
    noise = (F.col("id") * 7919 % 1000) / 250.0 - 2.0
    value = noise + F.when(F.col("id") % 3 == 0, 0.8).otherwise(-0.8)
    records = spark.range(600).select(
        F.concat(F.lit("u"), "id").alias("utterance_id"), F.lit(0).alias("token_index"),
        F.element_at(F.array(*[F.lit(s) for s in ("train", "cal", "test")]), (1 + F.col("id") % 7 % 3).cast("int")).alias("split"),
        label.alias("label"), F.lit("z").alias("substituted_with"), *[value.alias(c) for c in ("score", "spike_score", "vote_fraction", "gop")],
        F.lit("en").alias("l1"), F.lit("open").alias("corpus"), F.when(F.col("id") % 4 == 0, "z").otherwise("ð").alias("heard"),
        value.alias("hearing_score"), F.lit("ok").alias("alignment"), F.lit(0.9).alias("alignment_confidence"),
        F.lit(False).alias("audio_problem"), F.lit(5.0).alias("wall_ms"))
    frames = exam.run_exam(records, "ð", ["z"], "m1", "r")
    for name in ("audit_l1", "metrics", "hearing_audit"):
        assert "Range (0, 600" not in plan(frames[name])
    sizes = frames["summary"].first()
    assert sizes.train + sizes.cal + sizes.test == 600 and sizes.train > 0


def test_fields_of_text_grids_are_worked_out_once(spark):
    grid = ('File type = "ooTextFile"\nObject class = "TextGrid"\ntiers? <exists>\nitem []:\n    item [1]:\n        class = "IntervalTier"\n'
            '        name = "words"\n        intervals: size = 1\n        intervals [1]:\n            xmin = 0\n            xmax = 1\n            text = ""a""\n')
    df = spark.createDataFrame([("p", grid)], "path string, value string")
    rows = corpora.parse_textgrid_long(df)
    assert [tuple(r) for r in rows.collect()] == [("p", "words", 0, 0.0, 1.0, '"a"')]
    text = spark.createDataFrame([("p", grid)], "path string, value string")
    lazy = corpora.parse_textgrid_long(text)._jdf.queryExecution().optimizedPlan().toString()
    assert lazy.count("split(item") <= 2  # the rows to explode, and the filter on their number


def test_gzipped_files_are_parsed_where_they_are_read(spark, tmp_path):
    lines = ["File type = \"ooTextFile short\"", '"TextGrid"', "0", "9", "<exists>", "1", '"IntervalTier"', '"t"', "0", "9", "3000"]
    for k in range(3000):
        lines += [str(k), str(k + 1), f'"w{k}"']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k long, value string").coalesce(1).sortWithinPartitions("k")
    rows.select("value").write.option("compression", "gzip").text(folder := str(tmp_path / "g"))
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = files.read_textgrid_short(spark, folder)
        assert [(r.idx, r.xmin, r.text) for r in got.collect()] == [(k, float(k), f"w{k}") for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_short_text_grids_do_not_copy_their_lines_to_each_record(spark):
    grid = 'File type = "ooTextFile short"\n"TextGrid"\n\n0\n9\n<exists>\n2\n"IntervalTier"\n"a"\n0\n9\n0\n"TextTier"\n"b"\n0\n9\n1\n4\n"x"\n'
    rows = corpora.parse_textgrid_short(spark.createDataFrame([("p", grid)], "path string, value string"))
    assert [tuple(r) for r in rows.collect()] == [("p", "point", "b", 0, 4.0, 4.0, "x")]
    assert "Generate inline" in plan(rows)


def test_score_files_are_compressed(spark, tmp_path, monkeypatch):
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(bound, "scratch", lambda _, name: f"{tmp_path}/{name}")
    assert bound.a3_phone_scores(spark, str(tmp_path)).count() == 3
    assert {p.suffix for name in ("scores", "detail") for p in (tmp_path / name).glob("part-*")} == {".gz"}


def test_a_label_is_cleaned_once_for_its_branches(spark):
    rows = spark.createDataFrame([("AH0",), ("R_x",), ("sil",), ("ɫ",), ("b, d, s",), (None,), ("?",)], "t string")
    found = rows.select("t", S.tier_phone("t").alias("p"))
    assert plan(found).count("(?<=.)") == 1
    assert [r.p for r in found.collect()][2] is None
    assert {r.t: r.p for r in found.collect()}["ɫ"] == "l" and {r.t: r.p for r in found.collect()}["?"] is None


def test_lines_are_made_once_before_they_are_parsed(spark):
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TOKEN_RECORD if f.name != "utterance_id"]
    rows = spark.range(3).select(F.concat(F.lit("u"), "id").alias("utterance_id"), *none)
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    assert "Filter " not in plan(corpora.records_from_json(lines))  # it would hold the step that makes the lines
    odd = lines.unionByName(spark.createDataFrame([("  ",), (None,)], "value string"))
    assert sorted(r.utterance_id for r in corpora.records_from_json(odd).collect()) == ["u0", "u1", "u2"]


def test_units_take_the_hot_keys_of_their_rows(spark, monkeypatch):
    words = spark.createDataFrame(
        [(p, i, i / 2, i / 2 + 0.5, t) for p in ("a", "b") for i, t in enumerate(["\\w1", "w2|", "/w3", "", "w4"])],
        "path string, idx long, xmin double, xmax double, text string")
    want = sorted(I.intonation_units(words).collect())
    hot = R.hot_keys(words, ["path"])
    monkeypatch.setattr(R, "HOT_ROWS", 2)
    spread = R.hot_keys(words, ["path"])
    monkeypatch.setattr(R, "hot_keys", lambda *a: 1 / 0)
    assert len(want) == 4 and spread.count() == 2
    assert sorted(I.intonation_units(words, hot=hot).collect()) == sorted(I.intonation_units(words, hot=spread).collect()) == want


def test_only_phones_are_collected(spark):
    tokens = spark.createDataFrame([("u", 1, "ð"), ("u", 0, "a"), ("u", 2, None)], "utterance_id string, token_index int, phone string")
    found = RC.expected_phones(tokens, "ð", ["z", "d"])
    assert not re.search(r"collect_list\([^)]*confusions", plan(found))
    assert [(p["index"], p.ph, p.focus, p.confusions) for p in found.first().phones] == [
        (0, "a", False, []), (1, "ð", True, ["z", "d"]), (2, None, None, [])]


def test_rows_are_numbered_once_for_chosen_keys_and_their_rows(spark, tmp_path):
    spark.sql("""SELECT id div 3 AS l_orderkey, id * 17 % 501 AS l_partkey, id % 7 AS l_suppkey, CAST(id % 3 + 1 AS INT) AS l_linenumber,
        id % 50 + 0.0D AS l_quantity, id * 1.5D AS l_extendedprice, 0.1D AS l_discount, substr('NRA', CAST(id % 5 % 3 AS INT) + 1, 1) AS l_returnflag,
        timestamp'2020-01-01' AS l_shipdate FROM range(3000)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT id AS s_suppkey, id % 2 AS s_nationkey FROM range(8)").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT id AS n_nationkey, id AS n_regionkey FROM range(2)").write.parquet(str(tmp_path / "nation.parquet"))
    spark.sql("SELECT id AS r_regionkey, CAST(id AS STRING) AS r_name FROM range(2)").write.parquet(str(tmp_path / "region.parquet"))
    found = bound.c8_restrict(spark, str(tmp_path))
    lazy = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in lazy and "Exchange hashpartitioning" not in plan(found)
    rows = bound.V.li_split(spark, str(tmp_path), indexed=True).filter("split = 'train' AND label = 'correct' AND score IS NOT NULL")
    want = sorted(((r.utterance_id, r.token_index, r.phone, r.score) for r in rows.collect()), key=lambda r: (-r[3], r[0], r[1]))[:1000]
    assert want and sorted(tuple(r) for r in found.collect()) == sorted(want)


def plain_tokens(canonical, detail):
    """(utterance, token, word, position, label, votes) by the rules of the corpus, in plain Python."""
    def bracketed(said, position, expected):
        raw = re.findall(r"[^ \t\r\n]+", said or "")
        agrees = said is not None and len(re.findall(r"[^ \t\r\n{}]+", said)) == expected
        return agrees and position < len(raw) and raw[position].strip("{}") != raw[position]

    for name in canonical.keys() & detail.keys():
        n, spoken = 0, (detail[name] or {}).get("words") or []
        for w, word in enumerate((canonical[name] or {}).get("words") or []):
            phones = word.get("phones") or []
            said = (spoken[w].get("phones") or []) if w < len(spoken) else []
            for position, label in enumerate(phones):
                yield name, n, w, position, label, sum(bracketed(e, position, len(phones)) for e in said)
                n += 1


def test_score_lines_of_any_layout_give_their_tokens(spark):
    rng = random.Random(7)
    text = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
    canonical, detail = {}, {}
    for u in range(120):
        words = [{"text": text('ab:,[]{} é'), "phones": [text("ABÇ") for _ in range(rng.randrange(4))]} for _ in range(rng.randrange(5))]
        spoken = [{"phones": [text(["A", "{", "}", " ", "{B} ", "\t" if u % 9 == 0 else " "]) for _ in range(rng.randrange(6))]}
                  for _ in range(max(0, len(words) + rng.choice([-1, 0, 0, 1])))]
        canonical[f"u{u}"], detail[f"u{u}"] = {"words": words}, {"text": "T", "words": spoken}
    canonical["u3"]["words"] = [{"text": "x"}, {"phones": ["A", None, '"']}, {"phones": ["B"], "accuracy": [10.0], "n": {"words": []}}]
    detail["u3"]["words"] = [{"phones": ["A"]}, {"phones": ["{A} B C", None]}, {"phones": ["{B}", "B}", "B"], "total": 9}]
    canonical["u4"], detail["u5"], detail["other"] = None, {"words": None}, {"words": []}
    dump = [json.dumps, lambda o: json.dumps(o, separators=(",", ":"), ensure_ascii=False), lambda o: json.dumps(o, indent=1)]

    def lines(scores):
        names = list(scores)
        cuts = [json.dumps({}), " ", None] + [dump[i % 3]({n: scores[n] for n in names[i:i + 3]}) for i in range(0, len(names), 3)]
        return spark.createDataFrame([(x,) for x in cuts], "value string")

    rows = corpora.parse_phone_scores(lines(canonical), lines(detail)).withColumn(
        "votes", L.expert_votes(F.col("experts"), F.col("position"))).drop("experts")
    found = sorted(map(tuple, rows.collect()), key=str)
    assert found == sorted(plain_tokens(canonical, detail), key=str) and sum(r[-1] for r in found) > 20
    assert [r[1:5] for r in found if r[0] == "u3"] == [(0, 1, 0, "A"), (1, 1, 1, None), (2, 1, 2, '"'), (3, 2, 0, "B")]


@pytest.mark.parametrize("line", ['{"u":{"words":[{"phones":["A"}]}}', '{"u":{"words":[{"phones":"A"}]}}', '{"u":{"words":[]}', '{"u":[]}', '{}"u"', '{"u" {}}', "x"])
def test_broken_score_lines_stop(line):
    good = '{"u":{"words":[{"phones":["A"]}]}}'
    rows = lambda x: list(scores.packed_utterances(iter([pa.record_batch([pa.array(x)], ["value"])])))
    assert sum(b.num_rows for b in rows([good, None, "", good])) == 2
    with pytest.raises(ValueError):
        rows([good, line, good])


def test_score_files_are_made_and_read_without_a_function_for_each_phone(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("doc_id"), F.expr("repeat('a bb ccc dddd eeeee ', CAST(id AS INT))").alias("text")).write.parquet(
        f"{tmp_path}/documents.parquet")
    assert all(plan(lines).count("lambdafunction(") <= 4 for lines in bound.score_files(spark, str(tmp_path)))  # one for each word
    monkeypatch.setattr(bound, "scratch", lambda _, name: f"{tmp_path}/{name}")
    found = bound.b7_expert_votes(spark, str(tmp_path))
    assert "lambdafunction(" not in plan(found) and "from_json" not in plan(found)
    assert found.filter("utterance_id = 'doc1'").first().votes == 19
