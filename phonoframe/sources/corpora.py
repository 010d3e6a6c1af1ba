"""Readers of corpus files. Every parser works on a DataFrame of text, so a reader is
``spark.read`` plus one map-only projection. TextGrid and duration files, whose lines only mean something in
their order, are read by ``phonoframe.sources.files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe import schemas
from phonoframe.operators.storage import bound_batches
from phonoframe.sources import scores as scorefiles


def _stop(message: str, detail: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), detail)).cast(kind)


# -- TextGrid ------------------------------------------------------------------------


def _fields(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Add the value of the first line ``key = value`` of a column for each key, without one quotation mark on each side;
    empty without such a line. Every step is a column of its own, so that none is worked out twice."""
    c = F.col
    found = df.withColumns({f"_at_{k}": F.locate(f"{k} =", c(text)) for k in keys})
    rest = found.withColumns({f"_v_{k}": F.when(c(f"_at_{k}") > 0, F.btrim(F.substring_index(
        F.substr(c(text), c(f"_at_{k}") + len(k) + 2), "\n", 1), F.lit(" \t\r"))).otherwise("") for k in keys})
    opened = rest.withColumns({f"_v_{k}": F.when(
        F.startswith(f"_v_{k}", F.lit('"')), F.substr(f"_v_{k}", F.lit(2))).otherwise(c(f"_v_{k}")) for k in keys})
    return opened.withColumns({k: F.when(
        F.endswith(f"_v_{k}", F.lit('"')), F.substr(f"_v_{k}", F.lit(1), F.length(f"_v_{k}") - 1)).otherwise(c(f"_v_{k}"))
        for k in keys}).drop(*[f"{p}{k}" for k in keys for p in ("_at_", "_v_")])


def parse_textgrid_long(df: DataFrame) -> DataFrame:
    """(path, value) of long TextGrids -> (path, tier, idx, xmin, xmax, text)."""
    head = F.substring_index("value", "\n", 1)
    other = F.col("value").rlike(r'(?m)^\s*class =\s*+"?+(?!IntervalTier)')
    checked = (
        F.when(~head.contains("ooTextFile"), _stop("not a long TextGrid", F.col("path"), "string"))
        .when(~F.col("value").contains("tiers?"), _stop("no tiers? marker", F.col("path"), "string"))
        .when(other, _stop("tier is not an IntervalTier", F.col("path"), "string"))
        .otherwise(F.col("value"))
    )
    items = F.split(checked, r"(?m)^\s*item \[\d+")
    tiers = df.select("path", F.posexplode(items).alias("tier_no", "item")).filter("tier_no > 0")
    split = tiers.select("path", F.split("item", r"(?m)^\s*intervals \[").alias("parts"))
    named = _fields(split.withColumn("top", F.get("parts", F.lit(0))), "top", "name")
    rows = named.select("path", F.col("name").alias("tier"), F.posexplode("parts").alias("idx", "part")).filter("idx > 0")
    has_text = F.col("part").rlike(r"(?m)^\s*text =")
    xmin, xmax = F.col("xmin"), F.col("xmax")
    unbound = (xmin == "") | (xmax == "")
    bound = lambda v: F.when(unbound, _stop("interval text before its bounds", F.col("path"), "double")).otherwise(
        v.cast("double"))
    return _fields(rows.filter(has_text), "part", "xmin", "xmax", "text").select(
        "path", "tier", (F.col("idx") - 1).alias("idx"), bound(xmin).alias("xmin"), bound(xmax).alias("xmax"), "text")


def parse_textgrid_short(df: DataFrame) -> DataFrame:
    """(path, value) of short TextGrids -> (path, kind, tier, idx, xmin, xmax, text).

    Interval tiers take three lines per record and point tiers two (xmin = xmax). The
    tier headers are found by one fold over the tier count; records by position.
    """
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    head = F.substring_index("value", "\n", 1)
    marker = F.array_position(F.col("lines"), "<exists>")
    ready = df.select("path", lines.alias("lines"), head.alias("head")).select(
        "path",
        F.when(~F.col("head").contains("ooTextFile short"),
               _stop("not a short TextGrid", F.col("path"), "array<string>"))
        .when(marker == 0, _stop("no <exists> marker", F.col("path"), "array<string>"))
        .otherwise(F.col("lines")).alias("lines"),
        marker.cast("int").alias("at"))
    line = lambda k: F.get(F.col("lines"), k)
    bare = lambda s: F.btrim(s, F.lit('"'))
    start = F.struct((F.col("at") + 1).alias("next"), F.array().cast(
        "array<struct<kind:string,name:string,first:int,n:int>>").alias("tiers"))

    def walk(acc: Column, _: Column) -> Column:
        k = acc["next"]
        kind, n = bare(line(k)), line(k + 4).cast("int")
        width = F.when(kind == "IntervalTier", 3).when(kind == "TextTier", 2).otherwise(
            _stop("unknown tier kind", kind, "int"))
        tier = F.struct(kind.alias("kind"), bare(line(k + 1)).alias("name"),
                        (k + 5).alias("first"), n.alias("n"))
        return F.struct((k + 5 + n * width).alias("next"),
                        F.concat(acc["tiers"], F.array(tier)).alias("tiers"))

    count = line(F.col("at")).cast("int")
    tiers = F.aggregate(F.sequence(F.lit(1), count), start, walk, lambda acc: acc["tiers"])

    def record(t: Column, idx: Column) -> Column:
        wide = t["kind"] == "IntervalTier"
        base = t["first"] + idx * F.when(wide, 3).otherwise(2)
        return F.struct(
            F.when(wide, "interval").otherwise("point").alias("kind"), t["name"].alias("tier"), idx.alias("idx"),
            line(base).cast("double").alias("xmin"),
            F.when(wide, line(base + 1)).otherwise(line(base)).cast("double").alias("xmax"),
            bare(F.when(wide, line(base + 2)).otherwise(line(base + 1))).alias("text"))

    # records are made beside the lines, so that no copy of the lines goes with each of them
    placed = ready.select("path", "lines", F.filter(tiers, lambda t: t["n"] > 0).alias("tiers"))
    records = F.flatten(F.transform("tiers", lambda t: F.transform(
        F.sequence(F.lit(0), t["n"] - 1), lambda idx: record(t, idx))))
    return placed.select("path", F.inline(records))


# -- score files -----------------------------------------------------------------------


def parse_phone_scores(scores: DataFrame, detail: DataFrame) -> DataFrame:
    """Canonical phones with their expert strings.

    Both inputs have a JSON object per ``value``: utterance -> words -> phones. Returns
    (utterance_id, token_index, word_index, position, label, experts) with token_index
    running over the words and ``experts`` as the ``lines`` of the voting experts,
    words with one blank between them, and their ``votes`` at each position.
    A word without phones has no tokens, and a line that is no such object stops the job.
    """
    spark = scores.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # packed rows are too small for Spark to see how much work they are
    words = lambda df, name: df.select("value").mapInArrow(scorefiles.packed_utterances, scorefiles.PACKED).select(
        "utterance_id", F.col("packed").alias(name)).repartition(parts, "utterance_id")
    pairs = words(detail, "expert").join(words(scores, "canonical"), "utterance_id")
    voted = pairs.select("utterance_id", "canonical", "expert").mapInArrow(scorefiles.voted_words, scorefiles.VOTED)
    tokens = voted.select("utterance_id", "first", "word_index", "experts", F.posexplode("phones").alias("position", "label"))
    return tokens.select(
        "utterance_id", (F.col("first") + F.col("position")).alias("token_index"), "word_index", "position", "label", "experts")


def read_phone_scores(spark: SparkSession, scores: str, detail: str, lines: bool = False) -> DataFrame:
    """Score files: one JSON object each, or one on every line, which spreads over many tasks."""
    read = lambda p: spark.read.text(p, wholetext=not lines)
    return parse_phone_scores(read(scores), read(detail))


def parse_kv(df: DataFrame, exact: bool) -> DataFrame:
    """``value`` lines -> (key, value): exactly two fields, or the rest after the first."""
    line = F.trim("value")
    parts = F.split(line, r"\s+") if exact else F.split(line, r"\s+", 2)
    ok = F.size(parts) == 2
    checked = F.when(ok, parts).otherwise(_stop("unparsable line", F.col("value"), "array<string>"))
    return df.select(checked.alias("p")).select(
        F.get("p", F.lit(0)).alias("key"), F.get("p", F.lit(1)).alias("value"))


def read_kv_text(spark: SparkSession, path: str, exact: bool) -> DataFrame:
    return parse_kv(spark.read.text(path), exact)


def parse_durations(df: DataFrame, order: Column, keep: list[str] | None = None) -> DataFrame:
    """``name.SIG<TAB>duration ...`` -> (block, passage, duration, ord) behind the columns to ``keep``."""
    name = F.regexp_replace(F.substring_index(F.trim("value"), "\t", 1), r"\.SIG$", "")
    rest = F.substring_index(F.trim("value"), "\t", -1)
    lines = df.withColumn("_ord", order).filter(F.trim("value") != "")
    return lines.select(
        *(keep or []), F.substring(name, 1, 3).alias("block"), F.substring(name, 1, 5).alias("passage"),
        F.get(F.split(F.trim(rest), r"\s+"), F.lit(0)).cast("double").alias("duration"),
        F.col("_ord").alias("ord"))


def scan_media(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(key, path, length) of files below root; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", glob).load(root)
    name = F.substring_index("path", "/", -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("key"), "path", "length")


def missing_media(utts: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Utterances without a file."""
    return utts.join(media.select(F.col("key").alias(key)), key, "left_anti")


# -- records, labels, manifests -----------------------------------------------------------


def records_from_json(df: DataFrame) -> DataFrame:
    """JSON lines -> typed token records; a malformed line stops the job."""
    parsed = F.from_json("value", schemas.TOKEN_RECORD, {"mode": "FAILFAST"})
    # a filter would be moved below the step that makes the lines, and make them twice
    lines = df.select(F.explode(F.filter(F.array("value"), lambda v: F.trim(v) != "")).alias("value"))
    return lines.select(parsed.alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOKEN_RECORD).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Label rows of several export folders with their ``source`` folder.

    Stops when train or val is empty: one small aggregation decides.
    """
    rows = spark.read.csv([f"{d}/labels" for d in dirs], header=True, schema=schemas.LABELS).select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"^(?:file:)?(.*)/labels/[^/]*$", 1).alias("source"))
    return guard_splits(rows)


def guard_splits(rows: DataFrame) -> DataFrame:
    wanted = ["train", "val"]
    found = [r["split"] for r in rows.filter(F.col("split").isin(wanted)).select("split").distinct().collect()]
    if len(found) < len(wanted):
        raise ValueError(f"exports need both train and val rows, found {sorted(found)}")
    return rows


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    return df.filter(~((F.col("id") == "id") & (F.col("client_id") == "client_id")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows without header lines that a second writer left mid-file."""
    columns = "id STRING, client_id STRING, text STRING, tokens STRING, audio_path STRING"
    return drop_repeated_headers(spark.read.csv(path, header=True, schema=columns))


