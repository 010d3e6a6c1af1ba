"""Exam statistics: operating-point metrics, audits, AUC, threshold sweeps, bake-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import col, count_if, num, ratio, sigmoid
from phonoframe.operators.ranks import (
    join_keys,
    median_rank,
    positions,
    running,
    top_k,
    value_bucket,
)

Number = float | str | Column


def is_positive() -> Column:
    """The corpus says this token is an error."""
    return F.col("label").isin("substituted", "deleted")


def realized_of(target: Number) -> Column:
    """What was produced: the target, the deletion mark, or the known substitute."""
    t = F.lit(target) if isinstance(target, str) else target
    return (
        F.when(F.col("label") == "correct", t)
        .when(F.col("label") == "deleted", F.lit(K.DELETED))
        .otherwise(F.col("substituted_with"))
    )


# -- judge metrics ---------------------------------------------------------------


def _judge_rates(df: DataFrame) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"), None)
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"), None)
    return df.withColumns(
        {
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": ratio(2 * precision * recall, precision + recall),
        }
    )


def _judge_counts(value: str, flagged: Column) -> list[Column]:
    positive, scored = is_positive(), F.col(value).isNotNull()
    flagged = F.coalesce(flagged, F.lit(False))
    return [
        F.count("*").alias("tokens"),
        count_if(positive).alias("positives"),
        count_if(scored).alias("verdicts"),
        count_if(~scored).alias("refused"),
        count_if(F.col("audio_problem")).alias("audio_problem_refused"),
        count_if(flagged & positive).alias("tp"),
        count_if(flagged & ~positive).alias("fp"),
        count_if(~flagged & positive).alias("fn"),
    ]


def flagged_at(value: str, a: Number, b: Number, threshold: Number) -> Column:
    return sigmoid(num(a) * F.col(value) + num(b)) >= num(threshold)


def score_metrics(
    df: DataFrame, a: Number, b: Number, threshold: Number, value: str = "score",
    by: list[str] | None = None,
) -> DataFrame:
    """Counts, precision, recall and F1 at one operating point, per group."""
    counts = _judge_counts(value, flagged_at(value, a, b, threshold))
    return _judge_rates(df.groupBy(*(by or [])).agg(*counts))


def group_ok() -> Column:
    bars = (F.col("precision") >= K.PRECISION_BAR) & (F.col("recall") >= K.RECALL_BAR)
    small = (F.col("positives") == 0) | (F.col("precision") >= K.GROUP_FLOOR)
    return F.when(F.col("positives") >= K.GROUP_MIN, bars).otherwise(small)


def audit(
    df: DataFrame, a: Number, b: Number, threshold: Number, by: str, value: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """Metrics of every group and of the whole pool in one pass, with an ``ok`` flag."""
    keep = keep or []
    pooled = [F.col(k) for k in keep]
    sets = [[*pooled, F.col(by)], pooled]
    counts = _judge_counts(value, flagged_at(value, a, b, threshold))
    grouped = df.groupingSets(sets, *pooled, F.col(by)).agg(F.grouping(by).alias("_all"), *counts)
    named = grouped.withColumn(by, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(by)))
    return _judge_rates(named.drop("_all")).withColumn("ok", group_ok())


def final_status(cal_status: Column | str) -> Column:
    """Calibration status first, then the pooled bar."""
    met = (F.col("precision") >= K.PRECISION_BAR) & (F.col("recall") >= K.RECALL_BAR)
    return (
        F.when(col(cal_status) != "ok", col(cal_status))
        .when(met, F.lit("ok"))
        .otherwise(F.lit("pooled-bar-not-met"))
    )


def auc(df: DataFrame, score: str, label: Column, by: list[str] | None = None) -> DataFrame:
    """Tie-corrected ROC-AUC per group; null when a group has one class only.

    Rows collapse to distinct scores first; each distinct score then contributes its
    positives times the negatives below it plus half of the negatives tied with it.
    """
    by = by or []
    ties = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        count_if(label).alias("_pos"), count_if(~label).alias("_neg")
    )
    cum = running(ties, by, [score], {"_below": F.col("_neg")}, value_bucket(score))
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / F.lit(2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return cum.groupBy(*by).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.round(F.try_divide(F.sum(won), F.nullif(pairs, F.lit(0.0))), 4).alias("auc"),
    )


def precision_at_recall(
    df: DataFrame, score: str, label: Column, recall: float = 0.4, by: list[str] | None = None
) -> DataFrame:
    """Precision at the first rank (score desc, positives first on ties) reaching ``recall``."""
    by = by or []
    ties = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        count_if(label).alias("_pos"), count_if(~label).alias("_neg")
    )
    ties = ties.withColumn("_neg_score", -F.col(score))
    cum = running(
        ties, by, ["_neg_score"], {"_tp": F.col("_pos"), "_fp": F.col("_neg")},
        value_bucket("_neg_score"),
    )
    sizes = ties.groupBy(*by).agg(F.sum("_pos").alias("_n"))
    rows = join_keys(cum, sizes, by)
    # within a tie positives come first, so the rank is reached on the k-th positive
    need = F.ceil(F.lit(recall) * F.col("_n"))
    before = F.col("_tp") - F.col("_pos")
    hit = (F.col("_n") > 0) & (F.col("_tp") >= need) & (before < need)
    fp_before = F.col("_fp") - F.col("_neg")
    return rows.groupBy(*by).agg(
        F.max("_n").alias("positives"),
        F.round(
            F.coalesce(F.max(F.when(hit, need / (need + fp_before))), F.lit(0.0)), 4
        ).alias("precision"),
    )


# -- threshold sweeps ----------------------------------------------------------------


def thresholds_passed(p: Column) -> Column:
    """How many of the 100 operating thresholds a probability reaches.

    A guess by division is corrected against the literal list, so a probability equal
    to a listed threshold always passes it.
    """
    grid = F.array(*[F.lit(t) for t in K.THRESHOLDS])
    last = len(K.THRESHOLDS) - 1
    guess = F.greatest(F.least(F.floor((p - 0.5) / 0.005), F.lit(last)), F.lit(-1)).cast("int")
    up = F.coalesce(F.get(grid, guess + 1) <= p, F.lit(False))
    down = F.coalesce(F.get(grid, guess) > p, F.lit(False))
    passed = guess + 1 + F.when(up, 1).when(down, -1).otherwise(0)
    return F.when(p.isNotNull(), passed)


def _sweep(binned: DataFrame, by: list[str], fixed: list[str], passing: list[str]) -> DataFrame:
    """Totals at every threshold from per-bin counts (at most 101 rows per group)."""
    steps = F.sequence(F.lit(0), F.lit(len(K.THRESHOLDS) - 1))
    grid = F.array(*[F.lit(t) for t in K.THRESHOLDS])
    spread = binned.withColumn("_k", F.explode(steps)).withColumn(
        "threshold", F.get(grid, F.col("_k"))
    )
    reached = F.col("_bin") > F.col("_k")
    return spread.groupBy(*by, "threshold").agg(
        *[F.sum(f).alias(f) for f in fixed],
        *[F.sum(F.when(reached, F.col(p)).otherwise(0)).alias(p) for p in passing],
    )


def _pick(swept: DataFrame, by: list[str], bar: Column, wanted: str, fallback: str) -> DataFrame:
    met = F.coalesce(bar, F.lit(False))
    key = [
        met.alias("_met"),
        F.when(met, F.col(wanted)).otherwise(F.col(fallback)).alias("_value"),
        F.col("threshold"),
    ]
    rest = [c for c in swept.columns if c not in by and c != "threshold"]
    best = swept.groupBy(*by).agg(F.max(F.struct(*key, *rest)).alias("_best"))
    return best.select(
        *by,
        "_best.threshold",
        F.when(F.col("_best._met"), F.lit("ok")).otherwise(F.lit(K.BAR_NOT_MET)).alias("status"),
        *[F.col(f"_best.{c}").alias(c) for c in rest],
    )


def pick_threshold(
    df: DataFrame, a: Number, b: Number, value: str = "score", by: list[str] | None = None
) -> DataFrame:
    """Precision-first operating point over 100 thresholds, per group.

    One pass: every record is reduced to the number of thresholds it passes, counts
    per bin are summed, and the sweep runs on at most 101 bins per group.
    """
    by = by or []
    positive = is_positive()
    p = sigmoid(num(a) * F.col(value) + num(b))
    binned = df.groupBy(*by, F.coalesce(thresholds_passed(p), F.lit(0)).alias("_bin")).agg(
        F.count("*").alias("tokens"),
        count_if(positive).alias("positives"),
        count_if(F.col(value).isNotNull()).alias("verdicts"),
        count_if(F.col("audio_problem")).alias("audio_problem_refused"),
        count_if(positive).alias("tp"),
        count_if(~positive).alias("fp"),
    )
    fixed = ["tokens", "positives", "verdicts", "audio_problem_refused"]
    swept = _sweep(binned, by, fixed, ["tp", "fp"]).withColumns(
        {"refused": F.col("tokens") - F.col("verdicts"), "fn": F.col("positives") - F.col("tp")}
    )
    rated = _judge_rates(swept)
    return _pick(rated, by, F.col("precision") >= K.PRECISION_BAR, "recall", "precision")


# -- mirror metrics ----------------------------------------------------------------


def _hearing_counts(target: Number, confident: Column) -> list[Column]:
    heard, realized = F.col("heard"), realized_of(target)
    known = realized.isNotNull()
    said = heard.isNotNull()
    sure = said & F.coalesce(confident, F.lit(False))
    return [
        F.count("*").alias("tokens"),
        count_if(said).alias("scored"),
        count_if(sure).alias("confident"),
        count_if(sure & (heard == realized)).alias("correct"),
        count_if(sure & known).alias("_scorable"),
        count_if(said & known).alias("_raw"),
        count_if(said & (heard == realized)).alias("_raw_correct"),
    ]


def _hearing_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "accuracy": ratio(F.col("correct"), F.col("_scorable")),
            "coverage": ratio(F.col("confident"), F.col("tokens")),
            "answer_rate": ratio(F.col("confident"), F.col("scored")),
            "unscorable": F.col("confident") - F.col("_scorable"),
            "top1_accuracy": ratio(F.col("_raw_correct"), F.col("_raw")),
        }
    ).drop("_scorable", "_raw", "_raw_correct")


def hearing_metrics(
    df: DataFrame, target: Number, a: Number, b: Number, threshold: Number,
    by: list[str] | None = None,
) -> DataFrame:
    """Mirror honesty at one operating point, per group."""
    sure = flagged_at("hearing_score", a, b, threshold)
    return _hearing_rates(df.groupBy(*(by or [])).agg(*_hearing_counts(target, sure)))


def pick_hearing_threshold(
    df: DataFrame, target: Number, a: Number, b: Number, by: list[str] | None = None
) -> DataFrame:
    """Accuracy-first sweep: widest coverage with accuracy at the bar, per group."""
    by = by or []
    p = sigmoid(num(a) * F.col("hearing_score") + num(b))
    passed = F.when(F.col("heard").isNotNull(), thresholds_passed(p))
    binned = df.groupBy(*by, F.coalesce(passed, F.lit(0)).alias("_bin")).agg(
        *_hearing_counts(target, F.lit(True))
    )
    swept = _sweep(
        binned, by, ["tokens", "scored", "_raw", "_raw_correct"],
        ["confident", "correct", "_scorable"],
    )
    rated = _hearing_rates(swept)
    return _pick(rated, by, F.col("accuracy") >= K.ACCURACY_BAR, "coverage", "accuracy")


def hearing_status(cal_status: Column | str) -> Column:
    met = (F.col("accuracy") >= K.ACCURACY_BAR) & (F.col("coverage") >= K.COVERAGE_BAR)
    return (
        F.when(col(cal_status) != "ok", col(cal_status))
        .when(met, F.lit("ok"))
        .otherwise(F.lit("mirror-bar-not-met"))
    )


def hearing_audit(
    df: DataFrame, target: Number, a: Number, b: Number, threshold: Number, by: list[str]
) -> DataFrame:
    bars = (F.col("accuracy") >= K.ACCURACY_BAR) & (F.col("coverage") >= K.COVERAGE_BAR)
    small = (F.col("confident") == 0) | (F.col("accuracy") >= K.GROUP_FLOOR)
    return hearing_metrics(df, target, a, b, threshold, by).withColumn(
        "ok", F.when(F.col("confident") >= K.GROUP_MIN, bars).otherwise(small)
    )


def confusion(
    df: DataFrame, target: str, a: Number, b: Number, threshold: Number, heard: list[str]
) -> DataFrame:
    """Realized x heard counts of confident reports: target row first, zeros filled in.

    The columns are the labels in ``heard`` and, in order, any other that confident reports hold; the
    phone inventory bounds them.
    """
    sure = F.coalesce(flagged_at("hearing_score", a, b, threshold), F.lit(False))
    rows = df.filter(sure & F.col("heard").isNotNull()).withColumn("realized", realized_of(target)).filter(
        F.col("realized").isNotNull())
    found = rows.filter(~F.col("heard").isin(heard)).select("heard").distinct().collect()
    columns = [*heard, *sorted(r["heard"] for r in found)]
    table = rows.groupBy("realized").pivot("heard", columns).agg(F.count(F.lit(1))).na.fill(0)
    return table.withColumn("is_target", F.col("realized") == target).orderBy(
        F.col("is_target").desc(), "realized"
    )


# -- run health ----------------------------------------------------------------------


def status_stats(df: DataFrame) -> DataFrame:
    """Share of each alignment status, with the mean confidence of ok rows."""
    grouped = df.groupBy("alignment").agg(
        F.count("*").alias("n"), F.avg("alignment_confidence").alias("_mean")
    )
    return grouped.select(
        "alignment", "n",
        F.when(F.col("alignment") == "ok", F.round("_mean", 4)).alias("mean_ok_confidence"),
    )


def latency(df: DataFrame, order: list[str]) -> DataFrame:
    """Cold value of the first run and exact median over scored rows with positive time."""
    cold = df.agg(F.round(F.min_by("wall_ms", F.struct(*order)), 1).alias("cold_ms"))
    warm = df.filter(F.col("score").isNotNull() & (F.col("wall_ms") > 0))
    mid = positions(warm, [], "wall_ms", {"median_warm_ms": median_rank()})
    return cold.crossJoin(mid.select(F.round("median_warm_ms", 1).alias("median_warm_ms")))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.agg(*[count_if(F.col("split") == s).alias(s) for s in ("train", "cal", "test")])


def commit_gate(df: DataFrame, status: Column | str) -> DataFrame:
    """Split sizes and whether a calibration may be committed from them."""
    sizes = split_sizes(df).withColumn("status", F.lit(status) if isinstance(status, str) else status)
    empty = (F.col("cal") == 0) | (F.col("test") == 0)
    gate = (F.col("status") == "ok") & (F.col("cal") >= K.COMMIT_FLOOR)
    return sizes.withColumn(
        "commit",
        F.when(empty, F.raise_error(F.lit("the cal or test split is empty")).cast("boolean"))
        .otherwise(gate),
    )


# -- bake-offs ------------------------------------------------------------------------


def variant_rows(df: DataFrame) -> DataFrame:
    """Long form: one row per record and scoring variant, value in ``value``."""
    pairs = [("mean", "score"), ("spike", "spike_score"), ("vote", "vote_fraction"), ("gop", "gop")]
    options = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), F.col(c).cast("double").alias("value"))
            for name, c in pairs
        ]
    )
    return df.withColumn("_o", F.explode(options)).select(
        "*", F.col("_o.variant").alias("variant"), F.col("_o.value").alias("value")
    ).drop("_o")


def pick_variant(summary: DataFrame) -> DataFrame:
    """Best variant: among passing ones by (f1, recall), else by AUC; first listed on ties."""
    place = F.array_position(
        F.array(*[F.lit(v) for v in ("mean", "spike", "vote", "gop")]), F.col("variant")
    )
    passed = F.col("status") == "ok"
    order = [
        passed.desc(),
        F.when(passed, F.col("f1")).otherwise(F.coalesce(F.col("auc"), F.lit(-1.0))).desc(),
        F.when(passed, F.col("recall")).otherwise(F.lit(0.0)).desc(),
        place.asc(),
    ]
    return summary.orderBy(*order).limit(1)


def model_bakeoff(summaries: DataFrame) -> DataFrame:
    """Comparison table of models; the winner is the best (f1, precision) among ok ones."""
    ok = summaries.filter(F.col("status") == "ok")
    best = top_k(ok, [], [F.col("f1").desc(), F.col("precision").desc(), F.col("model_id")], 1)
    flag = best.select(F.col("model_id").alias("_winner"))
    return summaries.join(F.broadcast(flag), F.col("model_id") == F.col("_winner"), "left").select(
        *summaries.columns, F.col("_winner").isNotNull().alias("winner")
    )


def multiclass_metrics(df: DataFrame, classes: list, expected: str, predicted: str) -> DataFrame:
    """Accuracy, macro-F1 and per-class accuracy in one pass: one row per class."""
    cells = df.groupBy(expected, predicted).agg(F.count("*").alias("_n"))
    e, p, n = F.col(expected), F.col(predicted), F.col("_n")
    stats = cells.agg(
        F.sum(n).alias("total"),
        F.sum(F.when(e == p, n).otherwise(0)).alias("hits"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.sum(F.when((e == c) & (p == c), n).otherwise(0)).alias("tp"),
                    F.sum(F.when(e == c, n).otherwise(0)).alias("n"),
                    F.sum(F.when(p == c, n).otherwise(0)).alias("claimed"),
                )
                for c in classes
            ]
        ).alias("_classes"),
    )
    f1 = lambda c: ratio(2 * c["tp"], c["n"] + c["claimed"], None)
    macro = F.aggregate(F.col("_classes"), F.lit(0.0), lambda acc, c: acc + f1(c)) / len(classes)
    rows = stats.select(
        F.round(F.try_divide(F.col("hits").cast("double"), F.col("total")), 4).alias("accuracy"),
        F.round(macro, 4).alias("macro_f1"),
        F.explode("_classes").alias("c"),
    )
    return rows.select(
        F.col("c.class").alias("class"),
        F.col("c.n").alias("n"),
        F.round(F.try_divide(F.col("c.tp").cast("double"), F.col("c.n")), 4).alias("class_accuracy"),
        "accuracy", "macro_f1",
    )


def sequence_accuracy(df: DataFrame, decoded: Column, target: Column) -> DataFrame:
    """Share of clips whose decoded sequence equals the target sequence exactly."""
    hit = decoded == target
    return df.agg(
        F.count("*").alias("clips"),
        count_if(hit).alias("exact"),
        ratio(count_if(hit), F.count("*")).alias("accuracy"),
    )
