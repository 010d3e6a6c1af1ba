"""Platt calibration: grouped maximum-likelihood fits, probabilities, verdicts, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import col, count_if, num, sigmoid
from phonoframe.operators.ranks import join_keys
from phonoframe.operators.storage import settle, store

MAX_STEP = 20.0
MOST_GROUPS = 100_000
VARIANTS = {
    "mean": "score", "spike": "spike_score", "vote": "vote_fraction", "gop": "gop",
    "hearing": "hearing_score",
}


def fit_platt(
    df: DataFrame, score: str, label: Column, by: list[str] | None = None,
    max_iter: int = 40, tol: float = 1e-10,
) -> DataFrame:
    """Logistic fit of ``label`` on ``score`` per group: columns a, b, n, converged.

    A fit that does not converge, as on separable scores, whose slope has no bound, has no result: a
    and b are null, so probabilities are null and sweeps, verdicts and calibrations refuse the group.
    Steps are damped to ``MAX_STEP``, which no converging pass needs near its end.

    Newton's method on sufficient statistics: each pass is one aggregation to five
    sums per group, so records never leave the executors. Equal scores collapse to
    one weighted row before the first pass. A group with one class gets (0, 0) when
    all labels are true and (0, -1) when none is.
    """
    by = by or []
    data = settle(
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("_x"))
        .agg(F.count("*").cast("double").alias("_n"),
             count_if(label).cast("double").alias("_y"))
    )
    sizes = data.groupBy(*by).agg(F.sum("_n").alias("_size"), F.sum("_y").alias("_true"))
    single = (F.col("_true") == 0) | (F.col("_true") == F.col("_size"))
    state = settle(sizes.filter(F.col("_size") > 0).select(
        *by,
        F.col("_size").cast("bigint").alias("n"),
        F.lit(0.0).alias("a"),
        F.when(single & (F.col("_true") == 0), F.lit(-1.0)).otherwise(F.lit(0.0)).alias("b"),
        single.alias("converged"),
    ))
    if not by and state.isEmpty():
        raise ValueError("cannot fit a calibration on an empty pool")
    # ``data`` may have a few hot groups; ``state`` has a row for each group and is broadcast if they are few
    few = F.broadcast if state.count() <= MOST_GROUPS else lambda groups: groups
    for _ in range(max_iter):
        if state.filter(~F.col("converged")).isEmpty():
            break
        state = store(_newton_pass(data, state, by, tol, few))
    return state.withColumns({c: F.when(F.col("converged"), F.col(c)) for c in ("a", "b")})


def _newton_pass(data: DataFrame, state: DataFrame, by: list[str], tol: float, few) -> DataFrame:
    x, n, y = F.col("_x"), F.col("_n"), F.col("_y")
    fit = join_keys(data, few(state.filter(~F.col("converged")).select(*by, "a", "b")), by)
    p = sigmoid(F.col("a") * x + F.col("b"))
    w = n * p * (1 - p)
    sums = fit.groupBy(*by).agg(
        F.sum(x * (y - n * p)).alias("_ga"),
        F.sum(y - n * p).alias("_gb"),
        F.sum(w * x * x).alias("_haa"),
        F.sum(w * x).alias("_hab"),
        F.sum(w).alias("_hbb"),
    )
    det = F.col("_haa") * F.col("_hbb") - F.col("_hab") * F.col("_hab")
    da = F.try_divide(F.col("_hbb") * F.col("_ga") - F.col("_hab") * F.col("_gb"), det)
    db = F.try_divide(F.col("_haa") * F.col("_gb") - F.col("_hab") * F.col("_ga"), det)
    # a constant score has no slope to fit: only the intercept moves
    step_a = F.coalesce(da, F.lit(0.0))
    step_b = F.coalesce(db, F.try_divide(F.col("_gb"), F.col("_hbb")), F.lit(0.0))
    damp = F.least(F.lit(1.0), F.try_divide(F.lit(MAX_STEP), F.greatest(F.abs(step_a), F.abs(step_b))))
    step_a, step_b = step_a * F.coalesce(damp, F.lit(1.0)), step_b * F.coalesce(damp, F.lit(1.0))
    steps = sums.select(
        *by, step_a.alias("_da"), step_b.alias("_db"),
        (F.greatest(F.abs(step_a), F.abs(step_b)) < tol).alias("_done"),
    )
    joined = join_keys(state, few(steps), by, "left")
    move = ~F.col("converged") & F.col("_da").isNotNull()
    return joined.select(
        *by, "n",
        F.when(move, F.col("a") + F.col("_da")).otherwise(F.col("a")).alias("a"),
        F.when(move, F.col("b") + F.col("_db")).otherwise(F.col("b")).alias("b"),
        F.when(move, F.col("_done")).otherwise(F.col("converged")).alias("converged"),
    )


# -- applying a calibration -------------------------------------------------------------


def variant_value(variant: str | Column) -> Column:
    """Evidence of the chosen scoring variant; null evidence stays null."""
    if isinstance(variant, str):
        return F.col(VARIANTS[variant])
    pick = [F.when(variant == name, F.col(c)) for name, c in VARIANTS.items()]
    return F.coalesce(*pick)


def platt_prob(variant: str | Column, a: float | str | Column, b: float | str | Column) -> Column:
    return sigmoid(num(a) * variant_value(variant) + num(b))


def decide(value: Column | str, a: Column | str, b: Column | str, threshold: Column | str) -> Column:
    """struct(verdict, confidence, is_detected): three-way verdict around the band."""
    p = sigmoid(num(a) * col(value) + num(b))
    t = num(threshold)
    usable = p.isNotNull() & t.isNotNull()
    verdict = (
        F.when(usable & (p >= t), F.lit("substituted"))
        .when(usable & (p <= 1.0 - t), F.lit("on_target"))
        .otherwise(F.lit("uncertain"))
    )
    return F.struct(
        verdict.alias("verdict"),
        F.when(usable, p).otherwise(F.lit(0.0)).alias("confidence"),
        (verdict == "substituted").alias("is_detected"),
    )


def match_calibration(df: DataFrame, calib: DataFrame) -> DataFrame:
    """Attach the calibration of the same model and target; other models give nothing.

    A calibration table has one row per model and target. It is left to the join
    planner, which broadcasts it when its measured size allows.
    """
    table = calib.withColumnsRenamed({"model_id": "_model", "target": "_target"})
    on = (df["model_id"] == table["_model"]) & (df["target"] == table["_target"])
    return df.join(table, on, "left").drop("_model", "_target")


def phone_score(gop: Column | str, is_focus: Column | str, a: Column | str, b: Column | str) -> Column:
    """GOP on the 0..1 scale, for the focus phone with a GOP fit only."""
    return F.when(col(is_focus), F.round(sigmoid(num(a) * col(gop) + num(b)), 4))


# -- building and checking calibrations ----------------------------------------------------


def build_calibration(exams: DataFrame) -> DataFrame:
    """One calibration row per exam; every block only when its own exam passed.

    ``exams``: model_id, target, confusions, score_variant, generated_by, judge_status,
    platt_a/b, threshold, gop_a/b, hearing_status, hearing_a/b, hearing_threshold, cal.
    """
    judge = F.col("judge_status") == "ok"
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    committed = (F.col("hearing_status") == "ok") & (F.col("cal") >= K.COMMIT_FLOOR)
    return exams.filter(committed).select(
        F.lit("1.0").alias("schema_version"),
        "generated_by", "model_id", "target", "confusions", "score_variant",
        F.when(judge, pair("platt_a", "platt_b")).alias("substitution_platt"),
        F.when(judge, F.col("threshold")).alias("threshold"),
        F.when(F.col("gop_a").isNotNull(), pair("gop_a", "gop_b")).alias("gop_platt"),
        pair("hearing_a", "hearing_b").alias("hearing_platt"),
        F.col("hearing_threshold"),
        F.struct(
            F.lit(K.MIN_ALIGNMENT).alias("min_confidence"),
            F.lit(K.LOW_ALIGNMENT).alias("low_confidence"),
        ).alias("alignment"),
    )


def validate_calibration(df: DataFrame, reports: DataFrame, known: list[str]) -> DataFrame:
    """Violations of calibration rows as (model_id, target, rule).

    ``df`` may carry extra columns: any column outside ``known`` is a violation.
    ``reports`` has generated_by, status, threshold of the evidence.
    """
    required = [
        F.when(F.col(c).isNull(), F.lit(f"missing {c}"))
        for c in ("schema_version", "generated_by", "model_id", "target", "confusions")
    ]
    outside = [
        F.when(F.col(c).isNotNull() & ~F.col(c).between(0.5, 1.0), F.lit(f"{c} outside [0.5, 1]"))
        for c in ("threshold", "hearing_threshold")
    ]
    unknown = [
        F.when(F.col(c).isNotNull(), F.lit(f"unknown key {c}"))
        for c in df.columns if c not in known
    ]
    version = F.when(F.col("schema_version") != "1.0", F.lit("schema_version must be 1.0"))
    variants = F.when(
        ~F.coalesce(F.col("score_variant"), F.lit("mean")).isin("mean", "spike", "vote", "gop"),
        F.lit("unknown score_variant"),
    )
    rules = F.array_compact(F.array(*required, *outside, *unknown, version, variants))
    broken = df.select("model_id", "target", F.explode(rules).alias("rule"))
    proof = reports.select(
        F.col("generated_by").alias("_by"),
        F.col("status").alias("_status"),
        F.col("threshold").alias("_threshold"),
    )
    traced = df.join(proof, df["generated_by"] == proof["_by"], "left")
    reasons = (
        F.when(F.col("_by").isNull(), F.lit("report not found"))
        .when(F.col("_status") != "ok", F.lit("report is not ok"))
        .when(
            F.col("threshold").isNotNull() & ~F.col("threshold").eqNullSafe(F.col("_threshold")),
            F.lit("threshold differs from report"),
        )
    )
    untraced = traced.select("model_id", "target", reasons.alias("rule")).filter(
        F.col("rule").isNotNull()
    )
    return reduce(DataFrame.unionByName, [broken, untraced])
