"""The report of an exam: every section a table or a list of facts, as ordered lines of Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe.sources.sinks import fact_rows, item_rows, markdown_rows

JUDGED = ["tokens", "positives", "precision", "recall", "f1", "ok"]


def _shown(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def sigmoid_text(a: str, b: str, value: str) -> Column:
    return _shown("p = sigmoid(", F.round(a, 3), f" * {value} + ", F.round(b, 3), ")")


def report_lines(frames: dict[str, DataFrame]) -> DataFrame:
    """(section, order, rank, line) of the frames of ``plans.exam.evaluate``; samples may be missing."""
    summary, best = frames["summary"], frames["best"]
    c = F.col
    chosen = lambda df: df.join(F.broadcast(best.select("variant")), "variant", "left_semi")
    sides = chosen(frames["metrics"])
    test = sides.filter("split = 'test'")
    rates = lambda split: F.max(F.when(c("split") == split, F.concat_ws("/", "precision", "recall")))
    pairs = frames["metrics"].groupBy("variant").agg(rates("cal").alias("cal P/R"), rates("test").alias("held-out P/R"))
    variants = frames["variants"].select("variant", "threshold", "status", "f1", "auc").join(pairs, "variant", "left")
    gap = sides.agg(
        F.max(F.when(c("split") == "cal", c("precision"))).alias("precision"),
        F.max(F.when(c("split") == "cal", c("recall"))).alias("recall"),
        F.max(F.when(c("split") == "test", c("precision"))).alias("_held"))
    corpora = chosen(frames["audit_corpus"]).join(frames["auc_corpus"].select("corpus", "auc"), "corpus", "left")
    confusion = frames["hearing_confusion"]
    heard = [h for h in confusion.columns if h not in ("realized", "is_target")]
    sections: list[list[DataFrame]] = [
        [fact_rows(summary, "Exam", [
            ("model", c("model_id")), ("contrast", _shown("/", c("target"), "/ vs ", F.array_join("confusions", ", "))),
            ("tokens", _shown(c("train"), " train / ", c("cal"), " cal / ", c("test"), " held-out")),
            ("mirror", c("hearing_status")), ("judge", c("judge_status"))])],
        [fact_rows(frames["hearing"], "Mirror", [
            ("fit", sigmoid_text("hearing_a", "hearing_b", "hearing_score")), ("threshold", c("hearing_threshold")),
            ("held-out accuracy / coverage", _shown(c("accuracy"), " / ", c("coverage"))), ("answer rate", c("answer_rate")),
            ("accuracy without gate", c("top1_accuracy")),
            ("confident reports", _shown(c("confident"), " of ", c("tokens"), ", ", c("unscorable"), " without a known realisation"))])],
        [markdown_rows(confusion, ["realized", *heard], "Realised and heard", 0, F.concat(F.when(c("is_target"), "a").otherwise("b"), "realized"))],
        [markdown_rows(frames["hearing_audit"], ["l1", "tokens", "confident", "accuracy", "coverage", "ok"], "Mirror by first language", 0, c("l1"))],
        [item_rows(frames["hearing_sample"], "Reports to listen to", [
            F.when(c("correct_report"), "right").otherwise("wrong")], _shown(
            c("utterance_id"), ":", c("token_index"), " heard /", c("heard"), "/, realised /", c("realized"), "/ (p = ", c("p_heard_realized"), ")"))
         ] if "hearing_sample" in frames else [],
        [markdown_rows(variants, ["variant", "threshold", "status", "cal P/R", "held-out P/R", "f1", "auc"], "Judge variants", 0, c("variant"))],
        [fact_rows(best, "Judge operating point", [
            ("variant", c("variant")), ("fit", sigmoid_text("a", "b", "score")), ("threshold", c("threshold"))]),
         fact_rows(gap, "Judge on cal", [
            ("precision / recall", _shown(c("precision"), " / ", c("recall"))),
            ("precision gap to held-out", F.round(c("precision") - c("_held"), 4))])],
        [fact_rows(test.join(F.broadcast(best.select("variant", "auc")), "variant"), "Judge held-out", [
            ("precision / recall / f1", _shown(c("precision"), " / ", c("recall"), " / ", c("f1"))), ("auc", c("auc")),
            ("verdicts", c("verdicts")), ("refused", _shown(c("refused"), ", ", c("audio_problem_refused"), " for the recording"))])],
        [markdown_rows(chosen(frames["audit_l1"]), ["l1", *JUDGED], "Judge by first language", 0, c("l1"))],
        [markdown_rows(corpora, ["corpus", *JUDGED[:-1], "auc"], "Judge by corpus", 0, c("corpus"))],
        [markdown_rows(frames["alignment"], ["alignment", "n", "mean_ok_confidence"], "Alignment", 0, c("alignment"))],
        [fact_rows(frames["latency"], "Latency", [("first, ms", c("cold_ms")), ("median, ms", c("median_warm_ms"))])],
        [item_rows(frames["flagged_sample"], "Flags to listen to", [
            F.when(c("correct_flag"), "true").otherwise("false")], _shown(
            c("utterance_id"), ":", c("token_index"), " -> /", c("predicted_confusion"), "/ (p = ", c("p_substituted"), ") label ", c("corpus_label")))
         ] if "flagged_sample" in frames else [],
    ]
    parts = [part.withColumn("order", F.lit(k)) for k, part in enumerate(p for section in sections for p in section)]
    return reduce(DataFrame.unionByName, parts)
