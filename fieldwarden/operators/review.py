"""Workload, recall and ranking metrics of scored review rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_if, equal_width_bin, logistic_loss, ratio, sigmoid, wilson
from ..session import staged
from .bootstrap import side_by_side
from .policy import decided, mandatory, score_counts, score_groups, usable, with_support
from .scale import running_totals

ACCEPTANCE = (0.5, 0.8, 0.9, 0.95)
BUDGETS = (.1, .2, .3, .5, .7, .9)


def evaluate_policy(rows: DataFrame, policy: DataFrame, supported: DataFrame | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Workload and error recall of a policy, one row (per ``by``)."""
    return evaluate_decisions(decided(rows, policy, supported), by)


def evaluate_decisions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from rows that carry ``mandatory`` and ``needs_review``: summed per document, then over documents."""
    return evaluate_documents(document_tallies(rows, by), by)


def document_tallies(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per document (and ``by``) of rows with decisions: what :func:`evaluate_documents` sums up."""
    return field_tallies(rows, [*by, "document_id"])


def field_tallies(rows: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """The counts of an evaluation over the rows of each group; ``weight`` tells how many fields a row stands for."""
    flag, wrong, head = F.col("needs_review"), ~F.col("correct"), ~F.col("mandatory")
    one = F.lit(1) if weight is None else weight

    def counted(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, one)), F.lit(0))

    return rows.groupBy(*by).agg(
        F.sum(one).alias("n"), counted(wrong).alias("errors"), counted(flag).alias("reviewed"),
        counted(flag & wrong).alias("caught"), counted(~flag & ~wrong).alias("accepted_correct"),
        counted(~head).alias("forced"), counted(head & wrong).alias("head_errors"),
        counted(head & flag).alias("head_reviewed"), counted(head & flag & wrong).alias("head_caught"))


def evaluate_documents(documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Workload and error recall from :func:`document_tallies`, one row (per ``by``)."""
    names = [c for c in documents.columns if c not in (*by, "document_id")]
    total = documents.groupBy(*by).agg(F.count("*").alias("documents"),
                                       count_if(F.col("reviewed") > 0).alias("reviewed_documents"),
                                       *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return evaluate_totals(total, by)


def evaluate_totals(total: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from the sums of :func:`field_tallies`, ``documents`` and ``reviewed_documents`` of each group."""
    c = F.col
    accepted = c("n") - c("reviewed")
    precision = wilson(c("accepted_correct"), accepted)
    recall = wilson(c("caught"), c("errors"))
    return total.select(
        *by, c("n").alias("fields"), "documents", "errors", c("reviewed").alias("reviewed_fields"),
        F.coalesce(ratio(c("reviewed"), c("n")), F.lit(0.0)).alias("review_rate"), accepted.alias("accepted_fields"),
        ratio(c("accepted_correct"), accepted).alias("accepted_precision"),
        precision[0].alias("accepted_precision_wilson_low"), precision[1].alias("accepted_precision_wilson_high"),
        c("caught").alias("caught_errors"), (c("errors") - c("caught")).alias("missed_errors"),
        ratio(c("caught"), c("errors")).alias("error_recall"), recall[0].alias("error_recall_wilson_low"),
        recall[1].alias("error_recall_wilson_high"), ratio(c("caught"), c("reviewed")).alias("review_precision"),
        "reviewed_documents",
        F.coalesce(ratio(c("reviewed_documents"), c("documents")), F.lit(0.0)).alias("document_review_rate"),
        c("forced").alias("mandatory_review"), (c("n") - c("forced")).alias("head_fields"), "head_errors",
        ratio(c("head_reviewed"), c("n") - c("forced")).alias("head_review_rate"),
        ratio(c("head_caught"), c("head_errors")).alias("head_error_recall"))


def oracle_review_rate(rows: DataFrame, target: float = .95, supported: DataFrame | None = None) -> DataFrame:
    """Least review rate at which ``target`` of the errors can be caught by a perfect ranking."""
    marked = with_support(rows, supported).withColumn("m", mandatory())
    wrong = ~F.col("correct")
    t = marked.agg(F.count("*").alias("n"), count_if(wrong).alias("errors"), count_if(F.col("m")).alias("forced"),
                   count_if(F.col("m") & wrong).alias("forced_errors"))
    extra = F.greatest(F.lit(0), F.ceil(F.lit(target) * F.col("errors")) - F.col("forced_errors"))
    return t.select(F.coalesce(ratio(F.col("forced") + extra, F.col("n")), F.lit(0.0)).alias("oracle_review_rate"))


def review_curve(rows: DataFrame) -> DataFrame:
    """Risk-coverage curve: one row per realisable threshold, highest first when sorted."""
    return _curve(score_counts(rows))


def _curve(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n")).scalar()
    swept = running_totals(score_groups(counts), ["score"], {"accepted": F.col("n"), "missed": F.col("errors")},
                           descending=True)
    return (swept.withColumn("total", total)
            .select(F.col("score").alias("threshold"), "n", "accepted", "missed", "total",
                    ratio(F.col("accepted"), F.col("total")).alias("coverage"),
                    ratio(F.col("missed"), F.col("accepted")).alias("risk")))


def aurc(rows: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve; rows no threshold decides are ranked last as errors."""
    counts = score_counts(rows)
    points = _curve(counts)
    t = points.agg(F.coalesce(F.sum(F.col("risk") * F.col("n")), F.lit(0.0)).alias("area"),
                   F.coalesce(F.max("accepted"), F.lit(0)).alias("accepted"),
                   F.coalesce(F.max("missed"), F.lit(0)).alias("missed"))
    t = side_by_side(t, counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    invalid = F.col("total") - F.col("accepted")
    tail = F.when(invalid > 0, ratio(F.col("missed") + invalid, F.col("total")) * invalid).otherwise(0.0)
    return t.select(ratio(F.col("area") + tail, F.col("total")).alias("aurc"),
                    F.coalesce(ratio(F.col("accepted"), F.col("total")), F.lit(0.0)).alias("maximum_valid_coverage"))


def budgets(rows: DataFrame, fractions: Sequence[float] = BUDGETS) -> DataFrame:
    """Errors caught when a share of the fields is reviewed: mandatory ones, then whole tie groups from the lowest score."""
    counts = score_counts(rows)
    forced = F.col("score").isNull()
    head = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (
        ("total", F.col("n")), ("all_errors", F.col("errors")), ("forced", F.when(forced, F.col("n"))),
        ("forced_errors", F.when(forced, F.col("errors"))))])
    swept = running_totals(score_groups(counts), ["score"], {"upto": F.col("n")})
    numbers = head.select(F.struct("*").alias("h")).scalar()
    swept = swept.withColumn("h", numbers)
    cap = {f: F.greatest(F.col("h.forced"), F.floor(F.col("h.total") * F.lit(float(f)))) for f in fractions}
    picked = swept.agg(*[x for i, f in enumerate(fractions) for x in (
        F.sum(F.when(F.col("h.forced") + F.col("upto") <= cap[f], F.col("n"))).alias(f"n{i}"),
        F.sum(F.when(F.col("h.forced") + F.col("upto") <= cap[f], F.col("errors"))).alias(f"e{i}"))])
    both = side_by_side(head, picked)
    lines = F.array(*[F.struct(
        F.lit(float(f)).alias("budget"), (F.col("forced") + F.coalesce(f"n{i}", F.lit(0))).alias("reviewed"),
        (F.col("forced_errors") + F.coalesce(f"e{i}", F.lit(0))).alias("caught_errors"),
        F.col("total").alias("total"), F.col("all_errors").alias("all_errors")) for i, f in enumerate(fractions)])
    return both.select(F.inline(lines)).select(
        "budget", ratio(F.col("reviewed"), F.col("total")).alias("review_rate"), "caught_errors",
        ratio(F.col("caught_errors"), F.col("all_errors")).alias("error_recall"))


# ------------------------------------------------------------------ calibration and ranking

def accuracy_brier_nll(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, accuracy, Brier score and NLL of rows with ``logit`` and ``correct``."""
    y = F.col("correct").cast("double")
    p = sigmoid(F.col("logit"))
    scored = rows.filter(F.col("logit").isNotNull())
    return scored.groupBy(*by).agg(F.count("*").alias("count"), F.avg(y).alias("accuracy"),
                                   F.avg((p - y) * (p - y)).alias("brier"),
                                   F.avg(logistic_loss(F.col("logit"), y)).alias("nll"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins of the probability."""
    per_bin = (rows.filter(F.col("logit").isNotNull()).withColumn("p", sigmoid(F.col("logit")))
               .groupBy(equal_width_bin(F.col("p"), bins).alias("bin"))
               .agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg(F.col("correct").cast("double")).alias("y")))
    return per_bin.agg(ratio(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"))


def acceptance(rows: DataFrame, thresholds: Sequence[float] = ACCEPTANCE) -> DataFrame:
    """Coverage and precision of accepting probabilities at or above each threshold: one pass, one row each."""
    scored = rows.filter(F.col("logit").isNotNull()).select(sigmoid(F.col("logit")).alias("p"), "correct")
    t = scored.agg(F.count("*").alias("n"), *[x for i, level in enumerate(thresholds) for x in (
        count_if(F.col("p") >= level).alias(f"a{i}"), count_if((F.col("p") >= level) & F.col("correct")).alias(f"c{i}"))])
    lines = F.array(*[F.struct(F.lit(level).alias("threshold"), ratio(F.col(f"a{i}"), F.col("n")).alias("coverage"),
                               ratio(F.col(f"c{i}"), F.col(f"a{i}")).alias("precision"))
                      for i, level in enumerate(thresholds)])
    return t.select(F.inline(lines))


def auroc(rows: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null without both classes.

    Rows are first summed per distinct score, so only distinct scores are ranked.
    """
    return _areas(rows.withColumn("n", F.lit(1)), score, by)


def _areas(counts: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """The same from rows that stand for ``n`` fields each."""
    groups = (counts.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s"))
              .agg(*[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name)
                     for name, test in (("right", F.col("correct")), ("wrong", ~F.col("correct")))]))
    swept = running_totals(groups, ["s"], {"below": F.col("wrong")}, by)
    t = swept.groupBy(*by).agg(
        F.sum(F.col("right") * (F.col("below") - F.col("wrong") / 2)).alias("wins"),
        F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))
    return t.select(*by, ratio(F.col("wins"), F.col("right").cast("double") * F.col("wrong")).alias("auroc"),
                    "right", "wrong")


def within_field_auroc(rows: DataFrame, score: str = "logit") -> DataFrame:
    """Mean AUROC over the (form, field) groups that hold both outcomes."""
    groups = auroc(rows, score, ["form", "field_id"]).filter((F.col("right") > 0) & (F.col("wrong") > 0))
    return groups.agg(F.avg("auroc").alias("macro_auroc"), F.count("*").alias("groups_with_both_labels"))


def head_report(rows: DataFrame, policy: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Every headline metric of one scored cohort under a policy, in one row; the rows behind it are read once."""
    target = .95
    needed = ("document_id", "field_id", "status", "shape_violation", "correct", "score", "logit")
    rows = staged(rows.select(*[c for c in needed if c in rows.columns]), "scored")
    area = auroc(rows).select("auroc")
    return side_by_side(policy.select("threshold"), evaluate_policy(rows, policy, supported),
                        oracle_review_rate(rows, target, supported), accuracy_brier_nll(rows).drop("count"),
                        calibration_error(rows), area, aurc(rows))


def decision_counts(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many fields (``n``) share group, field, decision, outcome and scores: the rows are read once, for every report."""
    return judged.groupBy(*by, "form", "field_id", "mandatory", "needs_review", "correct", F.when(usable(), F.col("score")).alias("score"),
                          "logit", "raw_logit").agg(F.count("*").alias("n"))


def family_reports(judged: DataFrame, by: Sequence[str], target: float = .95, bins: int = 10) -> DataFrame:
    """Every headline metric of many heads or cohorts at once: one row per ``by``.

    ``judged`` carries score, calibrated ``logit``, ``raw_logit`` and the
    decisions of :func:`decided_by_family`. Rows are first counted by
    :func:`decision_counts`; sweep, area and ranking work on these counts.
    """
    return counted_reports(staged(decision_counts(judged, by), "decision_counts"), evaluate_decisions(judged, by), by, target, bins)


def counted_reports(fine: DataFrame, evaluation: DataFrame, by: Sequence[str], target: float = .95, bins: int = 10) -> DataFrame:
    """The same from :func:`decision_counts` and the evaluation of each group."""
    by, weight = list(by), F.col("n")
    counts = fine.groupBy(*by, "score").agg(F.sum(weight).alias("n"), F.coalesce(F.sum(F.when(~F.col("correct"), weight)), F.lit(0)).alias("errors"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    swept = running_totals(counts.filter(F.col("score").isNotNull()), ["score"], {"accepted": F.col("n"), "missed": F.col("errors")}, by,
                           descending=True)
    points = swept.groupBy(*by).agg(F.sum(ratio(F.col("missed"), F.col("accepted")) * F.col("n")).alias("area"),
                                    F.max("accepted").alias("accepted"), F.max("missed").alias("missed"))
    c = F.col
    invalid = c("total") - F.coalesce("accepted", F.lit(0))
    tail = F.when(invalid > 0, ratio(F.coalesce("missed", F.lit(0)) + invalid, c("total")) * invalid).otherwise(0.0)
    areas = totals.join(points, by, "left").select(*by, ratio(F.coalesce("area", F.lit(0.0)) + tail, c("total")).alias("aurc"))
    p, y = sigmoid(c("logit")), c("correct").cast("double")
    binned = (fine.filter(c("logit").isNotNull()).groupBy(*by, equal_width_bin(p, bins).alias("bin"))
              .agg(F.sum(weight).alias("n"), F.sum(p * weight).alias("p"), F.sum(y * weight).alias("y"),
                   F.sum((p - y) * (p - y) * weight).alias("brier"), F.sum(logistic_loss(c("logit"), y) * weight).alias("nll")))
    fit = binned.groupBy(*by).agg(ratio(F.sum("brier"), F.sum("n")).alias("brier"), ratio(F.sum("nll"), F.sum("n")).alias("nll"),
                                  ratio(F.sum(F.abs(c("p") - c("y"))), F.sum("n")).alias("ece"))
    within = (_areas(fine, "raw_logit", [*by, "form", "field_id"]).filter((c("right") > 0) & (c("wrong") > 0))
              .groupBy(*by).agg(F.avg("auroc").alias("within_field_auroc"), F.count("*").alias("within_field_groups")))
    extra = F.greatest(F.lit(0), F.ceil(F.lit(target) * c("errors")) - (c("errors") - c("head_errors")))
    oracle = F.coalesce(ratio(c("mandatory_review") + extra, c("fields")), F.lit(0.0)).alias("oracle_review_rate")
    joined = evaluation.select("*", oracle)
    for part in (areas, _areas(fine, "logit", by).select(*by, "auroc"), fit, within):
        joined = joined.join(part, by, "left")
    return joined


def headline(report: DataFrame) -> DataFrame:
    """The numbers two heads are ranked by: review rate, then AURC, then AUROC."""
    return report.select("review_rate", "aurc", (-F.coalesce("auroc", F.lit(0.0))).alias("negative_auroc"))
