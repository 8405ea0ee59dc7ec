"""The prediction-row contract: derived columns, guards and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_if
from ..functions.text import is_correct, json_type
from ..session import staged
from .bootstrap import side_by_side
from .scale import quantiles

KEY = ("document_id", "field_id")


def completed(rows: DataFrame) -> DataFrame:
    """Fills ``form`` (document id before ``__``) and ``kind`` (from the target) where they are missing."""
    form = F.split_part("document_id", F.lit("__"), F.lit(1))
    given = F.nullif(F.col("form"), F.lit("")) if "form" in rows.columns else F.lit(None).cast("string")
    kind = F.nullif(F.col("kind"), F.lit("")) if "kind" in rows.columns else F.lit(None).cast("string")
    is_array = json_type(F.col("target")) == "array"
    return (rows.withColumn("form", F.coalesce(given, form))
            .withColumn("kind", F.coalesce(kind, F.when(F.coalesce(is_array, F.lit(False)), "array").otherwise("scalar"))))


def judged(rows: DataFrame, comparator: str = "text") -> DataFrame:
    """Adds ``correct`` under a named comparator; a stored flag is replaced."""
    return rows.withColumn("correct", is_correct(F.col("status"), F.col("prediction"), F.col("target"), comparator))


def duplicate_keys(rows: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that occur more than once (must be empty before scoring)."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def key_coverage(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """How many keys two prediction sets share, and how many only one of them has."""
    left, right = (d.select(*key).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "a"), (b, "b")))
    both = left.join(right, list(key), "full_outer")
    return both.agg(count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
                    count_if(F.col("b").isNull()).alias("only_a"), count_if(F.col("a").isNull()).alias("only_b"))


def document_coverage(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Documents without rows (``missing``) and documents nobody asked for (``unexpected``); empty when exact."""
    have, want = rows.select("document_id").distinct(), requested.select("document_id").distinct()
    missing = want.exceptAll(have).withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def complete_documents(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of the documents that have exactly their expected number of rows (safe resume).

    ``expected`` has document_id and ``fields``.
    """
    done = (rows.groupBy("document_id").agg(F.count("*").alias("fields"))
            .join(expected.select("document_id", "fields"), ["document_id", "fields"], "left_semi"))
    return rows.join(done, "document_id", "left_semi")


def provenance_changes(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Keys whose value differs between two ``(key, value)`` tables; empty means the run may resume."""
    joined = stored.withColumnRenamed("value", "stored").join(
        offered.withColumnRenamed("value", "offered"), "key", "full_outer")
    return joined.filter(~F.col("stored").eqNullSafe(F.col("offered")))


def claim(stored: DataFrame | None, offered: DataFrame, has_rows: bool) -> None:
    """Refuse to resume a run of different provenance; the changed keys (a few settings) are named."""
    if stored is None:
        if has_rows:
            raise ValueError("predictions exist without provenance; use a new output")
        return
    changed = [r["key"] for r in provenance_changes(stored, offered).orderBy("key").limit(50).collect()]
    if changed:
        raise ValueError(f"the output holds a different run (differs in {changed})")


def paired_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two runs on the same fields: text, status, confidence and review decision.

    Inputs have document_id, field_id, text, status, score and needs_review.
    """
    cols = ("text", "status", "score", "needs_review")
    left, right = (d.select(*KEY, *[F.col(c).alias(f"{n}_{c}") for c in cols]) for d, n in ((a, "a"), (b, "b")))
    both = left.join(right, list(KEY))
    same = F.col("a_status") == F.col("b_status")
    gap = F.abs(F.col("a_score") - F.col("b_score"))
    both = staged(both.withColumn("gap", F.when(~F.isnan(gap), gap)), "pairs")
    shares = both.agg(
        F.count("*").alias("fields"), F.avg(same.cast("double")).alias("same_status"),
        F.avg((same & F.col("a_text").eqNullSafe(F.col("b_text"))).cast("double")).alias("same_text"),
        count_if(F.col("a_needs_review") != F.col("b_needs_review")).alias("review_flips"), F.max("gap").alias("gap_max"))
    return side_by_side(shares, quantiles(both, "gap", {"gap_median": .5, "gap_p99": .99}, linear=False))


def candidate_key(status: Column, value: Column) -> Column:
    """What tells candidates apart: the comparison key of an ``ok`` value, else one key per status."""
    return F.when(status == "ok", F.concat(F.lit("s"), value)).otherwise(F.concat(F.lit("<"), status, F.lit(">")))


def agreement(own: Column, candidates: Column) -> list[Column]:
    """``agreement`` and ``distinct_share`` of a row that carries its samples; null without samples.

    ``own`` is the :func:`candidate_key` of the row's value, ``candidates`` the
    array of those of its samples. Array functions only, no lambda and no shuffle.
    """
    count = F.nullif(F.size(candidates), F.lit(0))
    return [((count - F.size(F.array_remove(candidates, own))) / count).alias("agreement"),
            (F.size(F.array_distinct(candidates)) / count).alias("distinct_share")]


def agreement_features(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """The features of :func:`agreement` for candidates that stand in a table of their own.

    ``candidates`` have document_id, field_id, status and value (JSON text);
    every status but ``ok`` counts as one value. A row without candidates has
    null features.
    """
    from ..functions.text import canonical_text

    keyed = candidates.select(*KEY, "status", F.when(
        F.col("status") == "ok", canonical_text(F.coalesce("value", F.lit("null")))).otherwise(
        F.concat(F.lit("<"), F.col("status"), F.lit(">"))).alias("candidate"))
    # Copies of one value are combined before they meet the row they belong to.
    counted = keyed.groupBy(*KEY, "candidate", (F.col("status") == "ok").alias("ok")).agg(F.count("*").alias("copies"))
    own = rows.withColumn("__own", canonical_text(F.coalesce("prediction", F.lit("null"))))
    # Sizes of derived rows are unknown to the planner, which takes them for those of the file behind them: never broadcast.
    joined = own.select(*KEY, "__own").join(counted.hint("merge"), list(KEY), "left")
    agree = F.sum(F.when(F.col("ok") & (F.col("candidate") == F.col("__own")), F.col("copies")).otherwise(0))
    features = joined.groupBy(*KEY).agg((agree / F.sum("copies")).alias("agreement"),
                                        (F.count("candidate") / F.sum("copies")).alias("distinct_share"))
    return rows.join(features.hint("merge"), list(KEY))


def agreement_distribution(rows: DataFrame) -> DataFrame:
    """Share of rows whose candidates all agree, and accuracy with and without full agreement."""
    y, full = F.col("correct").cast("double"), F.col("agreement") == 1
    return rows.agg(F.avg(full.cast("double")).alias("all_agree_share"),
                    F.avg(F.when(full, y)).alias("correct_given_all_agree"),
                    F.avg(F.when(~full, y)).alias("correct_given_not_all_agree"))
