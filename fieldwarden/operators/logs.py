"""Summaries of serving, profile and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if, ratio
from .bootstrap import side_by_side
from .scale import quantiles


def serving_summary(requests: DataFrame) -> DataFrame:
    """Per model (and merged flag): request count, latency median, mean and maximum, fields and tokens per second."""
    by = ["model", "merge"]
    done = requests.filter(F.col("infer").isNotNull())
    totals = done.groupBy(*by).agg(
        F.count("*").alias("requests"), F.avg("infer").alias("mean_infer_s"), F.max("infer").alias("max_infer_s"),
        ratio(F.sum("fields"), F.sum("infer")).alias("fields_per_s"),
        ratio(F.sum("generated_tokens"), F.sum("decode")).alias("tokens_per_s"))
    return (totals.join(quantiles(done, "infer", {"median_infer_s": .5}, by), by)
            .join(quantiles(done, "prefix", {"median_prefix_s": .5}, by), by))


def error_summary(requests: DataFrame) -> DataFrame:
    """Failed requests per error type and model."""
    failed = requests.filter(F.col("error").isNotNull())
    return failed.groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("error_type"), "model").agg(
        F.count("*").alias("count"))


def newest(records: DataFrame, limit: int, time: str = "time", tie: str = "id") -> DataFrame:
    """The newest records, newest first (a distributed top-k)."""
    return records.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def request_records(fields: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Per request: fields, tokens, longest field, the count of every status and exact match of the scored fields.

    ``statuses`` lists ``status=count`` in the order of the names, whatever
    statuses there are. With ``timings`` (``request_id, decode, infer``
    seconds) tokens and fields per second are added; no seconds give null.
    """
    per_status = fields.groupBy("request_id", "status").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"),
        F.count("correct").alias("scored"), F.sum(F.col("correct").cast("double")).alias("right"))
    named = F.concat(F.coalesce("status", F.lit("none")), F.lit("="), F.col("n").cast("string"))
    records = per_status.groupBy("request_id").agg(
        F.sum("n").alias("fields"), F.sum("tokens").alias("generated_tokens"), F.max("longest").alias("longest_field_tokens"),
        F.array_join(F.sort_array(F.collect_list(named)), ",").alias("statuses"),
        F.sum("scored").alias("scored_fields"), F.try_divide(F.sum("right"), F.sum("scored")).alias("exact_match"))
    if timings is None:
        return records
    return records.join(timings, "request_id", "left").withColumns({
        "tokens_per_s": F.try_divide("generated_tokens", "decode"), "fields_per_s": F.try_divide("fields", "infer")}).drop(
            "decode", "infer")


def stage_shares(profile: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Share of the total seconds spent in every stage: ``(stage, seconds, share)``."""
    t = profile.agg(F.sum("seconds").alias("__total"), *[F.sum(s).alias(s) for s in stages])
    lines = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("seconds"),
                               ratio(F.col(s), F.col("__total")).alias("share")) for s in stages])
    return t.select(F.inline(lines))


def training_summary(log: DataFrame, window: int = 50) -> DataFrame:
    """Steps, documents and forms seen, totals, and mean loss of the first and last records.

    The two windows hold ``min(window, n // 2)`` records and never overlap;
    each end is a top-k of at most ``window`` rows.
    """
    totals = log.agg(F.count("*").alias("steps"), F.count_distinct("document_id").alias("documents_seen"),
                     F.count_distinct("form").alias("forms_seen"), F.sum("target_tokens").alias("target_tokens"),
                     F.coalesce(F.max("sequence_tokens"), F.lit(0)).alias("max_sequence_tokens"))

    def end(order, name: str) -> DataFrame:
        few = log.orderBy(order).limit(window).select("loss", F.row_number().over(Window.orderBy(order)).alias("r"))
        k = totals.select(F.least(F.lit(window), F.floor(F.col("steps") / 2))).scalar()
        return few.withColumn("k", k).filter("r <= k").agg(F.avg("loss").alias(name))

    return side_by_side(totals, end(F.asc("step"), "mean_loss_first"), end(F.desc("step"), "mean_loss_last")).withColumn(
        "loss_window", F.least(F.lit(window), F.floor(F.col("steps") / 2)))


def length_summary(lengths: DataFrame, by: Sequence[str], value: str = "tokens", limit: int | None = None) -> DataFrame:
    """Count, median, 95th percentile, maximum and rows over a limit, per group."""
    t = lengths.groupBy(*by).agg(F.count("*").alias("fields"), F.max(value).alias("max"), *(
        [count_if(F.col(value) > limit).alias("over_limit")] if limit is not None else []))
    points = quantiles(lengths, value, {"p50": .5, "p95": .95}, by)
    whole = points.select(*by, *[F.floor(F.col(p)).alias(p) for p in ("p50", "p95")])
    return t.join(whole, list(by))
