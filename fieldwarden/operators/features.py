"""Confidence features over trace records: summaries, normalisers, heuristics, pairs and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.numbers import count_if
from ..session import computed_once
from .scale import first_per_group

# Signal bases and the floors of the normalisers.
BASE_SIGNALS = ("key", "decide", "value")
VECTOR_FLOOR, STATS_FLOOR = 0.1, 0.05


def summaries(records: DataFrame, *keep: str) -> DataFrame:
    """The 27 summary columns of every record (pieces, stats, close, text, kind)."""
    mask = K.content_mask(F.col("pieces"), F.col("kind"))
    records = computed_once(records.select(*dict.fromkeys([*keep, "stats", "close", "text", "kind"]), mask.alias("__mask")))
    columns = K.summary_columns(F.col("stats"), F.col("close"), F.col("__mask"), F.col("text"), F.col("kind"))
    return records.select(*keep, *[c.alias(n) for n, c in columns.items()])


def heuristic_heads(summary: DataFrame, *keep: str) -> DataFrame:
    """Training-free scores: least and mean log-probability over the value tokens and the close decision."""
    count = F.round(F.expm1("log1p_tokens"))
    close = F.col("close_log_probability") if "close_log_probability" in summary.columns else F.col("close")
    least = F.when(count > 0, F.least("min_log_probability", close)).otherwise(close)
    return summary.select(*keep, least.alias("min_log_probability_score"),
                          ((F.col("mean_log_probability") * count + close) / (count + 1)).alias("mean_log_probability_score"))


def normalizers(vectors: DataFrame, column: str, floor: float = VECTOR_FLOOR) -> DataFrame:
    """Mean and sample deviation of every dimension: ``(dim, mean, std)``, deviations not below ``floor``."""
    return (vectors.select(F.posexplode(column).alias("dim", "x")).groupBy(F.col("dim").cast("bigint").alias("dim"))
            .agg(F.avg(F.col("x").cast("double")).alias("mean"),
                 F.greatest(F.lit(floor), F.stddev_samp(F.col("x").cast("double"))).alias("std")))


def signal(name: str, layers: Sequence[int] = ()) -> Column:
    """One signal of a record with a ``signals`` map: ``value``, or ``value@14`` for a stored layer."""
    base, _, layer = name.partition("@")
    if base not in BASE_SIGNALS or (layer and not layer.isdigit()):
        raise ValueError(f"unknown signal {name!r}: use {BASE_SIGNALS}, optionally with @layer")
    if layer and int(layer) not in layers:
        raise KeyError(f"signal {name!r} needs layer {layer} (stored: {list(layers)})")
    return F.element_at("signals", name)


def frequent_fields(rows: DataFrame, least: int = 16) -> DataFrame:
    """Fields with at least ``least`` rows, numbered from 1 in id order: the keys of a field prior."""
    from .scale import numbered

    return numbered(rows.groupBy("field_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least),
                    ["field_id"], "prior_index")


def with_prior_index(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``prior_index``; fields without a prior get 0."""
    return (rows.join(keys.select("field_id", "prior_index"), "field_id", "left")
            .withColumn("prior_index", F.coalesce("prior_index", F.lit(0))))


def masked_mean(tokens: Column, mask: Column, width: int) -> Column:
    """Mean of the token states that carry content; ``tokens`` holds states of ``width`` numbers one after the other.

    Zeros where no token carries content.
    """
    kept = F.filter(F.transform(mask, lambda m, t: F.when(m, t)), lambda t: t.isNotNull())

    def mean(kept: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
            kept, F.lit(0.0), lambda total, t: total + F.get(tokens, t * width + j).cast("double")) / F.greatest(F.size(kept), F.lit(1)))

    # The list of tokens is bound once, not evaluated per number.
    return F.element_at(F.transform(F.array(kept), mean), 1)


def class_balance(rows: DataFrame) -> DataFrame:
    """Right and wrong rows and whether both occur."""
    return rows.agg(count_if(F.col("correct")).alias("right_rows"), count_if(~F.col("correct")).alias("wrong_rows")).withColumn(
        "both_labels", (F.col("right_rows") > 0) & (F.col("wrong_rows") > 0))


def pair_counts(rows: DataFrame) -> DataFrame:
    """How many (right, wrong) pairs each (form, field) holds, from counts: no pair is formed."""
    return (rows.groupBy("form", "field_id").agg(count_if(F.col("correct")).alias("right_rows"),
                                                 count_if(~F.col("correct")).alias("wrong_rows"))
            .withColumn("pairs", F.col("right_rows") * F.col("wrong_rows")))


def ranking_pairs(rows: DataFrame, per_field: int = 32, seed: int = 42) -> DataFrame:
    """A seeded draw of (right, wrong) pairs of the same (form, field): at most ``per_field`` of each.

    Both sides are shuffled and met rank by rank, so a field with many rows
    never multiplies out.
    """
    keyed = rows.select("form", "field_id", "document_id", "correct", F.sha2(F.concat_ws(
        ":", F.lit(str(seed)), "document_id", "field_id"), 256).alias("k"))
    drawn = first_per_group(keyed, ["form", "field_id", "correct"], ["k", "document_id"], per_field)
    right = drawn.filter("correct").select("form", "field_id", "rank", F.col("document_id").alias("right_document"))
    wrong = drawn.filter(~F.col("correct")).select("form", "field_id", "rank", F.col("document_id").alias("wrong_document"))
    return right.join(wrong, ["form", "field_id", "rank"])


def single_valued(metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, how many values the cohorts hold (a missing one counts as ``false``); 1 everywhere means agreement.

    ``metadata`` is ``(cohort, key, value)``.
    """
    cohorts = metadata.select("cohort").distinct()
    wanted = cohorts.select("cohort", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    filled = wanted.join(metadata, ["cohort", "key"], "left").withColumn("value", F.coalesce("value", F.lit("false")))
    return filled.groupBy("key").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"))


def vector_drift(a: DataFrame, b: DataFrame, key: Sequence[str], column: str, absolute: float = 1e-3,
                 relative: float = 0.05) -> DataFrame:
    """Largest absolute difference and largest relative distance of two runs' vectors, with pass flags."""
    both = a.select(*key, F.col(column).alias("__a")).join(b.select(*key, F.col(column).alias("__b")), list(key))
    gaps = F.zip_with("__a", "__b", lambda x, y: x.cast("double") - y.cast("double"))

    def norm(values: Column) -> Column:
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    t = both.agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform(gaps, F.abs))).alias("max_absolute"),
                 F.max(F.when(norm(F.col("__b")) > 0, norm(gaps) / norm(F.col("__b")))).alias("max_relative"))
    return t.withColumn("within_absolute", F.col("max_absolute") <= absolute).withColumn(
        "within_relative", F.col("max_relative") <= relative)


def trace_index_problems(rows: DataFrame, split: str) -> DataFrame:
    """Counts that must be 0 for a sound trace cache: foreign rows, repeated indices, gaps."""
    t = rows.agg(count_if(F.col("split") != split).alias("foreign_rows"),
                 count_if(F.col("trace_index") >= 0).alias("valid"),
                 F.count_distinct(F.when(F.col("trace_index") >= 0, F.col("trace_index"))).alias("distinct_indices"),
                 F.max("trace_index").alias("last"))
    return t.select("foreign_rows", (F.col("valid") - F.col("distinct_indices")).alias("repeated"),
                    (F.coalesce("last", F.lit(-1)) + 1 - F.col("distinct_indices")).alias("gaps"))


def merged_parts(rows: DataFrame) -> DataFrame:
    """Rows of numbered parts with one continuous ``trace_index``: each part is shifted by the valid rows before it.

    Only the per-part counts are accumulated.
    """
    from .scale import running_totals

    counts = rows.groupBy("part").agg(count_if(F.col("trace_index") >= 0).alias("n"), F.count("*").alias("rows"))
    ends = running_totals(counts, ["part"], {"end": F.col("n")})
    shift = ends.select("part", (F.col("end") - F.col("n")).alias("shift"))
    moved = rows.join(shift, "part")
    return moved.withColumn("trace_index", F.when(F.col("trace_index") >= 0, F.col("trace_index") + F.col("shift"))
                            .otherwise(-1)).drop("shift")


def trace_indices(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``trace_index``: valid rows numbered from 0 in order, -1 for the others."""
    from .scale import running_totals

    valid = F.when(F.col("status") == "ok", 1).otherwise(0).cast("bigint")
    counted = running_totals(rows, order, {"__upto": valid})
    return counted.withColumn("trace_index", F.when(F.col("status") == "ok", F.col("__upto") - 1).otherwise(-1)).drop("__upto")
