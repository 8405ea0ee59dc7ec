"""Value-shape rules: the digit and letter patterns a field's values take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_digit, shape


def fit_shape_rules(labels: DataFrame, text: str = "text", min_examples: int = 20, min_share: float = .02,
                    coverage: float = .95, max_shapes: int = 5) -> DataFrame:
    """Rules ``(field_id, shapes)`` of the fields whose labelled values keep to a few shapes.

    ``labels`` have field_id, kind and the value's text. Values are combined
    per (field, shape) first; a field's total comes from those counts.
    """
    for name, least in (("min_examples", min_examples), ("max_shapes", max_shapes)):
        if least < 1:
            raise ValueError(f"{name} counts something and starts at 1, not {least}")
    for name, share in (("min_share", min_share), ("coverage", coverage)):
        if share <= 0 or share > 1:
            raise ValueError(f"{name} is a share above 0 and up to 1, not {share}")
    counted = (labels.filter((F.col("kind") == "scalar") & has_digit(F.col(text)))
               .groupBy("field_id", shape(F.col(text)).alias("shape")).agg(F.count("*").alias("n")))
    totals = counted.groupBy("field_id").agg(F.sum("n").alias("total"))
    kept = counted.join(totals, "field_id").filter(F.col("n") / F.col("total") >= min_share)
    # min_share bounds the kept shapes of a field: at most 1 / min_share of them are collected.
    return (kept.groupBy("field_id").agg(F.first("total").alias("total"), F.sum("n").alias("covered"),
                                         F.sort_array(F.collect_set("shape")).alias("shapes"))
            .filter((F.col("total") >= min_examples) & (F.size("shapes") <= max_shapes)
                    & (F.col("covered") / F.col("total") >= coverage)).select("field_id", "shapes"))


def flag_rows(rows: DataFrame, rules: DataFrame, text: str = "prediction") -> DataFrame:
    """Sets ``shape_violation``: a finished scalar with a digit whose shape its field never takes."""
    value = F.coalesce(F.col(text), F.lit(""))
    joined = rows.drop("shape_violation").join(rules.select("field_id", F.col("shapes").alias("__shapes")),
                                               "field_id", "left")
    broken = (F.col("__shapes").isNotNull() & (F.col("status") == "ok") & (F.col("kind") == "scalar")
              & has_digit(value) & ~F.array_contains("__shapes", shape(value)))
    return joined.withColumn("shape_violation", F.coalesce(broken, F.lit(False))).drop("__shapes")
