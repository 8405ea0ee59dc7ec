"""Array credit against hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwarden.operators import extraction

SCHEMA = "document_id string, field_id string, status string, target string, prediction string"


def credit(spark, *rows):
    return tuple(extraction.array_metrics(spark.createDataFrame(rows, SCHEMA)).first())


def test_array_credit(spark):
    assert credit(spark, ("d", "/a", "ok", '[{"k":"x","v":1},{"k":"y","v":null}]', '[{"v":1,"k":"x"},{"k":"y","v":null}]')) == (1, 1, 1, 1, 1, .75)
    assert credit(spark, ("d", "/a", "truncated", '["b", 2]', '["b"]')) == (1, 0, None, 0, 0, 0)
    assert credit(spark, ("d", "/a", "ok", '{"a": 1}', '["z"]')) == (1, None, 0, None, None, None)
    assert credit(spark, ("d", "/a", "ok", '["a","a","b"]', '["a"," b ","b"]')) == (1, 1, 2 / 3, 2 / 3, 2 / 3, 2 / 3)
    # Rows of one field share their items, rows of other fields do not.
    assert credit(spark, ("d", "/a", "ok", '["q"]', '["b"]'), ("d", "/a", "ok", '["b"]', '["q"]'), ("e", "/a", "ok", '["q"]', '["b"]'))[1:5] == (
        1, 2 / 3, 2 / 3, 2 / 3)


def test_equal_fields_stay_out_of_the_shuffle(spark):
    """What matches inside its row is counted there; the shuffle gets the rest only."""
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("document_id"), F.lit("/a").alias("field_id"), F.lit("ok").alias("status"),
        F.lit('["a","b"]').alias("target"), F.when(F.col("id") < 10, '["a","c"]').otherwise('["a","b"]').alias("prediction"))
    written = []
    kept = extraction.staged
    extraction.staged = lambda df, name: written.append(kept(df, name)) or written[-1]
    try:
        report = extraction.array_metrics(rows).first()
    finally:
        extraction.staged = kept
    assert report.row_recall == 1990 / 2000
    assert written[0].filter("document_id is not null").count() == 10
    assert written[0].filter("missed is not null").count() == 10
