"""Rows of given ids behind a bitmap."""

from __future__ import annotations

from fieldwarden.llm import sketch


def test_rows_of_ids(spark, monkeypatch):
    documents = spark.createDataFrame([(d, f"t{d}") for d in [*range(500), 7, None]], "doc_id bigint, text string")
    wanted = [3, 7, 7, 499, 1000, None]
    ids = spark.createDataFrame([(d,) for d in wanted], "doc_id bigint")
    for bits in (1 << 26, 1 << 15, 64):
        monkeypatch.setattr(sketch, "SKETCH_BITS", bits)
        assert sorted(map(tuple, sketch.of_ids(documents, ids).collect())) == [(3, "t3"), (7, "t7"), (7, "t7"), (499, "t499")]
    assert sketch.of_ids(documents, ids.limit(0)).collect() == []


def test_no_row_that_is_not_wanted_is_moved(spark):
    documents = spark.range(5000).selectExpr("id AS doc_id", "'text' AS text")
    plan = sketch.of_ids(documents, spark.range(3).selectExpr("id AS doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    # The exact join stands above the bitmap's filter.
    assert plan.index("LeftSemi") < plan.index("__bits")


def test_flags(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    got = sketch.with_likely(documents, spark.createDataFrame([(2,), (None,)], "doc_id bigint"), "maybe").collect()
    assert sorted((r.text, r.maybe) for r in got) == [("a", False), ("b", True), ("c", False)]
