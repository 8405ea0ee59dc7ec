"""The spread-out building blocks against plain windows, with one group holding a third of the rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldwarden.catalog import views
from fieldwarden.operators import scale
from fieldwarden.session import spread


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", i, rng.randrange(5), round(rng.random(), 4)) for i in range(6000)]
    return spark.createDataFrame(rows, "g string, id long, n long, x double").repartition(4)


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, by, descending):
    got = scale.running_totals(skewed, ["x", "id"], {"upto": F.col("n")}, by, descending)
    order = [F.desc("x"), F.desc("id")] if descending else ["x", "id"]
    want = skewed.withColumn("want", F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = got.join(want.select("id", "want"), "id")
    assert both.count() == 6000 and both.filter("upto <> want").count() == 0


def test_sliced_rows_are_spread(skewed):
    sizes = [r["count"] for r in scale.sliced(skewed, [F.col("x"), F.col("id")], 7).groupBy("__slice").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 6000 / 20


@pytest.mark.parametrize("linear", [True, False])
def test_quantiles(skewed, linear):
    got = {r.g: r for r in scale.quantiles(skewed, "x", {"a": .5, "b": .99, "c": 0.0}, ["g"], linear).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        xs = np.sort(part.x.to_numpy())
        for name, q in (("a", .5), ("b", .99), ("c", 0.0)):
            want = np.quantile(xs, q) if linear else xs[min(int(q * len(xs)), len(xs) - 1)]
            assert got[g][name] == pytest.approx(want)


def test_first_per_group(skewed):
    got = scale.first_per_group(skewed, ["g"], ["x", "id"], 7)
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("x", "id"))).filter("r <= 7")
    assert {(r.id, r["rank"]) for r in got.collect()} == {(r.id, r.r) for r in want.collect()}


def test_attach_keeps_every_row_of_hot_keys(skewed):
    least = skewed.filter("g <> 'g3'").groupBy("g").agg(F.min("id").alias("m"), F.count("*").alias("w"))
    got = scale.attach(skewed, least, ["g"], "w", ["id"], heavy_parts=8)
    assert got.count() == 6000 and got.columns == [*skewed.columns, "m"]
    want = skewed.join(least.drop("w"), "g", "left")
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_rows_of_a_task_do_not_grow_with_the_table(spark):
    few = spark.range(5000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(few).rdd.getNumPartitions() == spread(few, 5000).rdd.getNumPartitions() == cores
    assert spread(few, 100).rdd.getNumPartitions() == 50
    assert spread(few.repartition(60), 100).rdd.getNumPartitions() == 60
    assert spread(few, 100).count() == 5000


def test_views_cut_their_tables_by_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 10)
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert views.review_rows(spark, folder).rdd.getNumPartitions() == -(-orders // 10)


@pytest.mark.parametrize("steps", [1, 4, 7])
def test_slices_are_counted_without_lambdas(skewed, steps):
    cut = scale.sliced(skewed, [F.col("x"), F.col("id")], steps)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambdafunction" not in plan.split("scalar-subquery")[0]
    (points,) = scale.split_points(skewed, F.struct("x", "id"), [F.col("x"), F.col("id")], steps).first()
    for row in cut.collect():
        assert row["__slice"] == sum((p["x"], p["id"]) <= (row.x, row.id) for p in points)


def test_validated_traces_are_numbered_once(spark, monkeypatch):
    from fieldwarden.catalog import streams

    sf, seen = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    monkeypatch.setattr(streams, "read_table", lambda *a: spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_returnflag", passed("l_returnflag")))
    rows = streams.validated_traces(spark, sf).collect()
    # Once as a numbered line and once as a line without a number; the filters run first.
    assert seen.value == sum(r["rows"] for r in rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
