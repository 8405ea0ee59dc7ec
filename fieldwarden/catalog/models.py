"""Queries on calibration and confidence heads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, headgrid, heads
from ..operators.dataset import split_of
from ..session import read_table, staged
from . import query
from .review import rounded
from .views import review_rows, word


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as value states: right when the class is below five, wrong at random now and then."""
    rows = read_table(spark, sf_dir, "embeddings")
    key = F.col("vec_id").cast("string")
    h = word(F.sha2(F.concat(F.lit("h:"), key), 256), 0) % 100
    return rows.select(
        F.concat(F.lit("d"), (F.col("vec_id") % 97).cast("string")).alias("document_id"),
        F.concat(F.lit("/f"), (F.col("vec_id") % 7).cast("string")).alias("field_id"),
        F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("form"), F.lit("ok").alias("status"),
        F.lit(False).alias("shape_violation"), ((F.col("label") < 5) != (h < 10)).alias("correct"),
        F.col("embedding").alias("value"), F.transform(F.slice("embedding", 1, 8), lambda x: x * x).alias("summary"))


SIZES = {"value": 64, "summary": 8}


@query("calibration")
def calibration_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Folds, logits and means read the rows; they are derived once.
    rows = staged(review_rows(spark, sf_dir).select("document_id", "logit", "correct"), "rows")
    chosen = calibration.select_calibration(rows)
    scored = calibration.with_scores(rows, chosen)
    before_after = scored.filter("logit is not null").agg(F.avg("score").alias("mean_score"),
                                                          F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return rounded(before_after.select(
        F.lit(chosen["method"]).alias("method"), F.lit(chosen["temperature"]).alias("temperature"), F.lit(chosen["bias"]).alias("bias"),
        *[F.lit(v).alias(f"cv_nll_{m}") for m, v in chosen["cv_nll"].items()], "mean_score", "accuracy"), 6)


@query("head_grid")
def head_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = head_rows(spark, sf_dir).withColumn("split", split_of(F.col("document_id"), 5))
    trials = [*heads.grid(["linear"], [["value"], ["value", "summary"]], l2=[0.001]),
              *heads.grid(["linear"], [["value"]], l2=[0.01], prior=[True]), *heads.grid(["mlp"], [["value"]], l2=[0.0], steps=[30])]
    scored = heads.score_trials(rows.filter("split = 'train'"), rows.filter("split <> 'train'"), trials, SIZES)
    return rounded(heads.family_winners(scored), 6)


@query("signal_probe")
def signal_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(heads.probe(head_rows(spark, sf_dir), {"value": ["value"], "summary": ["summary"]}, SIZES, [0.001], 3), 6)


PROJECT = np.array([[((i * 4 + j) % 7 - 3) / 10 for j in range(4)] for i in range(8)])
ATTENTION = np.array([(j - 1.5) / 2 for j in range(4)])
OUTPUT = np.array([1.0, -0.5, 0.25, 2.0])


@query("pooled_scores", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE * 10 AS v, unnest(range(64)) AS p FROM embeddings),
hidden AS (SELECT vec_id, label, p // 8 AS t, j, tanh(sum(v * (((p % 8) * 4 + j) % 7 - 3) / 10.0::DOUBLE)) AS h FROM x, range(4) r(j) GROUP BY ALL),
level AS (SELECT vec_id, t, sum(h * (j - 1.5::DOUBLE) / 2) AS s FROM hidden WHERE t <= label GROUP BY ALL),
share AS (SELECT vec_id, t, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS a FROM level)
SELECT vec_id, round(sum(a * h * [1.0, -0.5, 0.25, 2.0]::DOUBLE[][j + 1]), 9) AS logit FROM share JOIN hidden USING (vec_id, t) GROUP BY vec_id""".replace(
    "[1.0, -0.5, 0.25, 2.0]::DOUBLE[][j + 1]", "([1.0, -0.5, 0.25, 2.0]::DOUBLE[])[j + 1]"))
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: t <= F.col("label")).alias("mask"))
    weights = heads.PooledWeights(PROJECT, ATTENTION, OUTPUT)
    return rounded(rows.select("vec_id", heads.pooled_scores(F.col("tokens"), F.col("mask"), weights).alias("logit")))


@query("mean_pooled", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS p FROM embeddings)
SELECT vec_id, p % 8 AS dim, round(avg(v) FILTER (p // 8 <= label), 9) AS mean FROM x GROUP BY vec_id, p % 8""")
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean state of the first ``label + 1`` of eight tokens."""
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("tokens"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: t <= F.col("label")).alias("mask"))
    pooled = heads.with_pooled(rows, 8).select("vec_id", F.posexplode("pooled").alias("dim", "mean"))
    return rounded(pooled.select("vec_id", F.col("dim").cast("bigint").alias("dim"), "mean"))


#: Given coefficients of two heads: inputs of 64 numbers, priors of four of the seven fields.
GIVEN = headgrid.LinearHeads(
    (heads.Trial("linear", ("value",)), heads.Trial("linear", ("value",), prior=True)), {"value": 64},
    np.array([(i % 5 - 2) / 100 for i in range(64)]), np.array([0.1 + (i % 3) / 20 for i in range(64)]),
    np.array([[(i * 3 + t) % 11 / 10 - 0.5 for t in range(2)] for i in range(64)]), np.array([0.25, -0.5]),
    ("/f1", "/f3", "/f4", "/f6"), np.array([[0.0, 0.5], [0.0, -1.25], [0.0, 2.0], [0.0, 0.75]]))


@query("prior_logits", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
z AS (SELECT vec_id, t, sum((v - (i % 5 - 2) / 100.0::DOUBLE) / (0.1::DOUBLE + (i % 3) / 20.0::DOUBLE) * ((i * 3 + t) % 11 / 10.0::DOUBLE - 0.5)) AS z
  FROM x, range(2) r(t) GROUP BY vec_id, t)
SELECT vec_id, round(max(z + 0.25) FILTER (t = 0), 6) AS plain, round(max(z - 0.5 + CASE vec_id % 7 WHEN 1 THEN 0.5 WHEN 3 THEN -1.25
  WHEN 4 THEN 2.0 WHEN 6 THEN 0.75 ELSE 0 END) FILTER (t = 1), 6) AS with_prior FROM z GROUP BY vec_id""")
def prior_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of given heads; a field without a prior adds nothing."""
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("/f"), (F.col("vec_id") % 7).cast("string")).alias("field_id"), F.col("embedding").alias("value"))
    scored = GIVEN.logits(rows)
    return scored.select("vec_id", F.round(F.get("logits", F.lit(0)), 6).alias("plain"), F.round(F.get("logits", F.lit(1)), 6).alias("with_prior"))


GRID = heads.grid(["linear"], [["value"], ["value", "summary"]], l2=[0.001, 0.01], steps=[3, 200], prior=[False, True])


@query("linear_head_grid", f"""SELECT trial, family, true AS at_minimum, true AS same_review_rate, true AS same_auroc, true AS winner_is_best
FROM (VALUES {', '.join(f"('{t.name}', '{t.family}')" for t in GRID)}) trials(trial, family)""")
def linear_head_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen heads fitted in shared passes, with facts that hold for every right fit.

    ``at_minimum``: the slopes along all inputs, recomputed from the logits,
    vanish after 200 steps. The review rate and ranking of every trial are
    recomputed with plain windows from the dev logits, the winner of a family
    by sorting its rows.
    """
    rows = head_rows(spark, sf_dir).withColumn("split", split_of(F.col("document_id"), 5))
    train, dev = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    fitted, trials = headgrid.score_linear_trials(train, dev, GRID, SIZES)
    penalty = {t.name: (i, t) for i, t in enumerate(GRID)}
    named = F.array(*[F.struct(F.lit(n).alias("trial"), F.get("logits", F.lit(i)).alias("logit")) for n, (i, _) in penalty.items()])

    def per_trial(part: DataFrame, *more: str) -> DataFrame:
        return fitted.logits(part).select("document_id", "field_id", "correct", *more, F.inline(named))

    gap = 1 / (1 + F.exp(-F.col("logit"))) - F.col("correct").cast("double")
    x = per_trial(train, "value", "summary").withColumn("gap", gap).select("trial", "gap", F.posexplode(headgrid.stacked(SIZES)).alias("i", "x"))
    place = {"value": range(64), "summary": range(64, 72)}
    own = [(n, i, float(fitted.mean[i]), float(fitted.std[i]), 2 * t.l2 * float(fitted.weights[i, k]))
           for n, (k, t) in penalty.items() for name in t.inputs for i in place[name]]
    ends = spark.createDataFrame(own, "trial string, i int, mean double, std double, pull double")
    # One row per trial and input, as large as the models; the rows beside them are the table times trials and inputs.
    slopes = x.join(F.broadcast(ends), ["trial", "i"]).groupBy("trial", "i").agg(F.avg(F.col("gap") * (F.col("x") - F.col("mean")) / F.col("std")).alias("s"),
                                                                     F.first("pull").alias("pull"))
    flat = slopes.groupBy("trial").agg((F.max(F.abs(F.col("s") + F.col("pull"))) < 1e-4).alias("flat"))
    scored = per_trial(dev)
    upward = Window.partitionBy("trial").orderBy("logit").rangeBetween(Window.unboundedPreceding, 0)
    wrong = (~F.col("correct")).cast("bigint")
    ranked = scored.select("trial", "logit", "correct", F.sum(wrong).over(upward).alias("upto"), F.count("*").over(upward).alias("place"),
                           F.sum(wrong).over(Window.partitionBy("trial", "logit")).alias("tied"))
    all_errors = F.sum(wrong).over(Window.partitionBy("trial"))
    ranked = ranked.withColumn("all_errors", all_errors)
    # Reviewed up to the first score at which 95% of the errors are caught.
    plain = ranked.groupBy("trial").agg(
        (F.min(F.when(F.col("upto") >= F.ceil(F.lit(0.95) * F.col("all_errors")), F.col("place"))) / F.count("*")).alias("rate"),
        (F.sum(F.when(F.col("correct"), F.col("upto") - F.col("tied") / 2)) / (F.sum(F.col("correct").cast("bigint")) * F.max("all_errors"))).alias("rank"))
    best = trials.groupBy("family").agg(F.min(F.struct("review_rate", "aurc", (-F.col("auroc")).alias("n"), "trial")).alias("b")).select("family", "b.trial")
    winners = heads.family_winners(trials).select("family", F.col("trial").alias("winner"))
    agreed = winners.join(best.withColumnRenamed("trial", "first"), "family").select("family", (F.col("winner") == F.col("first")).alias("winner_is_best"))
    facts = trials.join(flat, "trial").join(plain, "trial").join(agreed, "family")
    steps = F.col("trial").contains("steps200")
    return facts.select("trial", "family", (F.col("flat") | ~steps).alias("at_minimum"), (F.abs(F.col("rate") - F.col("review_rate")) < 1e-9).alias("same_review_rate"),
                        (F.abs(F.col("rank") - F.col("auroc")) < 1e-9).alias("same_auroc"), "winner_is_best")
