"""Heads fitted side by side against Spark's own fits, and their handling of priors, steps and missing traces."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.numbers import sigmoid
from fieldwarden.operators import headgrid, heads

SIZES = {"value": 4, "summary": 2}


def states(spark, count=600, seed=2):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        correct, field = bool(draw.random() < .6), int(draw.integers(6))
        value = draw.standard_normal(4) * [1, 5, .2, 1] + [1.2 * correct, 0, .1, field == 2]
        rows.append((f"d{i % 40}", f"/f{field}", "c", "ok", False, bool(correct ^ (field == 2)), value.tolist(), draw.standard_normal(2).tolist()))
    rows += [("d1", "/rare", "c", "ok", False, True, [0.0] * 4, [0.0] * 2), ("d1", "/f1", "c", "ok", False, True, None, [0.0] * 2)]
    return spark.createDataFrame(rows, "document_id string, field_id string, form string, status string, shape_violation boolean, correct boolean, "
                                       "value array<double>, summary array<double>")


def test_same_logits_as_single_fits(spark):
    rows = states(spark)
    trials = heads.grid(["linear"], [["value"], ["value", "summary"]], l2=[0.001, 0.05], steps=[150], prior=[False, True])
    fitted, passes = headgrid.fit_linear_heads(rows, trials, SIZES)
    assert passes <= 170
    together = fitted.logits(rows).filter("value is not null").select("field_id", "value", "summary", "logits").collect()
    full = rows.filter("value is not null")
    for i, trial in enumerate(trials):
        alone = {tuple(r.value): r.logit for r in heads.head_logits(heads.fit_head(full, trial, SIZES), full, trial).collect()}
        worst = max(abs(r.logits[i] - alone[tuple(r.value)]) for r in together)
        assert worst < 0.02, (trial.name, worst)


def test_fields_without_a_prior_add_nothing(spark):
    rows = states(spark)
    (trial,) = heads.grid(["linear"], [["value"]], [0.001], prior=[True])
    fitted, _ = headgrid.fit_linear_heads(rows, [trial], SIZES)
    assert fitted.fields == tuple(f"/f{i}" for i in range(6)) and np.abs(fitted.prior).max() > 0.1
    lone = headgrid.LinearHeads(fitted.trials, SIZES, fitted.mean, fitted.std, fitted.weights, fitted.bias)
    for name in ("/rare", "/never seen", None):
        other = rows.withColumn("field_id", F.lit(name).cast("string"))
        a, b = ([r.logits for r in h.logits(other).select("logits").collect()] for h in (fitted, lone))
        assert a == b
    # The same of a single fit: its coefficients are inputs and known fields, none for others.
    full = rows.filter("value is not null")
    model = heads.fit_head(full, trial, SIZES)
    assert model.stages[-1].coefficients.size == 4 + 6
    unknown, rare = (heads.head_logits(model, full.limit(5).withColumn("field_id", F.lit(n)), trial).select("logit").collect() for n in ("/never", "/rare"))
    plain = model.stages[-1]
    x = full.limit(5).select("value").collect()
    scaler = model.stages[1]
    want = [float((np.array(r.value) - scaler.mean.toArray()) / scaler.std.toArray() @ plain.coefficients.toArray()[:4] + plain.intercept) for r in x]
    assert [r.logit for r in unknown] == [r.logit for r in rare] == pytest.approx(want)


def test_snapshots_are_points_of_one_path(spark):
    rows = states(spark)
    trials = heads.grid(["linear"], [["value"]], [0.001], steps=[1, 4, 100])
    fitted, passes = headgrid.fit_linear_heads(rows, trials, SIZES)
    losses = []
    for i in range(3):
        scored = fitted.logits(rows.filter("value is not null")).withColumn("p", sigmoid(F.get("logits", F.lit(i))))
        y = F.col("correct").cast("double")
        losses.append(scored.agg(F.avg(-y * F.log("p") - (1 - y) * F.log(1 - F.col("p")))).first()[0])
    assert losses[0] > losses[1] > losses[2] and passes < 120


def test_numbers_of_trials_as_one_by_one(spark):
    rows = states(spark)
    trials = heads.grid(["linear"], [["value"], ["summary"]], [0.001], steps=[50])
    fitted, table = headgrid.score_linear_trials(rows, rows, trials, SIZES)
    got = {r.trial: r for r in table.collect()}
    for i, trial in enumerate(trials):
        scored = fitted.logits(rows).withColumn("logit", F.get("logits", F.lit(i))).withColumn("score", sigmoid(F.col("logit"))).drop("logits")
        want = heads.ranked_row(scored, trial.name, trial.family).first()
        for name in ("review_rate", "error_recall", "aurc", "auroc"):
            assert got[trial.name][name] == pytest.approx(want[name]), (trial.name, name)
    assert heads.family_winners(table).filter("primary").first().trial == trials[0].name


def test_odd_inputs(spark):
    rows = states(spark)
    trial = heads.Trial("linear", ("value",))
    none, passes = headgrid.fit_linear_heads(rows.limit(0), [trial], SIZES)
    assert passes == 0 and not none.weights.any()
    assert fitted_null(none, rows) == 1
    with pytest.raises(ValueError, match="not linear trials"):
        headgrid.fit_linear_heads(rows, [heads.Trial("mlp", ("value",))], SIZES)
    with pytest.raises(ValueError, match="not linear trials"):
        headgrid.fit_linear_heads(rows, [heads.Trial("linear", ("other",))], SIZES)


def fitted_null(fitted, rows):
    return fitted.logits(rows).filter("logits is null").count()


def test_mean_pooling_beats_the_unpooled_head(spark):
    # The sign of the content tokens' mean decides; the first token alone is noise.
    draw = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        tokens, mask = draw.standard_normal((5, 3)), draw.random(5) < .6
        mask[draw.integers(5)] = True
        rows.append((f"d{i % 60}", "/f", "c", "ok", False, bool(tokens[mask].mean(0)[0] * tokens[mask].mean(0)[1] > 0), tokens.ravel().tolist(),
                     mask.tolist(), tokens[0].tolist()))
    df = spark.createDataFrame(rows, "document_id string, field_id string, form string, status string, shape_violation boolean, correct boolean, "
                                     "tokens array<double>, mask array<boolean>, value array<double>")
    pooled = heads.with_pooled(df, 3)
    for r in pooled.limit(20).collect():
        assert np.allclose(r.pooled, np.reshape(r.tokens, (5, 3))[np.array(r["mask"])].mean(0))
    assert heads.with_pooled(df.limit(1).withColumn("mask", F.array(*[F.lit(False)] * 5)), 3).first().pooled == [0, 0, 0]
    trials = [heads.Trial("mean", ("pooled",), steps=200, width=6, seed=1), heads.Trial("mlp", ("value",), steps=200, width=6, seed=1)]
    auroc = {r.trial: r.auroc for r in heads.score_trials(pooled, pooled, trials, {"pooled": 3, "value": 3}).collect()}
    assert auroc[trials[0].name] > .9 > auroc[trials[1].name] + .1


def test_only_the_models_are_broadcast(spark, tmp_path):
    from fieldwarden.catalog import models

    spark.range(120).selectExpr("id AS vec_id", "cast(id % 10 AS int) AS label", "transform(sequence(0, 63), i -> cast(sin(id * 7 + i) AS float)) AS embedding"
                                ).write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = models.linear_head_grid(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line and "[trial" in line and ", i#" in line]
    assert joined and all("BuildRight" in line for line in joined), joined
