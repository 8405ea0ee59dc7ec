"""Calibration, heads, token features and streams against small brute-force versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.functions import tokens as K
from fieldwarden.operators import bootstrap, calibration, features, heads, logs, policy, review
from fieldwarden.plans import workflows
from fieldwarden.streaming import jobs


def logits(spark, n=3000, temperature=2.5, bias=-.4, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.gauss(0, 3)
        rows.append((f"d{i % 200}", x, rng.random() < 1 / (1 + math.exp(-(x / temperature + bias)))))
    return spark.createDataFrame(rows, "document_id string, logit double, correct boolean"), rows


def test_calibration_minimises_the_penalised_loss(spark):
    df, rows = logits(spark)
    x, y = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])

    def loss(s, b):
        z = x * math.exp(s) + b
        return np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))) + .001 * (s * s + b * b)

    for method in ("temperature", "affine"):
        fit = calibration.fit_calibration(df, method)
        s, b = -math.log(fit["temperature"]), fit["bias"]
        steps = [(s + d, b) for d in (-1e-3, 1e-3)] + ([(s, b + d) for d in (-1e-3, 1e-3)] if method == "affine" else [])
        assert all(loss(*at) >= loss(s, b) for at in steps)
    chosen = calibration.select_calibration(df)
    assert chosen["method"] == "affine" and chosen["temperature"] == pytest.approx(2.5, rel=.15) and chosen["bias"] == pytest.approx(-.4, abs=.15)
    assert chosen["cv_nll"]["affine"] < chosen["cv_nll"]["identity"]
    single = calibration.select_calibration(df.withColumn("correct", F.lit(True)))
    assert (single["method"], single["temperature"]) == ("identity_single_class", 1.0)


def states(spark, n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        right = bool(rng.random() > .3)
        vec = rng.normal(1.5 if right else -1.5, 1, 4)
        rows.append((f"d{i % 40}", "f", f"/f{i % 6}", "ok", right, False, [float(v) for v in vec]))
    return spark.createDataFrame(rows, "document_id string, form string, field_id string, status string, correct boolean, shape_violation boolean, value array<double>")


def test_heads_learn_a_planted_signal_and_reload(spark, tmp_path):
    rows = states(spark)
    trials = [*heads.grid(["linear"], [["value"]], [0.001]), heads.Trial("linear", ("value",), prior=True)]
    scored = heads.score_trials(rows, rows, trials, {"value": 4})
    winners = heads.family_winners(scored).collect()
    assert len(winners) == 2 and sum(w.primary for w in winners) == 1 and all(w.auroc > .97 for w in winners)
    model = heads.fit_head(rows, trials[0], {"value": 4})
    model.write().save(str(tmp_path / "head"))
    again = heads.PipelineModel.load(str(tmp_path / "head"))
    a, b = (heads.head_logits(m, rows, trials[0]).select("logit").orderBy("logit").limit(5).collect() for m in (model, again))
    assert a == b
    out = heads.out_of_fold(rows, ["value"], {"value": 4}, count=4)
    assert out.count() == 400 and out.select("document_id", "fold").distinct().count() == 40
    with pytest.raises(ValueError):
        heads.grid(["unknown"], [["value"]])


def test_signal_names():
    with pytest.raises(ValueError):
        features.signal("other")
    with pytest.raises(KeyError):
        features.signal("value@14", [21])


@pytest.mark.parametrize("tokens, looped", [
    ([1, 2, 3] * 50, True), (list(range(150)), False), ([1, 2, 3] * 20, False), ([9] * 128, True), ([9] * 127, False),
    (list(range(100)) * 4, True), (list(range(100)) * 3, False), ([5, 5] + [7, 8] * 100, True)])
def test_loops(spark, tokens, looped):
    df = spark.createDataFrame([(tokens,)], "t array<long>")
    assert df.select(K.ends_in_loop(F.col("t"))).first()[0] is looped


def test_token_arrays(spark):
    df = spark.createDataFrame([(["a", " ", '"', "b"], [""])], "p array<string>, q array<string>")
    row = df.select(K.content_mask(F.col("p"), F.lit("scalar")).alias("s"), K.content_mask(F.col("p"), F.lit("array")).alias("a"),
                    K.content_mask(F.col("q"), F.lit("scalar")).alias("none")).first()
    assert (row.s, row.a, row.none) == ([True, False, True, True], [True, False, False, True], [True])
    runs = spark.createDataFrame([(["<p>", "<p>", "<p>", "x", "x", "<e>"],)], "t array<string>")
    assert runs.select(K.collapsed_runs(F.col("t"), F.array(F.lit("<p>"), F.lit("<e>")))).first()[0] == "<p>×3 x x <e>"
    branches = spark.createDataFrame([([("a", 5, 30), ("b", 5, 5), ("c", 5, 80)],)], "b array<struct<id:string,prompt:long,target:long>>")
    row = branches.select(K.within_budget(F.col("b"), F.lit(10), 60).alias("some"), K.within_budget(F.col("b"), F.lit(100), 60).alias("least"),
                          K.packed_layout(F.lit(10), F.col("b")).alias("l")).first()
    assert row.some == ["a", "b"] and row.least == ["b"]
    assert [tuple(x) for x in row.l] == [("a", 10, 13, 14, 44), ("b", 45, 48, 49, 54), ("c", 55, 58, 59, 139)]
    sized = spark.createDataFrame([([("a", 9), ("b", 9), ("c", 3)],)], "f array<struct<id:string,length:int>>")
    kept = sized.select(K.drop_longest(F.col("f"), 13).alias("x"), K.drop_longest(F.col("f"), 2).alias("none")).first()
    assert kept.x == ["b", "c"] and kept.none == []
    empty = spark.createDataFrame([([], (-1.0, .5, .5, 1.0, -1.0), "")], "stats array<struct<log_probability:double,normalized_entropy:double,probability_margin:double,logit_margin:double,close_log_probability:double>>, "
                                  "close struct<log_probability:double,normalized_entropy:double,probability_margin:double,logit_margin:double,close_log_probability:double>, text string")
    summary = features.summaries(empty.withColumn("pieces", F.array().cast("array<string>")).withColumn("kind", F.lit("scalar")))
    scores = features.heuristic_heads(summary).first()
    assert len(summary.columns) == 27 and summary.first().kind_empty == 1 and scores.min_log_probability_score == -1 == scores.mean_log_probability_score


def test_training_windows_never_overlap(spark):
    log = spark.createDataFrame([(i, f"d{i % 3}", "f", float(i), 10, 20) for i in range(1, 8)], "step long, document_id string, form string, loss double, target_tokens long, sequence_tokens long")
    row = logs.training_summary(log).first()
    assert (row.loss_window, row.mean_loss_first, row.mean_loss_last, row.documents_seen) == (3, 2.0, 6.0, 3)


def test_finalize_and_audit_guards(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        for f in range(6):
            right = rng.random() > .3
            rows.append((f"d{i}", ("dev", "calibration", "risk_validation", "train")[i % 4], "f", f"/f{f}", "ok" if rng.random() > .05 else "truncated",
                         right, rng.gauss(2.0 if right else -2.0, 1)))
    df = spark.createDataFrame(rows, "document_id string, cohort string, form string, field_id string, status string, correct boolean, logit double")
    df = df.withColumn("shape_violation", F.lit(False)).withColumn("correct", F.col("correct") & (F.col("status") == "ok")).withColumn(
        "logit", F.when(F.col("status") == "ok", F.col("logit")))
    done = workflows.finalize(df, target=.8, replicates=100)
    line = done["summary"].first()
    assert line.bound_target_met and line.risk_error_recall >= .8 and line.risk_review_rate < .9
    fresh = df.filter("cohort = 'dev'").withColumn("document_id", F.concat(F.lit("new"), "document_id")).withColumn(
        "score", 1 / (1 + F.exp(-F.col("logit"))))
    report = workflows.audit(fresh, done["policy"], done["supported"], df, replicates=50).first()
    assert report.subset == "all" and report.review_rate_low <= report.review_rate <= report.review_rate_high
    with pytest.raises(ValueError):
        workflows.audit(fresh, done["policy"], done["supported"], fresh)
    leaking = df.unionByName(df.filter("cohort = 'dev'").withColumn("cohort", F.lit("risk_validation")))
    with pytest.raises(ValueError):
        workflows.finalize(leaking, replicates=10)


def test_streams_deduplicate_and_complete_documents(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("d1", "/a", "2024-01-01 00:00:00"), ("d1", "/a", "2024-01-01 00:00:05"), ("d1", "/b", "2024-01-01 00:01:00"),
            ("d2", "/a", "2024-01-01 00:02:00"), ("late", "/z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "document_id string, field_id string, t string").select(
        "document_id", "field_id", F.to_timestamp("t").alias("time")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    asked = str(tmp_path / "asked")
    spark.createDataFrame([("d1", 2), ("d2", 2), ("absent", 1)], "document_id string, expected_fields int").withColumn(
        "time", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).coalesce(1).write.parquet(asked)
    requests = spark.readStream.schema("document_id string, expected_fields int, time timestamp").parquet(asked)
    stream = spark.readStream.schema(schema).parquet(source)
    got = {r.document_id: (r.arrived_fields, r.state) for r in jobs.run_available(jobs.completion(stream, requests), "t4").collect()}
    assert got == {"d1": (2, "complete"), "d2": (1, "incomplete"), "absent": (0, "incomplete")}
    once = jobs.run_available(jobs.ingested_once(spark.readStream.schema(schema).parquet(source)), "t3")
    assert once.count() == 4


def test_decode_statistics_bind_their_sums(spark):
    """Right with ties, and a long array costs its length, not the square of it."""
    import time

    from fieldwarden.functions import tokens

    def stats(rows, width):
        df = spark.createDataFrame(rows, "logits array<double>, chosen int")
        return df.select(tokens.decode_statistics(F.col("logits"), F.col("chosen"), width - 1, width).alias("s")).select("s.*")

    logits = [1.0, 3.0, 3.0, -2.0]
    got = stats([(logits, 0)], 4).first()
    p = np.exp(logits) / np.exp(logits).sum()
    assert got.log_probability == pytest.approx(np.log(p[0])) and got.close_log_probability == pytest.approx(np.log(p[3]))
    assert got.normalized_entropy == pytest.approx(-(p * np.log(p)).sum() / np.log(4))
    assert (got.probability_margin, got.logit_margin) == (pytest.approx(0), 0)
    started = time.time()
    stats([(np.random.default_rng(0).normal(size=20_000).tolist(), 3)], 20_000).collect()
    assert time.time() - started < 30


def test_finalize_computes_rows_once_and_writes_reported_cohorts(spark, monkeypatch):
    rng, seen, written = random.Random(3), spark.sparkContext.accumulator(0), {}
    rows = [(f"d{i}", ("dev", "calibration", "risk_validation", "train")[i % 4], f"/f{f}", right, rng.gauss(2.0 if right else -2.0, 1))
            for i in range(80) for f in range(4) for right in [rng.random() > .3]]

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    def staged(df, name="stage"):
        written[name] = plain(df, name)
        return written[name]

    plain = workflows.staged
    monkeypatch.setattr(workflows, "staged", staged)
    df = spark.createDataFrame(rows, "document_id string, cohort string, field_id string, correct boolean, logit double").select(
        "*", F.lit("ok").alias("status"), F.lit(False).alias("shape_violation"), F.lit("long text").alias("prediction"))
    workflows.finalize(df.withColumn("document_id", passed("document_id")), target=.8, replicates=20)["summary"].collect()
    assert seen.value == 320 and "prediction" not in written["scored"].columns
    assert {r[0] for r in written["calibrated"].select("cohort").distinct().collect()} == {"dev", "risk_validation"}


def test_audit_computes_rows_once(spark):
    rng, seen = random.Random(4), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(f"d{i}", f"/f{f}", rng.random() > .2, rng.random()) for i in range(60) for f in range(4)],
                                 "document_id string, field_id string, correct boolean, score double").select(
        "*", F.lit("ok").alias("status"), F.lit(False).alias("shape_violation"))
    chosen, supported = policy.fixed_policy(rows, .5), policy.supported_fields(rows)
    other = spark.createDataFrame([("x",)], "document_id string")
    subsets = rows.filter("document_id < 'd3'").select(F.lit("some").alias("subset"), "document_id")
    report = {r.subset: r for r in workflows.audit(rows.withColumn("document_id", passed("document_id")), chosen, supported, other, subsets, 50).collect()}
    assert seen.value == 240
    judged = policy.decided(rows, chosen, supported)
    for name, part in (("all", judged), ("some", judged.filter("document_id < 'd3'"))):
        alone = review.evaluate_decisions(part).join(bootstrap.review_intervals(part, 50)).first()
        assert all(report[name][c] == alone[c] for c in alone.asDict())


def test_calibration_query_derives_rows_once(spark, monkeypatch):
    from fieldwarden.catalog import models

    rng, seen = random.Random(5), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(f"d{i}", right, rng.gauss(1.0 if right else -1.0, 1)) for i in range(80) for right in [rng.random() > .3]],
                                 "document_id string, correct boolean, logit double")
    want = calibration.select_calibration(rows)
    monkeypatch.setattr(models, "review_rows", lambda *a: rows.withColumn("document_id", passed("document_id")))
    line = models.calibration_selection(spark, "").first()
    assert seen.value == 80 and line.method == want["method"] and line.temperature == pytest.approx(want["temperature"], abs=1e-6)
