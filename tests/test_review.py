"""Policies, metrics and bootstrap against hand-made rows and brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.functions.hashing import DRAW_MODULUS, EXACT_MEAN, poisson_draw
from fieldwarden.functions.numbers import REVIEW_ALL, wilson
from fieldwarden.operators import bootstrap, policy, review

SCHEMA = "document_id string, form string, field_id string, status string, correct boolean, shape_violation boolean, score double, logit double"


def frame(spark, rows):
    full = [(d, "f", f, s, c, v, p, None if p is None or math.isnan(p) else math.log(max(p, 1e-9) / max(1 - p, 1e-9)))
            for d, f, s, c, v, p in rows]
    return spark.createDataFrame(full, SCHEMA)


def tied(spark):
    scores = [.3, .3, .6, .6, .9]
    right = [False, True, False, True, True]
    return frame(spark, [(f"d{i}", "/x", "ok", c, False, p) for i, (p, c) in enumerate(zip(scores, right))])


def test_ties_stay_together(spark):
    rows = tied(spark)
    fitted = policy.fit_policy(rows).first()
    assert fitted.threshold == pytest.approx(.75)
    report = review.evaluate_policy(rows, policy.fit_policy(rows)).first()
    assert (report.reviewed_fields, report.caught_errors, report.error_recall) == (4, 2, 1.0)


def test_threshold_edges(spark):
    no_errors = frame(spark, [("d", "/x", "ok", True, False, .5)])
    assert policy.fit_policy(no_errors).first().threshold == REVIEW_ALL
    forced = frame(spark, [("d", "/x", "truncated", False, False, None), ("d", "/y", "ok", True, False, .5)])
    assert policy.fit_policy(forced).first().threshold == 0
    last = frame(spark, [("d", "/x", "ok", True, False, .2), ("d", "/y", "ok", False, False, .9)])
    assert policy.fit_policy(last).first().threshold == REVIEW_ALL
    with pytest.raises(ValueError):
        policy.fit_policy(no_errors, split="audit")
    with pytest.raises(ValueError):
        policy.fit_conservative_policy(no_errors, split="dev")


def test_reasons_and_priority(spark):
    rows = frame(spark, [("d", "/x", "ok", True, False, .9), ("d", "/x2", "ok", True, False, .1), ("d", "/x3", "ok", True, True, .9),
                         ("d", "/x4", "truncated", True, True, None), ("d", "/x5", "ok", True, False, math.nan), ("d", "/new", "ok", True, False, .9)])
    known = rows.filter("field_id <> '/new'").select("field_id")
    queue = {r.field_id: (r.reason, r.priority) for r in policy.review_queue(rows, policy.fixed_policy(rows, .5), known).collect()}
    assert queue == {"/x2": ("low_correctness_confidence", pytest.approx(.9)), "/x3": ("field_shape_violation", 1.0),
                     "/x4": ("incomplete_or_invalid", 1.0), "/x5": ("incomplete_or_invalid", 1.0),
                     "/new": ("field_outside_evaluated_schema", 1.0)}


def simulated(spark, documents=120, fields=10, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(documents):
        for f in range(fields):
            wrong = rng.random() < .15
            rows.append((f"d{d:03d}", f"/f{f}", "ok" if rng.random() > .03 else "truncated", not wrong, False,
                         round(min(1.0, max(0.0, rng.gauss(.35 if wrong else .75, .15))), 3)))
    return frame(spark, rows), rows


def poisson_weights(key, count, replicates, seed=42):
    """Draws for ``count`` documents with one tally vector: how many values of the distribution function lie below."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    start, step, start_2, step_2 = (int(digest[i:i + 8], 16) % DRAW_MODULUS for i in (0, 8, 16, 24))
    u, v = (((s + np.arange(replicates) * t) % DRAW_MODULUS + .5) / DRAW_MODULUS for s, t in ((start, step), (start_2, step_2)))
    if count > EXACT_MEAN:
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        return np.maximum(0, np.floor(count + math.sqrt(count) * z + (z * z - 1) / 6 + (z - z**3) / (72 * math.sqrt(count)) + .5))
    total = np.cumsum([math.exp(j * math.log(count) - count - math.lgamma(j + 1)) for j in range(count + 200)])
    return np.searchsorted(total, u)


def test_conservative_policy_matches_a_plain_bisection(spark):
    df, rows = simulated(spark)
    got = policy.fit_conservative_policy(df, target=.9, replicates=200).first()
    wrong = [r for r in rows if not r[3]]
    keys = sorted({r[5] for r in rows if r[2] == "ok"})

    def state(k):
        caught = [r for r in wrong if r[2] != "ok" or (k and r[5] <= keys[k - 1])]
        p, n = len(caught) / len(wrong), len(wrong)
        low = (p + 1.96**2 / (2 * n) - 1.96 * math.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n))) / (1 + 1.96**2 / n)
        errors, hit = Counter(r[0] for r in wrong), Counter(r[0] for r in caught)
        vectors = Counter((hit[d], errors[d]) for d in errors)
        drawn = [(c, e, poisson_weights(f"{c},{e}", m, 200)) for (c, e), m in vectors.items()]
        ratio = sum(c * w for c, _, w in drawn) / sum(e * w for _, e, w in drawn)
        return low, float(np.quantile(ratio, .025))

    k, high = 0, len(keys) + 1
    while k < high:
        middle = (k + high) // 2
        k, high = (k, middle) if min(state(middle)) >= .9 else (middle + 1, high)
    assert got.threshold == pytest.approx((keys[k - 1] + keys[k]) / 2 if 0 < k < len(keys) else (0 if k == 0 else REVIEW_ALL))
    assert (got.wilson_recall_lower_95, got.document_bootstrap_recall_lower_95) == (pytest.approx(state(k)[0]), pytest.approx(state(k)[1]))
    assert got.bound_target_met
    strict = policy.fit_conservative_policy(df, target=.9999, replicates=50).first()
    assert strict.threshold == REVIEW_ALL and not strict.bound_target_met and strict.fallback == "review_all"
    perfect = policy.fit_conservative_policy(df.filter("correct"), replicates=20).first()
    assert perfect.threshold == REVIEW_ALL and perfect.wilson_recall_lower_95 == 0


@pytest.mark.parametrize("mean", [1, 2, 7, 64, 65, 500, 10**9])
def test_draws_are_poisson(spark, mean):
    drawn = spark.range(40_000).select(poisson_draw(
        F.lit(mean), (F.xxhash64(F.lit(1), "id") % 1000003 + 1000003) % 1000003 / 1000003 + 1e-7,
        (F.xxhash64(F.lit(2), "id") % 1000003 + 1000003) % 1000003 / 1000003).alias("w")).toPandas().w.to_numpy()
    assert abs(drawn.mean() - mean) < 4 * math.sqrt(mean / 40_000) + .01
    assert drawn.var() == pytest.approx(mean, rel=.04)
    if mean < 100:
        for j in range(int(mean + 4 * math.sqrt(mean)) + 1):
            p = math.exp(j * math.log(mean) - mean - math.lgamma(j + 1))
            assert abs((drawn == j).mean() - p) < 4.5 * math.sqrt(p / 40_000) + 1e-4


def test_interval_of_tallies_equals_that_of_documents(spark):
    # The document bootstrap with one Poisson(1) weight per document, in numpy.
    df, rows = simulated(spark, 400)
    got = bootstrap.review_intervals(df.withColumn("needs_review", F.col("score") < .5), 2000).first()
    names = sorted({r[0] for r in rows})
    at = {d: i for i, d in enumerate(names)}
    tally = np.zeros((len(names), 2))
    for r in rows:
        tally[at[r[0]]] += (r[5] < .5, 1)
    weight = np.random.default_rng(1).poisson(1, (4000, len(names)))
    low, high = np.quantile(weight @ tally[:, 0] / (weight @ tally[:, 1]), [.025, .975])
    assert got.review_rate_low == pytest.approx(low, abs=.003) and got.review_rate_high == pytest.approx(high, abs=.003)


def test_repeated_fields_are_refused(spark):
    df, _ = simulated(spark, 3)
    flagged = df.withColumn("needs_review", F.col("score") < .5).withColumn("kind", F.lit("scalar"))
    twice = flagged.unionByName(flagged.limit(1))
    for left, right in ((twice, flagged), (flagged, twice)):
        with pytest.raises(Exception, match="repeated field"):
            bootstrap.paired_systems(left, right, 10).collect()
        with pytest.raises(Exception, match="repeated field"):
            bootstrap.paired_delta(left, right, 10).collect()


def test_bootstrap_does_not_depend_on_partitioning(spark):
    df, _ = simulated(spark)
    flagged = df.withColumn("needs_review", F.col("score") < .5)
    a, b = (bootstrap.review_intervals(d, 200).first() for d in (flagged, flagged.repartition(7).orderBy("score")))
    assert a == b and 0 < a.error_recall_low < a.error_recall_high < 1


def test_paired_delta_of_equal_systems_is_zero(spark):
    df, _ = simulated(spark, 20)
    named = df.withColumn("kind", F.lit("scalar"))
    result = bootstrap.paired_delta(named, named, 100).first()
    assert (result.delta, result.delta_low, result.delta_high, result.only_a, result.only_b) == (0, 0, 0, 0, 0)
    missing = bootstrap.paired_delta(named.filter("document_id <> 'd001'"), named, 10).first()
    assert (missing.only_a, missing.only_b) == (0, 10)


def test_metrics_against_numpy(spark):
    df, rows = simulated(spark)
    scored = [(r[5], r[3]) for r in rows]
    p, y = np.array([s for s, _ in scored]), np.array([c for _, c in scored], dtype=float)
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert review.auroc(df).first().auroc == pytest.approx(np.mean(pairs))
    logit = np.log(np.maximum(p, 1e-9) / np.maximum(1 - p, 1e-9))
    q = 1 / (1 + np.exp(-logit))
    line = review.accuracy_brier_nll(df).first()
    assert line.brier == pytest.approx(np.mean((q - y) ** 2)) and line.accuracy == pytest.approx(y.mean())
    ece = 0.0
    for i in range(10):
        mask = (q >= i / 10) & ((q < (i + 1) / 10) if i < 9 else (q <= 1))
        ece += mask.mean() * abs(q[mask].mean() - y[mask].mean()) if mask.any() else 0
    assert review.calibration_error(df).first().ece == pytest.approx(ece)
    one_class = df.filter("correct")
    assert review.auroc(one_class).first().auroc is None


def test_budgets_never_split_a_tie(spark):
    got = {r.budget: r for r in review.budgets(tied(spark), (.2, .4, .7, .9)).collect()}
    assert [got[b].review_rate for b in (.2, .4, .7, .9)] == [0, pytest.approx(.4), pytest.approx(.4), pytest.approx(.8)]


def test_wilson(spark):
    low, high = spark.range(1).select(*wilson(F.lit(95), F.lit(100))).first()
    assert (round(low, 4), round(high, 4)) == (.8882, .9785)
    assert spark.range(1).select(*wilson(F.lit(0), F.lit(0))).first() == (None, None)


def test_more_review_never_catches_less(spark):
    df, _ = simulated(spark)
    recalls = [review.evaluate_policy(df, policy.fixed_policy(df, t)).first().error_recall for t in (.2, .4, .6, .8)]
    assert recalls == sorted(recalls)


def test_the_threshold_is_above_the_last_reviewed_score(spark):
    one = 0.5
    cases = [(one, np.nextafter(one, 1)), (0.25, 0.75), (3.0, None), (0.0, None), (1.0, np.nextafter(1.0, 2))]
    df = spark.createDataFrame([(a, None if b is None else float(b)) for a, b in cases], "a double, b double")
    for a, b, t in df.select("a", "b", policy.between(F.col("a"), F.col("b"))).collect():
        assert a < t and (b is None or t <= b)


def document_weights(documents, replicates, seed=42):
    """Poisson(1) weights of single documents."""
    from fieldwarden.functions.hashing import poisson_cuts

    cuts, result = np.array(poisson_cuts()), {}
    for d in documents:
        digest = hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()
        start, step = (int(digest[i:i + 8], 16) % DRAW_MODULUS for i in (0, 8))
        result[d] = np.searchsorted(cuts, (start + np.arange(replicates) * step) % DRAW_MODULUS, side="right")
    return result


def test_every_document_is_drawn_in_every_replicate(spark):
    df, rows = simulated(spark, 700, 4)
    flagged = df.withColumn("needs_review", F.col("score") < .5).withColumn("half", F.col("document_id") < "d300")
    weights = document_weights({r[0] for r in rows}, 150)
    got = {r.half: r for r in bootstrap.review_intervals(flagged, 150, by=["half"]).collect()}
    for half in (True, False):
        mine = [r for r in rows if (r[0] < "d300") == half]
        rate = sum(weights[r[0]] * (r[5] < .5) for r in mine) / sum(weights[r[0]] for r in mine)
        caught = sum(weights[r[0]] * (r[5] < .5) for r in mine if not r[3]) / sum(weights[r[0]] for r in mine if not r[3])
        assert (got[half].review_rate_low, got[half].review_rate_high) == tuple(pytest.approx(x) for x in np.quantile(rate, [.025, .975]))
        assert (got[half].error_recall_low, got[half].error_recall_high) == tuple(pytest.approx(x) for x in np.quantile(caught, [.025, .975]))
    drawn = np.concatenate([*weights.values()])
    assert drawn.mean() == pytest.approx(1, abs=.02) and drawn.var() == pytest.approx(1, abs=.03)


def test_threshold_of_document_draws_is_that_of_a_plain_sweep(spark):
    df, rows = simulated(spark)
    got = policy.fit_conservative_policy(df, target=.9, replicates=200, by_document=True).first()
    wrong, keys = [r for r in rows if not r[3]], sorted({r[5] for r in rows if r[2] == "ok"})
    w = document_weights({r[0] for r in rows}, 200)

    def state(k):
        caught = [r for r in wrong if r[2] != "ok" or (k and r[5] <= keys[k - 1])]
        p, n = len(caught) / len(wrong), len(wrong)
        low = (p + 1.96**2 / (2 * n) - 1.96 * math.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n))) / (1 + 1.96**2 / n)
        ratio = sum(w[r[0]] for r in caught) / sum(w[r[0]] for r in wrong) if caught else np.zeros(200)
        return low, float(np.quantile(ratio, .025))

    k = next(k for k in range(len(keys) + 1) if min(state(k)) >= .9)
    assert got.threshold == pytest.approx((keys[k - 1] + keys[k]) / 2)
    assert (got.wilson_recall_lower_95, got.document_bootstrap_recall_lower_95) == tuple(pytest.approx(x) for x in state(k))


def ends(values):
    return tuple(pytest.approx(x) for x in np.quantile(values, [.025, .975]))


def test_comparisons_draw_every_document(spark):
    """Many documents share their tallies; each has its own draw, as in the first round's SQL."""
    df, rows = simulated(spark, 300, 3)
    w = document_weights({r[0] for r in rows}, 120)
    n = sum(w[r[0]] for r in rows)
    errors = sum(w[r[0]] for r in rows if not r[3])

    def share(cut, wrong=False):
        return sum(w[r[0]] for r in rows if r[5] < cut and not (wrong and r[3])) / (errors if wrong else n)

    both = df.withColumn("base_review", F.col("score") < .5).withColumn("new_review", F.col("score") < .6)
    got = bootstrap.policy_comparison(both, 120).first()
    assert (got.review_rate_change_low, got.review_rate_change_high) == ends(share(.6) - share(.5))
    assert (got.candidate_error_recall_low, got.candidate_error_recall_high) == ends(share(.6, True))
    a, b = (df.withColumn("needs_review", F.col("score") < cut) for cut in (.6, .4))
    got = bootstrap.paired_systems(a, b, 120).first()
    assert (got.review_rate_change_low, got.review_rate_change_high) == ends(share(.6) - share(.4))
    assert (got.fields, got.documents) == (900, 300)


def test_compared_sides_are_dealt_once_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "DEALT_ROWS", 100)
    df, rows = simulated(spark, 120, 10)
    b = df.filter("field_id <> '/f9'").unionByName(frame(spark, [("x", None, "ok", True, False, .5)]))
    a = df.filter("field_id <> '/f0'").unionByName(frame(spark, [("x", None, "ok", True, False, .5)]))
    sides = bootstrap.both_sides(a, b, {"x": F.col("correct")}, {"y": F.col("correct")})
    assert sides.rdd.getNumPartitions() == 22 and sides.count() == 1202
    assert sides._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    assert sides.filter("in_a = 1 and in_b = 1").count() == 960
    got = bootstrap.paired_delta(a.withColumn("kind", F.lit("scalar")), b.withColumn("kind", F.lit("scalar")), 50).first()
    assert (got.fields, got.only_a, got.only_b) == (960, 121, 121)
    with pytest.raises(Exception, match="repeated field"):
        bootstrap.paired_delta(a.unionByName(a.limit(1)).withColumn("kind", F.lit("s")), b.withColumn("kind", F.lit("s")), 10).collect()


def test_queues_are_computed_once(spark):
    """The sorted queue reads written rows, and the order inside documents needs no numbering of the whole table."""
    from fieldwarden.catalog import review as queries

    folder = "/root/testdata/sf0.001"
    queue, ordered = queries.review_queue(spark, folder), queries.review_queue_order(spark, folder)
    # The queue has no row from the view behind it, only the written table; no joined offsets in the other.
    assert all("/queue-" in f for f in queue.inputFiles())
    plan = ordered._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan.split("Subquery")[0]
    last = ordered.groupBy("document_id").agg(F.max("urgency").alias("last"), F.count_distinct("urgency").alias("n"))
    assert last.filter("last <> n").isEmpty()
