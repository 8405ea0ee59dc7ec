"""Releases of several heads: all or nothing, unchanged, audited once."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.operators import bootstrap, policy, review
from fieldwarden.plans import release

COHORTS = {"calibration": 60, "risk_validation": 120, "dev": 40, "audit": 60}
KEYS = ("source_fingerprint", "merge")


def rows_of(spark, seed=5, fields=6):
    draw = random.Random(seed)
    out = []
    for cohort, count in COHORTS.items():
        for d in range(count):
            for f in range(fields):
                wrong, ok = draw.random() < .2, draw.random() > .04
                logit = draw.gauss(-1 if wrong else 1.5, 1) if ok else None
                for family, scale in (("head", 1.0), ("noisy", .5)):
                    own = None if logit is None else logit * scale + (draw.gauss(0, .6) if family == "noisy" else 0)
                    out.append((family, cohort, f"{cohort}{d}", f"form{d % 3}", f"/f{f}", "ok" if ok else "truncated", not wrong, False, own))
    return spark.createDataFrame(out, "family string, cohort string, document_id string, form string, field_id string, status string, correct boolean, "
                                      "shape_violation boolean, logit double")


def metadata(spark, **odd):
    return spark.createDataFrame([(c, k, odd.get(c, "v")) for c in COHORTS for k in KEYS], "cohort string, key string, value string")


@pytest.fixture(scope="module")
def frozen(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("release") / "r")
    rows = rows_of(spark)
    summary = release.finalize_families(rows.filter("cohort <> 'audit'"), "head", metadata(spark), KEYS, path, .9, 100)
    return path, rows, {r.family: r for r in summary.collect()}


def test_each_family_as_if_alone(spark, frozen):
    path, rows, summary = frozen
    parts = release.read_release(spark, path).parts
    for family in ("head", "noisy"):
        (fit,) = parts["calibrations"].filter(F.col("family") == family).collect()
        own = release.with_family_scores(rows.filter(F.col("family") == family), parts["calibrations"])
        risk = own.filter("cohort = 'risk_validation'")
        alone = policy.fit_conservative_policy(risk, .9, replicates=100)
        assert summary[family].threshold == pytest.approx(alone.first().threshold)
        assert (summary[family].calibration, summary[family].temperature) == (fit.method, fit.temperature)
        judged = policy.decided(own.filter("cohort = 'dev'"), alone, policy.supported_fields(risk))
        assert summary[family].dev_review_rate == pytest.approx(review.evaluate_decisions(judged).first().review_rate)
    assert [summary[f].primary for f in ("head", "noisy")] == [True, False]


def test_a_second_freeze_is_refused(spark, frozen):
    path, rows, _ = frozen
    with pytest.raises(ValueError, match="already frozen"):
        release.finalize_families(rows, "head", metadata(spark), KEYS, path)


def test_guards_of_finalize(spark):
    rows = rows_of(spark)
    with pytest.raises(ValueError, match="differ in .'merge', 'source_fingerprint'"):
        release.finalize_families(rows, "head", metadata(spark, dev="other"), KEYS)
    shared = rows.unionByName(rows.filter("document_id = 'dev3'").withColumn("cohort", F.lit("risk_validation")))
    with pytest.raises(ValueError, match="share documents"):
        release.finalize_families(shared, "head", metadata(spark), KEYS)
    with pytest.raises(ValueError, match="primary family"):
        release.finalize_families(rows, "unknown", metadata(spark), KEYS)


def test_changed_parts_are_noticed(spark, tmp_path):
    path = str(tmp_path / "r")
    settings = spark.createDataFrame([("a", "1")], "key string, value string")
    table = spark.range(3).coalesce(1)
    version = release.freeze(path, "x", settings, {"policies": table})
    assert release.read_release(spark, path).parts["policies"].count() == 3
    spark.range(4).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{version}/policies")
    with pytest.raises(ValueError, match="policies of .* changed after freezing"):
        release.read_release(spark, path)


def test_parts_without_a_pointer_are_no_release(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "r" / "versions" / "v" / "policies"))
    assert not release._written(spark, f"{tmp_path}/r/{release.POINTER}")
    settings = spark.createDataFrame([("a", "1")], "key string, value string")
    release.freeze(str(tmp_path / "r"), "x", settings, {})
    assert release.read_release(spark, str(tmp_path / "r")).primary == "x"


def test_the_audit_is_measured_once(spark, frozen):
    path, rows, _ = frozen
    audit_rows = rows.filter("cohort = 'audit'").drop("cohort")
    settings = spark.createDataFrame([(k, "v") for k in KEYS], "key string, value string")
    development = rows.filter("cohort <> 'audit'").select("document_id")
    with pytest.raises(ValueError, match="other settings"):
        release.audit_once(path, audit_rows, settings.withColumn("value", F.lit("w")), development)
    with pytest.raises(ValueError, match="shares documents"):
        release.audit_once(path, audit_rows, settings, rows.select("document_id"))
    baseline = audit_rows.filter("family = 'noisy' and field_id <> '/f0'").withColumn("needs_review", F.col("logit") < .1).fillna({"needs_review": True})
    subsets = audit_rows.filter("form = 'form1'").select(F.lit("form1_audit").alias("subset"), "document_id")
    report = {(r.family, r.subset): r for r in release.audit_once(path, audit_rows, settings, development, baseline, subsets, 200, .9).collect()}
    assert set(report) == {(f, s) for f in ("head", "noisy") for s in ("all", "form1_audit")}
    # The same numbers one family at a time.
    parts = release.read_release(spark, path).parts
    judged = policy.decided_by_family(release.with_family_scores(audit_rows, parts["calibrations"]), parts["policies"], parts["supported"])
    for family in ("head", "noisy"):
        own, line = judged.filter(F.col("family") == family), report[family, "all"]
        alone = review.evaluate_decisions(own).first()
        assert (line.fields, line.review_rate, line.error_recall) == (alone.fields, alone.review_rate, alone.error_recall)
        assert line.auroc == pytest.approx(review.auroc(own, "logit").first().auroc)
        assert line.aurc == pytest.approx(review.aurc(own).first().aurc)
        assert line.ece == pytest.approx(review.calibration_error(own).first().ece)
        assert line.nll == pytest.approx(review.accuracy_brier_nll(own).first().nll)
        assert line.within_field_auroc == pytest.approx(review.within_field_auroc(own, "raw_logit").first().macro_auroc)
        assert line.oracle_review_rate == pytest.approx(review.oracle_review_rate(own, .95).first().oracle_review_rate, abs=.1)
        pair = bootstrap.paired_systems(own, baseline, 50).first()
        assert line.shared_fields == pair.fields and line.versus_baseline_review_rate_change == pytest.approx(pair.review_rate_change)
        assert line.review_rate_95_low <= line.review_rate <= line.review_rate_95_high
    assert report["head", "all"].versus_primary_review_rate_change_low is None
    assert not math.isnan(report["noisy", "all"].versus_primary_review_rate_change_low)
    stored = spark.read.parquet(f"{path}/audit_predictions")
    assert stored.filter("family = 'head'").count() == audit_rows.count() / 2 and {"confidence", "needs_review"} <= set(stored.columns)
    with pytest.raises(ValueError, match="already audited"):
        release.audit_once(path, audit_rows, settings, development)


def test_audited_rows_are_written_once(spark, frozen, tmp_path):
    import os

    from fieldwarden.session import shared_dir

    path, rows, _ = frozen
    audit_rows, settings = rows.filter("cohort = 'audit'").drop("cohort"), spark.createDataFrame([(k, "v") for k in KEYS], "key string, value string")
    development = rows.filter("cohort <> 'audit'").select("document_id")
    baseline = audit_rows.filter("family = 'noisy' and field_id <> '/f0'").withColumn("needs_review", ~F.col("correct"))
    named = {"table": audit_rows.filter("form <> 'form0'").select(F.concat("form", F.lit("_audit")).alias("subset"), "document_id"),
             "column": F.when(F.col("form") != "form0", F.array(F.concat("form", F.lit("_audit"))))}
    parts, found = release.read_release(spark, path).parts, {}
    for kind, subsets in named.items():
        own, before = str(tmp_path / kind), set(os.listdir(shared_dir(spark).removeprefix("file:")))
        release.freeze(own, "head", settings, parts)
        report = release.audit_once(own, audit_rows, settings, development, baseline, subsets, 50, .9)
        found[kind] = [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in report.orderBy("family", "subset").collect()]
        new = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before}
        # A column of subsets leaves the predictions as the only copy of the rows.
        assert not new & {"audited", "shared", "scored", *(["audit_rows"] if kind == "column" else [])}
    assert found["table"] == found["column"] and len(found["table"]) == 6
    again = release.read_release(spark, str(tmp_path / "column"))
    twice = baseline.unionByName(baseline.limit(1))
    with pytest.raises(Exception, match="repeated field"):
        judged = policy.decided_by_family(release.with_family_scores(audit_rows, again.parts["calibrations"]), again.parts["policies"])
        release.audit_report(judged, "head", ["head", "noisy"], twice, None, 20).collect()


def counting(spark, table):
    """``table`` and a counter of how many of its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    return table.withColumn("document_id", passed("document_id")), seen


def test_finalize_families_computes_rows_of_reported_cohorts_once(spark):
    rows = rows_of(spark).filter("cohort <> 'audit'")
    given = {f: {"method": "affine", "temperature": 1.5, "bias": .1} for f in ("head", "noisy")}
    want = release.finalize_families(rows, "head", metadata(spark), KEYS, None, .9, 50, calibrations=given).collect()
    scored, seen = counting(spark, rows)
    got = release.finalize_families(scored, "head", metadata(spark), KEYS, None, .9, 50, calibrations=given, documents=rows).collect()
    assert sorted(got) == sorted(want)
    assert seen.value == rows.filter("cohort in ('dev', 'risk_validation')").count()
    shared = rows.withColumn("cohort", F.when(F.col("document_id") == "dev3", "risk_validation").otherwise(F.col("cohort"))).unionByName(rows)
    with pytest.raises(ValueError, match="share documents"):
        release.finalize_families(rows, "head", metadata(spark), KEYS, calibrations=given, documents=shared)


def test_documents_join_orders_before_their_fields(spark):
    from fieldwarden.catalog import views

    sf = "/root/testdata/sf0.001"
    documents = views.prepared_documents(spark, sf).select("document_id", F.col("split").alias("cohort")).filter("cohort <> 'train'")
    early = views.review_rows(spark, sf, documents=documents)
    late = views.review_rows(spark, sf).join(documents, "document_id").select(*early.columns)
    assert early.count() == late.count() > 0 and early.exceptAll(late).isEmpty()
