"""Freezing the policies of several heads and auditing them once.

A frozen folder holds versioned part tables and one pointer. The pointer is
written last and names the version, the digest of every part and the settings
that the rows must come from: a reader finds all of a release or none of it,
and notices a part that changed afterwards. The report of an audit is written
last too, and exists once.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import count_if, ratio
from ..operators import bootstrap, calibration, cohorts, features, policy, review, rows, shapes
from ..session import staged, task_count
from ..sources.records import claim_new, files_digest

POINTER = "frozen"
#: The cohorts that a finalization reports on, and what it reads of a row.
REPORTED = ("dev", "risk_validation")
NEEDED = ("family", "cohort", "document_id", "form", "field_id", "status", "shape_violation", "correct", "logit")


@dataclass(frozen=True)
class Release:
    """A frozen release: its part tables, its ``(key, value)`` settings and the family that is in charge."""

    parts: Mapping[str, DataFrame]
    settings: DataFrame
    primary: str
    version: str


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was committed under this path."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def freeze(path: str, primary: str, settings: DataFrame, parts: Mapping[str, DataFrame]) -> str:
    """Write the parts under a new version and then the pointer to them; a second freeze is refused.

    ``settings`` are ``(key, value)`` rows, the fingerprint of the extractor
    and its decode settings among them.
    """
    spark = settings.sparkSession
    if _written(spark, f"{path}/{POINTER}"):
        raise ValueError(f"{path} is already frozen; use a new folder")
    version = uuid.uuid4().hex
    lines = []
    for name, table in {**parts, "settings": settings.select("key", "value")}.items():
        folder = f"{path}/versions/{version}/{name}"
        claim_new(table, folder)
        lines.append((version, primary, name, files_digest(spark, [f"{folder}/*.parquet"]).first()["digest"]))
    claim_new(spark.createDataFrame(lines, "version string, primary string, part string, digest string").coalesce(1), f"{path}/{POINTER}")
    return version


def read_release(spark: SparkSession, path: str) -> Release:
    """The frozen release of a folder; a part that is not as it was frozen is an error."""
    pointer = spark.read.parquet(f"{path}/{POINTER}").collect()
    folder = f"{path}/versions/{pointer[0]['version']}"
    for line in pointer:
        if files_digest(spark, [f"{folder}/{line['part']}/*.parquet"]).first()["digest"] != line["digest"]:
            raise ValueError(f"{line['part']} of {path} changed after freezing")
    tables = {line["part"]: spark.read.parquet(f"{folder}/{line['part']}") for line in pointer}
    return Release({k: t for k, t in tables.items() if k != "settings"}, tables["settings"], pointer[0]["primary"], pointer[0]["version"])


def common_settings(metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(key, value)`` settings that all cohorts of ``metadata`` (``cohort, key, value``) share; a differing one is an error."""
    found = features.single_valued(metadata, keys)
    differing = [r["key"] for r in found.filter("values <> 1").orderBy("key").collect()]
    if differing:
        raise ValueError(f"the cohorts differ in {differing}")
    return found.select("key", "value")


def with_family_scores(scored: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Rows with ``raw_logit``, the calibrated ``logit`` and ``score`` of their family; null without a trace."""
    # One row per family; without the hint all rows were dealt to as many tasks as there are families.
    joined = scored.withColumnRenamed("logit", "raw_logit").join(F.broadcast(calibrations.select("family", "temperature", "bias")), "family")
    shifted = calibration.calibrated(F.col("raw_logit"), F.col("temperature"), F.col("bias"))
    return joined.withColumn("logit", shifted).withColumn("score", calibration.sigmoid(shifted)).drop("temperature", "bias")


def finalize_families(scored: DataFrame, primary: str, metadata: DataFrame, keys: Sequence[str], path: str | None = None,
                      target: float = .95, replicates: int = 2000, rules: DataFrame | None = None,
                      calibrations: Mapping[str, Mapping[str, object]] | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Calibrate every family, fit all conservative policies in the same passes, report and freeze them.

    Args:
        scored: Review rows with family, cohort and ``logit``; every family has the same cohorts.
        primary: The family in charge.
        metadata: Settings of each cohort's traces (``cohort, key, value``), equal for all.
        keys: The settings that are compared and frozen.
        path: Folder of the release; None computes and writes nothing.
        rules: Shape rules whose violations are mandatory reviews on dev and risk rows.
        calibrations: Known calibrations by family, else they are fitted on the calibration cohort.
        documents: ``cohort, document_id`` of all rows, when they are at hand before the rows are repeated per family.

    Returns one summary row per family: threshold, calibration, whether the
    bounds are met, and workload and recall on the risk and dev cohorts.
    """
    spark = scored.sparkSession
    if path is not None and _written(spark, f"{path}/{POINTER}"):
        raise ValueError(f"{path} is already frozen; use a new folder")
    settings = staged(common_settings(metadata, keys), "settings")
    pairs = (scored if documents is None else documents).select("cohort", "document_id").distinct()
    if not cohorts.cohort_overlaps(pairs).isEmpty():
        raise ValueError("cohorts share documents")
    used = scored.filter(F.col("cohort").isin(*REPORTED, *([] if calibrations else ["calibration"])))
    scored = staged((used if rules is None else shapes.flag_rows(used, rules)).select(*NEEDED), "scored")
    families = [r[0] for r in scored.select("family").distinct().orderBy("family").collect()]
    if primary not in families:
        raise ValueError(f"no rows of the primary family {primary}")
    if calibrations is None:
        own = scored.filter("cohort = 'calibration'")
        calibrations = {f: calibration.select_calibration(own.filter(F.col("family") == f)) for f in families}
    fitted = spark.createDataFrame([(f, str(calibrations[f]["method"]), float(calibrations[f]["temperature"]), float(calibrations[f]["bias"]))
                                    for f in families], "family string, method string, temperature double, bias double")
    ready = with_family_scores(scored.filter(F.col("cohort").isin(*REPORTED)), fitted)
    risk = ready.filter("cohort = 'risk_validation'")
    policies = staged(policy.conservative_policies(risk, target, replicates=replicates, families=families), "policies")
    supported = staged(risk.groupBy("family", "field_id").agg(F.count("*").alias("field_rows")), "supported")
    judged = staged(policy.decided_by_family(ready, policies, supported).drop("threshold", "unknown_field"), "judged")
    reports = staged(review.family_reports(judged, ["family", "cohort"], target), "reports")

    def of(cohort: str, *names: str) -> DataFrame:
        return reports.filter(F.col("cohort") == cohort).select("family", *[F.col(n).alias(f"{cohort.split('_')[0]}_{n}") for n in names])

    summary = (fitted.join(policies.select("family", "threshold", "bound_target_met"), "family")
               .join(of("risk_validation", "review_rate", "error_recall"), "family", "left").join(of("dev", "review_rate"), "family", "left")
               .select("family", (F.col("family") == primary).alias("primary"), "threshold", F.col("method").alias("calibration"), "temperature",
                       "bias", "bound_target_met", "risk_review_rate", "risk_error_recall", "dev_review_rate"))
    if path is not None:
        parts = {"calibrations": fitted, "policies": policies, "supported": supported, "reports": reports}
        freeze(path, primary, settings, parts if rules is None else {**parts, "rules": rules})
    return summary


def _members(judged: DataFrame, subsets: DataFrame | Column | None) -> DataFrame:
    """The rows with ``subsets``, the named subsets of their document; a table of documents is joined, a column is not."""
    if subsets is None:
        return judged.withColumn("subsets", F.array().cast("array<string>"))
    if isinstance(subsets, Column):
        return judged.withColumn("subsets", F.coalesce(subsets, F.array().cast("array<string>")))
    named = subsets.groupBy("document_id").agg(F.collect_set("subset").alias("subsets"))
    # To the planner derived rows are as few as those of the file behind them: never broadcast.
    joined = judged.join(named.hint("merge"), "document_id", "left")
    return staged(joined.withColumn("subsets", F.coalesce("subsets", F.array().cast("array<string>"))), "audit_rows")


def _tallies(marked: DataFrame, families: Sequence[str], names: Sequence[str], baseline: DataFrame | None) -> DataFrame:
    """One row per subset and document: per family (by number) fields, errors, reviews and caught errors.

    Columns that begin with ``s_`` count the fields that the baseline holds as
    well, ``s_b*`` its own errors and reviews there. Rows and baseline are dealt
    by document once, which serves fields and documents, without a join.
    """
    number = F.coalesce(*[F.when(F.col("family") == f, i) for i, f in enumerate(families)])
    inside = [F.array_contains("subsets", name).alias(f"in{j}") for j, name in enumerate(names)]
    rows_ = marked.select("document_id", "field_id", number.alias("side"), (~F.col("correct")).alias("wrong"),
                          F.col("needs_review").alias("flag"), *inside)
    if baseline is not None:
        known = baseline.filter(F.col("document_id").isNotNull() & F.col("field_id").isNotNull())
        other = known.select("document_id", "field_id", F.lit(-1).alias("side"), (~F.col("correct")).alias("wrong"),
                             F.col("needs_review").alias("flag"), *[F.lit(False).alias(f"in{j}") for j in range(len(names))])
        tasks = max(task_count(marked.sparkSession), -(-marked.count() // bootstrap.DEALT_ROWS))
        rows_ = rows_.unionByName(other).repartition(tasks, "document_id")
    c = F.col
    counts = {name: count_if((c("side") == i) & test) for i in range(len(families)) for name, test in (
        (f"n{i}", F.lit(True)), (f"e{i}", c("wrong")), (f"r{i}", c("flag")), (f"c{i}", c("wrong") & c("flag")))}
    if baseline is not None:
        counts |= {f"b{name}": count_if((c("side") == -1) & test) for name, test in (
            ("n", F.lit(True)), ("e", c("wrong")), ("r", c("flag")), ("c", c("wrong") & c("flag")))}
    within = [F.max(f"in{j}").alias(f"in{j}") for j in range(len(names))]
    if baseline is None:
        documents = rows_.groupBy("document_id").agg(*[x.alias(n) for n, x in counts.items()], *within)
        shared = []
    else:
        fields = rows_.groupBy("document_id", "field_id").agg(*[x.alias(n) for n, x in counts.items()], *within)
        repeated = F.raise_error(F.concat(F.lit("repeated field: "), "document_id", F.lit(" "), "field_id")).cast("bigint")
        fields = fields.withColumn("bn", F.when(c("bn") > 1, repeated).otherwise(c("bn")))
        own = [n for n in counts if not n.startswith("b")]
        # Only fields of the primary family count for the baseline; it holds a field once.
        shared = [F.sum(c("bn") * c(n)).alias(f"s_{n}") for n in own] + [F.sum(c(n) * c("n0")).alias(f"s_{n}") for n in ("be", "br", "bc")]
        documents = fields.groupBy("document_id").agg(*[F.sum(n).alias(n) for n in own], *within, *shared)
    lists = F.concat(F.array(F.lit("all")), *[F.when(c(f"in{j}"), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
                                              for j, n in enumerate(names)])
    # Documents that only the baseline holds are none of the audit.
    kept = documents.filter(" + ".join(f"n{i}" for i in range(len(families))) + " > 0").select(F.explode(lists).alias("subset"), *[n for n in documents.columns if n != "document_id" and not n.startswith("in")])
    names_ = [n for n in kept.columns if n != "subset"]
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("documents")).select("subset", "documents", *names_)


def _per_family(table: DataFrame, families: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Columns of the wide table that end in a family's number as rows per family; ``columns`` is new name -> pattern."""
    rows_ = F.array(*[F.struct(F.lit(f).alias("family"), *[F.col(pattern.format(i=i)).alias(name) for name, pattern in columns.items()])
                      for i, f in enumerate(families)])
    return table.select("subset", F.inline(rows_))


def audit_report(judged: DataFrame, primary: str, families: Sequence[str], baseline: DataFrame | None = None,
                 subsets: DataFrame | Column | None = None, replicates: int = 2000, target: float = .95, seed: int = 42) -> DataFrame:
    """One row per family and named subset (``all`` first of them): evaluation, ranking, intervals and comparisons.

    ``judged`` are audit rows of :func:`policy.decided_by_family`, the same
    fields for every family, written before: they are read several times.
    ``subsets`` as in :func:`audit_once`. Intervals of all families, of each against the
    primary one and of each against the baseline come from shared draws over
    wide tallies of documents; only these move rows, once.
    """
    families = [primary, *[f for f in families if f != primary]]
    numbers = range(len(families))
    marked = _members(judged, subsets)
    by = ["family", "subset"]
    # Counted before they are repeated per subset.
    fine = staged(review.decision_counts(marked, ["family", "subsets"]), "decision_counts")
    fine = fine.withColumn("subset", F.explode(F.concat(F.array(F.lit("all")), F.array_distinct("subsets")))).drop("subsets")
    totals_ = staged(review.field_tallies(fine, by, F.col("n")), "totals")
    names = [r[0] for r in totals_.select("subset").distinct().filter("subset <> 'all'").orderBy("subset").collect()]
    # Documents with equal counts are one row: what is left does not grow with the documents.
    tallies = staged(_tallies(marked, families, names, baseline), "tallies")
    documents = F.col("documents")
    seen = tallies.groupBy("subset").agg(*[x for i in numbers for x in (
        F.sum(F.when(F.col(f"n{i}") > 0, documents)).alias(f"d{i}"), F.coalesce(F.sum(F.when(F.col(f"r{i}") > 0, documents)), F.lit(0)).alias(f"v{i}"))])
    seen = _per_family(seen, families, {"documents": "d{i}", "reviewed_documents": "v{i}"})
    evaluation = review.evaluate_totals(totals_.join(seen, by), by)
    report = review.counted_reports(fine, evaluation, by, target)

    wide = [x for i in numbers for x in (f"e{i}", f"r{i}", f"c{i}")]
    drawn = bootstrap.replicate_sums(tallies, {"n": F.col("n0"), **{c: F.col(c) for c in wide}}, replicates, seed, ["subset"], "documents")
    ends = []
    for i in numbers:
        n, e, r, c = (F.col(x) for x in ("n", f"e{i}", f"r{i}", f"c{i}"))
        ends += [*bootstrap.interval(ratio(r, n), f"review_rate_{i}"), *bootstrap.interval(ratio(c, e), f"error_recall_{i}"),
                 *bootstrap.interval(ratio(r, n) - ratio(F.col("r0"), n), f"change_{i}")]
    pairs = [(f"{a}_{end}", f"{b}_{{i}}_{end}") for a, b in (("review_rate_95", "review_rate"), ("error_recall_95", "error_recall"),
                                                           ("versus_primary_review_rate_change", "change")) for end in ("low", "high")]
    own = _per_family(drawn.groupBy("subset").agg(*ends), families, dict(pairs))
    for name in ("versus_primary_review_rate_change_low", "versus_primary_review_rate_change_high"):
        own = own.withColumn(name, F.when(F.col("family") != primary, F.col(name)))
    report = report.join(own, ["family", "subset"], "left")
    if baseline is not None:
        shared = tallies.filter(" + ".join(f"s_n{i}" for i in numbers) + " > 0").select("subset", "documents", F.col("s_n0").alias("n"), *[F.col(f"s_{c}").alias(c) for c in ("be", "br", "bc", *wide)])
        totals = shared.groupBy("subset").agg(*[F.sum(F.col(c) * documents).alias(c) for c in ("n", "be", "br", "bc", *wide)])
        b_drawn = bootstrap.replicate_sums(shared, {c: F.col(c) for c in ("n", "br", *[f"r{i}" for i in numbers])}, replicates, seed, ["subset"], "documents")
        b_ends = b_drawn.groupBy("subset").agg(*[x for i in numbers for x in bootstrap.interval(
            ratio(F.col(f"r{i}"), F.col("n")) - ratio(F.col("br"), F.col("n")), f"b{i}")])
        both = totals.join(b_ends, "subset")
        columns = {"n": "n", "be": "be", "br": "br", "bc": "bc", "e": "e{i}", "r": "r{i}", "c": "c{i}",
                   "versus_baseline_review_rate_change_low": "b{i}_low", "versus_baseline_review_rate_change_high": "b{i}_high"}
        tall = _per_family(both, families, columns)
        report = report.join(tall.select(
            "family", "subset", F.col("n").alias("shared_fields"), ratio(F.col("r"), F.col("n")).alias("shared_review_rate"),
            ratio(F.col("br"), F.col("n")).alias("baseline_review_rate"), ratio(F.col("c"), F.col("e")).alias("shared_error_recall"),
            ratio(F.col("bc"), F.col("be")).alias("baseline_error_recall"),
            (ratio(F.col("r"), F.col("n")) - ratio(F.col("br"), F.col("n"))).alias("versus_baseline_review_rate_change"),
            "versus_baseline_review_rate_change_low", "versus_baseline_review_rate_change_high"), ["family", "subset"], "left")
    return report


def audit_once(path: str, audit_rows: DataFrame, settings: DataFrame, development: DataFrame, baseline: DataFrame | None = None,
               subsets: DataFrame | Column | None = None, replicates: int = 2000, target: float = .95) -> DataFrame:
    """Judge the audit rows of every frozen family, store the predictions by family and, last, the report; once.

    Args:
        path: Folder of a frozen release.
        audit_rows: Review rows with family and uncalibrated ``logit``.
        settings: ``(key, value)`` settings of the audit traces; they must be the frozen ones.
        development: Documents of every development cohort; sharing one is an error.
        baseline: Another system's rows (``document_id, field_id, correct, needs_review``).
        subsets: ``(subset, document_id)``, or a column over the audit rows with the array of a row's subsets, the same
            for all rows of a document; a document may be in several.

    The predictions are written first and the report is that of what was
    written. An audit that was cut off before its report starts over and
    replaces the predictions. Once the report exists, every further audit is
    refused.
    """
    spark = audit_rows.sparkSession
    if _written(spark, f"{path}/audit_report"):
        raise ValueError(f"{path} was already audited; the audit is measured once")
    release = read_release(spark, path)
    changed = [r["key"] for r in rows.provenance_changes(release.settings, settings.select("key", "value")).orderBy("key").limit(50).collect()]
    if changed:
        raise ValueError(f"the audit rows come from other settings than the release: {changed}")
    if not audit_rows.select("document_id").join(development.select("document_id"), "document_id", "left_semi").isEmpty():
        raise ValueError("the audit cohort shares documents with a development cohort")
    flagged = shapes.flag_rows(audit_rows, release.parts["rules"]) if "rules" in release.parts else audit_rows
    def decided(scored: DataFrame) -> DataFrame:
        return policy.decided_by_family(scored, release.parts["policies"], release.parts["supported"])

    families = [r[0] for r in release.parts["policies"].select("family").orderBy("family").collect()]
    stored = decided(with_family_scores(flagged, release.parts["calibrations"])).drop("threshold", "mandatory", "unknown_field")
    stored = stored.withColumnRenamed("score", "confidence")
    predictions = f"{path}/audit_predictions"
    stored.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("family").parquet(predictions)
    kept = spark.read.schema(stored.schema).parquet(predictions)
    judged = decided(kept.drop("needs_review").withColumnRenamed("confidence", "score"))
    report = staged(audit_report(judged, release.primary, families, baseline, subsets, replicates, target), "report")
    claim_new(report, f"{path}/audit_report")
    return spark.read.parquet(f"{path}/audit_report")
