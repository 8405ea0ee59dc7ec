"""Prepare, finalize, audit and serve.

Order matters and is kept by the inputs: finalize reads the dev, calibration
and risk cohorts only, and audit takes a policy that already exists.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import count_if, sigmoid
from ..operators import bootstrap, calibration, cohorts, dataset, policy, review, rows, shapes
from ..session import staged
from ..sources.records import read_jsonl, write_by, write_jsonl

DEVELOPMENT = ("train", "dev", "calibration", "risk_validation")


def prepare(manifest: DataFrame, pages: DataFrame, seed: int = 42, describe_arrays: bool = True) -> DataFrame:
    """Manifest and page hashes to documents with group, split, fields and reject reason."""
    groups = dataset.duplicate_groups(pages.select("document_id", "page_hash"))
    grouped = manifest.join(groups, "document_id", "left").withColumn("group_id", F.coalesce("group_id", "document_id"))
    return dataset.labelled(grouped.withColumn("split", dataset.split_of(F.col("group_id"), seed)), describe_arrays)


def write_prepared(documents: DataFrame, path: str) -> DataFrame:
    """Write the accepted documents by split and return the report of the run."""
    documents = staged(documents, "prepared")
    write_by(documents.filter(F.col("reason").isNull()).drop("reason"), path, "split")
    return dataset.prepare_report(documents)


def import_datasets(documents: DataFrame, used_pages: DataFrame, path: str, per_dataset: int | None = None, seed: int = 42) -> DataFrame:
    """Import several datasets into one documents file; returns the report per dataset.

    ``documents`` have dataset, document_id, ``image_sha256`` and ``fields``.
    A document that shares a page with ``used_pages`` is dropped; of the
    others of a dataset at most ``per_dataset`` are drawn by a seeded shuffle.
    The report counts the documents and fields written and the documents
    dropped; a dataset of which nothing is left is in it.
    """
    documents = staged(documents, "imported")
    kept = staged(dataset.drop_overlapping(documents, used_pages).select("dataset", "document_id", F.size("fields").alias("fields")), "fresh")
    drawn = staged(kept if per_dataset is None else dataset.dataset_sample(kept, per_dataset, seed), "drawn")
    write_jsonl(documents.join(drawn.select("dataset", "document_id"), ["dataset", "document_id"], "left_semi"), path)
    read = documents.groupBy("dataset").agg(F.count("*").alias("read"))
    fresh = kept.groupBy("dataset").agg(F.count("*").alias("fresh"))
    written = drawn.groupBy("dataset").agg(F.count("*").alias("documents"), F.sum("fields").alias("fields"))
    return read.join(fresh, "dataset", "left").join(written, "dataset", "left").na.fill(0, ["fresh", "documents", "fields"]).select(
        "dataset", "documents", "fields", (F.col("read") - F.col("fresh")).alias("dropped_overlapping_pages"))


def split_datasets(documents: DataFrame, preferred: DataFrame, path: str, seed: int = 42, test_cap: int = 50, test_fraction: float = .5,
                   dev_cap: int = 3, max_train_pages: int = 6) -> DataFrame:
    """Split several datasets into train, dev and test without a page on two sides; writes the splits, returns the report.

    ``documents`` have dataset, document_id, ``image_sha256``, ``pages`` and
    ``fields``; documents that share a page are one group, which belongs to
    the dataset of the document it is named after (its least id). Groups with
    a document of ``preferred`` go to test first. Outside train only first
    variants count, inside it documents of at most ``max_train_pages``. The
    report has kept documents and fields per split, groups, preferred test
    groups, long documents dropped and, in every row, the pages that train
    and test still share (0 in a sound split).
    """
    documents = staged(documents, "documents")
    pages = documents.select("document_id", F.explode_outer("image_sha256").alias("page_hash"))
    grouped = staged(dataset.duplicate_groups(pages), "grouped")
    wanted = preferred.select("document_id").distinct().withColumn("__wanted", F.lit(True))
    names = grouped.join(wanted, "document_id", "left").groupBy("group_id").agg(F.max(F.coalesce("__wanted", F.lit(False))).alias("preferred"))
    owner = documents.select(F.col("document_id").alias("group_id"), "dataset")
    split = staged(dataset.quota_split(owner.join(names, "group_id"), seed, test_cap, test_fraction, dev_cap), "split")
    placed = documents.drop("dataset").join(grouped, "document_id").join(split.select("group_id", "dataset", "split"), "group_id")
    marked = staged(dataset.usable_in_split(placed, max_train_pages), "placed")
    kept = marked.filter(F.col("dropped").isNull())
    write_by(kept.drop("dropped"), path, "split")
    hashes = kept.select("split", F.explode("image_sha256").alias("page_hash"))
    shared = dataset.shared_pages(*[hashes.filter(F.col("split") == s).select("page_hash") for s in ("train", "test")]).agg(
        F.count("*").alias("train_test_shared_pages"))
    groups = split.groupBy("dataset").agg(F.count("*").alias("groups"), count_if((F.col("split") == "test") & F.col("preferred")).alias("test_preferred"))
    report = groups.join(dataset.quota_report(marked), "dataset", "left")
    return report.withColumn("train_test_shared_pages", shared.scalar())


def finalize(scored: DataFrame, target: float = .95, replicates: int = 2000, rules: DataFrame | None = None,
             family: str = "head") -> dict[str, object]:
    """Calibrate one head, fit its conservative policy and report it on dev and on the risk cohort.

    ``scored`` has review rows with ``cohort`` and ``logit``. Returns the
    calibration, the policy, the supported fields and a one-row summary.
    """
    if rules is not None:
        scored = shapes.flag_rows(scored, rules)
    scored = staged(scored.select("cohort", "document_id", "field_id", "status", "shape_violation", "correct", "logit"), "scored")
    overlaps = cohorts.cohort_overlaps(scored.select("cohort", "document_id").distinct())
    if not overlaps.isEmpty():
        raise ValueError("cohorts share documents")
    fitted = calibration.select_calibration(scored.filter("cohort = 'calibration'"))
    with_scores = staged(calibration.with_scores(scored.filter("cohort in ('dev', 'risk_validation')"), fitted), "calibrated")
    risk, dev = (with_scores.filter(F.col("cohort") == c) for c in ("risk_validation", "dev"))
    chosen = staged(policy.fit_conservative_policy(risk, target, replicates=replicates), "policy")
    supported = staged(policy.supported_fields(risk), "supported")
    reports = {c: review.evaluate_policy(r, chosen, supported).select(
        F.col("review_rate").alias(f"{c}_review_rate"), F.col("error_recall").alias(f"{c}_error_recall"))
        for c, r in (("risk", risk), ("dev", dev))}
    summary = bootstrap.side_by_side(chosen.select("threshold", "bound_target_met"), reports["risk"], reports["dev"]).select(
        F.lit(family).alias("family"), F.lit(fitted["method"]).alias("calibration"),
        F.lit(float(fitted["temperature"])).alias("temperature"), F.lit(float(fitted["bias"])).alias("bias"), "*")
    return {"calibration": fitted, "policy": chosen, "supported": supported, "summary": summary}


def audit(audit_rows: DataFrame, chosen: DataFrame, supported: DataFrame, development: DataFrame,
          subsets: DataFrame | None = None, replicates: int = 2000) -> DataFrame:
    """One report row per named subset (and ``all``): evaluation with bootstrap intervals.

    ``development`` names the documents of every development cohort; sharing
    one is an error. ``subsets`` is ``(subset, document_id)``; a document may
    be in several. The rows are read once, into tallies per document; subsets,
    evaluation and draws take those.
    """
    tallies = staged(review.document_tallies(policy.decided(audit_rows, chosen, supported)), "tallies")
    shared = tallies.select("document_id").join(development.select("document_id"), "document_id", "left_semi")
    if not shared.isEmpty():
        raise ValueError("the audit cohort shares documents with a development cohort")
    judged = tallies.withColumn("subset", F.lit("all"))
    if subsets is not None:
        judged = judged.unionByName(tallies.join(subsets.select("subset", "document_id").distinct(), "document_id"))
    judged = staged(judged, "judged")
    return review.evaluate_documents(judged, ["subset"]).join(
        bootstrap.document_intervals(judged, replicates, by=["subset"]), "subset")


def serve(decoded: DataFrame, fitted: Mapping[str, object], chosen: DataFrame, supported: DataFrame,
          rules: DataFrame | None = None) -> DataFrame:
    """Decoded fields with confidence, review reason and priority: one row per requested field.

    ``decoded`` has document_id, field_id, kind, prediction, status and logit
    (null without a trace).
    """
    rows_ = decoded if rules is None else shapes.flag_rows(decoded, rules)
    if "shape_violation" not in rows_.columns:
        rows_ = rows_.withColumn("shape_violation", F.lit(False))
    scored = calibration.with_scores(rows_, fitted).withColumn("score", F.when(F.col("status") == "ok", F.col("score")))
    judged = policy.decided(scored, chosen, supported).withColumn("reason", policy.review_reason())
    priority = F.when(F.col("reason") == "low_correctness_confidence", 1 - F.col("score")).when(F.col("reason").isNotNull(), 1.0)
    return judged.withColumn("priority", priority).drop("calibrated_logit", "mandatory", "unknown_field")


def document_flags(served: DataFrame) -> DataFrame:
    """Per document: fields, fields to review and whether a person must look at it."""
    return served.groupBy("document_id").agg(F.count("*").alias("fields"), count_if(F.col("needs_review")).alias("review_fields"),
                                             F.max("needs_review").alias("document_needs_review"))


def responses(served: DataFrame) -> DataFrame:
    """One response per document of ``serve`` rows.

    ``result`` (JSON text, null where a field has no value), ``confidence``
    and ``status`` by field id, whether they are ``calibrated``, the ordered
    ``review`` list (most urgent first, then by field id) and whether a person
    must look at the document. A document's fields are one row, as in its request.
    """
    def by_field(value: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", value))))

    queued = F.when(F.col("needs_review"), F.struct((-F.col("priority")).alias("urgency"), "field_id", "reason", "score"))
    listed = F.transform(F.array_sort(F.collect_list(queued)), lambda q: F.struct(
        q["field_id"].alias("field_id"), q["reason"].alias("reason"), q["score"].alias("score")))
    filled = served.withColumn("value", F.when(F.col("status") == "ok", F.col("prediction")))
    return filled.groupBy("document_id").agg(
        by_field("value").alias("result"), by_field("score").alias("confidence"), by_field("status").alias("status"),
        F.lit(True).alias("calibrated"), listed.alias("review"), F.max("needs_review").alias("document_needs_review"))


PREDICTIONS = ("document_id string, form string, kind string, field_id string, status string, prediction string, target string, "
               "text string")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Store prediction rows as JSON lines; columns that are not there stay out of the file."""
    names = [c.split()[0] for c in PREDICTIONS.split(", ")]
    write_jsonl(predictions.select(*[c for c in names if c in predictions.columns]), path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored prediction rows; what a file does not hold is null."""
    return read_jsonl(spark, path, PREDICTIONS)


def evaluate(predictions: DataFrame, requested: DataFrame | None = None, comparator: str = "text") -> DataFrame:
    """Headline metrics of stored predictions under a comparator, after the key and coverage guards."""
    from ..operators import extraction

    judged = staged(rows.judged(rows.completed(predictions), comparator), "judged")
    if not rows.duplicate_keys(judged).isEmpty():
        raise ValueError("duplicated (document_id, field_id) rows")
    if requested is not None and not rows.document_coverage(judged, requested).isEmpty():
        raise ValueError("the predictions do not cover exactly the requested documents")
    return extraction.exact_match(judged)


def heuristic_scores(summary: DataFrame, column: str) -> DataFrame:
    """Review rows scored by a training-free head: its value as the logit."""
    return summary.withColumn("logit", F.col(column)).withColumn("score", sigmoid(F.col("logit")))
