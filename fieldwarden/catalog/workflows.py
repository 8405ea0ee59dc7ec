"""Queries that run whole workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields, policy, rows
from ..operators.dataset import prepare_report
from ..plans import workflows
from ..session import read_table, staged
from . import query
from .dataset import GROUPS_SQL, PAGES_SQL, line_pages
from .review import SUBSET_INTERVALS, ROWS, decided_sql, evaluation_sql, rounded
from .views import BUCKET, PREPARED_SQL, SPLIT_CASE, prepared_documents, review_rows


@query("prepared_splits", GROUPS_SQL.format(pages=PAGES_SQL) + f""", docs AS (SELECT doc_id::VARCHAR AS document_id, lang, doc_id IN (SELECT document_id::BIGINT FROM pages_of) AS found FROM documents),
placed AS (SELECT docs.*, {SPLIT_CASE.format(b=BUCKET.format("'42:' || group_id"))} AS split FROM docs JOIN grouped USING (document_id))
SELECT 'splits' AS section, split AS name, count(*) AS count FROM placed WHERE found GROUP BY split UNION ALL SELECT 'forms', lang, count(*) FROM placed WHERE found GROUP BY lang
UNION ALL SELECT 'rejected', 'Missing image', count(*) FROM placed WHERE NOT found HAVING count(*) > 0
UNION ALL SELECT 'branches', 'scalar_branches', 2 * count(*) FROM placed WHERE found UNION ALL SELECT 'branches', 'array_branches', count(*) FROM placed WHERE found""")
def prepared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    pages = line_pages(spark, sf_dir)
    found = pages.select("document_id").distinct().withColumn("pages_found", F.lit(True))
    label = F.to_json(F.struct(F.col("source").alias("source"), F.struct(F.col("n_chars").cast("string").alias("chars")).alias("stats"),
                               F.array(F.col("lang")).alias("langs")))
    manifest = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("form"), label.alias("label"),
                                F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("unprinted"))
    manifest = manifest.join(found, "document_id", "left").withColumn("pages_found", F.coalesce("pages_found", F.lit(False)))
    return prepare_report(workflows.prepare(manifest, pages))


AUDIT_POLICY = "policy AS (SELECT 0.6::DOUBLE AS threshold)"


@query("audit_report", f"""WITH {ROWS}, {AUDIT_POLICY}, {decided_sql()},
parts AS (SELECT 'all' AS subset, * FROM decided UNION ALL SELECT form || '_audit', * FROM decided WHERE form IN ('f1', 'f2')),
{evaluation_sql('parts', 'subset')}, {SUBSET_INTERVALS} SELECT evaluation.*, ends.* EXCLUDE (subset) FROM evaluation JOIN ends USING (subset)""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The policy's fields, the subsets and the audit read the rows; they are derived once.
    audit_rows = staged(review_rows(spark, sf_dir).select(
        "document_id", "form", "field_id", "status", "shape_violation", "correct", "score"), "rows")
    subsets = audit_rows.filter("form in ('f1', 'f2')").select(F.concat("form", F.lit("_audit")).alias("subset"), "document_id")
    others = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("document_id"))
    report = workflows.audit(audit_rows, policy.fixed_policy(audit_rows, .6), policy.supported_fields(audit_rows), others,
                             subsets, 500)
    return rounded(report)


@query("finalize_summary")
def finalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = prepared_documents(spark, sf_dir).select("document_id", F.col("split").alias("cohort"))
    named = documents.withColumn("cohort", F.when(F.col("cohort") == "test", "risk_validation").otherwise(F.col("cohort")))
    scored = review_rows(spark, sf_dir, documents=named).drop("score")
    return rounded(workflows.finalize(scored, replicates=500)["summary"], 6)


SERVED = f"""{ROWS}, served AS (SELECT *, 1 / (1 + exp(-(logit / 2 + 0.5::DOUBLE))) AS p FROM rows),
judged AS (SELECT *, NOT usable OR p < 0.7::DOUBLE AS needs_review FROM served)"""


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = review_rows(spark, sf_dir).drop("score", "correct").withColumn("kind", F.lit("scalar"))
    return workflows.serve(decoded, {"temperature": 2.0, "bias": 0.5}, policy.fixed_policy(decoded, .7), policy.supported_fields(decoded))


@query("served_fields", f"""WITH {SERVED} SELECT document_id, field_id, status, round(CASE WHEN status = 'ok' THEN p END, 9) AS score,
  CASE WHEN needs_review THEN CASE WHEN status <> 'ok' OR logit IS NULL THEN 'incomplete_or_invalid' WHEN shape_violation THEN 'field_shape_violation' ELSE 'low_correctness_confidence' END END AS reason,
  round(CASE WHEN needs_review THEN CASE WHEN usable THEN 1 - p ELSE 1.0::DOUBLE END END, 9) AS priority FROM judged""")
def served_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_served(spark, sf_dir).select("document_id", "field_id", "status", "score", "reason", "priority"))


@query("served_documents", f"""WITH {SERVED} SELECT document_id, count(*) AS fields, count(*) FILTER (needs_review) AS review_fields, bool_or(needs_review) AS document_needs_review
FROM judged GROUP BY document_id""")
def served_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.document_flags(_served(spark, sf_dir))


@query("response_documents", f"""WITH {SERVED}, named AS (SELECT *, CASE WHEN needs_review THEN CASE WHEN status <> 'ok' OR logit IS NULL THEN 'incomplete_or_invalid'
  WHEN shape_violation THEN 'field_shape_violation' ELSE 'low_correctness_confidence' END END AS reason, CASE WHEN usable THEN 1 - p ELSE 1.0::DOUBLE END AS urgency FROM judged)
SELECT document_id, string_agg(field_id || '=' || status, ',' ORDER BY field_id) AS statuses, count(*) FILTER (status = 'ok' AND p IS NOT NULL) AS confidences,
  coalesce(string_agg(field_id || '=' || reason, ',' ORDER BY urgency DESC, field_id) FILTER (needs_review), '') AS review, bool_or(needs_review) AS document_needs_review
FROM named GROUP BY document_id""")
def response_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(entries: Column, first: str, second: str) -> Column:
        return F.array_join(F.transform(entries, lambda e: F.concat(e[first], F.lit("="), e[second])), ",")

    answers = workflows.responses(_served(spark, sf_dir))
    scored = F.size(F.filter(F.map_values("confidence"), lambda c: c.isNotNull())).cast("bigint")
    return answers.select("document_id", joined(F.map_entries("status"), "key", "value").alias("statuses"), scored.alias("confidences"),
                          joined(F.col("review"), "field_id", "reason").alias("review"), "document_needs_review")


@query("provenance_changes", """WITH s AS (SELECT n_name AS key, n_regionkey::VARCHAR AS v FROM nation), o AS (SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_regionkey::VARCHAR END AS v
  FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT r_name, r_regionkey::VARCHAR FROM region)
SELECT coalesce(s.key, o.key) AS key, s.v AS stored, o.v AS offered FROM s FULL JOIN o ON s.key = o.key WHERE s.v IS DISTINCT FROM o.v""")
def provenance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    stored = nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    changed = nation.filter("n_nationkey <> 3").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise(
        F.col("n_regionkey").cast("string")).alias("value"))
    regions = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return rows.provenance_changes(stored, changed.unionByName(regions))


@query("split_of_document", f"WITH {PREPARED_SQL} SELECT document_id, split, form FROM docs WHERE document_id IN (SELECT min(document_id) FROM docs GROUP BY form)")
def split_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared_documents(spark, sf_dir)
    wanted = docs.groupBy("form").agg(F.min("document_id").alias("document_id")).select("document_id")
    return fields.located(docs, wanted).filter("found").select("document_id", "split", "form")
