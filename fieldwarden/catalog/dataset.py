"""Queries on splits, duplicate groups, labels, statistics, cohorts and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.hashing import hash_word, seeded
from ..operators import cohorts, dataset, fields
from ..plans.workflows import import_datasets
from ..plans.workflows import split_datasets as split_dataset_files
from ..session import TASK_ROWS, computed_once, read_table, scratch_path, spread
from ..sources.records import read_jsonl
from . import query
from .views import (LINES_SQL, MANIFEST_SQL, PREPARED_SQL, document_lines, part_manifest,
                    prepared_documents)


@query("hash_split", f"WITH {PREPARED_SQL} SELECT split, form, count(*) AS documents, count(DISTINCT group_id) AS groups FROM docs GROUP BY ALL")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_documents(spark, sf_dir).groupBy("split", "form").agg(
        F.count("*").alias("documents"), F.count_distinct("group_id").alias("groups"))


@query("document_seeds", "SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::UBIGINT::BIGINT AS seed FROM documents")
def document_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", hash_word(seeded(7, F.col("doc_id"))).alias("seed"))


@query("train_reserve", f"""WITH {PREPARED_SQL} SELECT CASE WHEN bucket < 15 THEN 'train_reserve' ELSE 'train' END AS part, form, count(*) AS documents
FROM docs WHERE split = 'train' AND form IN ('f1', 'f2', 'f3') GROUP BY ALL""")
def train_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared_documents(spark, sf_dir)
    parts = [dataset.selected(docs, p, 15, ("f1", "f2", "f3")).withColumn("part", F.lit(p)) for p in ("train", "train_reserve")]
    return parts[0].unionByName(parts[1]).groupBy("part", "form").agg(F.count("*").alias("documents"))


PAGES_SQL = LINES_SQL + """,
pages_of AS (SELECT DISTINCT document_id, sha256(line) AS page_hash FROM doc_lines)"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages: document_id, page_name, page_hash."""
    lines = document_lines(spark, sf_dir)
    return lines.select("document_id", F.concat_ws(":", "document_id", "position").alias("page_name"),
                        F.sha2("line", 256).alias("page_hash"))


GROUPS_SQL = """WITH RECURSIVE {pages},
edges AS (SELECT DISTINCT a.document_id AS u, b.v FROM pages_of a JOIN (SELECT page_hash, min(document_id) AS v FROM pages_of GROUP BY 1) b USING (page_hash)),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u, v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
grouped AS (SELECT d.document_id, least(d.document_id, min(reach.v)) AS group_id FROM (SELECT doc_id::VARCHAR AS document_id FROM documents) d
  LEFT JOIN reach ON reach.u = d.document_id GROUP BY d.document_id)"""


def grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"),
                                                            F.lit(None).cast("string").alias("page_hash"))
    pages = line_pages(spark, sf_dir).select("document_id", "page_hash")
    return dataset.duplicate_groups(pages.unionByName(everyone))


@query("duplicate_groups", GROUPS_SQL.format(pages=PAGES_SQL) + " SELECT document_id, group_id FROM grouped")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_documents(spark, sf_dir)


@query("duplicate_pages", f"""WITH {LINES_SQL}, files AS (SELECT DISTINCT document_id, position, sha256(line) AS h FROM doc_lines)
SELECT count(*) - count(DISTINCT h) AS duplicate_page_occurrences FROM files""")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.duplicate_page_occurrences(line_pages(spark, sf_dir))


@query("shared_pages", f"""WITH {PAGES_SQL} SELECT page_hash FROM pages_of JOIN documents ON document_id = doc_id::VARCHAR WHERE lang = 'en'
INTERSECT SELECT page_hash FROM pages_of JOIN documents ON document_id = doc_id::VARCHAR WHERE lang <> 'en'""")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_lines(spark, sf_dir).select("form", F.sha2("line", 256).alias("page_hash"))
    return dataset.shared_pages(pages.filter("form = 'en'"), pages.filter("form <> 'en'"))


@query("drop_overlapping_pages", f"""WITH {LINES_SQL}, h AS (SELECT document_id, form, sha256(line) AS page_hash FROM doc_lines)
SELECT doc_id::VARCHAR AS document_id FROM documents WHERE lang = 'en' AND doc_id::VARCHAR NOT IN
  (SELECT document_id FROM h WHERE form = 'en' AND page_hash IN (SELECT page_hash FROM h WHERE form <> 'en'))""")
def drop_overlapping_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "lang",
        F.transform(F.filter(F.split("text", "\n"), lambda x: V.strip(x) != ""), lambda x: F.sha2(x, 256)).alias("image_sha256"))
    documents = computed_once(documents)
    used = documents.filter("lang <> 'en'").select(F.explode("image_sha256").alias("page_hash"))
    return dataset.drop_overlapping(documents.filter("lang = 'en'"), used).select("document_id")


# ------------------------------------------------------------------ labels

def manifest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed_once(dataset.labelled(part_manifest(spark, sf_dir)))


@query("flatten_labels", f"""WITH {MANIFEST_SQL} SELECT document_id, position, field_id, description, value, kind FROM fields""")
def flatten_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.exploded(manifest_fields(spark, sf_dir), "document_id")


@query("first_fields", f"""WITH {MANIFEST_SQL} SELECT document_id, field_id FROM fields WHERE position < 3""")
def first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manifest_fields(spark, sf_dir).filter("fields is not null")
    return docs.select("document_id", F.explode(fields.first_fields(F.col("fields"), 3)).alias("f")).select(
        "document_id", F.col("f.id").alias("field_id"))


@query("assemble_labels", f"""WITH {MANIFEST_SQL} SELECT document_id, '{{"part":{{' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '"name":"' || p_name || '",' END
  || '"br/and~x":"' || p_brand || '"}}' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE ',"size":"' || p_size || '"' END || ',"large":' || (p_size > 25)
  || ',"tags":["' || replace(p_name, ' ', '","') || '"],"dims":[{{"k":"size","v":"' || p_size || '"}}],"a":{{"b":{{"c":"' || p_type || '"}}}}}}' AS label
FROM reasons WHERE reason IS NULL""")
def assemble_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manifest_fields(spark, sf_dir).filter("reason is null")
    return V.assembled(docs.select("document_id", "fields")).select("document_id", "label")


@query("rejected_documents", f"WITH {MANIFEST_SQL} SELECT document_id, reason FROM reasons WHERE reason IS NOT NULL")
def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_fields(spark, sf_dir).filter("reason is not null").select("document_id", "reason")


@query("prepare_report", f"""WITH {MANIFEST_SQL}
SELECT 'splits' AS section, split AS name, count(*) AS count FROM reasons WHERE reason IS NULL GROUP BY split
UNION ALL SELECT 'forms', form, count(*) FROM reasons WHERE reason IS NULL GROUP BY form
UNION ALL SELECT 'rejected', reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'branches', kind || '_branches', count(*) FROM fields WHERE reason IS NULL GROUP BY kind""")
def prepare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.prepare_report(manifest_fields(spark, sf_dir))


@query("split_stats", f"""WITH {MANIFEST_SQL}, sized AS (SELECT r.document_id, r.split, r.form, count(f.field_id) AS n FROM reasons r
  JOIN fields f USING (document_id) WHERE r.reason IS NULL GROUP BY ALL)
SELECT coalesce(split, 'total') AS split, count(*) AS documents, count(*) AS pages, sum(n)::BIGINT AS fields, count(DISTINCT form) AS forms
FROM sized GROUP BY ROLLUP (split)""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.document_stats(manifest_fields(spark, sf_dir).filter("reason is null"))


@query("value_types", f"""WITH {MANIFEST_SQL} SELECT coalesce(split, 'total') AS split, value_type, count(*) AS count FROM fields WHERE reason IS NULL
GROUP BY GROUPING SETS ((split, value_type), (value_type))""")
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = manifest_fields(spark, sf_dir).filter("reason is null")
    return dataset.value_type_counts(dataset.exploded(good, "split"))


@query("request_texts", f"""WITH {MANIFEST_SQL} SELECT document_id, 'JSON:' || chr(10) || string_agg(CASE WHEN description = field_id THEN field_id
  ELSE field_id || ': ' || description END, chr(10) ORDER BY position) AS request,
  '{{' || string_agg('"' || field_id || '":' || value, ',' ORDER BY position) || '}}' AS target FROM fields WHERE reason IS NULL GROUP BY document_id""")
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manifest_fields(spark, sf_dir).filter("reason is null")
    return docs.select("document_id", V.request_text(F.col("fields")).alias("request"),
                       V.target_text(F.col("fields")).alias("target"))


@query("field_list_requests", """WITH f AS (SELECT c_custkey, unnest([
  {'id': '/customer/name', 'description': 'Name of ' || c_mktsegment, 'kind': 'scalar'},
  {'id': '/customer/vip', 'description': '(true/false) balance over ' || c_nationkey, 'kind': 'scalar'},
  {'id': '/orders', 'description': 'Orders of ' || c_custkey, 'kind': 'array'},
  {'id': '/tags', 'description': 'Tags', 'kind': 'array'}, {'id': '/note', 'description': '/note', 'kind': 'scalar'}], recursive := true) FROM customer)
SELECT c_custkey, id, description, kind FROM f""")
def field_list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(
        F.lit('Read the page.\n- "customer" (object)\n  - "name": Name of '), F.col("c_mktsegment"),
        F.lit('\n  - "vip" (true/false): balance over '), F.col("c_nationkey").cast("string"),
        F.lit('\n- "orders" (array of objects): Orders of '), F.col("c_custkey").cast("string"),
        F.lit('\n  - "key": Key\n- "tags" (mảng): Tags\n- "note"\n'))
    customers = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), TASK_ROWS)
    return customers.select("c_custkey", F.inline(V.requested_fields(prompt)))


@query("request_errors", """SELECT CASE c_custkey % 4 WHEN 0 THEN 'duplicate field ids' WHEN 1 THEN 'kind must be scalar or array'
  WHEN 2 THEN 'no fields given' END AS error, count(*) AS requests FROM customer GROUP BY 1""")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    spec = (F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('[{"id":"'), name, F.lit('"},{"id":"/'), name, F.lit('"}]')))
            .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('[{"id":"'), name, F.lit('","kind":"table"}]')))
            .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("prose about "), name))
            .otherwise(F.concat(F.lit('{"'), name, F.lit('": {"a": "x", "b": ["y"]}}'))))
    customers = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), TASK_ROWS)
    fields = computed_once(customers.select(V.requested_fields(spec).alias("fields")))
    return fields.groupBy(V.request_error(F.col("fields")).alias("error")).agg(F.count("*").alias("requests"))


@query("salvaged_objects", """WITH t AS (SELECT s_suppkey, unnest(['/name', '/nation', '/rows', '/extra']) AS field_id FROM supplier)
SELECT s_suppkey, field_id, CASE WHEN field_id = '/name' THEN 'ok' WHEN field_id = '/nation' THEN 'ok'
  WHEN field_id = '/rows' THEN CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid_array' ELSE 'missing' END
  ELSE CASE s_suppkey % 3 WHEN 2 THEN 'missing' ELSE 'wrong_type' END END AS status,
  CASE WHEN field_id = '/name' THEN s_name WHEN field_id = '/nation' THEN s_nationkey::VARCHAR
    WHEN field_id = '/rows' THEN CASE s_suppkey % 3 WHEN 0 THEN '["' || s_name || '"]' WHEN 1 THEN '"' || s_name || '"' ELSE '' END
    ELSE CASE s_suppkey % 3 WHEN 2 THEN '' ELSE 'null' END END AS text FROM t JOIN supplier USING (s_suppkey)""")
def salvaged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, nation = F.to_json(F.col("s_name").cast("variant")), F.col("s_nationkey").cast("string")
    head = F.concat(F.lit('{"/name": '), name, F.lit(', "/nation": '), nation, F.lit(', "/rows": '))
    n = F.col("s_suppkey") % 3
    text = (F.when(n == 0, F.concat(head, F.lit("["), name, F.lit('], "/extra": null}')))
            .when(n == 1, F.concat(head, name, F.lit(', "/extra": null, "cut": "of')))
            .otherwise(F.concat(head, F.lit("["), name, F.lit(", 1"))))
    suppliers = computed_once(read_table(spark, sf_dir, "supplier").select("s_suppkey", V.object_members(text).alias("m")))
    asked = F.array(*[F.struct(F.lit(i).alias("field_id"), F.lit(k).alias("kind")) for i, k in (
        ("/name", "scalar"), ("/nation", "scalar"), ("/rows", "array"), ("/extra", "scalar"))])
    rows = suppliers.select("s_suppkey", "m", F.inline(asked))
    got = rows.withColumn("v", V.member_value(F.col("m"), F.col("field_id"), F.col("kind")))
    return got.select("s_suppkey", "field_id", F.col("v.status").alias("status"), F.col("v.text").alias("text"))


# ------------------------------------------------------------------ order of a run

@query("shuffled_documents", f"""WITH {PREPARED_SQL} SELECT document_id, row_number() OVER (ORDER BY sha256('42:' || document_id), document_id) AS run_position FROM docs""")
def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.run_order(prepared_documents(spark, sf_dir)).select("document_id", "run_position")


@query("interleaved_forms", f"""WITH {PREPARED_SQL}, keyed AS (SELECT document_id, form, sha256('42:' || document_id) AS k FROM docs),
rounds AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY k, document_id) AS r, min(k) OVER (PARTITION BY form) AS f FROM keyed)
SELECT document_id, form, row_number() OVER (ORDER BY r, f) AS run_position FROM rounds""")
def interleaved_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.run_order(prepared_documents(spark, sf_dir), balanced=True).select("document_id", "form", "run_position")


@query("strided_sample", f"""WITH {PREPARED_SQL}, n AS (SELECT document_id, row_number() OVER (ORDER BY document_id) - 1 AS r,
  greatest(1, count(*) OVER () // 1000) AS stride FROM docs)
SELECT document_id FROM n WHERE r % stride = 0 AND r < stride * 1000""")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.strided(prepared_documents(spark, sf_dir).select("document_id"), 1000)


@query("document_folds", f"""WITH {PREPARED_SQL}, g AS (SELECT DISTINCT group_id FROM docs),
f AS (SELECT group_id, (row_number() OVER (ORDER BY sha256('42:' || group_id), group_id) - 1) % 4 AS fold FROM g)
SELECT fold, count(*) AS documents, count(DISTINCT group_id) AS groups FROM docs JOIN f USING (group_id) GROUP BY fold""")
def document_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared_documents(spark, sf_dir).select(F.col("group_id").alias("document_id"))
    return cohorts.folds(docs).groupBy("fold").agg(F.count("*").alias("documents"),
                                                   F.count_distinct("document_id").alias("groups"))


# ------------------------------------------------------------------ cohorts

SIZES = cohorts.CohortSizes(seed=107, train_per_form=25, per_form=6, calibration_per_form=3, risk_per_form=10,
                            train_split="train_reserve", risk_split="calibration", exclude_forms=("f5",))
EXCLUDED_SQL = """excluded AS (SELECT DISTINCT 'f' || substr(o_orderpriority, 1, 1) || '__' || o_orderkey AS document_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_discount > 0.08)"""
COHORTS_SQL = f"""{PREPARED_SQL}, {EXCLUDED_SQL},
pool AS (SELECT * FROM docs WHERE (split <> 'train' OR bucket < 15) AND form <> 'f5' AND document_id NOT IN (SELECT document_id FROM excluded)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split, form ORDER BY sha256('107:' || document_id), document_id) AS position FROM pool
  WHERE form IN (SELECT form FROM pool WHERE split = 'train')),
slices AS (SELECT * FROM (VALUES ('train', 'train', 0, 25), ('dev', 'dev', 0, 6), ('calibration', 'calibration', 0, 3),
  ('risk_validation', 'calibration', 3, 10), ('audit', 'test', 0, 6)) s(cohort, split, low, n)),
plan AS (SELECT cohort, form, position, document_id FROM ranked JOIN slices USING (split) WHERE position > low AND position <= low + n)"""


def excluded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount > 0.08").select("l_orderkey").distinct()
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.concat(
        F.lit("f"), F.substring("o_orderpriority", 1, 1), F.lit("__"), F.col("o_orderkey").cast("string")).alias("document_id"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.plan_cohorts(prepared_documents(spark, sf_dir), SIZES, excluded_orders(spark, sf_dir), 15)


@query("cohort_plan", f"WITH {COHORTS_SQL} SELECT cohort, form, position, document_id FROM plan")
def cohort_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir)


@query("cohort_sizes", f"WITH {COHORTS_SQL} SELECT cohort, form, count(*) AS documents FROM plan GROUP BY ALL")
def cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).groupBy("cohort", "form").agg(F.count("*").alias("documents"))


@query("unused_documents", f"WITH {PREPARED_SQL}, {EXCLUDED_SQL} SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM excluded)")
def unused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.fresh_pool(prepared_documents(spark, sf_dir), excluded_orders(spark, sf_dir)).select("document_id")


@query("fresh_audit", f"""WITH {COHORTS_SQL}, unused AS (SELECT * FROM docs WHERE document_id NOT IN (SELECT document_id FROM excluded UNION SELECT document_id FROM plan)),
r AS (SELECT form, document_id, row_number() OVER (PARTITION BY form ORDER BY sha256('211:' || document_id), document_id) AS rank FROM unused)
SELECT form, rank, document_id FROM r WHERE rank <= 20""")
def fresh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.fresh_audit(prepared_documents(spark, sf_dir), 20, 211, excluded_orders(spark, sf_dir),
                               planned(spark, sf_dir)).select("form", "rank", "document_id")


@query("replaced_audit", f"""WITH {COHORTS_SQL}, r AS (SELECT document_id, row_number() OVER (PARTITION BY form ORDER BY sha256('211:' || document_id), document_id) AS rank
  FROM docs WHERE document_id NOT IN (SELECT document_id FROM excluded UNION SELECT document_id FROM plan))
SELECT cohort, count(*) AS documents FROM (SELECT cohort FROM plan WHERE cohort <> 'audit' UNION ALL SELECT 'audit' FROM r WHERE rank <= 20) GROUP BY cohort""")
def replaced_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(spark, sf_dir)
    audit = cohorts.fresh_audit(prepared_documents(spark, sf_dir), 20, 211, excluded_orders(spark, sf_dir), plan)
    return cohorts.replace_audit(plan, audit).groupBy("cohort").agg(F.count("*").alias("documents"))


TAGGED_SQL = """tagged AS (SELECT DISTINCT l_orderkey AS document_id, l_returnflag || l_linestatus AS cohort FROM lineitem)"""


@query("cohort_overlaps", f"WITH {TAGGED_SQL} SELECT x.cohort AS a, y.cohort AS b, count(*) AS documents FROM tagged x JOIN tagged y USING (document_id) WHERE x.cohort < y.cohort GROUP BY ALL")
def cohort_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.concat("l_returnflag", "l_linestatus").alias("cohort"))
    return cohorts.cohort_overlaps(tagged)


@query("cohort_leaks", f"""WITH {PREPARED_SQL}, {EXCLUDED_SQL} SELECT split AS cohort, count(*) AS documents, min(document_id) AS example
FROM docs WHERE document_id IN (SELECT document_id FROM excluded) GROUP BY split""")
def cohort_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = prepared_documents(spark, sf_dir).withColumnRenamed("split", "cohort")
    return cohorts.cohort_leaks(plan, excluded_orders(spark, sf_dir))


@query("resolved_plan", """SELECT l_returnflag AS cohort, count(*) AS documents, count(*) FILTER (o_orderkey IS NOT NULL) AS found
FROM (SELECT DISTINCT l_returnflag, l_orderkey + 100 AS k FROM lineitem) LEFT JOIN orders ON k = o_orderkey GROUP BY 1""")
def resolved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cohort"),
                                                        (F.col("l_orderkey") + 100).alias("document_id")).distinct()
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    return cohorts.resolved(plan, orders).groupBy("cohort").agg(F.count("*").alias("documents"), F.count_if("found").alias("found"))


# ------------------------------------------------------------------ several datasets

QUOTA_SQL = """base AS (SELECT 'd' || substr(o_orderpriority, 1, 1) || '__' || lpad(o_orderkey::VARCHAR, 9, '0') || '__v' || (1 + o_orderkey % 3) AS document_id,
  'd' || substr(o_orderpriority, 1, 1) AS form, o_custkey, 1 + o_orderkey % 9 AS pages, o_orderstatus = 'P' AS pref FROM orders),
named AS (SELECT *, min(document_id) OVER (PARTITION BY o_custkey) AS group_id, bool_or(pref) OVER (PARTITION BY o_custkey) AS preferred FROM base),
groups AS (SELECT DISTINCT split_part(group_id, '__', 1) AS dataset, group_id, preferred FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY NOT preferred, sha256('42:' || dataset || ':' || group_id), group_id) AS r,
  count(*) OVER (PARTITION BY dataset) AS n FROM groups),
cut AS (SELECT *, least(50, floor(n * 0.5)) AS t FROM ranked),
split AS (SELECT *, CASE WHEN r <= t THEN 'test' WHEN r <= t + least(3, floor((n - t) / 10)) THEN 'dev' ELSE 'train' END AS split FROM cut)"""


def _quota_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, sf_dir, "orders")
    dataset_name = F.concat(F.lit("d"), F.substring("o_orderpriority", 1, 1))
    docs = orders.select(
        F.concat_ws("__", dataset_name, F.lpad(F.col("o_orderkey").cast("string"), 9, "0"),
                    F.concat(F.lit("v"), (1 + F.col("o_orderkey") % 3).cast("string"))).alias("document_id"),
        "o_custkey", F.sequence(F.lit(1), (1 + F.col("o_orderkey") % 9).cast("int")).alias("pages"),
        (F.col("o_orderstatus") == "P").alias("pref"))
    groups = docs.groupBy("o_custkey").agg(F.min("document_id").alias("group_id"), F.max("pref").alias("preferred"))
    return docs, groups.withColumn("dataset", F.split_part("group_id", F.lit("__"), F.lit(1)))


@query("quota_split", f"WITH {QUOTA_SQL} SELECT dataset, split, count(*) AS groups, count(*) FILTER (preferred) AS preferred FROM split GROUP BY ALL")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = _quota_documents(spark, sf_dir)
    return dataset.quota_split(groups).groupBy("dataset", "split").agg(
        F.count("*").alias("groups"), F.count_if("preferred").alias("preferred"))


@query("quota_report", f"""WITH {QUOTA_SQL}, placed AS (SELECT split.dataset, split.split, pages, document_id[-1:] AS v FROM named JOIN split USING (group_id)),
kept AS (SELECT *, CASE WHEN split <> 'train' AND v <> '1' THEN 'variant' WHEN split = 'train' AND pages > 6 THEN 'long' END AS dropped FROM placed)
SELECT dataset, count(*) FILTER (dropped IS NULL AND split = 'train') AS train_documents, count(*) FILTER (dropped IS NULL AND split = 'dev') AS dev_documents,
  count(*) FILTER (dropped IS NULL AND split = 'test') AS test_documents, count(*) FILTER (dropped = 'long') AS train_dropped_long FROM kept GROUP BY dataset""")
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, groups = _quota_documents(spark, sf_dir)
    split = dataset.quota_split(groups).select("o_custkey", "dataset", "split")
    placed = dataset.usable_in_split(docs.join(split, "o_custkey").withColumn("fields", F.array(F.lit(1))))
    return dataset.quota_report(placed).drop("train_fields", "dev_fields", "test_fields")


@query("dataset_sample", """WITH r AS (SELECT o_orderpriority AS dataset, o_orderkey AS document_id, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY sha256('42:' || o_orderpriority || ':' || o_orderkey), o_orderkey) AS r FROM orders)
SELECT dataset, document_id FROM r WHERE r <= 100""")
def dataset_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("document_id"))
    return dataset.dataset_sample(orders, 100)


@query("dataset_import", f"""WITH {LINES_SQL}, h AS (SELECT document_id, form, sha256(line) AS page_hash FROM doc_lines),
d AS (SELECT doc_id::VARCHAR AS document_id, source AS dataset, (SELECT count(*) FROM h WHERE h.document_id = doc_id::VARCHAR) AS fields,
  doc_id::VARCHAR IN (SELECT document_id FROM h WHERE form = 'en' AND page_hash IN (SELECT page_hash FROM h WHERE form <> 'en')) AS shares
  FROM documents WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, shares ORDER BY sha256('42:' || dataset || ':' || document_id), document_id) AS r FROM d)
SELECT dataset, count(*) FILTER (NOT shares AND r <= 40) AS documents, coalesce(sum(fields) FILTER (NOT shares AND r <= 40), 0)::BIGINT AS fields,
  count(*) FILTER (shares) AS dropped_overlapping_pages, count(*) FILTER (NOT shares AND r <= 40) AS in_file FROM r GROUP BY dataset""")
def dataset_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of several sources imported without those that share a line with another language."""
    documents = computed_once(read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("dataset"), "lang",
        F.transform(F.filter(F.split("text", "\n"), lambda x: V.strip(x) != ""), lambda x: F.sha2(x, 256)).alias("image_sha256")))
    used = documents.filter("lang <> 'en'").select(F.explode("image_sha256").alias("page_hash"))
    path = scratch_path(spark, "documents")
    own = documents.filter("lang = 'en'").drop("lang").withColumn("fields", F.col("image_sha256"))
    report = import_datasets(own.withColumn("fields", F.coalesce("fields", F.array())), used, path, 40)
    stored = read_jsonl(spark, path, "dataset string").groupBy("dataset").agg(F.count("*").alias("in_file"))
    return report.join(stored, "dataset", "left").na.fill(0, ["in_file"])


_NAMED = "{id} || '__v' || ({id}::BIGINT % 2 + 1)"
_NAMED_GROUPS = GROUPS_SQL.format(pages=LINES_SQL + f""",
pages_of AS (SELECT DISTINCT {_NAMED.format(id='document_id')} AS document_id, sha256(line) AS page_hash FROM doc_lines)""").replace(
    "SELECT doc_id::VARCHAR AS document_id FROM documents", f"SELECT {_NAMED.format(id='doc_id')} AS document_id FROM documents")


@query("split_datasets", _NAMED_GROUPS + f""",
d AS (SELECT {_NAMED.format(id='doc_id')} AS document_id, lang AS dataset, doc_id % 10 = 0 AS wanted, (SELECT count(*) FROM doc_lines l WHERE l.document_id = doc_id::VARCHAR) AS pages FROM documents),
names AS (SELECT group_id, bool_or(wanted) AS preferred FROM grouped JOIN d USING (document_id) GROUP BY group_id),
owned AS (SELECT names.*, dataset FROM names JOIN d ON d.document_id = group_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY NOT preferred, sha256('42:' || dataset || ':' || group_id), group_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM owned),
cut AS (SELECT *, least(50, floor(n * 0.5))::BIGINT AS t FROM ranked),
split AS (SELECT *, CASE WHEN r <= t THEN 'test' WHEN r <= t + least(3, (n - t) // 10) THEN 'dev' ELSE 'train' END AS split FROM cut),
placed AS (SELECT d.document_id, split.dataset, split, pages, CASE WHEN split <> 'train' AND document_id[-1:] <> '1' THEN 'variant' WHEN split = 'train' AND pages > 12 THEN 'long' END AS dropped
  FROM d JOIN grouped USING (document_id) JOIN split USING (group_id)),
counts AS (SELECT dataset, {', '.join(f"count(*) FILTER (dropped IS NULL AND split = '{s}') AS {s}_documents, coalesce(sum(pages) FILTER (dropped IS NULL AND split = '{s}'), 0)::BIGINT AS {s}_fields" for s in ('train', 'dev', 'test'))},
  count(*) FILTER (dropped = 'long') AS train_dropped_long FROM placed GROUP BY dataset)
SELECT dataset, count(*) AS groups, count(*) FILTER (split = 'test' AND preferred) AS test_preferred, any_value(COLUMNS(counts.* EXCLUDE (dataset))), 0::BIGINT AS train_test_shared_pages
FROM split JOIN counts USING (dataset) GROUP BY dataset""")
def split_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four languages as datasets, their lines as pages and fields."""
    table = read_table(spark, sf_dir, "documents")
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: V.strip(x) != ""), lambda x: F.sha2(x, 256))
    documents = computed_once(table.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("__v"), (F.col("doc_id") % 2 + 1).cast("string")).alias("document_id"),
        F.col("lang").alias("dataset"), F.coalesce(lines, F.array().cast("array<string>")).alias("image_sha256"), "doc_id"))
    documents = documents.withColumn("pages", F.col("image_sha256")).withColumn("fields", F.col("image_sha256"))
    preferred = documents.filter("doc_id % 10 = 0").select("document_id")
    return split_dataset_files(documents.drop("doc_id"), preferred, scratch_path(spark, "splits"), max_train_pages=12)


@query("documents_per_form", f"WITH {PREPARED_SQL} SELECT form, count(*) AS documents FROM docs GROUP BY form")
def documents_per_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_documents(spark, sf_dir).groupBy("form").agg(F.count("*").alias("documents"))


# ------------------------------------------------------------------ chat labels

@query("chat_turns", """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS prompt, arg_max(text, turn) FILTER (role = 'assistant') AS answer
FROM conversations GROUP BY conv_id""")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.chat_turns(read_table(spark, sf_dir, "conversations"))


@query("chat_fields", """WITH t AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS a, count(*) AS n FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, unnest([{'field_id': '/reply', 'description': 'Last reply', 'value': a}, {'field_id': '/meta/turns', 'description': '(true/false) many', 'value': n::VARCHAR},
  {'field_id': '/meta/none', 'description': '/meta/none', 'value': ''}], recursive := true) FROM t WHERE a IS NOT NULL)
SELECT conv_id, field_id, description, value FROM f""")
def chat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    labels = dataset.chat_turns(turns).join(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    answer = F.when(F.col("answer").isNotNull(), F.to_json(F.struct(
        F.col("answer").alias("reply"), F.struct(F.col("n").alias("turns"), F.lit("x").alias("none")).alias("meta"))))
    answer = F.replace(answer, F.lit('"none":"x"'), F.lit('"none":null'))
    prompt = F.concat(F.col("prompt"), F.lit('\n- "reply": Last reply\n- "meta" (object)\n  - "turns" (true/false): many\n'))
    fields = dataset.chat_fields(computed_once(labels.select("conv_id", F.coalesce(prompt, F.lit('- "reply": Last reply\n- "meta" (object)\n  - "turns" (true/false): many')).alias("prompt"), answer.alias("answer"))))
    return fields.filter("reason is null").select("conv_id", F.inline("fields")).select(
        "conv_id", F.col("id").alias("field_id"), "description", V.json_string(F.col("value")).alias("value"))
