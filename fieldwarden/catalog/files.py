"""Queries that write driver tables in a source's layout and read them back from the files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset
from ..plans import workflows
from ..session import read_table, scratch_path
from ..sources import datasets, records
from . import SQL, query
from .review import rounded
from .views import text_rows


@query("evaluated_file", SQL["exact_match"])
def evaluated_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    workflows.write_predictions(text_rows(spark, sf_dir), path)
    return rounded(workflows.evaluate(workflows.read_predictions(spark, path)))


@query("json_files", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = scratch_path(spark, "json")
    records.write_json(suppliers, path, ["s_nationkey"])
    return records.read_json(spark, path, suppliers.schema)


@query("torn_log", """WITH t AS (SELECT *, min(CASE WHEN s_suppkey % 7 = 3 THEN s_suppkey END) OVER (PARTITION BY s_nationkey) AS torn FROM supplier)
SELECT s_suppkey AS step, s_name AS name FROM t WHERE (torn IS NULL OR s_suppkey < torn) AND s_suppkey <= 400""")
def torn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier")
    line = F.to_json(F.struct(F.col("s_suppkey").alias("step"), F.col("s_name").alias("name")))
    lines = supplier.select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 7 == 3, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    path = scratch_path(spark, "log")
    # One file per nation, its lines in the order of their steps.
    (lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").drop("s_suppkey")
     .write.partitionBy("s_nationkey").text(path))
    return records.read_log(spark, path, "step bigint, name string", keep_through=400)


@query("old_trace_layout", "SELECT l_orderkey AS document, l_linenumber AS trace_index, l_comment AS value, l_shipmode AS stats FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_comment, l_linestatus AS l_shipmode FROM lineitem)")
def old_trace_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "old")
    lines.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("feature_index"), F.col("l_returnflag").alias("end"),
                 F.col("l_linestatus").alias("token_stats")).write.parquet(path)
    return datasets.from_old_layout(spark.read.parquet(path))


@query("plan_written_once", "SELECT c_mktsegment AS cohort, c_custkey AS document, true AS refused FROM customer")
def plan_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cohort"), F.col("c_custkey").alias("document"))
    path, refused = scratch_path(spark, "plan"), False
    records.claim_new(plan, path)
    try:
        records.claim_new(plan.limit(0), path)
    except AnalysisException as error:
        refused = error.getCondition() == "PATH_ALREADY_EXISTS"
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("feature_counts", r"""WITH t AS (SELECT lang AS split, text, text = '0123' AS z FROM documents),
f AS (SELECT split, 'multiline' AS feature FROM t WHERE contains(text, chr(10))
  UNION ALL SELECT split, 'angle_brackets' FROM t WHERE contains(text, '<') OR contains(text, '>')
  UNION ALL SELECT split, 'special_token_like' FROM t WHERE regexp_matches(text, '<\|[^|<>]*\|>')
  UNION ALL SELECT split, 'surrounding_whitespace' FROM t WHERE regexp_matches(text, '^[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$')
  UNION ALL SELECT split, 'leading_zero_digits' FROM t WHERE regexp_full_match(text, '0[0-9]+'))
SELECT split, feature, count(*) AS count FROM f GROUP BY ALL""")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return dataset.feature_counts(documents.select(F.col("lang").alias("split"), T.to_json_string(F.col("text")).alias("value")))
