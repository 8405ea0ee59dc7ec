"""Queries that run the streaming jobs over the event log, and round trips through sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path, staged, task_count
from ..sources import datasets, records
from ..streaming import jobs
from . import query
from .review import rounded
from .views import REQUESTS_SQL, as_requests


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def naive(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# A stream that ends leaves its last windows open; the SQL keeps those that end at or before the last watermark.

@query("stream_scorecard", f"""WITH {REQUESTS_SQL}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, * FROM requests)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, model, count(*) AS requests, count(*) FILTER (error_type IS NOT NULL) AS failed,
  round(sum(infer), 6) AS infer_seconds, round(max(infer), 9) AS max_infer_s, round(sum(generated_tokens) / sum(decode), 6) AS tokens_per_s FROM w
WHERE start + INTERVAL 1 HOUR <= (SELECT max(time) - INTERVAL 10 MINUTE FROM requests) GROUP BY ALL""")
def stream_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = jobs.run_available(jobs.scorecard(as_requests(event_stream(spark, sf_dir))), "scorecard")
    return card.select(naive("window_start"), "model", "requests", "failed", F.round("infer_seconds", 6).alias("infer_seconds"),
                       F.round("max_infer_s", 9).alias("max_infer_s"), F.round("tokens_per_s", 6).alias("tokens_per_s"))


@query("stream_sliding_scorecard", f"""WITH {REQUESTS_SQL}, w AS (SELECT time_bucket(INTERVAL 30 MINUTE, time) - s * INTERVAL 30 MINUTE AS start, r.* FROM requests r, range(2) t(s))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, model, count(*) AS requests FROM w
WHERE start + INTERVAL 1 HOUR <= (SELECT max(time) - INTERVAL 10 MINUTE FROM requests) GROUP BY ALL""")
def stream_sliding_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = jobs.scorecard(as_requests(event_stream(spark, sf_dir)), "1 hour", "30 minutes")
    return jobs.run_available(card, "sliding").select(naive("window_start"), "model", "requests")


@query("stream_ingest_once", f"""WITH {REQUESTS_SQL} SELECT count(*) AS rows, count(*) AS keys FROM (SELECT DISTINCT user_id, id FROM requests)""")
def stream_ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_requests(event_stream(spark, sf_dir)).select(
        F.col("user_id").alias("document_id"), F.col("id").alias("field_id"), "time", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    once = jobs.run_available(jobs.ingested_once(rows), "ingested")
    return once.agg(F.count("*").alias("rows"), F.count_distinct("document_id", "field_id").alias("keys"))


def chunked_events(spark: SparkSession, sf_dir: str, chunks: int = 4) -> DataFrame:
    """The event table as a stream of ``chunks`` parts in the order of time, one part a batch.

    A file source takes older files first, so the parts are written one after
    the other, each by several tasks.
    """
    events = read_table(spark, sf_dir, "events")
    path = scratch_path(spark, "events")
    at = F.col("ts").cast("timestamp").cast("double")
    low, high = events.select(F.min(at), F.max(at)).first()
    part = F.least(F.lit(chunks - 1), F.floor((at - low) / F.lit((high - low) / chunks + 1e-6)))
    tasks = max(2, task_count(spark) // chunks)
    for chunk in range(chunks):
        events.filter(part == chunk).repartition(tasks).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", tasks).parquet(path)


@query("stream_completion", f"""WITH {REQUESTS_SQL}, asked AS (SELECT c_custkey AS document_id, 1 + c_custkey % 3 AS expected_fields, (SELECT min(time) FROM requests) + INTERVAL 10 DAY AS deadline FROM customer),
known AS (SELECT document_id, expected_fields, count(id) FILTER (time <= deadline) AS n FROM asked LEFT JOIN requests ON user_id = document_id GROUP BY ALL),
strangers AS (SELECT user_id, min(time) + INTERVAL 10 DAY AS deadline FROM requests WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
  HAVING min(time) + INTERVAL 10 DAY < (SELECT max(time) - INTERVAL 1 HOUR FROM requests))
SELECT document_id::VARCHAR AS document_id, CASE WHEN n >= expected_fields THEN 'complete' ELSE 'incomplete' END AS state, least(n, expected_fields) AS arrived_fields, expected_fields FROM known
UNION ALL SELECT s.user_id::VARCHAR, 'unexpected', count(*) FILTER (time <= deadline), NULL FROM strangers s JOIN requests r ON r.user_id = s.user_id GROUP BY s.user_id""")
def stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_requests(chunked_events(spark, sf_dir))
    # Every row is delivered twice; a field still counts once.
    rows = events.select(F.col("user_id").alias("document_id"), F.col("id").alias("field_id"), "time", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    start = read_table(spark, sf_dir, "events").agg(F.min("ts")).first()[0]
    customers = spark.readStream.schema(read_table(spark, sf_dir, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    requests = customers.select(F.col("c_custkey").alias("document_id"), (1 + F.col("c_custkey") % 3).alias("expected_fields"),
                                F.lit(start).cast("timestamp").alias("time"))
    return jobs.run_available(jobs.completion(rows.drop("delivery"), requests, wait="10 days"), "completion")


@query("stream_log_follow", f"""WITH {REQUESTS_SQL}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '1970-01-01') AS start, model AS split, coalesce(infer, 0) AS value FROM requests)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, split, count(*) AS records, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM w
WHERE start + INTERVAL 6 HOUR <= (SELECT max(time) - INTERVAL 1 HOUR FROM requests) GROUP BY ALL""")
def stream_log_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = as_requests(event_stream(spark, sf_dir)).select("time", F.col("model").alias("split"), F.coalesce("infer", F.lit(0.0)).alias("value"))
    follow = jobs.run_available(jobs.log_follow(log, "6 hours"), "follow")
    return follow.select(naive("window_start"), "split", "records", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("stream_sessions", f"""WITH {REQUESTS_SQL}, g AS (SELECT *, CASE WHEN time - lag(time) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY time)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS sid FROM g),
z AS (SELECT user_id, sid, min(time) AS start, max(time) + INTERVAL 30 MINUTE AS stop, count(*) AS requests, sum(generated_tokens)::BIGINT AS tokens FROM s GROUP BY user_id, sid)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS session_start, requests, tokens FROM z WHERE stop <= (SELECT max(time) - INTERVAL 1 HOUR FROM requests)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.run_available(jobs.sessions(as_requests(event_stream(spark, sf_dir))), "sessions")
    return found.select("user_id", naive("session_start"), "requests", "tokens")


@query("stream_queue", f"""WITH {REQUESTS_SQL}, q AS (SELECT id, model, CASE WHEN model IN ('click', 'view') THEN CASE WHEN infer IS NULL THEN 'incomplete_or_invalid'
  WHEN (k % 100) / 100.0::DOUBLE < 0.4 THEN 'low_correctness_confidence' END ELSE 'field_outside_evaluated_schema' END AS reason, k FROM requests)
SELECT id, reason, round(CASE WHEN reason = 'low_correctness_confidence' THEN 1 - (k % 100) / 100.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS priority FROM q WHERE reason IS NOT NULL""")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = as_requests(event_stream(spark, sf_dir))
    rows = requests.select("id", F.col("model").alias("field_id"), F.when(F.col("infer").isNull(), "truncated").otherwise("ok").alias("status"),
                           F.lit(False).alias("shape_violation"),
                           F.when(F.col("infer").isNotNull(), ((F.col("generated_tokens") / 3).cast("bigint") % 100) / F.lit(100.0)).alias("score"))
    known = read_table(spark, sf_dir, "events").filter("event_type in ('click', 'view')").select(F.col("event_type").alias("field_id")).distinct()
    return rounded(jobs.run_available(jobs.live_queue(rows, 0.4, known), "queue").select("id", "reason", "priority"))


# ------------------------------------------------------------------ sources and sinks

@query("jsonl_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    records.write_jsonl(customers, path)
    suppliers = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    records.append_jsonl(suppliers, path)
    return records.read_jsonl(spark, path, customers.schema)


@query("split_partitions", """SELECT l_returnflag AS split, count(*) AS documents, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1""")
def split_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    lines = read_table(spark, sf_dir, "lineitem").withColumn("split", F.col("l_returnflag"))
    records.write_by(lines, path, "split")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("documents"), F.sum("l_linenumber").alias("lines"))


@query("exclusion_sources", """SELECT 'rows' AS source, count(DISTINCT o_custkey) AS documents FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'plan', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('P', 'F')""")
def exclusion_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias("document_id"))
    rows, plan = scratch_path(spark, "used-rows"), scratch_path(spark, "used-plan")
    records.write_jsonl(orders.filter("o_orderstatus = 'P'").select(F.col("document_id").alias("id")), rows)
    records.claim_new(orders.filter("o_orderstatus = 'F'").select("document_id"), plan)
    used = datasets.exclusions(spark, {rows: "rows", plan: "plan"})
    named = used.withColumn("source", F.when(F.col("source") == rows, "rows").otherwise("plan"))
    return named.rollup("source").agg(F.count_distinct("document_id").alias("documents")).select(
        F.coalesce("source", F.lit("all")).alias("source"), "documents")


@query("trace_tables", """SELECT l_returnflag AS split, count(*) AS rows, count(*) FILTER (l_linenumber > 1) AS records FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1""")
def trace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "traces")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), key.alias("trace_index"), "l_linenumber", "l_quantity")
    metadata = lines.groupBy(F.col("split").alias("cohort")).agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit("rows"))
    datasets.write_traces(lines.drop("l_quantity"), lines.filter("l_linenumber > 1").select("split", "trace_index", "l_quantity"), metadata, path)
    return datasets.read_traces(spark, path, "N").groupBy("split").agg(F.count("*").alias("rows"), F.count("l_quantity").alias("records"))


@query("validated_traces", """SELECT l_returnflag AS split, count(*) AS rows, count(*) FILTER (l_linenumber > 1) AS traced FROM lineitem GROUP BY 1""")
def validated_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace cache over the order lines, numbered per cohort, read back through its checks."""
    from ..operators.scale import numbered

    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    traced = numbered(lines.filter("l_linenumber > 1"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "place", ["split"])
    rows = traced.withColumn("trace_index", F.col("place") - 1).drop("place").unionByName(
        lines.filter("l_linenumber = 1").withColumn("trace_index", F.lit(-1).cast("bigint"))).withColumn("row_split", F.col("split"))
    # The rows, their records and the metadata read the numbers; they are given once.
    rows = staged(rows, "numbered")
    path = scratch_path(spark, "traces")
    metadata = rows.groupBy(F.col("split").alias("cohort")).agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit("rows"))
    datasets.write_traces(rows, rows.filter("trace_index >= 0").select("split", "trace_index"), metadata, path)
    found = [datasets.validated_traces(spark, path, s) for s in ("A", "N", "R")]
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.groupBy("split").agg(F.count("*").alias("rows"), F.count(F.when(F.col("trace_index") >= 0, 1)).alias("traced"))
