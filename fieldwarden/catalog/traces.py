"""Queries on token statistics, feature summaries, packed layouts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.hashing import order_key
from ..operators import extraction, features, fields, logs
from ..operators.scale import numbered
from ..session import computed_once, read_table
from . import query
from .review import ROWS, r, rounded
from .views import (BRANCHES_SQL, REQUESTS_SQL, TRACES_SQL, document_lines, order_branches, request_log,
                    review_rows, trace_records)

STAT_COLUMNS = dict(zip(K.TOKEN_STATS, ("logp", "ent", "pm", "lm", "cl"), strict=True))
MASKED = """masked AS (SELECT *, content OR NOT bool_or(content) OVER (PARTITION BY document_id, position) AS keep FROM tokens)"""
NUMERIC = "[\\p{Nd}\\s.,/:%+\\-()]*\\p{Nd}[\\p{Nd}\\s.,/:%+\\-()]*"


@query("value_summaries", f"""WITH {TRACES_SQL}, {MASKED}, s AS (SELECT document_id, position, any_value(h) AS h, any_value(line) AS line,
  {', '.join(f'avg({c}) AS mean_{s}, stddev_pop({c}) AS std_{s}' for s, c in STAT_COLUMNS.items())},
  min(logp) AS min_log_probability, quantile_cont(logp, 0.1) AS q10_log_probability, max(ent) AS max_normalized_entropy,
  min(pm) AS min_probability_margin, max(cl) AS max_close_log_probability, ln(1 + count(*)) AS log1p_tokens, avg(keep::INT) AS content_share
  FROM masked GROUP BY document_id, position)
SELECT document_id, '/line/' || position AS field_id, {', '.join(f'round(mean_{s}, 7) AS mean_{s}, round(std_{s}, 7) AS std_{s}' for s in K.TOKEN_STATS)},
  {', '.join(f'round({c}, 7) AS {c}' for c in ('min_log_probability', 'q10_log_probability', 'max_normalized_entropy', 'min_probability_margin', 'max_close_log_probability', 'log1p_tokens', 'content_share'))},
  round(-((91 + h) % 1000) / 97.0::DOUBLE, 7) AS close_log_probability, round(((7 * 31 + h) % 997) / 997.0::DOUBLE, 7) AS close_normalized_entropy,
  round(((7 * 17 + h) % 991) / 991.0::DOUBLE, 7) AS close_probability_margin, round(((77 + h) % 500) / 53.0::DOUBLE, 7) AS close_logit_margin,
  round(-((203 + h) % 800) / 53.0::DOUBLE, 7) AS close_close_log_probability,
  round((length(line) - length(regexp_replace(line, '\\p{{Nd}}', '', 'g')))::DOUBLE / length(line), 7) AS digit_share, 0.0::DOUBLE AS kind_empty,
  (h % 10 <> 0 AND regexp_full_match(line, '{NUMERIC}'))::INT::DOUBLE AS kind_numeric, (h % 10 <> 0 AND NOT regexp_full_match(line, '{NUMERIC}'))::INT::DOUBLE AS kind_text,
  (h % 10 = 0)::INT::DOUBLE AS kind_array FROM s""")
def value_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.summaries(trace_records(spark, sf_dir), "document_id", "field_id"), 7)


@query("heuristic_heads", f"""WITH {TRACES_SQL}, s AS (SELECT document_id, position, count(*) AS n, min(logp) AS lo, avg(logp) AS m, -((91 + any_value(h)) % 1000) / 97.0::DOUBLE AS c
  FROM tokens GROUP BY document_id, position)
SELECT document_id, '/line/' || position AS field_id, round(least(lo, c), 7) AS min_log_probability_score, round((m * n + c) / (n + 1), 7) AS mean_log_probability_score FROM s""")
def heuristic_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = features.summaries(trace_records(spark, sf_dir), "document_id", "field_id")
    return rounded(features.heuristic_heads(summary, "document_id", "field_id"), 7)


@query("uncertain_tokens", f"""WITH {TRACES_SQL}, {MASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, position ORDER BY NOT keep, logp, i) AS rank FROM masked)
SELECT document_id, '/line/' || position AS field_id, string_agg(piece, ' ' ORDER BY i) AS kept FROM r WHERE rank <= 8 GROUP BY document_id, position""")
def uncertain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = computed_once(trace_records(spark, sf_dir).withColumn("mask", K.content_mask(F.col("pieces"), F.col("kind"))))
    tokens = F.transform("pieces", lambda p, i: F.struct(
        p.alias("piece"), F.get("mask", i).alias("content"), F.get("stats", i)["log_probability"].alias("log_probability")))
    kept = K.uncertain_tokens(tokens, 8)
    return records.select("document_id", "field_id", F.array_join(F.transform(kept, lambda t: t["piece"]), " ").alias("kept"))


@query("content_tokens", f"""WITH {TRACES_SQL}, {MASKED} SELECT h % 10 = 0 AS is_array, count(*) AS tokens, count(*) FILTER (keep) AS content FROM masked GROUP BY 1""")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = K.content_mask(F.col("pieces"), F.col("kind"))
    sized = trace_records(spark, sf_dir).select((F.col("kind") == "array").alias("is_array"), F.size(mask).alias("t"),
                                                F.size(F.filter(mask, lambda m: m)).alias("c"))
    return sized.groupBy("is_array").agg(F.sum("t").alias("tokens"), F.sum("c").alias("content"))


@query("decode_statistics", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE * 20 AS v, unnest(range(64)) AS i FROM embeddings),
z AS (SELECT vec_id, any_value(label) AS label, max(v) AS top, max(v) + ln(sum(exp(v - m))) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM x) GROUP BY vec_id),
k AS (SELECT vec_id, max(v, 2)[2] AS second FROM x GROUP BY vec_id)
SELECT vec_id, round(max(v - lse) FILTER (i = z.label), 7) AS log_probability, round(-sum(exp(v - lse) * (v - lse)) / ln(64), 7) AS normalized_entropy,
  round(any_value(exp(top - lse) - exp(second - lse)), 7) AS probability_margin, round(any_value(top - second), 7) AS logit_margin,
  round(max(v - lse) FILTER (i = 63), 7) AS close_log_probability FROM x JOIN z USING (vec_id) JOIN k USING (vec_id) GROUP BY vec_id""")
def decode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 20).alias("logits"))
    stats = K.decode_statistics(F.col("logits"), F.col("label"), close=63, allowed=64)
    return rounded(logits.select("vec_id", stats.alias("stats")).select("vec_id", "stats.*"), 7)


@query("normalizers", """WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings)
SELECT dim, round(avg(v), 9) AS mean, round(greatest(0.1, stddev_samp(v)), 9) AS std FROM x GROUP BY dim""")
def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.normalizers(read_table(spark, sf_dir, "embeddings"), "embedding"))


@query("vector_drift", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, round(unnest(embedding)::DOUBLE, 2) AS b FROM embeddings),
p AS (SELECT vec_id, max(abs(a - b)) AS d, sqrt(sum((a - b) * (a - b))) / sqrt(sum(b * b)) AS rel FROM x GROUP BY vec_id)
SELECT count(*) AS rows, round(max(d), 9) AS max_absolute, round(max(rel), 9) AS max_relative, max(d) <= 0.001 AS within_absolute, max(rel) <= 0.05 AS within_relative FROM p""")
def vector_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = a.select("vec_id", F.transform("v", lambda x: F.round(x, 2)).alias("v"))
    return rounded(features.vector_drift(a, b, ["vec_id"], "v"))


@query("pair_counts", f"""WITH {ROWS} SELECT form, field_id, count(*) FILTER (correct) AS right_rows, count(*) FILTER (NOT correct) AS wrong_rows,
  count(*) FILTER (correct) * count(*) FILTER (NOT correct) AS pairs FROM rows WHERE status = 'ok' GROUP BY ALL""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_counts(review_rows(spark, sf_dir).filter("status = 'ok'"))


@query("ranking_pairs", f"""WITH {ROWS}, k AS (SELECT form, field_id, document_id, correct, row_number() OVER (PARTITION BY form, field_id, correct
  ORDER BY sha256('42:' || document_id || ':' || field_id), document_id) AS rank FROM rows WHERE status = 'ok')
SELECT a.form, a.field_id, a.rank, a.document_id AS right_document, b.document_id AS wrong_document FROM k a JOIN k b
  ON a.form = b.form AND a.field_id = b.field_id AND a.rank = b.rank AND a.correct AND NOT b.correct WHERE a.rank <= 32""")
def ranking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ranking_pairs(review_rows(spark, sf_dir).filter("status = 'ok'"))


@query("frequent_fields", """WITH f AS (SELECT l_partkey::VARCHAR AS field_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 31),
k AS (SELECT field_id, row_number() OVER (ORDER BY field_id) AS prior_index FROM f)
SELECT coalesce(prior_index, 0) AS prior_index, count(*) AS rows FROM lineitem LEFT JOIN k ON field_id = l_partkey::VARCHAR GROUP BY 1""")
def frequent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("field_id"))
    keyed = features.with_prior_index(rows, features.frequent_fields(rows, 31))
    return keyed.groupBy("prior_index").agg(F.count("*").alias("rows"))


@query("class_balance", f"""WITH {ROWS} SELECT count(*) FILTER (correct) AS right_rows, count(*) FILTER (NOT correct) AS wrong_rows,
  bool_or(correct) AND bool_or(NOT correct) AS both_labels FROM rows""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.class_balance(review_rows(spark, sf_dir))


@query("cohort_summary", f"""WITH {ROWS} SELECT form AS cohort, count(*) AS fields, count(*) FILTER (status = 'ok') AS valid, count(*) FILTER (correct) AS correct FROM rows GROUP BY form""")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.cohort_summary(review_rows(spark, sf_dir).withColumnRenamed("form", "cohort"))


@query("cohort_settings", """WITH m AS (SELECT DISTINCT c_mktsegment AS cohort, 'nations' AS key, 'yes' AS value FROM customer WHERE c_nationkey >= 0
  UNION ALL SELECT c_mktsegment, 'customers', count(*)::VARCHAR FROM customer GROUP BY 1)
SELECT key, count(DISTINCT value) AS "values", min(value) AS value FROM (SELECT * FROM m UNION ALL SELECT DISTINCT c_mktsegment, 'merge', 'false' FROM customer) GROUP BY key""")
def cohort_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "cohort")
    settings = customers.filter("c_nationkey >= 0").select("cohort", F.lit("nations").alias("key"), F.lit("yes").alias("value")).distinct()
    sizes = customers.groupBy("cohort").agg(F.count("*").cast("string").alias("value")).select("cohort", F.lit("customers").alias("key"), "value")
    return features.single_valued(settings.unionByName(sizes), ["nations", "customers", "merge"])


@query("trace_indices", f"""WITH {ROWS}, v AS (SELECT *, sum((status = 'ok')::INT) OVER (ORDER BY document_id, position) AS upto FROM rows),
t AS (SELECT form, CASE WHEN status = 'ok' THEN upto - 1 ELSE -1 END AS ti FROM v)
SELECT form, count(*) AS rows, min(ti)::BIGINT AS first, max(ti)::BIGINT AS last, sum(ti)::BIGINT AS total FROM t GROUP BY form""")
def trace_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir).select("document_id", "position", "form", "status")
    return features.trace_indices(rows, ["document_id", "position"]).groupBy("form").agg(
        F.count("*").alias("rows"), F.min("trace_index").alias("first"), F.max("trace_index").alias("last"),
        F.sum("trace_index").alias("total"))


PARTS = """parts AS (SELECT l_orderkey % 64 AS part, l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN row_number() OVER (
  PARTITION BY l_orderkey % 64, l_returnflag <> 'R' ORDER BY l_orderkey, l_partkey, l_suppkey) - 1 ELSE -1 END AS trace_index FROM lineitem)"""


@query("merged_parts", f"""WITH {PARTS}, n AS (SELECT part, count(*) FILTER (trace_index >= 0) AS n FROM parts GROUP BY part),
s AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS shift FROM n), m AS (SELECT CASE WHEN trace_index >= 0 THEN trace_index + shift ELSE -1 END AS ti FROM parts JOIN s USING (part))
SELECT count(*) AS rows, count(DISTINCT ti) AS "distinct", max(ti)::BIGINT AS last, sum(ti)::BIGINT AS total FROM m""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 64).alias("part"),
                                                         F.when(F.col("l_returnflag") != "R", "ok").otherwise("cut").alias("status"))
    valid = numbered(lines.filter("status = 'ok'"), ["l_orderkey", "l_partkey", "l_suppkey"], "n", ["part"]).select(
        "part", (F.col("n") - 1).alias("trace_index"))
    others = lines.filter("status <> 'ok'").select("part", F.lit(-1).cast("bigint").alias("trace_index"))
    return features.merged_parts(valid.unionByName(others)).agg(
        F.count("*").alias("rows"), F.count_distinct("trace_index").alias("distinct"), F.max("trace_index").alias("last"),
        F.sum("trace_index").alias("total"))


@query("trace_cache_check", """SELECT count(*) FILTER (l_linestatus <> 'O') AS foreign_rows, count(l_linenumber) - count(DISTINCT l_linenumber) AS repeated,
  max(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS gaps FROM lineitem""")
def trace_cache_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("trace_index"))
    return features.trace_index_problems(lines, "O")


# ------------------------------------------------------------------ layout

@query("packed_layout", f"""WITH {BRANCHES_SQL}, s AS (SELECT *, prefix + coalesce(sum(prompt + target) OVER (PARTITION BY document_id ORDER BY position
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM branches)
SELECT document_id, id, start::BIGINT AS start, (start + prompt - 2)::BIGINT AS key, (start + prompt - 1)::BIGINT AS decide, (start + prompt + target - 1)::BIGINT AS value FROM s""")
def packed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_branches(spark, sf_dir).select("document_id", F.inline(K.packed_layout(F.col("prefix"), F.col("branches"))))


@query("over_budget_fields", f"""WITH {BRANCHES_SQL} SELECT document_id, count(*) FILTER (target <= 10) AS kept, count(*) FILTER (target <= 10) = 0 AS rejected FROM branches GROUP BY document_id""")
def over_budget_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.size(fields.within_budget(F.col("branches"), "target", 10))
    return order_branches(spark, sf_dir).select("document_id", kept.cast("bigint").alias("kept"), (kept == 0).alias("rejected"))


@query("token_budget", f"""WITH RECURSIVE {BRANCHES_SQL}, walk AS (SELECT document_id, prefix AS used, -1 AS position, [] ::VARCHAR[] AS ids FROM branches WHERE position = 0
  UNION ALL SELECT w.document_id, CASE WHEN w.used + b.prompt + b.target <= 120 THEN w.used + b.prompt + b.target ELSE w.used END, b.position,
    CASE WHEN w.used + b.prompt + b.target <= 120 THEN list_append(w.ids, b.id) ELSE w.ids END
  FROM walk w JOIN branches b ON b.document_id = w.document_id AND b.position = w.position + 1),
short AS (SELECT document_id, arg_min(id, (prompt + target) * 100 + position) AS id FROM branches GROUP BY document_id)
SELECT walk.document_id, array_to_string(CASE WHEN len(ids) > 0 THEN ids ELSE [short.id] END, ',') AS kept FROM walk JOIN short USING (document_id) WHERE position = 5""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = K.within_budget(F.col("branches"), F.col("prefix"), 120)
    return order_branches(spark, sf_dir).select("document_id", F.array_join(kept, ",").alias("kept"))


@query("drop_longest_values", f"""WITH {BRANCHES_SQL}, s AS (SELECT *, sum(target + 2) OVER (PARTITION BY document_id ORDER BY target, position DESC) AS cum FROM branches)
SELECT document_id, coalesce(string_agg(id, ',' ORDER BY position) FILTER (cum <= 40), '') AS kept FROM s GROUP BY document_id""")
def drop_longest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = F.transform("branches", lambda b: F.struct(b["id"].alias("id"), b["target"].alias("length")))
    return order_branches(spark, sf_dir).select("document_id", F.array_join(K.drop_longest(sized, 40, 2), ",").alias("kept"))


@query("field_groups", f"""WITH {BRANCHES_SQL} SELECT document_id, (position // 4)::BIGINT AS "group", string_agg(id, ',' ORDER BY position) AS ids FROM branches GROUP BY ALL""")
def field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.transform(fields.grouped(F.col("branches"), 4), lambda g: F.struct(
        g["group"].alias("group"), F.array_join(F.transform(g["fields"], lambda b: b["id"]), ",").alias("ids")))
    return order_branches(spark, sf_dir).select("document_id", F.inline(groups))


@query("sampled_fields", f"""WITH {BRANCHES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sha256('3:' || document_id || id)) AS r FROM branches)
SELECT document_id, string_agg(id, ',' ORDER BY r) AS ids FROM r WHERE r <= 2 GROUP BY document_id""")
def sampled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = fields.sampled(F.col("branches"), F.col("document_id"), 2, seed=3)
    return order_branches(spark, sf_dir).select("document_id", F.array_join(F.transform(drawn, lambda b: b["id"]), ",").alias("ids"))


@query("loss_weights", f"""WITH {BRANCHES_SQL} SELECT document_id, id, round(1.0::DOUBLE / sum(target) OVER (PARTITION BY document_id), 9) AS by_token,
  round(1.0::DOUBLE / (target * count(*) OVER (PARTITION BY document_id)), 9) AS by_field FROM branches""")
def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform("branches", lambda b: b["target"])
    rows = F.arrays_zip(F.transform("branches", lambda b: b["id"]).alias("id"), K.loss_weights(sizes, False).alias("by_token"),
                        K.loss_weights(sizes, True).alias("by_field"))
    return rounded(order_branches(spark, sf_dir).select("document_id", F.inline(rows)).toDF("document_id", "id", "by_token", "by_field"))


@query("token_lengths", f"""WITH {BRANCHES_SQL} SELECT id, count(*) AS fields, max(target) AS max, count(*) FILTER (target > 9) AS over_limit,
  floor(quantile_cont(target::DOUBLE, 0.5))::BIGINT AS p50, floor(quantile_cont(target::DOUBLE, 0.95))::BIGINT AS p95 FROM branches GROUP BY id""")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = order_branches(spark, sf_dir).select(F.inline("branches")).select("id", F.col("target").alias("tokens"))
    return logs.length_summary(lengths, ["id"], limit=9)


@query("collapsed_runs", """WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM words),
runs AS (SELECT doc_id, w, g, min(i) AS i, count(*) AS n FROM isl GROUP BY doc_id, w, g)
SELECT doc_id, md5(string_agg(CASE WHEN n > 1 AND w IN ('haha', 'the', 'de', 'la', 'und', '') THEN w || '×' || n ELSE repeat(w || ' ', n - 1) || w END, ' ' ORDER BY i)) AS text FROM runs GROUP BY doc_id""")
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = F.array(*[F.lit(w) for w in ("haha", "the", "de", "la", "und", "")])
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("t"))
    return documents.select("doc_id", F.md5(K.collapsed_runs(F.col("t"), special)).alias("text"))


LOOP_SQL = """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
base AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN w || flatten(list_transform(range(80), lambda x: w[1:3])) ELSE w END AS w FROM t),
c AS (SELECT doc_id, len(w) AS n, w, p, greatest(128, 4 * p) AS need FROM base, range(1, 257) r(p) WHERE len(w) > p AND w[len(w)] = w[len(w) - p])
SELECT base.doc_id, coalesce(bool_or(need <= n AND c.w[n - need + p + 1:n] = c.w[n - need + 1:n - p]), false) AS loop FROM base LEFT JOIN c ON c.doc_id = base.doc_id GROUP BY base.doc_id"""


@query("loops", LOOP_SQL)
def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    tokens = F.when(F.col("doc_id") % 3 == 0, F.concat("w", F.flatten(F.array_repeat(F.slice("w", 1, 3), 80)))).otherwise(F.col("w"))
    return computed_once(documents.select("doc_id", tokens.alias("t"))).select("doc_id", K.ends_in_loop(F.col("t")).alias("loop"))


@query("stop_reasons", f"""WITH {TRACES_SQL}, s AS (SELECT CASE WHEN h < 20 THEN 'invalid_json' WHEN h < 900 THEN 'close' WHEN h % 2 = 0 THEN 'loop' ELSE 'budget' END AS stop FROM traces)
SELECT stop, CASE stop WHEN 'invalid_json' THEN 'invalid_array' WHEN 'close' THEN 'ok' ELSE 'truncated' END AS status, count(*) AS values FROM s GROUP BY stop""".replace("AS values", 'AS "values"'))
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    stop = K.stop_reason((h < 900), (h % 2 == 0), (h < 20))
    rows = computed_once(trace_records(spark, sf_dir).select(stop.alias("stop")))
    return rows.groupBy("stop", K.final_status(F.col("stop"), F.lit("ok")).alias("status")).agg(F.count("*").alias("values"))


# ------------------------------------------------------------------ logs

@query("serving_summary", f"""WITH {REQUESTS_SQL} SELECT model, merge, count(*) AS requests, {r('avg(infer)', 'mean_infer_s')}, {r('max(infer)', 'max_infer_s')},
  {r('sum(fields) / sum(infer)', 'fields_per_s')}, {r('sum(generated_tokens) / sum(decode)', 'tokens_per_s')}, {r('median(infer)', 'median_infer_s')},
  {r('median(prefix)', 'median_prefix_s')} FROM requests WHERE infer IS NOT NULL GROUP BY model, merge""")
def serving_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(logs.serving_summary(request_log(spark, sf_dir)))


@query("serving_errors", f"WITH {REQUESTS_SQL} SELECT error_type, model, count(*) AS count FROM requests WHERE error_type IS NOT NULL GROUP BY ALL")
def serving_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.error_summary(request_log(spark, sf_dir))


@query("newest_requests", f"WITH {REQUESTS_SQL} SELECT id, model, fields FROM requests ORDER BY time DESC, id DESC LIMIT 200")
def newest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.newest(request_log(spark, sf_dir), 200).select("id", "model", "fields")


@query("request_records", f"""WITH {ROWS}, s AS (SELECT document_id, status || '=' || count(*) AS named FROM rows GROUP BY document_id, status),
n AS (SELECT document_id, string_agg(named, ',' ORDER BY named) AS statuses FROM s GROUP BY document_id)
SELECT document_id AS request_id, count(*) AS fields, sum(length(target) + 1)::BIGINT AS generated_tokens, max(length(target) + 1) AS longest_field_tokens,
  any_value(statuses) AS statuses, count(*) FILTER (status = 'ok') AS scored_fields, {r("avg(correct::INT) FILTER (status = 'ok')", 'exact_match')},
  {r('sum(length(target) + 1) / (nullif(count(*) % 5, 0) / 4.0)', 'tokens_per_s')}, {r('count(*) / (count(*) / 2.0 + 1)', 'fields_per_s')}
FROM rows JOIN n USING (document_id) GROUP BY document_id""")
def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir).select(F.col("document_id").alias("request_id"), "status", (F.length("target") + 1).cast("bigint").alias("tokens"),
                                             F.when(F.col("status") == "ok", F.col("correct")).alias("correct"))
    timings = rows.groupBy("request_id").agg((F.count("*") % 5 / 4).alias("decode"), (F.count("*") / 2 + 1).alias("infer"))
    return rounded(logs.request_records(rows, timings))


@query("stage_shares", """WITH s AS (SELECT sum(l_extendedprice) AS total, sum(l_quantity) AS encode, sum(l_extendedprice * 0.25::DOUBLE) AS steps,
  sum(l_extendedprice) FILTER (l_linenumber <= 2) AS tail FROM lineitem)
SELECT 'encode' AS stage, round(encode, 4) AS seconds, round(encode / total, 9) AS share FROM s UNION ALL SELECT 'steps', round(steps, 4), round(steps / total, 9) FROM s
UNION ALL SELECT 'tail', round(tail, 4), round(tail / total, 9) FROM s""")
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("encode"), (F.col("l_extendedprice") * 0.25).alias("steps"),
        F.when(F.col("l_linenumber") <= 2, F.col("l_extendedprice")).otherwise(0.0).alias("tail"))
    shares = logs.stage_shares(profile, ["encode", "steps", "tail"])
    return shares.select("stage", F.round("seconds", 4).alias("seconds"), F.round("share", 9).alias("share"))


@query("training_summary", """WITH n AS (SELECT count(*) AS steps, count(DISTINCT user_id) AS documents_seen, count(DISTINCT event_type) AS forms_seen,
  sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS target_tokens, max(json_extract_string(props, '$.k')::BIGINT) AS max_sequence_tokens FROM events),
a AS (SELECT value, row_number() OVER (ORDER BY event_id) AS r, row_number() OVER (ORDER BY event_id DESC) AS q FROM events)
SELECT n.*, (SELECT round(avg(value), 9) FROM a WHERE r <= least(50, steps // 2)) AS mean_loss_first,
  (SELECT round(avg(value), 9) FROM a WHERE q <= least(50, steps // 2)) AS mean_loss_last, least(50, steps // 2) AS loss_window FROM n""")
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("user_id").alias("document_id"), F.col("event_type").alias("form"),
        k.alias("target_tokens"), k.alias("sequence_tokens"), F.col("value").alias("loss"))
    return rounded(logs.training_summary(log))


@query("part_numbers", """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS trace_index FROM lineitem)
SELECT l_orderkey, l_linenumber, trace_index, trace_index // 1000 AS part FROM n""")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.part_numbered(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 1000)


@query("slowest_requests", f"""WITH {REQUESTS_SQL}, n AS (SELECT model, id, infer, row_number() OVER (PARTITION BY model ORDER BY infer DESC, id) AS r FROM requests WHERE infer IS NOT NULL)
SELECT model, id, round(infer, 9) AS infer FROM n WHERE r = 1""")
def slowest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.slowest(request_log(spark, sf_dir), "infer", ["model"], ["id"]))


@query("first_shuffled", """SELECT o_orderkey FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 100""")
def first_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", order_key(7, F.col("o_orderkey")).alias("k"))
    return fields.first_in_order(orders, ["k", "o_orderkey"], 100).select("o_orderkey")
