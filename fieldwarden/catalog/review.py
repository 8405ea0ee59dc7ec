"""Queries on policies, review workload, ranking and calibration metrics, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import DRAW_MODULUS, EXACT_MEAN, poisson_cuts
from ..functions.numbers import REVIEW_ALL
from ..operators import bootstrap, policy, review
from ..session import staged
from . import query
from .views import review_rows, review_rows_sql

ROWS = review_rows_sql()
ROWS_B = review_rows_sql("rows_b", "b")
REPLICATES = 1000

# ------------------------------------------------------------------ SQL pieces


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Double columns rounded, so summation order does not show."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, digits: int = 9) -> str:
    return f"round(({expression})::DOUBLE, {digits}) AS {name}"


def wilson_sql(s: str, n: str, end: str) -> str:
    p = f"(({s})::DOUBLE / ({n}))"
    z = "1.96::DOUBLE"
    centre = f"({p} + {z} * {z} / (2 * ({n})))"
    half = f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4.0::DOUBLE * ({n}) * ({n}))))"
    scale = f"(1 + {z} * {z} / ({n}))"
    if end == "low":
        return f"CASE WHEN ({n}) > 0 THEN greatest(0.0::DOUBLE, ({centre} - {half}) / {scale}) END"
    return f"CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE, ({centre} + {half}) / {scale}) END"


def seeds_sql(key: str) -> str:
    word = "('0x' || substr(sha256('42:' || {key}), {at}, 8))::UBIGINT::BIGINT % {m} AS {name}"
    return ", ".join(word.format(key=key, at=at, m=DRAW_MODULUS, name=name) for at, name in ((1, "s"), (9, "t"), (17, "s2"), (25, "t2")))


#: Values of the Poisson distribution functions that are inverted.
CDF = f"""cdf AS (SELECT k, list(total ORDER BY j) AS cdf FROM (SELECT k, j, sum(exp(j * ln(k) - k - lgamma(j + 1))) OVER (PARTITION BY k ORDER BY j) AS total
  FROM range(1, {EXACT_MEAN + 1}) means(k), range(0, 300) counts(j) WHERE j <= k + 10 * sqrt(k) + 12) GROUP BY k)"""


def drawn_sql(documents: str, sums: list[str], replicates: int = REPLICATES, by: str = "", tag: str = "") -> str:
    """``drawn``: weighted sums per replicate of a table with one row per document and the summed columns.

    A second use in one statement names its tables with a ``tag`` and takes the first one's ``cdf``.
    """
    group = f"{by}, " if by else ""
    names = ", ".join(sums)
    u, v = (f"(({s} + replicate * {t}) % {DRAW_MODULUS} + 0.5) / {DRAW_MODULUS}::DOUBLE" for s, t in (("s", "t"), ("s2", "t2")))
    return f"""{'' if tag else CDF + ','}
tallies{tag} AS (SELECT {group}{names}, count(*) AS k FROM {documents} GROUP BY ALL),
seeded{tag} AS (SELECT tallies{tag}.*, cdf, {seeds_sql(f"concat_ws(',', {names})")} FROM tallies{tag} LEFT JOIN cdf ON cdf.k = tallies{tag}.k),
uniform{tag} AS (SELECT *, {u} AS u, sqrt(-2 * ln({u})) * cos(2 * pi() * ({v})) AS z FROM seeded{tag}, range({replicates}) replicates(replicate)),
weighted{tag} AS (SELECT *, CASE WHEN k <= {EXACT_MEAN} THEN len(list_filter(cdf, lambda c: c < u)) ELSE greatest(0, floor(
  k + sqrt(k) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(k)) + 0.5)) END AS w FROM uniform{tag}),
drawn{tag} AS (SELECT {group}replicate, {', '.join(f'sum({s} * w)::DOUBLE AS {s}' for s in sums)} FROM weighted{tag} GROUP BY {group}replicate)"""


def weight_sql(replicate: str = "replicate") -> str:
    drawn = f"((s + {replicate} * t) % {DRAW_MODULUS})"
    cuts = poisson_cuts()
    return "CASE " + " ".join(f"WHEN {drawn} < {cut} THEN {k}" for k, cut in enumerate(cuts)) + f" ELSE {len(cuts)} END"


def document_drawn_sql(documents: str, sums: list[str], replicates: int = REPLICATES, by: str = "") -> str:
    """``drawn``: weighted sums per replicate of a table with document_id and the summed columns, every document drawn in each."""
    group = f"{by}, " if by else ""
    return f"""seeded AS (SELECT *, {seeds_sql('document_id')} FROM {documents}),
drawn AS (SELECT {group}replicate, {', '.join(f'sum({s} * ({weight_sql()}))::DOUBLE AS {s}' for s in sums)}
  FROM seeded, range({replicates}) replicates(replicate) GROUP BY ALL)"""


def ends_sql(value: str, name: str) -> str:
    return (f"round(quantile_cont({value}, 0.025), 9) AS {name}_low, "
            f"round(quantile_cont({value}, 0.975), 9) AS {name}_high")


SUBSET_INTERVALS = f"""d AS (SELECT subset, document_id, n, reviewed, errors, caught FROM per_document),
{document_drawn_sql('d', ['n', 'reviewed', 'errors', 'caught'], 500, 'subset')},
ends AS (SELECT subset, {ends_sql('reviewed / n', 'review_rate')}, {ends_sql('caught / nullif(errors, 0)', 'error_recall')} FROM drawn GROUP BY subset)"""
GROUPS = """groups AS (SELECT score, count(*) AS n, count(*) FILTER (NOT correct) AS errors FROM rows WHERE usable GROUP BY score)"""
FIT = f"""{GROUPS},
totals AS (SELECT count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct AND NOT usable) AS forced FROM rows),
swept AS (SELECT score, errors, sum(errors) OVER (ORDER BY score) AS caught FROM groups),
edge AS (SELECT max(score) FILTER (caught - swept.errors < ceil(0.95::DOUBLE * t.errors) - t.forced) AS last,
  min(score) FILTER (caught - swept.errors >= ceil(0.95::DOUBLE * t.errors) - t.forced) AS next FROM swept, totals t),
policy AS (SELECT CASE WHEN t.errors = 0 THEN {REVIEW_ALL}::DOUBLE WHEN last IS NULL THEN 0.0::DOUBLE
  WHEN next IS NOT NULL THEN (last + next) / 2 ELSE greatest({REVIEW_ALL}::DOUBLE, last) END AS threshold FROM edge, totals t)"""


def decided_sql(rows: str = "rows", name: str = "decided", unknown: str = "false", policy_name: str = "policy") -> str:
    return f"""{name} AS (SELECT r.*, {unknown} AS unknown_field, {unknown} OR NOT usable AS mandatory,
  {unknown} OR NOT usable OR score < threshold AS needs_review FROM {rows} r, {policy_name})"""


def evaluation_sql(source: str = "decided", by: str = "") -> str:
    group, head = (f" GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""per_document AS (SELECT {head}document_id, count(*) AS n, count(*) FILTER (NOT correct) AS errors,
  count(*) FILTER (needs_review) AS reviewed, count(*) FILTER (needs_review AND NOT correct) AS caught,
  count(*) FILTER (NOT needs_review AND correct) AS ok, count(*) FILTER (mandatory) AS forced,
  count(*) FILTER (NOT mandatory AND NOT correct) AS he, count(*) FILTER (NOT mandatory AND needs_review) AS hr,
  count(*) FILTER (NOT mandatory AND needs_review AND NOT correct) AS hc FROM {source} GROUP BY {head}document_id),
summed AS (SELECT {head}count(*) AS documents, count(*) FILTER (reviewed > 0) AS rd, sum(n)::BIGINT AS n,
  sum(errors)::BIGINT AS errors, sum(reviewed)::BIGINT AS reviewed, sum(caught)::BIGINT AS caught,
  sum(ok)::BIGINT AS ok, sum(forced)::BIGINT AS forced, sum(he)::BIGINT AS he, sum(hr)::BIGINT AS hr,
  sum(hc)::BIGINT AS hc FROM per_document{group}),
evaluation AS (SELECT {head}n AS fields, documents, errors, reviewed AS reviewed_fields, {r('reviewed / n', 'review_rate')},
  n - reviewed AS accepted_fields, {r('ok / nullif(n - reviewed, 0)', 'accepted_precision')},
  {r(wilson_sql('ok', 'n - reviewed', 'low'), 'accepted_precision_wilson_low')},
  {r(wilson_sql('ok', 'n - reviewed', 'high'), 'accepted_precision_wilson_high')},
  caught AS caught_errors, errors - caught AS missed_errors, {r('caught / nullif(errors, 0)', 'error_recall')},
  {r(wilson_sql('caught', 'errors', 'low'), 'error_recall_wilson_low')},
  {r(wilson_sql('caught', 'errors', 'high'), 'error_recall_wilson_high')},
  {r('caught / nullif(reviewed, 0)', 'review_precision')}, rd AS reviewed_documents,
  {r('rd / documents', 'document_review_rate')}, forced AS mandatory_review, n - forced AS head_fields, he AS head_errors,
  {r('hr / nullif(n - forced, 0)', 'head_review_rate')}, {r('hc / nullif(he, 0)', 'head_error_recall')} FROM summed)"""


P = "CASE WHEN logit >= 0 THEN 1 / (1 + exp(-abs(logit))) ELSE exp(-abs(logit)) / (1 + exp(-abs(logit))) END"

# ------------------------------------------------------------------ policies


@query("fit_policy", f"""WITH {ROWS}, {FIT}
SELECT round(threshold, 9) AS threshold, 0.95::DOUBLE AS target_error_recall, 'dev' AS fitted_split, 'global' AS mode,
  (SELECT count(DISTINCT field_id) FROM rows) AS supported_fields FROM policy""")
def fit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    supported = policy.supported_fields(rows).agg(F.count("*").alias("supported_fields"))
    return rounded(bootstrap.side_by_side(policy.fit_policy(rows), supported))


@query("evaluate_policy", f"WITH {ROWS}, {FIT}, {decided_sql()}, {evaluation_sql()} SELECT * FROM evaluation")
def evaluate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    return rounded(review.evaluate_policy(rows, policy.fit_policy(rows), policy.supported_fields(rows)))


UNKNOWN = "field_id NOT IN ('/order/status', '/order/total', '/order/date', '/order/key')"


@query("review_queue", f"""WITH {ROWS}, {FIT}, {decided_sql(unknown=UNKNOWN)},
queue AS (SELECT document_id, field_id, status, round(score, 9) AS score, CASE WHEN unknown_field THEN 'field_outside_evaluated_schema'
  WHEN status <> 'ok' OR score IS NULL OR isnan(score) THEN 'incomplete_or_invalid'
  WHEN shape_violation THEN 'field_shape_violation' ELSE 'low_correctness_confidence' END AS reason FROM decided WHERE needs_review)
SELECT document_id, field_id, status, score, reason,
  round(CASE WHEN reason = 'low_correctness_confidence' THEN 1 - score ELSE 1.0::DOUBLE END, 9) AS priority FROM queue""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    known = policy.supported_fields(rows.filter(~F.col("field_id").isin("/order/priority", "/customer/key")))
    queue = policy.review_queue(rows, policy.fit_policy(rows), known)
    # Written first: a sort reads its rows twice, once for the split points.
    queue = staged(queue.select("document_id", "field_id", "status", "score", "reason", "priority"), "queue")
    return rounded(queue.orderBy(F.desc("priority"), "document_id", "field_id"))


@query("review_queue_order", f"""WITH {ROWS}, {FIT}, {decided_sql()},
queue AS (SELECT document_id, field_id, position,
  CASE WHEN usable THEN 1 - score ELSE 1.0::DOUBLE END AS priority FROM decided WHERE needs_review)
SELECT document_id, field_id, row_number() OVER (PARTITION BY document_id ORDER BY priority DESC, position) AS urgency FROM queue""")
def review_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    queue = policy.review_queue(rows, policy.fit_policy(rows))
    # A document has as many rows as a request has fields: its order is one small window.
    order = Window.partitionBy("document_id").orderBy(F.desc("priority"), "position")
    return queue.select("document_id", "field_id", F.row_number().over(order).cast("bigint").alias("urgency"))


@query("review_reasons", f"""WITH {ROWS}, {FIT}, {decided_sql(unknown=UNKNOWN)}
SELECT CASE WHEN unknown_field THEN 'field_outside_evaluated_schema'
  WHEN status <> 'ok' OR score IS NULL OR isnan(score) THEN 'incomplete_or_invalid'
  WHEN shape_violation THEN 'field_shape_violation' ELSE 'low_correctness_confidence' END AS reason,
  count(*) AS fields, count(*) FILTER (NOT correct) AS errors FROM decided WHERE needs_review GROUP BY 1""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    known = policy.supported_fields(rows.filter(~F.col("field_id").isin("/order/priority", "/customer/key")))
    return policy.review_queue(rows, policy.fit_policy(rows), known).groupBy("reason").agg(
        F.count("*").alias("fields"), F.sum((~F.col("correct")).cast("bigint")).alias("errors"))


@query("oracle_review_rate", f"""WITH {ROWS} SELECT round((count(*) FILTER (NOT usable) + greatest(0,
  ceil(0.95::DOUBLE * count(*) FILTER (NOT correct)) - count(*) FILTER (NOT correct AND NOT usable)))::DOUBLE / count(*), 9)
  AS oracle_review_rate FROM rows""")
def oracle_review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.oracle_review_rate(review_rows(spark, sf_dir)))


CURVE = f"""{GROUPS}, swept AS (SELECT score, n, sum(n) OVER w AS accepted, sum(errors) OVER w AS missed FROM groups
  WINDOW w AS (ORDER BY score DESC))"""


@query("review_curve", f"""WITH {ROWS}, {CURVE} SELECT round(score, 9) AS threshold, accepted::BIGINT AS accepted,
  {r('accepted / (SELECT count(*) FROM rows)', 'coverage')}, {r('missed / accepted', 'risk')} FROM swept""")
def review_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.review_curve(review_rows(spark, sf_dir)).select("threshold", "accepted", "coverage", "risk"))


@query("aurc", f"""WITH {ROWS}, {CURVE}, t AS (SELECT sum(missed::DOUBLE / accepted * n) AS area, max(accepted) AS acc,
  max(missed) AS mis FROM swept), total AS (SELECT count(*) AS n FROM rows)
SELECT {r('(area + (mis + n - acc)::DOUBLE / n * (n - acc)) / n', 'aurc')}, {r('acc / n', 'maximum_valid_coverage')}
FROM t, total""")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.aurc(review_rows(spark, sf_dir)))


@query("budgets", f"""WITH {ROWS}, {GROUPS},
swept AS (SELECT n, errors, sum(n) OVER (ORDER BY score) AS upto FROM groups),
head AS (SELECT count(*) AS total, count(*) FILTER (NOT correct) AS all_errors, count(*) FILTER (NOT usable) AS forced,
  count(*) FILTER (NOT usable AND NOT correct) AS forced_errors FROM rows),
levels AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS budget),
picked AS (SELECT budget, any_value(total) AS total, any_value(all_errors) AS all_errors,
  any_value(forced) + coalesce(sum(n) FILTER (forced + upto <= greatest(forced, floor(total * budget))), 0) AS reviewed,
  (any_value(forced_errors) + coalesce(sum(errors) FILTER (forced + upto <= greatest(forced, floor(total * budget))), 0))::BIGINT
  AS caught_errors FROM swept, head, levels GROUP BY budget)
SELECT budget, {r('reviewed / total', 'review_rate')}, caught_errors, {r('caught_errors / all_errors', 'error_recall')} FROM picked""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.budgets(review_rows(spark, sf_dir)))


@query("fit_conservative_policy", f"""WITH {ROWS},
errors AS (SELECT document_id, CASE WHEN usable THEN score END AS score FROM rows WHERE NOT correct),
seeded AS (SELECT *, {seeds_sql('document_id')} FROM errors),
weighted AS (SELECT replicate, score, sum({weight_sql()}) AS w FROM seeded, range({REPLICATES}) replicates(replicate) GROUP BY ALL),
keys AS (SELECT -1::DOUBLE AS cut UNION SELECT score FROM rows WHERE usable),
totals AS (SELECT replicate, sum(w) AS total, sum(w) FILTER (score IS NULL) AS forced FROM weighted GROUP BY replicate),
grid AS (SELECT cut, replicate, coalesce(w, 0) AS w FROM keys CROSS JOIN (SELECT replicate FROM totals)
  LEFT JOIN weighted ON weighted.score = cut AND weighted.replicate = totals.replicate),
recalls AS (SELECT cut, replicate, (coalesce(forced, 0) + sum(w) OVER (PARTITION BY replicate ORDER BY cut))::DOUBLE / nullif(total, 0)
  AS recall FROM grid JOIN totals USING (replicate)),
cluster AS (SELECT cut, quantile_cont(recall, 0.025) AS cluster FROM recalls GROUP BY cut),
counts AS (SELECT cut, count(errors.document_id) FILTER (errors.score IS NULL OR errors.score <= cut) AS s, count(*) AS n
  FROM keys, errors GROUP BY cut),
state AS (SELECT cut, cluster, {wilson_sql('s', 'n', 'low')} AS wilson FROM cluster JOIN counts USING (cut)),
chosen AS (SELECT min(cut) FILTER (least(cluster, wilson) >= 0.95) AS hit, max(cut) AS top FROM state)
SELECT round(CASE WHEN hit IS NULL THEN {REVIEW_ALL}::DOUBLE WHEN hit = -1 THEN 0.0::DOUBLE ELSE coalesce((hit +
  (SELECT min(score) FROM rows WHERE usable AND score > hit)) / 2, {REVIEW_ALL}::DOUBLE) END, 9) AS threshold,
  round(state.wilson, 9) AS wilson_recall_lower_95, round(state.cluster, 9) AS document_bootstrap_recall_lower_95,
  hit IS NOT NULL AS bound_target_met FROM chosen JOIN state ON state.cut = coalesce(hit, top)""".replace(
    "CROSS JOIN (SELECT replicate FROM totals)", "CROSS JOIN totals").replace(
    "SELECT cut, replicate, coalesce(w, 0) AS w", "SELECT cut, totals.replicate, coalesce(w, 0) AS w"))
def fit_conservative_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = policy.fit_conservative_policy(review_rows(spark, sf_dir), replicates=REPLICATES, by_document=True)
    return rounded(fitted.select("threshold", "wilson_recall_lower_95", "document_bootstrap_recall_lower_95",
                                 "bound_target_met"))


# ------------------------------------------------------------------ metrics

@query("accuracy_brier_nll", f"""WITH {ROWS}, scored AS (SELECT correct::INT::DOUBLE AS y, logit, {P} AS p FROM rows WHERE logit IS NOT NULL)
SELECT count(*) AS count, {r('avg(y)', 'accuracy')}, {r('avg((p - y) * (p - y))', 'brier')},
  {r('avg(greatest(logit, 0.0::DOUBLE) - logit * y + ln(1 + exp(-abs(logit))))', 'nll')} FROM scored""")
def accuracy_brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.accuracy_brier_nll(review_rows(spark, sf_dir)))


@query("calibration_error", f"""WITH {ROWS}, scored AS (SELECT correct::INT::DOUBLE AS y, {P} AS p FROM rows WHERE logit IS NOT NULL),
binned AS (SELECT p, y, CASE {' '.join(f'WHEN p < {i + 1}::DOUBLE / 10 THEN {i}' for i in range(9))} WHEN p <= 1 THEN 9 END AS bin FROM scored),
per_bin AS (SELECT count(*) AS n, avg(p) AS p, avg(y) AS y FROM binned GROUP BY bin)
SELECT {r('sum(n * abs(p - y)) / sum(n)', 'ece')} FROM per_bin""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.calibration_error(review_rows(spark, sf_dir)))


AUC = """swept AS (SELECT {by}s, pos, neg, sum(neg) OVER ({part}ORDER BY s) AS below FROM (SELECT {by}{score} AS s,
  count(*) FILTER (correct) AS pos, count(*) FILTER (NOT correct) AS neg FROM rows WHERE {score} IS NOT NULL GROUP BY ALL)),
area AS (SELECT {by}sum(pos * (below - neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auroc, sum(pos)::BIGINT AS pos,
  sum(neg)::BIGINT AS neg FROM swept {group})"""


@query("auroc", f"""WITH {ROWS}, {AUC.format(by='', part='', score='logit', group='')}
SELECT {r('auroc', 'auroc')}, pos AS "right", neg AS wrong FROM area""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.auroc(review_rows(spark, sf_dir), "logit"))


@query("within_field_auroc", f"""WITH {ROWS}, {AUC.format(by='form, field_id, ', part='PARTITION BY form, field_id ', score='logit',
                                                          group='GROUP BY form, field_id')}
SELECT {r('avg(auroc)', 'macro_auroc')}, count(*) AS groups_with_both_labels FROM area WHERE pos > 0 AND neg > 0""")
def within_field_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.within_field_auroc(review_rows(spark, sf_dir)))


@query("acceptance", f"""WITH {ROWS}, scored AS (SELECT correct, {P} AS p FROM rows WHERE logit IS NOT NULL)
SELECT threshold, {r('count(*) FILTER (p >= threshold) / count(*)', 'coverage')},
  {r('count(*) FILTER (p >= threshold AND correct) / nullif(count(*) FILTER (p >= threshold), 0)', 'precision')}
FROM scored, (SELECT unnest([0.5, 0.8, 0.9, 0.95]::DOUBLE[]) AS threshold) GROUP BY threshold""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.acceptance(review_rows(spark, sf_dir)))


@query("wilson_by_form", f"""WITH {ROWS} SELECT form, count(*) AS fields, count(*) FILTER (correct) AS right_fields,
  {r(wilson_sql('count(*) FILTER (correct)', 'count(*)', 'low'), 'low')},
  {r(wilson_sql('count(*) FILTER (correct)', 'count(*)', 'high'), 'high')} FROM rows GROUP BY form""")
def wilson_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import count_if, wilson

    t = review_rows(spark, sf_dir).groupBy("form").agg(F.count("*").alias("fields"),
                                                       count_if(F.col("correct")).alias("right_fields"))
    low, high = wilson(F.col("right_fields"), F.col("fields"))
    return rounded(t.select("form", "fields", "right_fields", low.alias("low"), high.alias("high")))


@query("head_report", f"""WITH {ROWS}, {FIT}, {decided_sql()}, {evaluation_sql()},
{AUC.format(by='', part='', score='score', group='').replace('swept', 'ranked').replace('area', 'ranking').replace(
    'WHERE score IS NOT NULL', 'WHERE score IS NOT NULL AND NOT isnan(score)')},
{CURVE.replace(GROUPS + ', ', '').replace('swept', 'curve')},
aurc AS (SELECT sum(missed::DOUBLE / accepted * n) AS area, max(accepted) AS acc, max(missed) AS mis FROM curve)
SELECT round(threshold, 9) AS threshold, review_rate, error_recall, document_review_rate,
  round(ranking.auroc, 9) AS auroc, {r('(area + (mis + fields - acc)::DOUBLE / fields * (fields - acc)) / fields', 'aurc')}
FROM policy, evaluation, ranking, aurc""")
def head_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir).withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    report = review.head_report(rows, policy.fit_policy(rows))
    return rounded(report.select("threshold", "review_rate", "error_recall", "document_review_rate", "auroc", "aurc"))


# ------------------------------------------------------------------ bootstrap

@query("paired_delta", f"""WITH {ROWS}, {ROWS_B},
pairs AS (SELECT coalesce(rows.document_id, rows_b.document_id) AS document_id, rows.correct::INT AS a, rows_b.correct::INT AS b
  FROM rows FULL JOIN rows_b ON rows.document_id = rows_b.document_id AND rows.field_id = rows_b.field_id),
documents AS (SELECT document_id, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(a - b)::BIGINT AS d,
  count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM pairs GROUP BY document_id),
{document_drawn_sql('documents', ['d', 'n'])},
points AS (SELECT sum(n)::BIGINT AS fields, count(*) AS documents, {r('sum(a) / sum(n)', 'candidate_exact_match')},
  {r('sum(b) / sum(n)', 'baseline_exact_match')}, {r('(sum(a) - sum(b)) / sum(n)', 'delta')},
  sum(only_a)::BIGINT AS only_a, sum(only_b)::BIGINT AS only_b FROM documents)
SELECT points.*, {ends_sql('d / n', 'delta')} FROM drawn, points GROUP BY ALL""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (review_rows(spark, sf_dir, s).withColumn("kind", F.lit("scalar")) for s in "ab")
    return rounded(bootstrap.paired_delta(a, b, REPLICATES, kinds=["scalar"]))


PER_DOCUMENT = """documents AS (SELECT document_id, count(*) AS n, count(*) FILTER (needs_review) AS reviewed,
  count(*) FILTER (NOT correct) AS errors, count(*) FILTER (needs_review AND NOT correct) AS caught FROM decided GROUP BY document_id)"""


@query("review_intervals", f"""WITH {ROWS}, {FIT}, {decided_sql()}, {PER_DOCUMENT},
{document_drawn_sql('documents', ['n', 'reviewed', 'errors', 'caught'])}
SELECT {ends_sql('reviewed / n', 'review_rate')}, {ends_sql('caught / nullif(errors, 0)', 'error_recall')} FROM drawn""")
def review_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    return rounded(bootstrap.review_intervals(policy.decided(rows, policy.fit_policy(rows)), REPLICATES))


@query("policy_comparison", f"""WITH {ROWS}, {FIT}, {decided_sql()},
documents AS (SELECT document_id, count(*) AS n, count(*) FILTER (NOT correct) AS errors,
  count(*) FILTER (needs_review) AS base, count(*) FILTER (needs_review AND NOT correct) AS base_caught,
  count(*) FILTER (mandatory OR score < 0.5) AS new, count(*) FILTER ((mandatory OR score < 0.5) AND NOT correct) AS new_caught
  FROM decided GROUP BY document_id),
{document_drawn_sql('documents', ['n', 'errors', 'base', 'base_caught', 'new', 'new_caught'])}
SELECT {ends_sql('new / n - base / n', 'review_rate_change')}, {ends_sql('base_caught / nullif(errors, 0)', 'baseline_error_recall')},
  {ends_sql('new_caught / nullif(errors, 0)', 'candidate_error_recall')} FROM drawn""")
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    base = policy.decided(rows, policy.fit_policy(rows)).withColumnRenamed("needs_review", "base_review")
    both = base.withColumn("new_review", F.col("mandatory") | (F.col("score") < 0.5))
    return rounded(bootstrap.policy_comparison(both, REPLICATES))


@query("paired_systems", f"""WITH {ROWS}, {ROWS_B},
a AS (SELECT document_id, field_id, NOT correct AS err, NOT usable OR score < 0.6 AS review FROM rows),
b AS (SELECT document_id, field_id, NOT correct AS err, NOT usable OR score < 0.4 AS review FROM rows_b),
documents AS (SELECT a.document_id, count(*) AS n, count(*) FILTER (a.review) AS a, count(*) FILTER (a.err) AS a_err,
  count(*) FILTER (a.review AND a.err) AS a_hit, count(*) FILTER (b.review) AS b, count(*) FILTER (b.err) AS b_err,
  count(*) FILTER (b.review AND b.err) AS b_hit FROM a JOIN b ON a.document_id = b.document_id AND a.field_id = b.field_id
  GROUP BY a.document_id), {document_drawn_sql('documents', ['n', 'a', 'b'])},
points AS (SELECT sum(n)::BIGINT AS fields, count(*) AS documents, {r('sum(a) / sum(n)', 'review_rate')},
  {r('sum(b) / sum(n)', 'baseline_review_rate')}, sum(a_err)::BIGINT AS errors, sum(b_err)::BIGINT AS baseline_errors,
  {r('sum(a_hit) / sum(a_err)', 'error_recall')}, {r('sum(b_hit) / sum(b_err)', 'baseline_error_recall')},
  {r('sum(a) / sum(n) - sum(b) / sum(n)', 'review_rate_change')} FROM documents)
SELECT points.*, {ends_sql('a / n - b / n', 'review_rate_change')} FROM drawn, points GROUP BY ALL""")
def paired_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (policy.decided(review_rows(spark, sf_dir, s), policy.fixed_policy(review_rows(spark, sf_dir, s), cut))
            for s, cut in (("a", .6), ("b", .4)))
    return rounded(bootstrap.paired_systems(a, b, REPLICATES))
