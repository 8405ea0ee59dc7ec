"""Quality rules whose cutoffs are certified on labelled holdouts: exact binomial bounds limit false rejections per stratum.

Everything here is column expressions, aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, staged
from .registry import query

SPACES = r"[\x20\x09-\x0D]+"
#: Good documents that all rules of a stratum together may reject, at most this share ...
ALPHA = 0.05
#: ... except with this probability over the draw of the holdout, for all strata and rules at once.
DELTA = 0.05
#: Good labels lost that one bad label caught must outweigh, on the part of the labels that choose among certified cutoffs.
GOOD_WEIGHT = 100

#: Rule -> (feature, cutoffs from the loosest to the strictest). Values at or beyond a cutoff are rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "dup_lines": ("n_dup_lines / n_lines", (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "long_words": ("word_chars / n_words", (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    "short_words": ("-word_chars / n_words", (-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5)),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    def windows(h: Column) -> Column:
        heads = F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(5)), F.lit(5)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def repeated(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(placed, lambda p: F.transform(F.filter(p, lambda s, i: F.coalesce(
            (F.get(p, i - 1)["h"] == s["h"]) | (F.get(p, i + 1)["h"] == s["h"]),
            F.get(p, i - 1)["h"] == s["h"], F.get(p, i + 1)["h"] == s["h"], F.lit(False))), lambda s: s["i"]))
        return let(F.sort_array(same), covered)

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), repeated(w)).otherwise(F.lit(0).cast("bigint"))))


def text_counts(text: Column) -> Column:
    """Struct of the base counts of one text; null and empty texts count nothing.

    ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``,
    all long. ``n_lines`` are the lines that hold a word.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"),
                                             F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                                             _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint")
    return let(of_words, lambda w: let(of_lines, lambda x: F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
        x["n_lines"].alias("n_lines"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"))))


def base_failed() -> Column:
    """Under ten words, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1 (Stirling's series nine steps up)."""
    y = x + 9.0
    series = (1 / 12.0) / y - (1 / 360.0) / F.pow(y, 3) + (1 / 1260.0) / F.pow(y, 5) - (1 / 1680.0) / F.pow(y, 7)
    product = x
    for step in range(1, 9):
        product = product * (x + float(step))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), the exact test of "the rate is at most p"; 1 where k is not below n * p.

    Terms fall from k downwards; what a thousand terms leave over is bounded by
    their geometric rest, so the value is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    log_term = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
                + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(1000)).cast("int"))).otherwise(F.array().cast("array<int>"))
    ratio = k / (n - k + 1) * ((1 - p) / p)
    total = F.aggregate(steps, start, add, lambda acc: acc["sum"] + F.when(
        k > 1000, acc["term"] * ratio / (1 - ratio)).otherwise(0.0))
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log_term) * total)).otherwise(1.0)


def _level(feature: str, cuts: tuple[float, ...]) -> Column:
    """The first step, from 1, whose cutoff rejects the row; one more than the steps where none does."""
    return len(cuts) + 1 - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.expr(feature) >= cut))


def cutoff_table(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and the chosen cutoff of each rule (null: the rule is off there); strata where all are off are absent.

    Args:
        labelled: ``stratum, identity, good`` and the base counts; one row per
            labelled document. Equal texts (``identity``) count once, as good
            if any copy is.
        alpha: Share of good documents that all rules together may reject.
        delta: Probability of breaking that anywhere.

    A third of the texts, by identity, only choose; the others are the
    holdout. Each rule has ``alpha / rules`` to spend in each stratum. Its
    cutoffs are tested from loose to strict at level ``delta / (rules *
    strata)`` and the first failure ends the walk, so no further correction
    for the number of cutoffs is due. Of the certified ones, the cutoff with
    the best count of bad minus ``GOOD_WEIGHT`` times good rejections on the
    choosing part is taken, if that is positive. ``strata`` are all with a
    labelled text that passes the base rule, however many.
    """
    texts = labelled.groupBy("stratum", "identity").agg(F.max("good").alias("good"), *[
        F.first(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
    texts = texts.filter(~base_failed()).withColumn(
        "holdout", F.conv(F.substring("identity", 1, 8), 16, 10).cast("bigint") % 3 != 0)
    levels = F.array(*[F.struct(F.lit(rule).alias("rule"), _level(feature, cuts).alias("level"))
                       for rule, (feature, cuts) in RULES.items()])
    counted = (texts.select("stratum", "good", "holdout", F.inline(levels))
               .groupBy("stratum", "rule", "level").agg(*[
                   F.count(F.when((F.col("good") == g) & (F.col("holdout") == h), 1)).alias(name)
                   for name, g, h in (("good_h", 1, True), ("good_t", 1, False), ("bad_t", 0, False))]))
    # At most one row per level: windows over them are small whatever the number of documents.
    grid = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(at).alias("step"), F.lit(cut).alias("cut"))
                     for rule, (_, cuts) in RULES.items() for at, cut in enumerate(cuts, 1)])
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good_h").alias("n"))
    strata = counted.filter(F.col("rule") == next(iter(RULES))).select("stratum").distinct()
    number = strata.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    walk = strata.select("stratum", F.inline(grid))
    reached = walk.join(counted, ["stratum", "rule"]).filter(F.col("level") <= F.col("step")).groupBy(
        "stratum", "rule", "step").agg(*[F.sum(c).alias(c) for c in ("good_h", "good_t", "bad_t")])
    tested = (walk.join(totals, ["stratum", "rule"]).join(reached, ["stratum", "rule", "step"], "left")
              .na.fill(0, ["good_h", "good_t", "bad_t"])
              .withColumn("passes", binomial_tail(F.col("good_h"), F.col("n"), alpha / len(RULES))
                          <= delta / (len(RULES) * number)))
    until = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    worth = F.col("bad_t") - GOOD_WEIGHT * F.col("good_t")
    best = (tested.withColumn("certified", F.min("passes").over(until)).filter("certified").filter(worth > 0)
            .groupBy("stratum", "rule").agg(F.max_by("cut", F.struct(worth, -F.col("step"))).alias("cut")))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in RULES])


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row: ``cutoffs``, the ``cutoff_table`` as a map from stratum to its cutoffs."""
    return cutoff_table(labelled, alpha, delta).agg(F.map_from_entries(F.collect_list(F.struct("stratum", F.struct(*RULES)))).alias("cutoffs"))


def judged(documents: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows that hold the base counts and ``stratum``, with ``base_failed``, ``failed`` (rules broken) and ``kept``.

    ``cutoffs`` is a ``cutoff_table`` or the map of ``certified_cutoffs``. It is
    broadcast: a stratum stands in it only with the hundreds of labels that a
    certified rule takes, and documents of a common language stay dealt out.
    """
    if "cutoffs" in cutoffs.columns:
        cutoffs = cutoffs.select(F.explode("cutoffs").alias("stratum", "__own"))
    else:
        cutoffs = cutoffs.select("stratum", F.struct(*RULES).alias("__own"))
    broken = F.filter(F.array(*[F.when(F.expr(feature) >= F.col("__own")[rule], F.lit(rule))
                                for rule, (feature, _) in RULES.items()]), lambda r: r.isNotNull())
    rows = documents.join(F.broadcast(cutoffs.withColumnRenamed("stratum", "__stratum")),
                          F.col("stratum") == F.col("__stratum"), "left").drop("__stratum")
    rows = rows.withColumn("base_failed", base_failed())
    rows = rows.withColumn("failed", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(broken))
    return rows.withColumn("kept", F.size("failed") == 0).drop("__own")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_counts(documents: DataFrame) -> DataFrame:
    """``documents`` with the base counts and ``stratum`` (language; null is its own stratum ''); such columns are replaced."""
    rows = documents.drop(*COUNTS, "stratum").withColumn("__counts", text_counts(F.col("text")))
    return rows.select(*[c for c in rows.columns if c != "__counts"], "__counts.*",
                       F.coalesce(F.col("lang"), F.lit("")).alias("stratum"))


def labelled_counts(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted documents that have a quality label; ``counted`` holds ``doc_id, identity``.

    Null labels and ids are ignored; of repeated labels the better one counts.
    """
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good")))
    return counted.select("doc_id", "stratum", "identity", *COUNTS).join(known, "doc_id").drop("doc_id")


def _sql() -> str:
    features = "\n  UNION ALL ".join(
        f"SELECT stratum, good, holdout, '{rule}' AS rule, {len(cuts) + 1} - len(list_filter({[float(c) for c in cuts]}, lambda c: "
        f"CAST({feature.replace(' / ', ' / CAST(').rstrip()} AS DOUBLE) AS DOUBLE) >= c)) AS level FROM texts"
        for rule, (feature, cuts) in RULES.items())
    grid = ", ".join(f"('{rule}', {at}, {float(cut)})" for rule, (_, cuts) in RULES.items() for at, cut in enumerate(cuts, 1))
    share, tests = ALPHA / len(RULES), len(RULES)
    broken = " OR ".join(
        f"coalesce(CAST({feature.replace(' / ', ' / CAST(')} AS DOUBLE) AS DOUBLE) >= (SELECT cut FROM best b WHERE "
        f"b.stratum = c.stratum AND rule = '{rule}'), false)" for rule, (feature, _) in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, stratum, md5(text) AS identity, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b0 AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c),
texts AS (SELECT stratum, identity, max(CAST(quality > 0 AS INT)) AS good, any_value(n_words) AS n_words,
                 any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_lines) AS n_lines,
                 any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words,
                 CAST('0x' || identity[1:8] AS BIGINT) % 3 <> 0 AS holdout
          FROM b0 JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY stratum, identity),
levels AS ({features}),
grid(rule, step, cut) AS (VALUES {grid}),
strata AS (SELECT DISTINCT stratum FROM texts),
tested AS (
  SELECT stratum, rule, step, cut, count(*) FILTER (good = 1 AND holdout) AS n,
         count(*) FILTER (good = 1 AND holdout AND level <= step) AS k,
         count(*) FILTER (good = 1 AND NOT holdout AND level <= step) AS good_t,
         count(*) FILTER (good = 0 AND NOT holdout AND level <= step) AS bad_t
  FROM strata JOIN levels USING (stratum) JOIN grid USING (rule) GROUP BY ALL),
passed AS (
  SELECT *, k < n * {share} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
           lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln({1 - share}))))
           <= {DELTA} / ({tests} * (SELECT greatest(count(*), 1) FROM strata)) AS passes FROM tested),
walked AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY step) AS certified FROM passed),
best AS (SELECT stratum, rule, arg_max(cut, (bad_t - {GOOD_WEIGHT} * good_t, -step)) AS cut FROM walked
         WHERE certified AND bad_t > {GOOD_WEIGHT} * good_t GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({broken}) AS kept
FROM b0 c
"""


@query("op2_quality_rules", _sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the counts are made once and staged without the texts."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.md5("text").alias("identity"))
    counted = staged(with_counts(documents.withColumn("identity", F.coalesce("identity", F.md5(F.lit(""))))).drop("text", "lang"),
                     "quality")
    cutoffs = cutoff_table(labelled_counts(counted, read_table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return judged(counted, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                           "n_repeat_words", "base_failed", "kept")
