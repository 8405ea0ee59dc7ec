"""Review policies: which fields a person must check, and how a threshold is fitted."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import REVIEW_ALL, count_if, finite, ratio, wilson
from ..session import materialize, staged
from .bootstrap import document_sums, replicate_sums
from .scale import numbered, running_totals


def usable() -> Column:
    """Whether a threshold decides the row: finished, no shape violation, a finite score."""
    return (F.col("status") == "ok") & ~F.coalesce(F.col("shape_violation"), F.lit(False)) & finite(F.col("score"))


def supported_fields(rows: DataFrame) -> DataFrame:
    """Field ids seen when a policy is fitted, with their row counts; written once, as they belong to the policy."""
    return staged(rows.groupBy("field_id").agg(F.count("*").alias("field_rows")), "supported")


def with_support(rows: DataFrame, supported: DataFrame | None) -> DataFrame:
    """Adds ``unknown_field``: the policy names its fields and this is not one of them.

    No hint on the join: adaptive execution broadcasts the field list while it
    is small and splits hot fields of a shuffled join otherwise.
    """
    if supported is None:
        return rows.withColumn("unknown_field", F.lit(False))
    known = supported.select("field_id", F.lit(True).alias("__known"))
    restricted = known.agg(F.count("*") > 0).scalar()
    return (rows.join(known, "field_id", "left")
            .withColumn("unknown_field", restricted & F.col("__known").isNull()).drop("__known"))


def mandatory() -> Column:
    """Reviewed whatever the score (after :func:`with_support`)."""
    return F.col("unknown_field") | ~usable()


def decided(rows: DataFrame, policy: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Adds ``mandatory`` and ``needs_review`` under a one-row policy."""
    threshold = policy.select("threshold").scalar()
    return (with_support(rows, supported).withColumn("mandatory", mandatory())
            .withColumn("needs_review", F.col("mandatory") | (F.col("score") < threshold)))


def fixed_policy(rows: DataFrame, threshold: float, target: float = .95, split: str = "dev") -> DataFrame:
    """A one-row policy with a given threshold."""
    return rows.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"),
                                             F.lit(target).alias("target_error_recall"),
                                             F.lit(split).alias("fitted_split"), F.lit("global").alias("mode"))


def score_counts(rows: DataFrame) -> DataFrame:
    """Fields and errors per distinct usable score, and in the row without a score those that no threshold decides; written once.

    Totals, forced errors, sweep and curve all come from these counts, so the
    rows behind them are read once.
    """
    return staged(rows.groupBy(F.when(usable(), F.col("score")).alias("score")).agg(
        F.count("*").alias("n"), count_if(~F.col("correct")).alias("errors")), "score_counts")


def score_groups(counts: DataFrame) -> DataFrame:
    """The counts of the rows that a threshold decides."""
    return counts.filter(F.col("score").isNotNull())


def between(last: Column, following: Column) -> Column:
    """A threshold that reviews ``last`` and not the following score: halfway, and above ``last`` in any case.

    Halfway between neighbouring doubles is the lower one; the upper one is
    taken then. Without a following score the threshold is above all.
    """
    half = (last + following) / 2
    return F.when(following.isNull(), F.greatest(F.lit(REVIEW_ALL), last + F.abs(last) * 4e-16)).when(half > last, half).otherwise(following)


def fit_policy(rows: DataFrame, target: float = .95, split: str = "dev") -> DataFrame:
    """Lowest threshold that catches ``target`` of the errors; ties in score stay together.

    The threshold lies halfway between the last reviewed score and the next
    one. Without errors there is no evidence and everything is reviewed.
    """
    if split != "dev":
        raise ValueError("a head is compared on dev only; use fit_conservative_policy for the risk cohort")
    if not 0 < target <= 1:
        raise ValueError(f"target_error_recall must be in (0, 1], got {target}")
    counts = score_counts(rows)
    totals = counts.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
                        F.coalesce(F.sum(F.when(F.col("score").isNull(), F.col("errors"))), F.lit(0)).alias("forced"))
    swept = running_totals(score_groups(counts), ["score"], {"caught": F.col("errors")})
    limits = totals.select((F.ceil(F.lit(target) * F.col("errors")) - F.col("forced")).alias("needed")).scalar()
    reviewed = F.col("caught") - F.col("errors") < F.col("needed")
    edge = swept.withColumn("needed", limits).agg(F.max(F.when(reviewed, F.col("score"))).alias("last"),
                                                  F.min(F.when(~reviewed, F.col("score"))).alias("next"))
    total = totals.select("errors").scalar()
    threshold = (F.when(total == 0, REVIEW_ALL).when(F.col("last").isNull(), 0.0)
                 .otherwise(between(F.col("last"), F.col("next"))))
    return edge.select(threshold.alias("threshold"), F.lit(target).alias("target_error_recall"),
                       F.lit(split).alias("fitted_split"), F.lit("global").alias("mode"))


#: Steps of the threshold search that share one pass over the errors.
SEARCH_STEPS = 4


def _midpoints(low: int, high: int, steps: int) -> list[int]:
    """Every point that a bisection of ``low..high`` can look at in its next ``steps`` steps."""
    if low >= high or not steps:
        return []
    middle = (low + high) // 2
    return [middle, *_midpoints(low, middle, steps - 1), *_midpoints(middle + 1, high, steps - 1)]


def fit_conservative_policy(rows: DataFrame, target: float = .95, split: str = "risk_validation",
                            replicates: int = 2000, seed: int = 42, by_document: bool = False) -> DataFrame:
    """Lowest threshold whose Wilson bound and document-bootstrap bound of error recall both reach ``target``.

    ``by_document`` draws every document once per replicate, the same at every
    threshold: no bound falls when more is reviewed, so the bisection finds
    what a sweep over all scores finds.
    """
    one = rows.withColumn("family", F.lit("head"))
    return conservative_policies(one, target, split, replicates, seed, ["head"], by_document).drop("family")


def conservative_policies(rows: DataFrame, target: float = .95, split: str = "risk_validation", replicates: int = 2000,
                          seed: int = 42, families: Sequence[str] | None = None, by_document: bool = False) -> DataFrame:
    """One conservative policy per ``family`` of the rows, all found in the same passes.

    The distinct usable scores of a family are numbered once and the number of
    them that must be reviewed is found by bisection. A pass over the error
    rows serves ``SEARCH_STEPS`` steps of every family: it tallies caught
    errors and errors per document for every point that these can look at. The
    driver sees one row per family and point.
    """
    if split != "risk_validation":
        raise ValueError("fit on the separate risk_validation cohort, never on audit or test rows")
    errors = materialize(rows.filter(~F.col("correct")).groupBy(
        "family", "document_id", F.when(usable(), F.col("score")).alias("score")).agg(F.count("*").alias("n")))
    keys = staged(numbered(rows.filter(usable()).select("family", "score").distinct(), ["score"], "place", ["family"]), "scores")
    if families is None:
        families = [r[0] for r in rows.select("family").distinct().orderBy("family").collect()]
    counted = dict(keys.groupBy("family").agg(F.count("*")).collect())
    count = {f: counted.get(f, 0) for f in families}
    span = {f: (0, count[f] + 1) for f in families}
    bounds: dict[tuple[str, int], tuple[float, float]] = {}
    while any(low < high for low, high in span.values()):
        points = {f: _midpoints(*span[f], SEARCH_STEPS) for f in families}
        bounds |= _recall_bounds(errors, _scores_at(keys, points), replicates, seed, by_document)
        for f in families:
            low, high = span[f]
            for _ in range(SEARCH_STEPS):
                if low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if min(bounds[f, middle]) >= target else (middle + 1, high)
            span[f] = low, high
    chosen = {f: low for f, (low, _) in span.items()}
    open_ = {f: [count[f]] for f in families if (f, min(chosen[f], count[f])) not in bounds}
    if open_:
        bounds |= _recall_bounds(errors, {f: {p: math.inf for p in ps} for f, ps in open_.items()}, replicates, seed, by_document)
    ends = _scores_at(keys, {f: [low, low + 1] for f, low in chosen.items()})
    lines = []
    for f, low in chosen.items():
        met, (wilson_low, cluster_low) = low <= count[f], bounds[f, min(low, count[f])]
        lines.append((f, met, low, ends[f][low] if met and low else None, ends[f].get(low + 1) if low < count[f] else None,
                      wilson_low, cluster_low))
    found = rows.sparkSession.createDataFrame(lines, "family string, met boolean, place long, last double, following double, wilson double, cluster double")
    threshold = F.when(~F.col("met"), REVIEW_ALL).when(F.col("place") == 0, 0.0).otherwise(between(F.col("last"), F.col("following")))
    return found.select(
        "family", threshold.alias("threshold"), F.lit(target).alias("target_error_recall"), F.lit(split).alias("fitted_split"),
        F.lit("global").alias("mode"), F.col("wilson").alias("wilson_recall_lower_95"),
        F.col("cluster").alias("document_bootstrap_recall_lower_95"), F.col("met").alias("bound_target_met"),
        F.lit(replicates).alias("bootstrap_replicates"), F.when(~F.col("met"), "review_all").alias("fallback"))


def _scores_at(keys: DataFrame, places: Mapping[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """The numbered scores of each family at the given places; what has no score reviews nothing."""
    wanted = sorted({p for ps in places.values() for p in ps})
    rows = keys.filter(F.col("place").isin(wanted)).select("family", "place", "score").collect()
    known = {(r["family"], r["place"]): r["score"] for r in rows}
    return {f: {p: known.get((f, p), -math.inf) for p in ps} for f, ps in places.items() if ps}


def _recall_bounds(errors: DataFrame, cuts: Mapping[str, Mapping[int, float]], replicates: int, seed: int,
                   by_document: bool = False) -> dict:
    """Per family and place (number -> highest reviewed score) both lower bounds of error recall; 0 without errors."""
    most = max(len(c) for c in cuts.values())
    listed = {f: [*c.items()] + [(-1, -math.inf)] * (most - len(c)) for f, c in cuts.items()}
    table = F.create_map(*[x for f, c in listed.items() for x in (F.lit(f), F.array(*[
        F.struct(F.lit(p).alias("place"), F.lit(float(cut)).alias("cut")) for p, cut in c]))])[F.col("family")]
    caught = [F.sum(F.when(F.col("score").isNull() | (F.col("score") <= table[i]["cut"]), F.col("n")).otherwise(0)).alias(f"c{i}")
              for i in range(most)]
    documents = errors.filter(F.col("family").isin(*cuts)).groupBy("family", "document_id").agg(F.sum("n").alias("errors"), *caught)
    tall = documents.select("family", "errors", F.inline(F.array(*[
        F.struct(table[i]["place"].alias("place"), F.col(f"c{i}").alias("caught")) for i in range(most)]))).filter("place >= 0")
    tall = tall.groupBy("family", "place", "caught", "errors").agg(F.count("*").alias("documents"))
    if by_document:
        sums = document_sums(documents, {"errors": F.col("errors"), **{f"c{i}": F.col(f"c{i}") for i in range(most)}}, replicates, seed, ["family"])
        drawn = sums.select("family", "errors", F.inline(F.array(*[
            F.struct(table[i]["place"].alias("place"), F.col(f"c{i}").alias("caught")) for i in range(most)]))).filter("place >= 0")
    else:
        drawn = replicate_sums(tall, {"caught": F.col("caught"), "errors": F.col("errors")}, replicates, seed, ["family", "place"], "documents")
    cluster = drawn.groupBy("family", "place").agg(F.percentile(ratio(F.col("caught"), F.col("errors")), 0.025).alias("cluster"))
    counts = tall.groupBy("family", "place").agg(F.sum(F.col("caught") * F.col("documents")).alias("caught"),
                                                 F.sum(F.col("errors") * F.col("documents")).alias("errors"))
    low, _ = wilson(F.col("caught"), F.col("errors"))
    rows = counts.join(cluster, ["family", "place"]).select("family", "place", low.alias("wilson"), "cluster").collect()
    none = {(f, p): (0.0, 0.0) for f, c in cuts.items() for p in c}
    return none | {(r["family"], r["place"]): (r["wilson"] or 0.0, r["cluster"] or 0.0) for r in rows}


def decided_by_family(rows: DataFrame, policies: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Adds ``threshold``, ``mandatory`` and ``needs_review`` under the policy of each row's ``family``.

    ``supported`` names the fields of each family; a family without any is not restricted.
    """
    thresholds = policies.select("family", "threshold")
    if supported is None:
        marked = rows.withColumn("unknown_field", F.lit(False))
    else:
        named = supported.select("family", "field_id", F.lit(True).alias("__known"))
        restricted = policies.select("family").join(named.select("family").distinct().withColumn("__named", F.lit(True)), "family", "left")
        thresholds = thresholds.join(restricted, "family")
        marked = rows.join(named, ["family", "field_id"], "left")
    marked = marked.join(thresholds, "family")
    if supported is not None:
        marked = marked.withColumn("unknown_field", F.coalesce("__named", F.lit(False)) & F.col("__known").isNull()).drop("__known", "__named")
    return marked.withColumn("mandatory", mandatory()).withColumn("needs_review", F.col("mandatory") | (F.col("score") < F.col("threshold")))


def review_reason() -> Column:
    """Why a row is reviewed, null when it is accepted (after :func:`decided`)."""
    return F.when(F.col("needs_review"), (
        F.when(F.col("unknown_field"), "field_outside_evaluated_schema")
        .when((F.col("status") != "ok") | ~finite(F.col("score")), "incomplete_or_invalid")
        .when(F.coalesce(F.col("shape_violation"), F.lit(False)), "field_shape_violation")
        .otherwise("low_correctness_confidence")))


def review_queue(rows: DataFrame, policy: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Reviewed rows with reason and priority: 1 for mandatory reviews, else 1 - score."""
    queue = decided(rows, policy, supported).withColumn("reason", review_reason()).filter(F.col("reason").isNotNull())
    priority = F.when(F.col("reason") == "low_correctness_confidence", 1 - F.col("score")).otherwise(1.0)
    return queue.withColumn("priority", priority)
