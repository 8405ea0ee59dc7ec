"""Disjoint cohorts of unseen documents, drawn per form."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .dataset import is_reserved
from .scale import first_per_group, numbered

# Cohort names in plan order.
COHORTS = ("train", "dev", "calibration", "risk_validation", "audit")


@dataclass(frozen=True)
class CohortSizes:
    """How many documents of each form every cohort takes, and from where.

    ``train_split`` is ``train`` or ``train_reserve``. The risk cohort is
    taken after the cohort that shares its source, so the two never meet.
    """

    seed: int
    train_per_form: int
    per_form: int = 2
    calibration_per_form: int | None = None
    risk_per_form: int = 4
    train_split: str = "train"
    risk_split: str = "train"
    exclude_forms: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.train_split not in ("train", "train_reserve") or self.risk_split not in ("train", "calibration"):
            raise ValueError("cohorts come from train or train_reserve, the risk cohort from train or calibration")

    def slices(self) -> list[tuple[str, str, int, int]]:
        """``(cohort, source split, offset, count)``."""
        calibration = self.calibration_per_form or self.per_form
        offset = self.train_per_form if self.risk_split == "train" else calibration
        return [("train", "train", 0, self.train_per_form), ("dev", "dev", 0, self.per_form),
                ("calibration", "calibration", 0, calibration),
                ("risk_validation", self.risk_split, offset, self.risk_per_form), ("audit", "test", 0, self.per_form)]


def sizes_from(config: Mapping[str, object]) -> CohortSizes:
    """Sizes from a plain mapping; unknown or missing keys are errors."""
    unknown = set(config) - set(CohortSizes.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown cohort keys: {sorted(unknown)}")
    return CohortSizes(**{**config, "exclude_forms": tuple(config.get("exclude_forms") or ())})


def cohort_pool(documents: DataFrame, sizes: CohortSizes, excluded: DataFrame | None = None,
                holdout_percent: int = 0) -> DataFrame:
    """Documents a cohort may take: of the right part of train, not excluded, not of an excluded form."""
    reserve = sizes.train_split == "train_reserve"
    right_part = (F.col("split") != "train") | (is_reserved(F.col("group_id"), holdout_percent) == reserve)
    pool = documents.filter(right_part)
    if sizes.exclude_forms:
        pool = pool.filter(~F.col("form").isin(*sizes.exclude_forms))
    return pool if excluded is None else pool.join(excluded.select("document_id").distinct(), "document_id", "left_anti")


def plan_cohorts(documents: DataFrame, sizes: CohortSizes, excluded: DataFrame | None = None,
                 holdout_percent: int = 0) -> DataFrame:
    """The plan ``(cohort, form, position, document_id)``.

    Per source split and form the documents are shuffled with the seed and
    each cohort takes a fixed range. Only forms of the train pool take part.
    """
    pool = cohort_pool(documents, sizes, excluded, holdout_percent).select("document_id", "split", "form")
    forms = pool.filter(F.col("split") == "train").select("form").distinct()
    keyed = pool.join(forms, "form", "left_semi").withColumn("__key", order_key(sizes.seed, F.col("document_id")))
    slices = sizes.slices()
    reach = max(offset + count for _, _, offset, count in slices)
    drawn = first_per_group(keyed, ["split", "form"], ["__key", "document_id"], reach)
    ranges = F.array(*[F.struct(F.lit(c).alias("cohort"), F.lit(s).alias("source"), F.lit(o).alias("low"),
                                F.lit(o + n).alias("high")) for c, s, o, n in slices])
    taking = F.filter(ranges, lambda x: (x["source"] == F.col("split")) & (F.col("rank") > x["low"]) & (F.col("rank") <= x["high"]))
    return drawn.select("form", "rank", "document_id", F.inline(taking)).select(
        "cohort", "form", F.col("rank").alias("position"), "document_id")


def fresh_pool(documents: DataFrame, *used: DataFrame) -> DataFrame:
    """Documents in none of the used sets."""
    touched = used_documents(*used)
    return documents.join(touched, "document_id", "left_anti")


def used_documents(*sources: DataFrame) -> DataFrame:
    """Distinct document ids over several sources."""
    ids = [s.select("document_id") for s in sources]
    together = ids[0]
    for more in ids[1:]:
        together = together.unionByName(more)
    return together.distinct()


def fresh_audit(documents: DataFrame, per_form: int, seed: int = 211, *used: DataFrame) -> DataFrame:
    """At most ``per_form`` unused documents of each form, drawn by a seeded shuffle."""
    keyed = fresh_pool(documents, *used).withColumn("__key", order_key(seed, F.col("document_id")))
    return first_per_group(keyed, ["form"], ["__key", "document_id"], per_form).drop("__key")


def replace_audit(plan: DataFrame, audit: DataFrame) -> DataFrame:
    """The plan with its audit cohort replaced; subsets named ``*_audit`` go with the old one."""
    kept = plan.filter((F.col("cohort") != "audit") & ~F.col("cohort").endswith("_audit"))
    return kept.select("cohort", "document_id").unionByName(audit.select(F.lit("audit").alias("cohort"), "document_id"))


def cohort_overlaps(plan: DataFrame) -> DataFrame:
    """Pairs of cohorts that share documents; empty when the plan is sound.

    A document has at most a handful of cohorts, collected per document as a
    set of names, so no document meets every other one.
    """
    named = plan.groupBy("document_id").agg(F.sort_array(F.collect_set("cohort")).alias("c")).filter(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(
        a.alias("a"), b.alias("b")))))
    return named.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("documents"))


def cohort_leaks(plan: DataFrame, trained: DataFrame) -> DataFrame:
    """Cohort documents that are also in a forbidden set: count and smallest ids per cohort."""
    found = plan.join(trained.select("document_id").distinct(), "document_id", "left_semi")
    return found.groupBy("cohort").agg(F.count("*").alias("documents"), F.min("document_id").alias("example"))


def resolved(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """Plan rows with their documents; ``found`` is false where the id is unknown."""
    known = documents.withColumn("found", F.lit(True))
    return plan.join(known, "document_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def strided(documents: DataFrame, count: int) -> DataFrame:
    """An even sample of at most ``count`` documents over the sorted ids: every ``n // count``-th of all ``n``."""
    stride = F.greatest(F.lit(1), F.floor(documents.agg(F.count("*")).scalar() / F.lit(count)))
    ranked = numbered(documents, ["document_id"], "__n").withColumn("__stride", stride)
    at = F.col("__n") - 1
    return ranked.filter((at % F.col("__stride") == 0) & (at < F.col("__stride") * count)).drop("__n", "__stride")


def folds(rows: DataFrame, count: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``fold``: documents shuffled, then dealt in turn; a document is never split."""
    documents = rows.select("document_id").distinct().withColumn("__key", order_key(seed, F.col("document_id")))
    dealt = numbered(documents, ["__key", "document_id"], "__n").select(
        "document_id", ((F.col("__n") - 1) % count).alias("fold"))
    return rows.join(dealt, "document_id")
