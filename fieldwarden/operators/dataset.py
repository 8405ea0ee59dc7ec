"""Raw labels to leak-free splits: grouping of duplicates, splits, rejects, statistics and run order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.hashing import hash_bucket, order_key, seeded
from ..functions.numbers import count_if
from ..session import computed_once, staged
from .scale import attach, numbered

# Upper bucket bounds of the splits, out of 100.
SPLIT_BOUNDS = (("train", 80), ("dev", 87), ("calibration", 94), ("test", 100))


def document_id(form: Column, sample: Column) -> Column:
    """``form__sample``."""
    return F.concat_ws("__", form, sample.cast("string"))


def split_of(group: Column, seed: int = 42) -> Column:
    """Split of a duplicate group: stable for a seed, whatever else is in the data."""
    bucket = hash_bucket(seeded(seed, group))
    (first, bound), *rest = SPLIT_BOUNDS
    name = F.when(bucket < bound, first)
    for split, bound in rest:
        name = name.when(bucket < bound, split)
    return name


def is_reserved(group: Column, holdout_percent: int) -> Column:
    """Whether a train group is held back; does not depend on the seed."""
    return hash_bucket(group) < holdout_percent


def selected(documents: DataFrame, split: str, holdout_percent: int = 0, forms: Sequence[str] = ()) -> DataFrame:
    """Documents of a split (``train_reserve`` is the held-back part of train), optionally of some forms."""
    reserve = split == "train_reserve"
    chosen = documents.filter(F.col("split") == ("train" if reserve else split))
    if split in ("train", "train_reserve"):
        chosen = chosen.filter(is_reserved(F.col("group_id"), holdout_percent) == reserve)
    return chosen.filter(F.col("form").isin(*forms)) if forms else chosen


def run_order(documents: DataFrame, seed: int = 42, balanced: bool = False) -> DataFrame:
    """Adds ``run_position`` (from 1): a seeded shuffle, or one document of every form in turn.

    A balanced run visits forms in order of first appearance in the shuffle.
    """
    keyed = documents.withColumn("__key", order_key(seed, F.col("document_id")))
    if not balanced:
        return numbered(keyed, ["__key", "document_id"], "run_position").drop("__key")
    rounds = numbered(keyed, ["__key", "document_id"], "__round", ["form"])
    first = keyed.groupBy("form").agg(F.min("__key").alias("__first"), F.count("*").alias("n"))
    placed = attach(rounds, first, ["form"], "n", ["document_id"])
    return numbered(placed, ["__round", "__first"], "run_position").drop("__key", "__round", "__first")


# ------------------------------------------------------------------ duplicate groups

def duplicate_groups(pages: DataFrame, rounds: int = 50) -> DataFrame:
    """Documents that share any page, transitively: ``(document_id, group_id)``, the smallest id of the group.

    ``pages`` has document_id and page_hash. Documents of one hash form a star
    around the smallest of them, so a page shared by very many documents costs
    one edge per document. The stars are then merged by alternating rounds
    that link every neighbour of a document to its smallest neighbour. Each
    round's edges are written to the shared folder.
    """
    members = staged(pages.filter(F.col("page_hash").isNotNull()).select("document_id", "page_hash").distinct(), "pages")
    hubs = members.groupBy("page_hash").agg(F.min("document_id").alias("v"), F.count("*").alias("n"))
    stars = attach(members, hubs.filter("n > 1"), ["page_hash"], "n", ["document_id"])
    edges = staged(stars.filter(F.col("v") < F.col("document_id")).select(F.col("document_id").alias("u"), "v").distinct(),
                   "edges")
    seen = None
    for _ in range(rounds):
        edges = staged(_link_smaller(_link_larger(edges)), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"duplicate groups did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("document_id"), F.col("v").alias("__root"))
    everyone = pages.select("document_id").distinct()
    return everyone.join(roots, "document_id", "left").select(
        "document_id", F.coalesce("__root", "document_id").alias("group_id"))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds ``m``, the smallest neighbour ``v`` of ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return attach(pairs, least, ["u"], "n", ["v"])


def _link_larger(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a document is linked to the smallest document of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _link_smaller(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the document itself, is linked to the smallest of them."""
    linked = _with_least(edges)
    others = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(linked.select("u", F.col("m").alias("v"))).distinct()


def duplicate_page_occurrences(pages: DataFrame) -> DataFrame:
    """Page files whose content already occurs under another name."""
    return pages.select("page_name", "page_hash").distinct().agg(
        (F.count("*") - F.count_distinct("page_hash")).alias("duplicate_page_occurrences"))


def drop_overlapping(documents: DataFrame, used_pages: DataFrame) -> DataFrame:
    """Documents none of whose ``image_sha256`` is among the used page hashes."""
    touching = (documents.select("document_id", F.explode("image_sha256").alias("page_hash"))
                .join(used_pages.select("page_hash").distinct(), "page_hash", "left_semi").select("document_id"))
    return documents.join(touching, "document_id", "left_anti")


def shared_pages(train: DataFrame, test: DataFrame) -> DataFrame:
    """Page hashes that occur on both sides."""
    return train.select("page_hash").intersect(test.select("page_hash"))


# ------------------------------------------------------------------ labels

def labelled(manifest: DataFrame, describe_arrays: bool = True) -> DataFrame:
    """Manifest rows with their leaf ``fields`` and a ``reason`` when they must be rejected.

    ``manifest`` has label (JSON text), unprinted (JSON text or null),
    description (JSON text or null) and pages_found. Fields listed as
    unprinted are dropped when the list is a list. Nothing raises: broken rows
    carry a reason and the rest go on.
    """
    names = F.from_json(F.when(T.json_type(F.col("unprinted")) == "array", F.col("unprinted")), "array<string>")
    leaves = V.flatten_label(F.col("label"), F.col("description"), describe_arrays)
    opened = computed_once(manifest.withColumn("__leaves", leaves).withColumn(
        "__names", F.coalesce(names, F.array().cast("array<string>"))))
    kept = computed_once(opened.withColumn("fields", F.filter(
        "__leaves", lambda f: ~F.array_contains(F.col("__names"), f["id"]))))
    reason = (F.when(~F.col("pages_found"), "Missing image").when(F.col("__leaves").isNull(), "Malformed label")
              .when(F.size("fields") == 0, "No usable fields"))
    return kept.withColumn("reason", reason).drop("__leaves", "__names")


def exploded(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per field: the kept columns, then position, field_id, description, value, kind."""
    return documents.select(*keep, F.posexplode("fields").alias("position", "f")).select(
        *keep, F.col("position").cast("bigint").alias("position"), F.col("f.id").alias("field_id"), F.col("f.description").alias("description"),
        F.col("f.value").alias("value"), F.col("f.kind").alias("kind"))


def prepare_report(documents: DataFrame) -> DataFrame:
    """Document counts by split, by form and by reject reason, and branch counts by kind: ``(section, name, count)``."""
    good = documents.filter(F.col("reason").isNull())
    counts = documents.groupingSets([["split"], ["form"], ["reason"]], "split", "form", "reason").agg(
        count_if(F.col("reason").isNull()).alias("good"), F.count("*").alias("all"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "splits").when(F.col("g") == 5, "forms").otherwise("rejected")
    sections = counts.select(section.alias("section"), F.coalesce("split", "form", "reason").alias("name"),
                             F.when(F.col("g") == 6, F.col("all")).otherwise(F.col("good")).alias("count"))
    arrays = F.size(F.filter("fields", lambda f: f["kind"] == "array"))
    branches = good.agg(F.sum(arrays).alias("array_branches"), F.sum(F.size("fields") - arrays).alias("scalar_branches"))
    branches = branches.select(F.inline(F.array(*[F.struct(F.lit("branches").alias("section"), F.lit(n).alias("name"),
                                                            F.col(n).alias("count"))
                                                  for n in ("array_branches", "scalar_branches")])))
    return sections.filter("name is not null and count > 0").unionByName(branches)


def document_stats(documents: DataFrame, by: str = "split") -> DataFrame:
    """Documents, pages and fields per split and in total."""
    return documents.rollup(by).agg(F.count("*").alias("documents"), F.sum(F.size("pages")).alias("pages"),
                                    F.sum(F.size("fields")).alias("fields"),
                                    F.count_distinct("form").alias("forms"), F.grouping(by).alias("__all")).select(
        F.when(F.col("__all") == 1, "total").otherwise(F.col(by)).alias(by), "documents", "pages", "fields", "forms")


def value_type_counts(fields: DataFrame, by: str = "split") -> DataFrame:
    """Fields per value type, per split and in total."""
    typed = fields.select(by, V.value_type(F.col("value")).alias("value_type"))
    return (typed.groupingSets([[by, "value_type"], ["value_type"]], by, "value_type")
            .agg(F.count("*").alias("count"), F.grouping(by).alias("__all"))
            .select(F.when(F.col("__all") == 1, "total").otherwise(F.col(by)).alias(by), "value_type", "count"))


def feature_counts(fields: DataFrame, by: str = "split") -> DataFrame:
    """String features of string values per split."""
    named = fields.select(by, F.explode(T.string_features(T.json_string(F.col("value")))).alias("feature"))
    return named.groupBy(by, "feature").agg(F.count("*").alias("count"))


# ------------------------------------------------------------------ quota split of several datasets

def quota_split(groups: DataFrame, seed: int = 42, test_cap: int = 50, test_fraction: float = .5,
                dev_cap: int = 3) -> DataFrame:
    """Splits the groups of every dataset: a capped share to test, a few to dev, the rest to train.

    ``groups`` has dataset, group_id and preferred; preferred groups go first,
    otherwise the order is a seeded shuffle.
    """
    keyed = (groups.withColumn("__late", (~F.col("preferred")).cast("int"))
             .withColumn("__key", F.sha2(F.concat_ws(":", F.lit(str(seed)), "dataset", "group_id"), 256)))
    ranked = numbered(keyed, ["__late", "__key", "group_id"], "__rank", ["dataset"])
    sizes = groups.groupBy("dataset").agg(F.count("*").alias("groups"))
    sizes = sizes.withColumn("__n", F.col("groups"))
    placed = attach(ranked, sizes, ["dataset"], "__n", ["group_id"])
    test = F.least(F.lit(test_cap), F.floor(F.col("groups") * F.lit(float(test_fraction))))
    dev = F.least(F.lit(dev_cap), F.floor((F.col("groups") - test) / 10))
    split = F.when(F.col("__rank") <= test, "test").when(F.col("__rank") <= test + dev, "dev").otherwise("train")
    return placed.withColumn("split", split).drop("__late", "__key", "__rank", "groups")


def usable_in_split(documents: DataFrame, max_train_pages: int = 6) -> DataFrame:
    """Adds ``dropped``: other variants than the first outside train, long documents inside it."""
    variant = F.nullif(F.regexp_extract("document_id", r"__v([0-9]+)\z", 1), F.lit(""))
    other = (F.col("split") != "train") & variant.isNotNull() & (variant != "1")
    long = (F.col("split") == "train") & (F.size("pages") > max_train_pages)
    return documents.withColumn("dropped", F.when(other, "variant").when(long, "train_dropped_long"))


def quota_report(documents: DataFrame) -> DataFrame:
    """Per dataset: kept documents and fields of each split, and long documents dropped from train."""
    kept = F.col("dropped").isNull()
    sums = [x for s in ("train", "dev", "test") for x in (
        count_if(kept & (F.col("split") == s)).alias(f"{s}_documents"),
        F.coalesce(F.sum(F.when(kept & (F.col("split") == s), F.size("fields"))), F.lit(0)).alias(f"{s}_fields"))]
    return documents.groupBy("dataset").agg(
        *sums, count_if(F.coalesce(F.col("dropped") == "train_dropped_long", F.lit(False))).alias("train_dropped_long"))


# ------------------------------------------------------------------ chat labels

def chat_turns(conversations: DataFrame) -> DataFrame:
    """First user turn and last assistant turn of every conversation: ``(conv_id, prompt, answer)``.

    Turn numbers are compared in the aggregation, so no conversation is sorted
    or collected.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.groupBy("conv_id").agg(
        F.min_by(F.col("text"), F.when(user, F.col("turn"))).alias("prompt"),
        F.max_by(F.col("text"), F.when(assistant, F.col("turn"))).alias("answer"))


def chat_fields(labels: DataFrame) -> DataFrame:
    """Fields of chat labels ``(document_id, prompt, answer)``; an answer that is no JSON object gets a reason.

    Descriptions come from the field list of the prompt, of a key listed twice
    from its last line; null answers read as empty text and numbers as their
    text.
    """
    told = V.prompt_fields(F.col("prompt"))

    def description(f: Column) -> Column:
        lines = F.filter(F.col("__told"), lambda t: t["id"] == f["id"])
        return F.coalesce(F.try_element_at(lines, F.lit(-1))["description"], f["id"])

    fields = F.transform(V.flatten_label(F.col("answer")), lambda f: F.struct(
        f["id"].alias("id"), description(f).alias("description"),
        V.plain_value(f["value"]).alias("value"), f["kind"].alias("kind")))
    is_object = F.coalesce(T.json_type(F.col("answer")) == "object", F.lit(False))
    return (labels.withColumn("__told", told).withColumn("fields", F.when(is_object, fields))
            .withColumn("reason", F.when(~is_object, "The answer is not a JSON object")
                        .when(F.size("fields") == 0, "No usable fields")).drop("__told"))


def variant_kept(name: Column, variant: str | None = "v1") -> Column:
    """Whether a label file belongs to the wanted variant; names without a variant always do."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    if variant is None:
        return F.lit(True)
    return ~stem.rlike(r"__v[0-9]+\z") | stem.endswith(f"__{variant}")


def dataset_sample(documents: DataFrame, per_dataset: int, seed: int = 42) -> DataFrame:
    """At most ``per_dataset`` documents of each dataset, drawn by a seeded shuffle."""
    from .scale import first_per_group

    keyed = documents.withColumn("__key", F.sha2(F.concat_ws(":", F.lit(str(seed)), "dataset", "document_id"), 256))
    return first_per_group(keyed, ["dataset"], ["__key", "document_id"], per_dataset).drop("__key", "rank")
