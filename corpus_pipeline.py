"""Corpus pipeline: reject toxic and poor documents, keep one of each group of near copies, cut repeats, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Labels
come from the tables in ``sf_dir``. Rows without an id are kept by the
filters that need none, and repeated rows are decided alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import jaccard, packing, quality, sketch, substrings, toxicity
from fieldwarden.session import read_table, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the cutoff; the model learns from the labels of documents still there."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return docs.filter(model.score(F.col("text")) < toxicity.CUTOFF)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    # The row travels whole beside its counts, so that no column of its own is touched.
    row = docs.select("doc_id", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("identity"), F.struct(*docs.columns).alias("__row"))
    counted = staged(quality.with_counts(row).drop("text", "lang"), "counted")
    cutoffs = quality.cutoff_table(quality.labelled_counts(counted, labels))
    return quality.judged(counted, cutoffs).filter("kept").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that with the least id.

    Rows that repeat an id stand or fall together; of those with equal texts
    the one with the least other columns stays. Rows without an id are kept. Texts without a word are no copies of
    each other.
    """
    classes = jaccard.near_duplicates(docs.select("doc_id", "text"), jaccard.Similarity(5, 80))
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = (docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    same = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(same.select("__row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier one has.

    A text that loses words becomes its kept words joined by one space and
    ``n_chars`` its length; all others stay as they are.
    """
    cut = substrings.cut_repeats(docs.select("doc_id", "text"), with_text=True).filter("n_removed > 0")
    cut = cut.select("doc_id", F.col("words_sha256").alias("__words"), F.col("kept").alias("__kept")).dropDuplicates(["doc_id", "__words"])
    cut = staged(cut, "kept")
    # Only documents that may have lost words meet their new texts; the others stay where they are.
    likely = sketch.with_likely(docs, cut.select("doc_id"), "__likely")
    marked = likely.filter("__likely").withColumn("__words", substrings.word_digest(F.col("text"))["sha256"])
    joined = marked.join(cut, ["doc_id", "__words"], "left")
    new = {"text": F.coalesce("__kept", "text"),
           "n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept")).otherwise(F.col("n_chars"))}
    changed = joined.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(c)).alias(c) for c in docs.columns])
    return likely.filter("not __likely").select(*docs.columns).unionByName(changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 2048 ids."""
    pieces = packing.cut_pieces(docs.select("doc_id", "text"), packing.default_encoder(), with_ids=False)
    return packing.pack(staged(pieces.drop("ids"), "pieces"))


STAGES = [("toxicity", reject_toxic), ("quality_rules", reject_poor), ("near_copies", drop_near_copies),
          ("substring_dedup", cut_repeats), ("packing", pack)]

#: Model fits and segmentations have no SQL; tests/llm compares the stages with plain searches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
