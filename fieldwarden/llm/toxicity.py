"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, staged
from .registry import query

#: Lengths of the character n-grams.
SIZES = (3, 4, 5)
#: N-grams are hashed to ``2**BITS`` features.
BITS = 18
#: Most labelled documents that the fit reads: the documented bound of the training set.
SAMPLE_ROWS = 40_000
#: Most features that the linear model sees: those with the largest class difference ...
FEATURES = 4096
#: ... if it is beyond this chi-square value, which few n-grams of a small training set reach by chance.
CHI_SQUARE = 20.0
#: A document is toxic from this score on.
CUTOFF = 0.3

# ASCII letters and digits stay, every other ASCII character separates words.
_ASCII = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)


def gram_buckets(text: str) -> np.ndarray:
    """Feature numbers of every n-gram inside the words of ``text`` (lower-cased, one separator on either side counts)."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    gaps = np.concatenate(([0], np.cumsum(points == 32)))
    codes, found = points.astype(np.uint64), []
    for size in SIZES:
        count = len(codes) - size + 1
        if count <= 0:
            continue
        value = np.full(count, 0x9E3779B97F4A7C15 * size & (2**64 - 1), np.uint64)
        for at in range(size):
            value = value * np.uint64(0x100000001B3) + codes[at:at + count]
        inner = gaps[size - 1:size - 1 + count] == gaps[1:1 + count]
        value = value[inner]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        found.append((value >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """``sigmoid(intercept + sum of the weights of the n-grams present)``."""

    intercept: float
    weights: np.ndarray

    def score_text(self, text: str | None) -> float:
        """Score of one text in 0..1; null counts as empty."""
        buckets = gram_buckets(text or "")
        buckets = np.unique(buckets[self.weights[buckets] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[buckets].sum(), -500, 500))))

    def score(self, text: Column) -> Column:
        """Score column; reads nothing but the text."""
        model = self

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score_text(t) for t in texts], dtype="float64")

        return scored(text)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per n-gram and class of one task; bucket -1 counts the documents."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    totals = [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            counts[toxic][np.unique(gram_buckets(text.as_py() or ""))] += 1
            totals[toxic] += 1
    used = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int64()), pa.array([totals[0], *counts[0][used]], pa.int64()),
                                      pa.array([totals[1], *counts[1][used]], pa.int64())], ["bucket", "clean", "toxic"])


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids.

    Null texts are empty; null labels are no labels; of repeated labels of a
    document the larger counts. The sample is small by its limit, so it is
    broadcast and no text is shuffled.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit the classifier on labelled documents.

    Document counts per n-gram and class give the log-count ratios; the
    ``features`` n-grams whose class rates differ most enter a logistic
    regression as their ratio where present. Without labels of both classes
    every score is the smoothed share of toxic labels.
    """
    rows = staged(training_rows(documents, labels, sample_rows), "toxicity")
    counts = (rows.mapInArrow(_class_counts, "bucket bigint, clean bigint, toxic bigint")
              .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas())
    totals = counts[counts.bucket < 0][["clean", "toxic"]].sum()
    weights = np.zeros(1 << BITS)
    if min(totals) == 0:
        share = (totals["toxic"] + 1) / (totals.sum() + 2)
        return ToxicityModel(float(np.log(share / (1 - share))), weights)
    counts = counts[counts.bucket >= 0].sort_values("bucket")
    rate = {c: (counts[c].to_numpy() + 1.0) / (totals[c] + 2.0) for c in ("clean", "toxic")}
    ratio = np.log(rate["toxic"] / rate["toxic"].sum()) - np.log(rate["clean"] / rate["clean"].sum())
    pooled = (counts["clean"] + counts["toxic"] + 1.0).to_numpy() / (totals.sum() + 2.0)
    spread = (rate["toxic"] - rate["clean"]) ** 2 / (pooled * (1 - np.minimum(pooled, 1 - 1e-9)))
    chi_square = spread / (1 / totals["toxic"] + 1 / totals["clean"])
    chosen = np.argsort(-spread, kind="stable")[:features]
    chosen = np.sort(chosen[chi_square[chosen] >= min(CHI_SQUARE, chi_square.max())])
    buckets, scale = counts["bucket"].to_numpy()[chosen], ratio[chosen]
    place = np.full(1 << BITS, -1)
    place[buckets] = np.arange(len(buckets))

    @F.udf(VectorUDT())
    def vector(text):
        at = np.unique(place[gram_buckets(text)])
        at = at[at >= 0]
        return Vectors.sparse(len(scale), at.tolist(), scale[at].tolist())

    inputs = rows.select(vector("text").alias("features"), F.col("toxic").cast("double").alias("label"))
    model = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False).fit(staged(inputs, "grams"))
    weights[buckets] = model.coefficients.toArray() * scale
    return ToxicityModel(float(model.intercept), weights)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from the fit; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``documents`` with ``toxicity`` (score) and ``toxic`` (score of at least ``CUTOFF``); such columns are replaced.

    Empty and null texts get the score of the intercept, equal texts equal
    scores; an empty table stays empty.
    """
    return (documents.withColumn("toxicity", model.score(F.col("text")))
            .withColumn("toxic", F.col("toxicity") >= CUTOFF))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that saw no held-out label."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(documents, labels.filter(~held_out(F.col("doc_id"))))
    return scored(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                                           F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))
