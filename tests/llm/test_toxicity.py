"""Toxicity: held-out accuracy, features, and edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldwarden.llm import toxicity


def corpus(n):
    draw = random.Random(1)
    parts = ["ta", "ri", "on", "el", "mu", "sha", "er", "ing"]
    rows = []
    for d in range(n):
        words = ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(draw.randint(5, 60))]
        toxic = d % 6 == 0
        if toxic:
            for w in draw.choices(["vile", "Nasty", "rotten!"], k=3):
                words.insert(draw.randrange(len(words)), w)
        rows.append((d, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows], "doc_id bigint, text string, toxicity double")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id bigint, toxic int")
    return docs, labels


def test_held_out_labels(spark):
    rows = corpus(900)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(d, x) for d, _, x in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert 150 < len(held) < 300
    right = sum(int(got[d].toxicity >= 0.3) == x for d, x in held)
    assert right >= 0.97 * len(held)
    again = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    assert np.allclose(again.weights, model.weights)
    bounded = toxicity.fit(docs, labels, sample_rows=300, features=200)
    assert (bounded.weights != 0).sum() <= 200


def test_edges(spark):
    rows = corpus(60)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "é" * 80_000), (3, "😀 ab")], "doc_id bigint, text string")
    scores = [r.toxicity for r in toxicity.scored(odd, model).collect()]
    assert scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(odd.limit(0), model).collect() == []
    for known in (labels.limit(0), labels.filter("toxic = 0"), labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        flat = toxicity.fit(docs, known)
        assert not flat.weights.any() and 0 < flat.score_text("any text") < 1
    repeated = labels.union(labels.filter("doc_id < 20"))
    assert np.allclose(toxicity.fit(docs, repeated).weights, model.weights)
    unknown = spark.createDataFrame([(None, 1)], "doc_id bigint, toxic int").select(toxicity.held_out(F.col("doc_id")).alias("h"))
    assert unknown.first().h is False
