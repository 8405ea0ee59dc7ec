"""Scores against counting and softmax in plain Python; probabilities, gradients, learning and the handling of odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import maxent
from fieldwarden.llm.maxent import ARY, CONTEXTS, Learner, Settings, nested_classes, scored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def corpus(seed, count):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(count):
        text, at = [], draw.randrange(400)
        for _ in range(draw.randint(0, 60)):
            at = (at * 7 + draw.choice([1, 1, 1, 5])) % 400 if draw.random() < 0.9 else draw.randrange(400)
            text.append(words[at].upper() if draw.random() < 0.2 else words[at])
        text += [f"rare{draw.randrange(5000)}" for _ in range(draw.randint(0, 3))]
        rows.append((d, "  ".join(text)))
    return rows


def run(spark, rows, every=7, settings=Settings(bits=12)):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, score int, n string")
    return [tuple(r) for r in scored(df, F.coalesce(F.col("doc_id") % every != 2, F.lit(True)), settings).collect()]


def base(rows, every=7):
    learned = Counter(t for d, x in rows if d is None or d % every != 2 for t in tokens(x))
    total, distinct = sum(learned.values()), len(learned)
    return sorted((str(d), len(tokens(x)), sum(learned[t] > 0 for t in tokens(x)), total,
                   sum(math.log10((learned[t] + 1) / (total + distinct + 1)) for t in tokens(x))) for d, x in rows)


@pytest.mark.parametrize("settings", [Settings(bits=12), Settings(leaves=50, known=120, bits=10, rounds=3), Settings(leaves=5, known=0, bits=4)])
def test_counts_and_base_scores(spark, settings):
    rows = corpus(1, 200)
    rows += [(300, None), (301, ""), (None, rows[3][1]), (None, rows[3][1]), (5, rows[5][1]), (5, "another text"), (302, "\x1f \x7f A"),
             (303, " ".join(f"long{i % 3000}" for i in range(30_000)))]
    got = sorted((str(d), *more) for d, *more in run(spark, rows, settings=settings))
    want = base(rows)
    assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want)
    assert np.allclose(sorted(g[4] for g in got), sorted(w[4] for w in want), rtol=1e-9)
    repeated = [g[5] for g in got if g[0] == "None"]
    assert abs(repeated[0] - repeated[1]) < 1e-9


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = corpus(2, 2500)
    got = run(spark, rows, settings=Settings(bits=14))
    held = [r for r in got if r[0] % 7 == 2]
    assert sum(r[5] for r in held) > sum(r[4] for r in held) + 0.2 * sum(r[1] for r in held)


def small_model(leaves, seed=0, bits=6):
    draw = np.random.default_rng(seed)
    names = np.sort(draw.integers(0, 2**63, leaves).astype(np.uint64))
    counts = draw.integers(1, 1000, leaves)
    vocab = maxent.vocabulary(names, counts, int(counts.sum()) + 700, leaves + 300, 40, leaves)
    weights = draw.standard_normal((1 << bits, ARY)).astype(np.float32)
    return vocab, weights, bits


@pytest.mark.parametrize("leaves", [0, 1, 13, 14, 15, 300])
def test_probabilities_sum_to_one(leaves):
    vocab, weights, bits = small_model(leaves)
    every = np.arange(leaves + 2)
    for seed in range(3):
        context = np.repeat(np.random.default_rng(seed).integers(0, 2**63, (len(CONTEXTS), 1)).astype(np.uint64), len(every), axis=1)
        logs = maxent.log_probabilities(vocab.classes, weights, every, context, bits)
        assert abs(np.exp(logs).sum() - 1) < 1e-5
    # Known rare words and one unseen word share the rest: 700 tokens of 300 words.
    assert math.isclose((700 + 300 + 1) / (vocab.rare_total + vocab.rare_words + 1), 1)


def test_without_weights_a_class_member_has_its_share():
    mass = np.array([50, 1, 7, 200, *range(1, 60)])
    classes = nested_classes(mass)
    logs = maxent.log_probabilities(classes, np.zeros((16, ARY), np.float32), np.arange(len(mass)), np.zeros((len(CONTEXTS), len(mass)), np.uint64), 4)
    assert np.allclose(np.exp(logs), mass / mass.sum(), rtol=1e-4)


def plain_log(vocab, weights, bits, leaf, context):
    out = 0.0
    c = vocab.classes
    for at in range(c.start[leaf], c.start[leaf + 1]):
        node, member = int(c.node[at]), int(c.member[at])
        rows = [((int(x) ^ int(c.salt[node])) * int(maxent._FOLD) % 2**64) >> (64 - bits) for x in context]
        logits = [float(c.base[node][j]) + sum(float(weights[r][j]) for r in rows) for j in range(ARY)]
        out += logits[member] - math.log(sum(math.exp(x) for x in logits))
    return out


def test_log_probabilities_against_plain_python():
    vocab, weights, bits = small_model(120)
    draw = np.random.default_rng(9)
    leaf = draw.integers(0, 122, 200)
    contexts = draw.integers(0, 2**63, (len(CONTEXTS), 200)).astype(np.uint64)
    got = maxent.log_probabilities(vocab.classes, weights, leaf, contexts, bits)
    assert np.allclose(got, [plain_log(vocab, weights, bits, leaf[i], contexts[:, i]) for i in range(200)], atol=1e-4)


def test_an_update_follows_the_numeric_gradient():
    vocab, weights, bits = small_model(40, bits=5)
    draw = np.random.default_rng(3)
    leaf, contexts = draw.integers(0, 42, 60), draw.integers(0, 2**63, (len(CONTEXTS), 60)).astype(np.uint64)

    def loss(w):
        return -sum(plain_log(vocab, w, bits, leaf[i], contexts[:, i]) for i in range(60))

    learner = Learner(weights, 0.1)
    learner.update(vocab.classes, leaf, contexts)
    step = learner.weights - weights
    for r, j in draw.integers(0, 16, (12, 2)) + [[5, 0]] * 12:
        more, less = weights.astype(np.float64), weights.astype(np.float64)
        more[r, j] += 1e-4
        less[r, j] -= 1e-4
        slope = (loss(more) - loss(less)) / 2e-4
        assert abs(step[r, j] + 0.1 * slope / math.sqrt(learner.squares[r] + 1e-6)) < 1e-3
    assert loss(learner.weights) < loss(weights)


def test_averages_are_weighted_by_use():
    change = np.arange(2 * ARY, dtype="<f2").reshape(2, ARY)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 3], pa.int32()), pa.array([1, 2, 1], pa.int64()), pa.array([change.tobytes(), (change + 4).tobytes(), change.tobytes()]),
         pa.array([np.array(u, "<u4").tobytes() for u in ([1, 0], [3, 2], [0, 5])])], ["block", "task", "change", "used"])
    got = {r.column(0)[0].as_py(): np.frombuffer(r.column(1)[0].as_py(), "<f4").reshape(2, ARY) for r in maxent._averaged_rows(iter([batch]))}
    assert np.allclose(got[0], np.stack([change[0] + 3.0, change[1] + 4.0])) and np.allclose(got[3], np.stack([change[0] * 0, change[1]]))


def test_empty_tables(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(2, "nothing is learned")])
    assert only[1:4] == (4, 0, 0) and only[4] == 0 and only[5] <= 0
