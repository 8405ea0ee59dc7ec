"""Vector classes against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldwarden.llm import vectors
from test_jaccard import closure


def brute_force(rows, cosine=0.98):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, n = [], [0] * len(rows)
    for i, (a, x, k) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b, y, m = rows[j]
            if k == m and good(x, k) and good(y, m) and len(x) == len(y):
                if np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links.append((a, b))
                    n[i] += 1
                    n[j] += 1
    least = closure([r[0] for r in rows], links)
    return sorted((a, n[i], least[a], a == least[a]) for i, (a, _, _) in enumerate(rows))


def corpus(seed, count, dense):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        v = draw.standard_normal(16)
        rows.append([v, i % 3])
        if i % 4 == 0:
            rows.append([v + draw.standard_normal(16) * 0.12, i % 3])
        if i % 9 == 0:
            rows.append([v.copy(), i % 3])
    center = draw.standard_normal(16)
    rows += [[center + draw.standard_normal(16) * 0.11, 1] for _ in range(dense)]
    out = [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]
    n = len(out)
    out += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 15 + [None], 1), (n + 3, [1.0] * 15 + [float("nan")], 1),
            (n + 4, out[0][1], None), (n + 5, out[0][1], 2), (n + 6, [], 1), (n + 7, [2 * x for x in out[0][1]], 0),
            (n + 8, [1.0, 2.0], 0), (n + 9, [1.0, 2.0], 0), (n + 10, [1.0] * 15 + [float("inf")], 1)]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, component string")
    return sorted(map(tuple, vectors.near_duplicate_vectors(df, **more).collect()))


@pytest.mark.parametrize("block", [1024, 16])
def test_links_and_classes(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = corpus(block, 150, 70)
    assert run(spark, rows) == brute_force(rows)


def test_recall_of_narrow_windows(spark):
    rows = corpus(3, 400, 0)
    want, got = brute_force(rows), run(spark, rows, window=4)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("mutual", [0.9, 0.95])
def test_dense_label_much_larger_than_a_window(spark, mutual):
    # Vectors around one direction, which nearly all have that cosine with each other, and isolated linked pairs.
    draw, count, pairs = np.random.default_rng(17), 6000, 300
    center, other = np.eye(64)[0], draw.standard_normal((count, 63))
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    inner = (0.983 - mutual) / (1 - mutual)
    noise = other[pairs:2 * pairs] - (other[pairs:2 * pairs] * other[:pairs]).sum(axis=1, keepdims=True) * other[:pairs]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other[pairs:2 * pairs] = inner * other[:pairs] + math.sqrt(1 - inner**2) * noise
    x = (math.sqrt(mutual) * center + np.pad(other, ((0, 0), (1, 0))) * math.sqrt(1 - mutual)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1)).tolist()
    assert {(i, i + pairs) for i in range(pairs)} <= set(map(tuple, linked))
    n, least = np.bincount(np.ravel(linked), minlength=count), closure(range(count), linked)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_duplicate_vectors(df).collect()))
    assert got == [(i, n[i], least[i], least[i] == i) for i in range(count)]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [5.0, 5.0], 0)],
                               "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(str, map(tuple, vectors.near_duplicate_vectors(df).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False)]))
