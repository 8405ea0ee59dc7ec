"""Hard negatives against a plain search over all pairs in Python integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from fieldwarden.llm import negatives
from fieldwarden.llm.negatives import Mining, hard_negatives, score_bounds
from pyspark.sql import functions as F

LONG = 2**63 - 1


def brute_force(rows, every, mining=Mining()):
    def good(i, v, label):
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)

    known = [(i, [math.floor(mining.scale * float(x)) for x in v], label) for i, v, label in rows if good(i, v, label)]
    anchors, plain = {}, {}
    for (i, v, label), source in zip(known, [r[1] for r in rows if good(*r)]):
        if i % every == 0 and (i not in anchors or (label, source) < plain[i]):
            anchors[i], plain[i] = (v, label), (label, source)
    out = []
    for a, (x, label) in anchors.items():
        def score(y):
            return max(-LONG, min(LONG, sum(p * q for p, q in zip(x, y))))

        others = sorted(((-score(y), i, m) for i, y, m in known if i != a and len(x) == len(y)))
        for p, positive, _ in [o for o in others if o[2] == label][:mining.positives]:
            p = -p
            fits = [o for o in others if o[2] != label and mining.least * p <= -100 * o[0] <= mining.most * p]
            out += [(a, positive, rank, i, p, -n) for rank, (n, i, _) in enumerate(fits[:mining.negatives], 1)]
    return sorted(out)


def corpus(seed, count, size=16, spread=0.4):
    draw = np.random.default_rng(seed)
    centers = draw.standard_normal((5, size))
    rows = [(i, (centers[draw.integers(5)] + spread * draw.standard_normal(size)).astype(np.float32).tolist(), int(draw.integers(4)))
            for i in range(count)]
    rows += [(count + k, rows[k][1], (rows[k][2] + k) % 4) for k in range(40)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * size, 1), (100, [0.0] * size, 2), (n + 2, [1.0] * (size - 1) + [None], 1),
                   (n + 3, [float("nan")] * size, 1), (n + 4, rows[0][1], None), (None, rows[0][1], 1), (n + 5, [], 1),
                   (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 1.0], 1), (1000, [1.0, 1.0], 1), (n + 8, [0.3, 0.4], 0),
                   (0, rows[3][1], 0), (7, rows[0][1], rows[0][2]), (n + 9, [float("inf")] * size, 0)]


def run(spark, rows, every, mining=Mining(), kind="float"):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, rank int, vector string")
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, mining).collect()))


@pytest.mark.parametrize("group,part", [(1 << 14, 1 << 20), (8, 200)])
def test_all_pairs(spark, monkeypatch, group, part):
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "PART", part)
    rows = corpus(group, 900)
    got = run(spark, rows, 25)
    assert got == brute_force(rows, 25) and len(got) > 1000


def test_other_parameters(spark):
    mining = Mining(positives=2, negatives=3, least=-50, most=100, scale=3, references=4)
    rows = corpus(3, 200)
    assert run(spark, rows, 10, mining) == brute_force(rows, 10, mining)


def test_values_beyond_doubles_and_longs(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.standard_normal(4) * 10.0 ** draw.integers(0, 12)).tolist(), i % 2) for i in range(60)]
    assert run(spark, rows, 10, kind="double") == brute_force(rows, 10)


def test_bounds_hold():
    draw = np.random.default_rng(1)
    refs = negatives.directions(8, np.zeros((0, 0)), 5)
    for spread in (0.0, 1e-9, 0.01, 1.0):
        a = np.floor(256 * draw.standard_normal((50, 8)))
        rows = np.floor(256 * (draw.standard_normal(8) + spread * draw.standard_normal((20, 8))))
        rows[0] = a[0]
        angles = negatives._angles(rows, refs).astype(np.float32)
        norms = np.linalg.norm(rows, axis=1)
        below, above = score_bounds(negatives._angles(a, refs).astype(np.float32), np.linalg.norm(a, axis=1), angles.min(axis=0), angles.max(axis=0),
                                    norms.min(), norms.max())
        scores = a @ rows.T
        assert np.all(below <= scores.min(axis=1)) and np.all(above >= scores.max(axis=1))


def test_far_slices_are_not_multiplied():
    draw = np.random.default_rng(4)
    centers = np.eye(16)[:4] * 50
    values = np.floor(centers[np.arange(4000) // 1000] + draw.standard_normal((4000, 16)))
    angles = negatives._angles(values, negatives.directions(16, centers, 4))
    table = pa.table({"vec_id": np.arange(4), "label": np.zeros(4, np.int64), "vector": [v.tolist() for v in values[::1000]],
                      "angles": [a.tolist() for a in angles[::1000]]})
    anchors = negatives.Anchors(table, 16, Mining(scale=1, references=4), False)
    pairs = [anchors.meet(np.arange(b, b + 100) + 10, 0, values[b:b + 100], angles[b:b + 100]) for b in range(0, 4000, 100)]
    anchors.best.settle()
    again = sum(anchors.meet(np.arange(b, b + 100) + 10, 0, values[b:b + 100], angles[b:b + 100]) for b in range(0, 4000, 100))
    assert sum(pairs) <= 4 * 4000 and again <= 4 * 4000 * 0.3


def test_empty_tables(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 0)], 10) == []
    assert run(spark, [(10, [1.0], 0)], 10) == []
