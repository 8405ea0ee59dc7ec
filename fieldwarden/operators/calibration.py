"""Calibration of logits: ``sigmoid(logit / temperature + bias)``, fitted by Newton steps over one aggregate each.

Every step sums the gradient and curvature of all parameter sets (folds and
families together) in one pass; the driver only solves 2x2 systems. Rows with
equal logit, label and fold are combined before the first pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import logistic_loss, sigmoid
from ..session import staged
from .cohorts import folds

# Penalty on both parameters, and the ranges they are clamped to.
PENALTY, SCALE_RANGE, BIAS_RANGE = 0.001, (0.05, 20.0), (-10.0, 10.0)

#: Family name -> whether (scale, bias) are fitted. Add an entry to plug in another family.
METHODS: dict[str, tuple[bool, bool]] = {"identity": (False, False), "temperature": (True, False), "affine": (True, True)}


def calibrated(logit: Column, temperature: Column, bias: Column) -> Column:
    """Calibrated logit."""
    return logit / temperature + bias


def with_scores(rows: DataFrame, calibration: Mapping[str, float]) -> DataFrame:
    """Adds the calibrated logit and ``score``, null where there is no trace."""
    shifted = calibrated(F.col("logit"), F.lit(float(calibration["temperature"])), F.lit(float(calibration["bias"])))
    return rows.withColumn("calibrated_logit", shifted).withColumn("score", sigmoid(F.col("calibrated_logit")))


def _clamp(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


class _Fit:
    """One parameter set while it is fitted: its training rows leave out ``held_out``."""

    def __init__(self, method: str, held_out: int | None) -> None:
        self.method, self.held_out = method, held_out
        self.free = METHODS[method]
        self.at, self.step, self.best = [0.0, 0.0], [0.0, 0.0], math.inf
        self.done = not any(self.free)

    def update(self, n: float, loss: float, gs: float, gb: float, hss: float, hsb: float, hbb: float) -> None:
        """Take one damped Newton step from the summed derivatives at the current point."""
        s, b = self.at
        value = loss / n + PENALTY * (s * s + b * b)
        if value > self.best + 1e-12:  # the last step overshot: halve it
            self.step = [d / 2 for d in self.step]
            self.at = [a - d for a, d in zip(self.at, self.step, strict=True)]
            self.done = max(map(abs, self.step)) < 1e-9
            return
        self.best = value
        g = [gs / n + 2 * PENALTY * s, gb / n + 2 * PENALTY * b]
        h = [[hss / n + 2 * PENALTY, hsb / n], [hsb / n, hbb / n + 2 * PENALTY]]
        for i, free in enumerate(self.free):
            if not free:
                g[i], h[i][i], h[0][1], h[1][0] = 0.0, 1.0, 0.0, 0.0
        h[0][0], h[1][1] = max(h[0][0], 1e-6), max(h[1][1], 1e-6)
        while h[0][0] * h[1][1] - h[0][1] ** 2 <= 1e-12:
            h[0][0], h[1][1] = h[0][0] * 2, h[1][1] * 2
        d = h[0][0] * h[1][1] - h[0][1] ** 2
        move = [-(h[1][1] * g[0] - h[0][1] * g[1]) / d, -(h[0][0] * g[1] - h[0][1] * g[0]) / d]
        size = max(map(abs, move))
        self.step = [m / max(1.0, size) for m in move]
        self.at = [a + m for a, m in zip(self.at, self.step, strict=True)]
        self.done = max(abs(x) for x in g) < 1e-10 or size < 1e-9

    def result(self) -> dict[str, float]:
        return {"temperature": 1 / _clamp(math.exp(self.at[0]), SCALE_RANGE), "bias": _clamp(self.at[1], BIAS_RANGE)}


def _pick(values: list[float]) -> Callable[[Column], Column]:
    table = F.array(*[F.lit(float(v)) for v in values])
    return lambda index: F.get(table, index)


def _solve(groups: DataFrame, fits: list[_Fit], rounds: int = 60) -> None:
    for _ in range(rounds):
        open_fits = [f for f in fits if not f.done]
        if not open_fits:
            return
        index = F.col("set")
        scale = _pick([math.exp(f.at[0]) for f in open_fits])(index)
        bias = _pick([f.at[1] for f in open_fits])(index)
        held = _pick([-1.0 if f.held_out is None else float(f.held_out) for f in open_fits])(index)
        x, y, w = F.col("logit") * scale, F.col("y"), F.col("w")
        spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(open_fits) - 1))).alias("set"))
        p = sigmoid(x + bias)
        gap, bend = (p - y) * w, p * (1 - p) * w
        sums = (spread.filter(F.col("fold") != held).groupBy("set").agg(
            F.sum(w), F.sum(logistic_loss(x + bias, y) * w), F.sum(gap * x), F.sum(gap),
            F.sum(bend * x * x + gap * x), F.sum(bend * x), F.sum(bend)).collect())
        for row in sums:
            open_fits[row[0]].update(*row[1:])


def _groups(rows: DataFrame) -> DataFrame:
    return staged(rows.filter(F.col("logit").isNotNull()).groupBy(
        "logit", F.col("correct").cast("double").alias("y"), "fold").agg(F.count("*").cast("double").alias("w")), "logits")


def fit_calibration(rows: DataFrame, method: str) -> dict[str, float | str]:
    """Fit one family on rows with ``logit`` and ``correct``; a single class gives the identity."""
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}")
    groups = _groups(rows.withColumn("fold", F.lit(0)))
    if groups.select("y").distinct().count() < 2:
        return {"temperature": 1.0, "bias": 0.0, "method": "identity_single_class"}
    fit = _Fit(method, None)
    _solve(groups, [fit])
    return {**fit.result(), "method": method}


def select_calibration(rows: DataFrame, count: int = 4, seed: int = 42) -> dict[str, object]:
    """Choose the family by cross-validated NLL with folds of whole documents, then refit it on all rows."""
    groups = _groups(folds(rows, count, seed))
    classes = groups.groupBy("fold").agg(F.count_distinct("y").alias("c"), F.max("y").alias("y")).collect()
    outside = {f["fold"]: {y for g in classes if g["fold"] != f["fold"] for y in ((0.0, 1.0) if g["c"] > 1 else (g["y"],))}
               for f in classes}
    fits = [_Fit(m, f) for m in METHODS for f in [*sorted(outside), None]]
    for fit in fits:
        if fit.held_out is not None and len(outside[fit.held_out]) < 2:
            fit.done = True
    _solve(groups, fits)
    losses = {}
    for method in METHODS:
        chosen = {f.held_out: f.result() for f in fits if f.method == method}
        # A fold without documents keeps the identity; it has no rows to be scored.
        of_fold = [chosen.get(f, {"temperature": 1.0, "bias": 0.0}) for f in range(count)]
        t, b = (_pick([c[name] for c in of_fold]) for name in ("temperature", "bias"))
        at = F.col("fold").cast("int")
        z = calibrated(F.col("logit"), t(at), b(at))
        losses[method] = groups.agg(F.sum(logistic_loss(z, F.col("y")) * F.col("w")) / F.sum("w")).first()[0]
    best = min(losses, key=losses.get)
    final = next(f for f in fits if f.method == best and f.held_out is None)
    totals = groups.agg(F.sum("w"), F.count_distinct("y")).first()
    method = best if totals[1] > 1 else "identity_single_class"
    result = final.result() if totals[1] > 1 else {"temperature": 1.0, "bias": 0.0}
    return {**result, "method": method, "cv_nll": losses, "fields": int(totals[0])}
