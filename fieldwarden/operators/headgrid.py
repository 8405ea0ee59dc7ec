"""All linear heads of a grid, fitted in shared passes.

A pass evaluates loss and gradient of every open trial over the same rows:
each task multiplies its rows with the stacked weights and sends one row per
trial. The driver keeps the steps (L-BFGS per trial), whose size is that of
the models. Trials that differ in their number of steps are points on one
path.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..session import staged
from .features import frequent_fields
from .heads import Trial
from .policy import usable
from .scale import running_totals

#: Steps that L-BFGS remembers; a step is halved at most so often before the trial stops.
MEMORY, HALVINGS = 8, 12
#: Least standard deviation by which an input is divided.
FLOOR = 1e-6


@dataclass(frozen=True)
class LinearHeads:
    """Linear heads over standardised inputs side by side: one column of ``weights`` and ``prior`` per trial.

    ``prior`` has a row per field of ``fields`` and none for others: a field
    without a prior adds exactly nothing.
    """

    trials: tuple[Trial, ...]
    sizes: Mapping[str, int]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    fields: tuple[str, ...] = ()
    prior: np.ndarray | None = None

    def logits(self, rows: DataFrame) -> DataFrame:
        """Rows with ``logits``, one per trial; null where an input is missing."""
        scale = self.weights / self.std[:, None]
        shift = self.bias - self.mean @ scale
        at = {f: i for i, f in enumerate(self.fields)}
        prior = self.prior if self.prior is not None else np.zeros((0, len(self.trials)))
        size = len(self.mean)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, known = _matrix(batch.column("__x"), size)
                z = np.full((batch.num_rows, len(shift)), np.nan)
                z[known] = x @ scale + shift
                number = np.array([at.get(f, -1) for f in batch.column("__field").to_pylist()], np.int64)
                z[number >= 0] += prior[number[number >= 0]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * len(shift)), pa.array(z.ravel()),
                                                 mask=pa.array(~known))
                keep = [i for i, name in enumerate(batch.schema.names) if name not in ("__x", "__field")]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], lists], [*[batch.schema.names[i] for i in keep], "logits"])

        field = F.col("field_id") if "field_id" in rows.columns else F.lit(None).cast("string")
        ready = rows.select("*", stacked(self.sizes).alias("__x"), field.alias("__field"))
        return ready.mapInArrow(found, _with(rows, "logits array<double>"))


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{name}` {kind}" for name, kind in rows.dtypes] + [more])


def stacked(sizes: Mapping[str, int]) -> Column:
    """All array inputs one after the other as doubles; null if one is missing."""
    return F.concat(*[F.transform(name, lambda x: x.cast("double")) for name in sizes])


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    kept = column.filter(pa.array(known))
    return kept.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), known


def _sums(parts: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Vectors of all tasks (``key, task, value``) added up per key; a key's vectors stream through one task in a fixed order."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
                vector = np.frombuffer(value)
                if key != last:
                    if last is not None:
                        yield _row(last, total)
                    last, total = key, vector.copy()
                else:
                    total += vector
        if last is not None:
            yield _row(last, total)

    def _row(key: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "value"])

    summed = parts.repartition(max(1, min(count, 64)), "key").sortWithinPartitions("key", "task").mapInArrow(added, "key int, value binary")
    return {r["key"]: np.frombuffer(r["value"]) for r in summed.collect()}


_PART = "key int, task bigint, value binary"


def _parts(keys: Sequence[int], values: Sequence[np.ndarray]) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([task] * len(keys), pa.int64()),
                                       pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())], ["key", "task", "value"])


def _moments(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * size)
        for batch in batches:
            x, _ = _matrix(batch.column("x"), size)
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield _parts([0], [total])
    return rows


def _slopes(size: int, fields: int, keys: Sequence[int], points: np.ndarray):
    """Per open trial: rows, loss and gradient (inputs, intercept, fields) of one task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, count = np.zeros(len(keys)), np.zeros_like(points), 0
        for batch in batches:
            x, _ = _matrix(batch.column("x"), size)
            y, field = batch.column("y").to_numpy()[:, None], batch.column("field").to_numpy()
            known = field > 0
            z = x @ points[:size] + points[size]
            z[known] += points[size + field[known]]
            count += len(x)
            loss += (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum(0)
            gap = 0.5 * (1 + np.tanh(z / 2)) - y
            slope[:size] += x.T @ gap
            slope[size] += gap.sum(0)
            if fields:
                np.add.at(slope, size + field[known], gap[known])
        yield _parts(keys, [np.concatenate([[count, loss[i]], slope[:, i]]) for i in range(len(keys))])
    return rows


class _Path:
    """One trial while it is fitted: L-BFGS with halved steps."""

    def __init__(self, size: int, free: np.ndarray, penalised: np.ndarray, l2: float, steps: Sequence[int], tolerance: float):
        self.at = np.zeros(size)
        self.free, self.penalised, self.l2, self.tolerance = free, penalised, l2, tolerance
        self.wanted, self.kept = set(steps), {}
        self.most = max(steps)
        self.loss, self.slope, self.taken, self.done = np.inf, None, 0, False
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.halved, self.point = None, 0, self.at

    def update(self, count: float, loss: float, slope: np.ndarray) -> None:
        """Take in the sums at ``point`` and choose the next one."""
        held = np.where(self.penalised, self.point, 0)
        loss = loss / count + self.l2 * held @ held
        slope = np.where(self.free, slope / count + 2 * self.l2 * held, 0)
        if self.step is not None:
            if not loss <= self.loss + 1e-4 * (self.slope @ (self.point - self.at)) + 1e-14:
                self.halved += 1
                self.step = self.step / 2
                self.point = self.at + self.step
                if self.halved >= HALVINGS:
                    self._finish()
                return
            self.pairs = [*self.pairs, (self.point - self.at, slope - self.slope)][-MEMORY:]
            self.taken += 1
        self.at, self.loss, self.slope = self.point, loss, slope
        if self.taken in self.wanted:
            self.kept[self.taken] = self.at.copy()
        if np.abs(slope).max(initial=0) < self.tolerance or self.taken >= self.most:
            self._finish()
            return
        self.step, self.halved = self._direction(), 0
        self.point = self.at + self.step

    def _finish(self) -> None:
        # A path that ends early stays where it is for every later snapshot.
        self.done = True
        for k in self.wanted - set(self.kept):
            self.kept[k] = self.at.copy()

    def _direction(self) -> np.ndarray:
        q, stack = self.slope.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ q / (y @ s) if y @ s > 1e-18 else 0.0
            stack.append(a)
            q -= a * y
        if self.pairs and self.pairs[-1][0] @ self.pairs[-1][1] > 1e-18:
            s, y = self.pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(stack)):
            if y @ s > 1e-18:
                q += s * (a - y @ q / (y @ s))
        return -q


def fit_linear_heads(rows: DataFrame, trials: Sequence[Trial], sizes: Mapping[str, int], prior_least: int = 16,
                     tolerance: float = 1e-5) -> tuple[LinearHeads, int]:
    """Fit every linear trial on rows with array inputs, ``field_id`` and ``correct``; also how many passes it took.

    The penalised mean logistic loss of standardised inputs, as for one head
    alone. A prior has a coefficient for each field with ``prior_least`` rows.
    Rows without a trace are left out; without any row all weights are 0.
    """
    wrong = [t.name for t in trials if t.mode != "linear" or set(t.inputs) - set(sizes)]
    if wrong:
        raise ValueError(f"not linear trials over {sorted(sizes)}: {wrong}")
    size = sum(sizes.values())
    keys = staged(frequent_fields(rows, prior_least).select("field_id", "prior_index"), "prior") if any(t.prior for t in trials) else None
    fields = tuple(r[0] for r in keys.orderBy("prior_index").select("field_id").collect()) if keys is not None else ()
    joined = rows if keys is None else rows.join(keys, "field_id", "left")
    number = F.lit(0) if keys is None else F.coalesce("prior_index", F.lit(0))
    raw = staged(joined.select(stacked(sizes).alias("x"), F.col("correct").cast("double").alias("y"), number.cast("bigint").alias("field"))
                 .filter("x is not null and y is not null"), "head_rows")
    total = _sums(raw.mapInArrow(_moments(size), _PART), 1).get(0, np.zeros(1 + 2 * size))
    count = max(total[0], 1)
    mean = total[1:size + 1] / count
    std = np.maximum(np.sqrt(np.maximum(total[size + 1:] / count - mean ** 2, 0) * count / max(count - 1, 1)), FLOOR)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column("x"), size)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(((x - mean) / std).ravel()))
            yield pa.RecordBatch.from_arrays([flat, batch.column("y"), batch.column("field")], ["x", "y", "field"])

    ready = staged(raw.mapInArrow(scaled, "x array<double>, y double, field bigint"), "scaled")
    place, begin = {}, 0
    for name, width in sizes.items():
        place[name], begin = slice(begin, begin + width), begin + width
    paths: dict[tuple, _Path] = {}
    for t in trials:
        key = (t.inputs, t.l2, t.prior)
        steps = sorted({u.steps for u in trials if (u.inputs, u.l2, u.prior) == key})
        free = np.zeros(size + 1 + len(fields), bool)
        for name in t.inputs:
            free[place[name]] = True
        free[size] = True
        free[size + 1:] = t.prior
        penalised = free.copy()
        penalised[size] = False
        paths.setdefault(key, _Path(len(free), free, penalised, t.l2, steps, tolerance))
    every, passes = list(paths.values()), 0
    while total[0] and any(not p.done for p in every):
        open_ = [i for i, p in enumerate(every) if not p.done]
        points = np.stack([every[i].point for i in open_], axis=1)
        sums = _sums(ready.mapInArrow(_slopes(size, len(fields), open_, points), _PART), len(open_))
        for i in open_:
            every[i].update(sums[i][0], sums[i][1], sums[i][2:])
        passes += 1
    chosen = np.stack([paths[t.inputs, t.l2, t.prior].kept.get(t.steps, np.zeros(size + 1 + len(fields))) for t in trials], axis=1)
    return LinearHeads(tuple(trials), dict(sizes), mean, std, chosen[:size], chosen[size], fields, chosen[size + 1:]), passes


def trial_numbers(scored: DataFrame, target: float = .95) -> DataFrame:
    """What trials are ranked by, one row per ``trial``: ``review_rate, error_recall, aurc, auroc`` at the threshold fitted on these rows.

    ``scored`` has review rows with ``trial`` and ``score``. Rows are counted
    per trial and distinct score, and one running sum serves sweep, curve and
    ranking of all trials.
    """
    c = F.col
    counts = staged(scored.groupBy("trial", F.when(usable(), c("score")).alias("score")).agg(
        F.count("*").alias("n"), F.sum((~c("correct")).cast("bigint")).alias("errors")), "trial_counts")
    none = c("score").isNull()
    totals = counts.groupBy("trial").agg(
        F.sum("n").alias("total"), F.sum("errors").alias("all_errors"), F.coalesce(F.sum(F.when(none, c("n"))), F.lit(0)).alias("forced"),
        F.coalesce(F.sum(F.when(none, c("errors"))), F.lit(0)).alias("forced_errors"))
    swept = running_totals(counts.filter(~none), ["score"], {"upto": c("n"), "caught": c("errors")}, ["trial"]).join(totals, "trial")
    needed = F.ceil(F.lit(target) * c("all_errors")) - c("forced_errors")
    reviewed = c("caught") - c("errors") < needed
    right = c("n") - c("errors")
    # From the top: how many are accepted at or above a score, and how many of them are wrong.
    accepted = c("total") - c("forced") - c("upto") + c("n")
    missed = c("all_errors") - c("forced_errors") - c("caught") + c("errors")
    found = swept.groupBy("trial").agg(
        F.coalesce(F.max(F.when(reviewed, c("upto"))), F.lit(0)).alias("reviewed"),
        F.coalesce(F.max(F.when(reviewed, c("caught"))), F.lit(0)).alias("caught"),
        F.sum(ratio(missed, accepted) * c("n")).alias("area"),
        F.sum(right * (c("caught") - c("errors") / 2)).alias("wins"), F.sum(right).alias("right"), F.sum("errors").alias("wrong"))
    both = totals.join(found, "trial", "left").na.fill(0, ["reviewed", "caught", "area", "wins", "right", "wrong"])
    missed_all = c("wrong")
    tail = F.when(c("forced") > 0, ratio(missed_all + c("forced"), c("total")) * c("forced")).otherwise(0.0)
    return both.select(
        "trial", F.when(c("all_errors") == 0, 1.0).otherwise(ratio(c("forced") + c("reviewed"), c("total"))).alias("review_rate"),
        ratio(c("forced_errors") + c("caught"), c("all_errors")).alias("error_recall"), ratio(c("area") + tail, c("total")).alias("aurc"),
        ratio(c("wins"), c("right") * c("wrong")).alias("auroc"))


def score_linear_trials(train: DataFrame, dev: DataFrame, trials: Sequence[Trial], sizes: Mapping[str, int],
                        target: float = .95) -> tuple[LinearHeads, DataFrame]:
    """Fit all linear trials on ``train`` and rank them on ``dev``: the heads, and one written row per trial."""
    from ..functions.numbers import sigmoid

    heads, _ = fit_linear_heads(train, trials, sizes)
    named = F.array(*[F.struct(F.lit(t.name).alias("trial"), F.lit(t.family).alias("family"), F.get("logits", F.lit(i)).alias("logit"))
                      for i, t in enumerate(trials)])
    slim = dev.select(*[x for x in dev.columns if x in ("status", "shape_violation", "correct", "field_id", *sizes)])
    scored = heads.logits(slim).select("status", "shape_violation", "correct", F.inline(named)).withColumn("score", sigmoid(F.col("logit")))
    families = dev.sparkSession.createDataFrame(sorted({(t.name, t.family) for t in trials}), "trial string, family string")
    return heads, staged(trial_numbers(scored, target).join(families, "trial"), "trials")
