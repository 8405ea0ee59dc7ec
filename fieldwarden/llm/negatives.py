"""Hard negatives of anchor vectors by integer inner products, filtered with the triangle inequality of angles.

Every vector keeps its angles to a few reference directions. For an anchor
and a slice of rows whose angles lie in known intervals, the triangle
inequality bounds the angle between them, and with the norms their score.
Only slices whose bounds meet a window that the anchor still looks for are
multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, staged, task_count
from .registry import query


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, which share of the positive's score a negative may have (percent), the grid of values."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90
    scale: int = 256
    references: int = 16


#: Anchors that one task holds, and rows that pass by them in one task at most.
GROUP, PART = 1 << 14, 1 << 20
#: Rows whose bounds are taken together.
SLICE = 256
#: Beyond the error of an angle in single precision and of the arc cosine near its ends.
ANGLE_SLACK = 4e-6
#: Products of norms below this are exact sums in double precision.
EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def directions(size: int, sample: np.ndarray, count: int) -> np.ndarray:
    """Unit reference directions of one vector length: the sampled rows if they have that length, else fixed random ones."""
    found = sample if sample.shape[1:] == (size,) and len(sample) else np.random.default_rng(size).standard_normal((count, size))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _angles(values: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a zero vector stands at a right angle to all."""
    top = np.maximum(np.abs(values).max(axis=1, keepdims=True), 1e-300)
    scaled = values / top
    norm = np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip(scaled / norm @ refs.T, -1, 1))


def _angle_rows(scale: int, sample: np.ndarray, count: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                values = np.floor(scale * _matrix(part.column("vector"), int(size)))
                angles = _angles(values, directions(int(size), sample, count)).astype(np.float32)
                cell = angles.argmin(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("vec_id", "label", "size", "vector")], flat, pa.array(cell.astype(np.int32)),
                     pa.array(angles[np.arange(len(cell)), cell])],
                    ["vec_id", "label", "size", "vector", "angles", "cell", "own"])
    return rows


def score_bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray,
                 least_norm: float, most_norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of each anchor with rows whose angles and norms lie in the given intervals.

    Wider than the true bounds by more than rounding can take away.
    """
    near = np.maximum(np.maximum(angles - high, low - angles).max(axis=1), 0)
    far = np.minimum(angles + high, 2 * np.pi - angles - low).min(axis=1)
    most = np.cos(np.clip(near - ANGLE_SLACK, 0, np.pi))
    least = np.cos(np.clip(far + ANGLE_SLACK, 0, np.pi))
    slack = 1 + norms * most_norm * 1e-9
    return (norms * least * np.where(least >= 0, least_norm, most_norm) - slack,
            norms * most * np.where(most >= 0, most_norm, least_norm) + slack)


def exact_scores(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-number rows; beyond doubles in Python integers, beyond a long as the nearest long."""
    if bound < EXACT:
        return left @ right.T
    whole = [[int(x) for x in row] for row in right]
    return np.array([[max(-_LONG, min(_LONG, sum(int(a) * b for a, b in zip(row, other)))) for other in whole] for row in left],
                    np.int64).reshape(len(left), len(right))


class Best:
    """The first ``count`` rows of many keys: highest score, then smallest id."""

    def __init__(self, keys: int, count: int):
        self.count = count
        self.floor = np.full(keys, -np.inf)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.new.append((key, score, row))
        self.waiting += len(key)
        if self.waiting > max(1 << 16, len(self.held[0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, score and id of the rows kept; ``floor`` is the last kept score of each full key."""
        key, score, row = (np.concatenate(c) for c in zip(self.held, *self.new))
        order = np.lexsort((row, -score, key))
        key, score, row = key[order], score[order], row[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.count
        self.held = key[keep], score[keep], row[keep]
        full = place == self.count - 1
        self.floor[key[full]] = score[full]
        self.new, self.waiting = [], 0
        return self.held


class Anchors:
    """Anchors of one task, by label, with the score windows that each of them looks for."""

    def __init__(self, table: pa.Table, size: int, mining: Mining, windows: bool):
        self.id = table.column("vec_id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.values = np.floor(mining.scale * _matrix(table.column("vector").combine_chunks(), size))
        self.angles = _matrix(table.column("angles").combine_chunks(), mining.references)
        self.norm = np.linalg.norm(self.values, axis=1)
        self.windows = windows
        if windows:
            self.count = mining.positives
            self.low, self.high = np.ones((len(self.id), self.count), np.int64), np.zeros((len(self.id), self.count), np.int64)
            for i, scores in enumerate(table.column("scores").to_pylist()):
                for k, p in enumerate(scores or []):
                    self.low[i, k], self.high[i, k] = -(-mining.least * p // 100), mining.most * p // 100
            self.best = Best(self.low.size, mining.negatives)
        else:
            self.count = 1
            self.low, self.high = np.full((len(self.id), 1), -_LONG), np.full((len(self.id), 1), _LONG)
            self.best = Best(self.low.size, mining.positives)

    def meet(self, row_id: np.ndarray, label: int, values: np.ndarray, angles: np.ndarray) -> int:
        """Score the rows of a slice against the anchors that they can matter to; how many pairs were multiplied."""
        same = slice(np.searchsorted(self.label, label), np.searchsorted(self.label, label, side="right"))
        chosen = np.arange(len(self.id))
        chosen = np.delete(chosen, same) if self.windows else chosen[same]
        if not len(chosen):
            return 0
        norms = np.linalg.norm(values, axis=1)
        below, above = score_bounds(self.angles[chosen], self.norm[chosen], angles.min(axis=0), angles.max(axis=0), norms.min(), norms.max())
        # Scores end at the longs, so do their bounds.
        below, above = np.minimum(below, _LONG), np.maximum(above, -_LONG)
        # A window that is full wants its last kept score or more.
        low = np.maximum(self.low, self.best.floor.reshape(self.low.shape))[chosen]
        high = self.high[chosen].astype(np.float64)
        open_ = low <= high
        wanted = (open_ & (above[:, None] >= low) & (below[:, None] <= high)).any(axis=1)
        chosen, low, high, open_ = chosen[wanted], low[wanted], high[wanted], open_[wanted]
        if not len(chosen):
            return 0
        scores = exact_scores(self.values[chosen], values, self.norm[chosen].max() * norms.max())
        least, most = np.where(open_, low, np.inf).min(axis=1), np.where(open_, high, -np.inf).max(axis=1)
        a, r = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]))
        found = scores[a, r].astype(np.int64)
        for k in range(self.count):
            hit = ((found >= self.low[chosen[a], k]) & (found <= self.high[chosen[a], k]) & (found >= low[a, k])
                   & (row_id[r] != self.id[chosen[a]]))
            if hit.any():
                self.best.add(chosen[a[hit]] * self.count + k, found[hit], row_id[r[hit]])
        return len(chosen) * len(row_id)


def _scan(mining: Mining, windows: bool):
    """Rows ``anchor_id, k, score, row_id``: what the anchors of a task keep of the rows that pass by."""
    def kept(anchors: Anchors | None) -> Iterator[pa.RecordBatch]:
        if anchors is not None:
            key, score, row = anchors.best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(anchors.id[key // anchors.count]), pa.array((key % anchors.count).astype(np.int32)),
                                              pa.array(score), pa.array(row)], ["anchor_id", "k", "score", "row_id"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_key, waiting, anchors = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("size", "grp", "part", "side", "label", "cell")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for begin, end in zip([0, *change], [*change, batch.num_rows]):
                if begin == end:
                    continue
                size, *at, side, label, _ = (int(c[begin]) for c in columns)
                if (size, *at) != cell_key:
                    yield from kept(anchors)
                    cell_key, waiting, anchors = (size, *at), [], None
                run = batch.slice(begin, end - begin)
                if side == 0:
                    waiting.append(run)
                    continue
                if anchors is None:
                    if not waiting:
                        continue
                    anchors, waiting = Anchors(pa.Table.from_batches(waiting), size, mining, windows), []
                for first in range(0, run.num_rows, SLICE):
                    part = run.slice(first, SLICE)
                    anchors.meet(part.column("vec_id").to_numpy(), label, np.floor(mining.scale * _matrix(part.column("vector"), size)),
                                 _matrix(part.column("angles"), mining.references))
        yield from kept(anchors)
    return rows


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, parts: int, mining: Mining, windows: bool) -> DataFrame:
    """Every group of anchors against every part of the rows, each pair of them in one task."""
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, parts)]
    hashed = [F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int") for n in (groups, parts)]
    if not windows:
        anchors = anchors.withColumn("scores", F.array().cast("array<bigint>"))
    both = anchors.select("*", hashed[0].alias("grp"), every[1].alias("part"), F.lit(0).alias("side")).unionByName(
        rows.select("*", every[0].alias("grp"), hashed[1].alias("part"), F.lit(1).alias("side"),
                    F.lit(None).cast("array<bigint>").alias("scores")))
    keys = ["size", "grp", "part"]
    return (both.repartition(max(groups * parts, 1), *keys).sortWithinPartitions(*keys, "side", "label", "cell", "own", "vec_id")
            .mapInArrow(_scan(mining, windows), "anchor_id bigint, k int, score bigint, row_id bigint"))


def _first(found: DataFrame, keys: list[str], count: int, name: str) -> DataFrame:
    """The first rows of each key; a task sent ``count`` at most, so a key has few rows."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= count)


def hard_negatives(vectors: DataFrame, anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, embedding, label``).

    Components become ``floor(scale * x)``, scores are their integer inner
    products, higher scores come first, ties by smaller id. The positives of
    an anchor (rows where ``anchor`` holds) are its first other rows of the
    same label. Each of them has its own window of scores, from ``least`` to
    ``most`` percent of its score; the first rows of other labels inside are
    its hard negatives. A positive without any gives no row.

    Rows with a null id, label or vector, an empty vector, or a null, NaN or
    infinite component take no part; zero vectors do. Vectors of different
    lengths do not meet. Another row is one with another id: rows that repeat
    an id are candidates of their own, but one anchor, the row with the least
    label and vector. Scores beyond a long count as the nearest long. Empty
    tables give no rows, further columns are left aside.

    All anchors meet all rows, in groups of ``GROUP`` anchors and parts of up
    to ``PART`` rows: a row travels once per group, an anchor once per part.
    """
    spark = vectors.sparkSession
    value = F.col("embedding")
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & (F.size(value) > 0)
              & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    rows = vectors.withColumn("__anchor", F.coalesce(anchor, F.lit(False))).filter(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.size(value).alias("size"),
        value.cast(f"array<{kind}>").alias("vector"), "__anchor")
    # The rows with the smallest hashes of their ids point into the data better than random directions do.
    sample = [r[0] for r in rows.filter(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vector")
              .select("vector").limit(mining.references).collect()]
    whole = np.floor(mining.scale * np.array([s for s in sample if len(s) == len(sample[0])], np.float64)) if sample else np.zeros((0, 0))
    whole = whole[np.any(whole != 0, axis=1)]
    refs = whole / np.abs(whole).max(axis=1, keepdims=True) if len(whole) == mining.references else np.zeros((0, 0))
    columns = f"vec_id bigint, label bigint, size int, vector array<{kind}>, angles array<float>, cell int, own float"
    plain = rows.drop("__anchor")
    angled = staged(plain.mapInArrow(_angle_rows(mining.scale, refs, mining.references), columns), "angled")
    least = F.min(F.struct("label", "vector", "size"))
    anchors = rows.filter("__anchor").groupBy("vec_id").agg(least.alias("a")).select("vec_id", "a.label", "a.size", "a.vector")
    anchors = staged(anchors.mapInArrow(_angle_rows(mining.scale, refs, mining.references), columns), "anchors")

    number, asked = angled.count(), anchors.count()
    groups = max(1, -(-asked // GROUP))
    parts = max(1, -(-number // PART), -(-min(task_count(spark), number // SLICE) // groups))
    near = _searched(angled, anchors, groups, parts, mining, False)
    positives = staged(_first(near, ["anchor_id"], mining.positives, "place"), "positives")
    listed = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))
    asking = anchors.join(listed.select(F.col("anchor_id").alias("vec_id"), F.col("p.score").alias("scores")), "vec_id")
    found = _first(_searched(angled, asking, groups, parts, mining, True), ["anchor_id", "k"], mining.negatives, "rank")
    own = positives.select("anchor_id", (F.col("place") - 1).alias("k"), F.col("row_id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
    return found.join(own, ["anchor_id", "k"]).select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"),
                                                      "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
       row_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) <= 10
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector counts under the next label."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
