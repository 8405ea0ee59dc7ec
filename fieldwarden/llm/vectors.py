"""Embedding near-dedup by comparing all pairs of a label.

The vectors of a label are dealt into blocks and every pair of blocks is
compared exactly. Each comparison counts the links of its vectors and names
enough of them to connect what they connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, staged, task_count
from .components import connected_components, sorted_groups
from .registry import query

#: Least cosine of a link.
COSINE = 0.98
#: Least blocks of a label of more than ``SMALL`` vectors, so that a common label is many tasks.
SPLIT, SMALL = 4, 64
#: Most vectors of a block.
BLOCK = 4096
#: Vectors of a block that are compared with the other block at a time.
SLICE = 512


def _unit(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    # Scaled by the largest component first: squares of extreme values neither overflow nor vanish.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _joining(linked: np.ndarray, begin: int, columns: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Links between two classes of ``classes``, which are united; rows count from ``begin``, ``columns`` numbers the columns."""
    found = []
    for i in np.flatnonzero((linked & (classes[columns] != classes[begin:begin + len(linked), None])).any(axis=1)):
        near = columns[linked[i]]
        other, first = np.unique(classes[near], return_index=True)
        own = classes[begin + i]
        for c, k in zip(other, first):
            if c != own:
                found.append((begin + i, near[k]))
        classes[np.isin(classes, other)] = own
    return found


def _block_links(cosine: float):
    """Rows ``a, b, linked`` of every pair of blocks: per vector its linked weights on the other side, and joining links."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["label", "size", "left", "right"]):
            side = group.column("side").to_numpy()
            group = group.take(pa.array(np.argsort(side, kind="stable")))
            size, rows_left = group.column("size")[0].as_py(), int((side == 0).sum())
            uid, weight = group.column("uid").to_numpy(), group.column("weight").to_numpy()
            unit = _unit(group.column("vector"), size)
            alone = rows_left == len(uid)
            if alone and group.column("left")[0].as_py() != group.column("right")[0].as_py() or not rows_left:
                continue
            columns = np.arange(len(uid)) if alone else np.arange(rows_left, len(uid))
            count, classes, found = np.zeros(len(uid), np.int64), np.arange(len(uid)), []
            for begin in range(0, rows_left, SLICE):
                end = min(begin + SLICE, rows_left)
                linked = unit[begin:end] @ unit[columns].T >= cosine
                if alone:
                    linked &= columns > np.arange(begin, end)[:, None]
                if linked.any():
                    count[begin:end] += linked @ weight[columns]
                    count[columns] += weight[begin:end] @ linked
                    found += _joining(linked, begin, columns, classes)
            seen = np.flatnonzero(count)
            a = np.concatenate([uid[seen], uid[[i for i, _ in found]]]) if found else uid[seen]
            b = [None] * len(seen) + [int(uid[j]) for _, j in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*count[seen].tolist(), *[None] * len(found)], pa.int64())],
                ["a", "b", "linked"])
    return rows


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int | None = None,
                           window: int | None = None) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id, embedding, label``): ``vec_id, n_links, component_id, kept``.

    Vectors are compared under equal labels only. A null label or vector, an
    empty or zero vector, and one that holds a null, NaN or infinite component
    is linked with nothing, as are vectors of different lengths. Equal vectors
    are one node with a weight, and linked. Rows that repeat an id are vectors
    of their own; without an id a row is linked to equal vectors alone, has no
    component if those have no id either, and is never kept.

    All pairs of a label are compared, so no link is missed however dense the
    label is; the work grows with the square of its distinct vectors, the
    copies of a vector with their number by ``BLOCK``. ``passes`` and
    ``window`` set an earlier search by neighbours and have no effect.
    """
    value = F.col("embedding")
    usable = (F.col("label").isNotNull() & value.isNotNull() & (F.size(value) > 0)
              & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists(value, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", value.cast("array<double>").alias("vector"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    name = [F.when(F.col("usable"), F.xxhash64(F.lit(seed), "label", "vector")) for seed in (1, 2)]
    rows = rows.withColumn("x", name[0]).withColumn("y", name[1])
    nodes = staged(rows.filter("usable").groupBy("x", "y").agg(
        F.min("vec_id").alias("uid"), F.count("*").alias("weight"), F.first("label").alias("label"),
        F.first("vector").alias("vector")), "nodes")
    known = nodes.filter("uid is not null").select("uid", "label", F.size("vector").alias("size"), "vector", "weight")
    n = F.count("*")
    sizes = staged(known.groupBy("label", "size").agg(F.least(F.ceil(n / SMALL), F.greatest(F.lit(SPLIT), F.ceil(n / BLOCK)))
                                                      .cast("int").alias("blocks")), "sizes")
    dealt = known.join(sizes, ["label", "size"]).withColumn("own", F.expr("pmod(xxhash64(uid), blocks)").cast("int"))
    # A block meets itself and every other one once.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("own", other).alias("left"), F.greatest("own", other).alias("right"), (F.col("own") > other).cast("int").alias("side")))
    keys = ["label", "size", "left", "right"]
    spread = dealt.select("label", "size", "uid", "vector", "weight", F.inline(meets))
    near = staged(spread.repartition(task_count(vectors.sparkSession), *keys).sortWithinPartitions(*keys)
                  .mapInArrow(_block_links(cosine), "a bigint, b bigint, linked bigint"), "near")
    components = staged(connected_components(near.filter("b is not null").select("a", "b")), "components")
    counts = near.filter("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("linked").alias("linked"))
    per_node = staged(nodes.select("x", "y", "uid", "weight").join(components.withColumnRenamed("node", "uid"), "uid", "left")
                      .join(counts, "uid", "left").select(
        "x", "y", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n"),
        F.coalesce("component", "uid").alias("component")), "per_node")
    out = rows.select("vec_id", "x", "y").join(per_node, ["x", "y"], "left")
    component = F.coalesce("component", F.when(F.col("x").isNull(), F.col("vec_id")))
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


@query("op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its class."""
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
