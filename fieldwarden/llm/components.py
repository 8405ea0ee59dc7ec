"""Connected components of an undirected graph by alternating stars, and groups cut out of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Alternations before giving up; each at least halves the length of every path, so 64 suffice for any graph.
ROUNDS = 64


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang the larger (or the smaller) neighbours of every node below its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    used = both if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The least neighbours are a staged table: both sides of the join are plain exchanges and a hub is split.
    least = staged(_least_neighbours(used), "least")
    joined = used.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.filter("a <> least").select("a", F.col("least").alias("b")))
    return staged(moved.distinct(), "stars")


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs below one other node at most and nothing hangs below it then."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        stars.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``, longs): the least node reachable.

    Loops, repeated and reversed edges change nothing; an edge with a null
    end is no edge. Every round is a table in the shared folder.
    """
    stars = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "edges")
    nodes = stars
    for _ in range(ROUNDS):
        if _settled(stars):
            break
        stars = _stars(_stars(stars, large=True), large=False)
    else:
        raise RuntimeError("components did not settle")
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return every.join(stars.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` from batches whose rows are sorted by them; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = None
        for c in columns:
            differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True)
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(i + 1 for i, x in enumerate(change.to_pylist()) if x), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(c[begin].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)
