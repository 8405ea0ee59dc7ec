"""Building blocks that keep ordered and keyed work spread over tasks.

A plain window over a whole table, or over a group that holds a third of it,
puts those rows into one task. The functions here give the same results from
many tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged, task_count

#: Rows of an ordered slice: a table is cut into about as many slices as it has this many rows.
SLICE_ROWS = 250_000
#: Most slices as a power of two; the split points are one row of at most that many keys.
MOST_STEPS = 17


def slice_steps(rows: int) -> int:
    """Depth of the binary search over split points: ``2 ** steps`` slices for a table of ``rows`` rows, two at least."""
    return min(MOST_STEPS, max(1, math.ceil(math.log2(max(1, rows) / SLICE_ROWS))))


def split_points(df: DataFrame, key: Column, identity: Sequence[Column], steps: int) -> DataFrame:
    """One row with at most ``2**steps - 1`` sorted split points of ``key``.

    The sample behind them holds the rows with the smallest hashes of
    ``identity``: a distributed top-k of fixed size, and the same rows every
    time the plan runs.
    """
    sample = (df.select(key.alias("k"), F.xxhash64(*identity).alias("h"))
              .orderBy("h", "k").limit(16 << steps)
              .agg(F.sort_array(F.collect_list("k")).alias("s")))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / F.lit(1 << steps))).cast("int")
    return sample.select("s", step.alias("step")).select(
        F.filter("s", lambda x, i: (i > 0) & (i % F.col("step") == 0)).alias("points"))


def with_slice(df: DataFrame, points: Column, key: Column, steps: int, name: str) -> DataFrame:
    """Adds how many split points are at most ``key``: a binary search, a column per step (a lambda would be interpreted)."""
    found = df.withColumns({"__points": points, name: F.lit(0)})
    for width in (1 << i for i in reversed(range(steps))):
        after = F.col(name) + width
        found = found.withColumn(name, F.when(F.get("__points", after - 1) <= key, after).otherwise(F.col(name)))
    return found.drop("__points")


def sliced(df: DataFrame, order: Sequence[Column], steps: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``__slice``: an order-preserving cut of the rows into about equal parts."""
    key = order[0] if len(order) == 1 else F.struct(*order)
    points = split_points(df, key, [*[F.col(c) for c in by], *order], steps)
    return with_slice(df, points.scalar(), key, steps, "__slice")


def running_totals(df: DataFrame, order: Sequence[str], totals: Mapping[str, Column], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """Inclusive running sums in the order of ``order`` (unique within ``by``).

    Args:
        df: One row per distinct order key; aggregate ties before calling.
        order: Sort columns, not null.
        totals: New column name -> summed expression.
        by: Independent groups; a hot group is spread over the slices too.
        descending: Accumulate from the largest key down.

    The rows are written once, counted and cut into ordered slices: slice
    totals (one row per slice and group) give each slice its offset, and the
    sums inside a slice run in the slice's own task.
    """
    names = list(totals)
    sign = F.desc if descending else F.asc
    df = staged(df, "ordered")
    cut = sliced(df, [F.col(c) for c in order], slice_steps(df.count()), by)
    for name in names:
        cut = cut.withColumn(f"__v_{name}", totals[name])
    keys = [*by, "__slice"]
    before = Window.partitionBy(*by).orderBy(sign("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
               .select(*keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names]))
    inside = (Window.partitionBy(*keys).orderBy(*[sign(c) for c in order])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.select("*", *[F.sum(f"__v_{n}").over(inside).alias(n) for n in names])
    joined = local.join(offsets, keys)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__o_{n}")).alias(n) for n in names])


def numbered(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact row numbers (from 1) in the order of ``order``, per ``by`` group, without large one-task windows."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], count: Column | int,
                    name: str = "rank", bound: int | None = None) -> DataFrame:
    """The first ``count`` rows of each group with their rank, in two rounds.

    Round one keeps the first rows of each shard of a group, round two ranks
    what is left: the same rows as one window, but a hot group is cut into as
    many shards as there are tasks first.
    """
    shards = task_count(df.sparkSession)
    limit = bound if bound is not None else int(count)
    shard = F.pmod(F.xxhash64(*order), F.lit(shards))
    local = Window.partitionBy(*by, "__shard").orderBy(*order)
    kept = (df.withColumn("__shard", shard).withColumn(name, F.row_number().over(local))
            .filter(F.col(name) <= limit).drop(name, "__shard"))
    ranked = kept.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(name) <= count)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str],
           heavy_parts: int | None = None) -> DataFrame:
    """Left join to a table with one row per key when some keys are hot on the left.

    Args:
        left: Many rows per key.
        right: One row per key; ``weight`` is the number of left rows of the key.
        keys: Join columns.
        weight: Column of ``right``, dropped from the result.
        spread: Columns of ``left`` that differ within a key.
        heavy_parts: A key is hot above ``1 / heavy_parts`` of all rows, so
            fewer than ``heavy_parts`` keys are hot: the only side broadcast.
            By default a key is hot that fills a quarter of a task.

    Rows of hot keys take their values from the broadcast rows and are sent
    on under a random-like second key, so no task gets a whole hot key.
    """
    values = [c for c in right.columns if c not in (*keys, weight)]
    right = staged(right, "keys")
    if heavy_parts is None:
        heavy_parts = min(1 << 16, max(512, 4 * task_count(left.sparkSession)))
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).scalar()
    marked = right.withColumn("__hot", F.col(weight) * heavy_parts > total)
    heavy = marked.filter("__hot").select(*keys, F.struct(*values).alias("__heavy"))
    light = marked.filter(~F.col("__hot")).select(*keys, F.struct(*values).alias("__light"),
                                                  F.lit(0).cast("bigint").alias("__salt"))
    probed = left.join(F.broadcast(heavy), list(keys), "left")
    salt = F.when(F.col("__heavy").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(0)
    joined = probed.withColumn("__salt", salt.cast("bigint")).join(light, [*keys, "__salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"__heavy.{v}"), F.col(f"__light.{v}")).alias(v)
                                          for v in values])


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = (), linear: bool = True) -> DataFrame:
    """Exact quantiles per group: one row per ``by`` with a column per entry of ``points``.

    Equal values are counted first and the counts accumulated in order, so no
    task ever holds all values of a group. ``linear`` interpolates between
    neighbours; otherwise the value at sorted index ``floor(q * n)`` is taken.
    """
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__x"))
               .agg(F.count("*").alias("__c")))
    placed = running_totals(counted, ["__x"], {"__end": F.col("__c")}, by)
    totals = placed.groupBy(*by).agg(F.sum("__c").alias("__n"))
    both = placed.join(totals, list(by)) if by else placed.withColumn("__n", totals.scalar())

    def at(index: Column) -> Column:
        # The value whose run of equal values holds the sorted position ``index``.
        return F.max(F.when((F.col("__end") - F.col("__c") <= index) & (index < F.col("__end")), F.col("__x")))

    found = []
    for name, q in points.items():
        place = F.lit(float(q)) * (F.col("__n") - 1) if linear else F.least(
            F.floor(F.lit(float(q)) * F.col("__n")), F.col("__n") - 1)
        low = F.floor(place)
        found += [at(low).alias(f"__low_{name}"), at(F.least(low + 1, F.col("__n") - 1)).alias(f"__high_{name}"),
                  F.max(place - low).alias(f"__part_{name}")]
    result = both.groupBy(*by).agg(*found)
    return result.select(*by, *[
        (F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")).alias(n)
        if linear else F.col(f"__low_{n}").alias(n) for n in points])
