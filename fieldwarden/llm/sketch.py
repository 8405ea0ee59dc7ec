"""A bitmap of hashed ids that tells most rows apart before any of them moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import computed_once

#: Bits of the bitmap: 2,048 rows of 4 KB at most, whatever the number of ids.
SKETCH_BITS = 1 << 26
_WORD = 1 << 15


def _place() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(SKETCH_BITS))


def with_likely(documents: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``documents`` with the flag ``name``: false only if ``doc_id`` is surely not in ``ids`` (or null)."""
    marks = ids.filter("doc_id is not null").select(_place().alias("p"))
    maps = marks.groupBy((F.col("p") / _WORD).cast("int").alias("__word")).agg(F.expr(f"bitmap_construct_agg(p % {_WORD})").alias("__bits"))
    bit = (F.col("__p") % _WORD).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce((F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1) & F.col("doc_id").isNotNull(), F.lit(False))
    rows = documents.withColumn("__p", _place()).withColumn("__word", (F.col("__p") / _WORD).cast("int"))
    return rows.join(F.broadcast(maps), "__word", "left").select(*documents.columns, likely.alias(name))


def of_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose ``doc_id`` is in ``ids``, without moving the others.

    The bitmap filters the scan, the exact join sees what is left: the wanted
    rows and, with many ids, some others.
    """
    near = with_likely(documents, ids, "__likely").filter("__likely").drop("__likely")
    # Without this barrier the optimizer moves the exact join below the bitmap, where it shuffles every row.
    near = computed_once(near)
    return near.join(ids.select("doc_id"), "doc_id", "left_semi")
