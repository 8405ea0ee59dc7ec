"""Choosing fields of a document that is one row with an array of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .scale import numbered


def first_fields(fields: Column, limit: int) -> Column:
    """The first ``limit`` fields of each document."""
    return F.slice(fields, 1, limit)


def within_budget(fields: Column, size: str, budget: int) -> Column:
    """The fields whose own size fits the budget; a document left without any is to be rejected."""
    return F.filter(fields, lambda f: f[size] <= budget)


def grouped(fields: Column, size: int) -> Column:
    """``array<struct<group, fields>>``: the fields in order, ``size`` to a request, the last one maybe fewer."""
    starts = F.filter(F.sequence(F.lit(0), F.ceil(F.size(fields) / size).cast("int")), lambda g: g * size < F.size(fields))
    return F.transform(starts, lambda g: F.struct(g.cast("bigint").alias("group"), F.slice(fields, g * size + 1, size).alias("fields")))


def sampled(fields: Column, document: Column, limit: int, seed: int) -> Column:
    """``limit`` fields in a seeded order of their ids, the same whatever order they come in."""
    keyed = F.array_sort(F.transform(fields, lambda f: F.struct(
        order_key(seed, F.concat(document.cast("string"), f["id"])).alias("key"), f.alias("field"))))
    return F.transform(F.slice(keyed, 1, limit), lambda x: x["field"])


def located(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Split and form of the wanted documents; ``found`` is false for ids that no split holds."""
    known = documents.select("document_id", "split", "form", F.lit(True).alias("found"))
    return wanted.select("document_id").distinct().join(known, "document_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def part_numbered(rows: DataFrame, order: list[str], part_size: int) -> DataFrame:
    """``trace_index`` from 0 in the order of ``order`` and the ``part`` file of ``part_size`` rows that it falls into."""
    ranked = numbered(rows, order, "__n")
    index = F.col("__n") - 1
    return ranked.select(*rows.columns, index.alias("trace_index"), F.floor(index / part_size).alias("part"))


def first_in_order(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of an order: a distributed top-k, in that order."""
    return rows.orderBy(*order).limit(limit)


def slowest(pairs: DataFrame, value: str, by: list[str], columns: list[str]) -> DataFrame:
    """Per group the row with the greatest ``value``, of equal ones the least by ``columns``."""
    best = F.min_by(F.struct(*columns, value), F.struct((-F.col(value)).alias("v"), *columns))
    return pairs.filter(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("row")).select(*by, "row.*")
