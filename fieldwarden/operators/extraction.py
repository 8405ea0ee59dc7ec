"""Extraction metrics over prediction rows: exact match, breakdowns, error kinds and array credit."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import count_if, ratio
from ..functions.text import encode_json, tidy_json
from ..session import staged
from .bootstrap import side_by_side


def exact_match(rows: DataFrame) -> DataFrame:
    """Headline metrics of judged rows in one row.

    Rows are read once: they are summed per document, form and kind into a
    small table, and every metric is a further sum over that.
    """
    summed = staged(rows.groupBy("document_id", "form", "kind").agg(
        F.count("*").alias("n"), count_if(F.col("correct")).alias("y"),
        count_if(T.is_coordinates(T.generated_text(F.col("text")))).alias("boxes"),
        count_if(F.col("status") == "truncated").alias("cut")), "summed")
    documents = summed.groupBy("document_id").agg((F.sum("y") == F.sum("n")).cast("double").alias("all_right")).agg(
        F.count("*").alias("documents"), F.avg("all_right").alias("complete_document_rate"))
    forms = summed.groupBy("form").agg(ratio(F.sum("y"), F.sum("n")).alias("em")).agg(
        F.count("*").alias("forms"), F.avg("em").alias("macro_form_exact_match"))

    def share(part: str, condition: Column | None = None) -> Column:
        if condition is None:
            return ratio(F.sum(part), F.sum("n"))
        return ratio(F.sum(F.when(condition, F.col(part))), F.sum(F.when(condition, F.col("n"))))

    total = summed.agg(
        F.sum("n").alias("fields"), share("y").alias("exact_match"),
        share("y", F.col("kind") == "scalar").alias("scalar_exact_match"),
        share("y", F.col("kind") == "array").alias("array_exact_match"),
        share("boxes").alias("coordinate_rate"), share("cut").alias("truncated_rate"))
    return side_by_side(total, documents, forms)


def breakdown(rows: DataFrame) -> DataFrame:
    """Count and exact match by form, by kind and in total, from one pass with grouping sets."""
    y = F.avg(F.col("correct").cast("double")).alias("exact_match")
    return (rows.groupingSets([["form"], ["kind"], []], "form", "kind")
            .agg(F.count("*").alias("count"), y, F.grouping_id().alias("__g"))
            .select(F.when(F.col("__g") == 1, "form").when(F.col("__g") == 2, "kind").otherwise("total").alias("by"),
                    F.when(F.col("__g") == 1, F.col("form")).when(F.col("__g") == 2, F.col("kind")).otherwise("all").alias("name"),
                    "count", "exact_match"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows per status."""
    return rows.groupBy("status").agg(F.count("*").alias("count"))


def error_counts(rows: DataFrame) -> DataFrame:
    """Wrong rows per kind of failure, most frequent first.

    The text comparisons behind a kind run on wrong rows only.
    """
    wrong = rows.filter(~F.col("correct"))
    kind = T.error_kind(F.col("status"), F.col("prediction"), F.col("target"), T.generated_text(F.col("text")))
    return (wrong.select(kind.alias("error")).groupBy("error").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "error"))


#: Pairs of a target and a prediction whose credit a task remembers: equal pairs are parsed once.
REMEMBERED = 1 << 15
CREDIT = ("expected", "predicted", "cells", "cells_right", "matched")


def _credit(target: str | None, prediction: str | None) -> tuple:
    """Counts of one array field, and the items that only the target or only the prediction holds.

    A target that is no array has no counts.
    """
    raw = None if prediction is None else json.loads(prediction)
    predicted = tidy_json(raw, True)
    expected = predicted if target == prediction else "" if target is None else tidy_json(json.loads(target), True)
    if not isinstance(expected, list):
        return None, len(predicted), None, None, None, None, None
    cells = right = 0
    for at, mine in enumerate(expected):
        theirs, given = (predicted[at], raw[at]) if at < len(predicted) else (None, None)
        if isinstance(mine, dict):
            cells += len(mine)
            if isinstance(theirs, dict):
                right += sum(1 for k, v in mine.items() if k in theirs and given[k] is not None and theirs[k] == v)
        else:
            cells += 1
            right += given is not None and theirs == mine
    if expected == predicted:
        return len(expected), len(predicted), cells, right, len(expected), None, None
    missed, spare = (Counter(map(encode_json, items)) for items in (expected, predicted))
    both = missed & spare
    return (len(expected), len(predicted), cells, right, both.total(),
            list((missed - both).elements()), list((spare - both).elements()))


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    credit = lru_cache(REMEMBERED)(_credit)
    numbers, texts = pa.int32(), pa.list_(pa.string())
    for batch in batches:
        target, prediction = (batch.column(c).to_pylist() for c in ("t", "p"))
        *counts, missed, spare = zip(*map(credit, target, prediction)) if target else [()] * 7
        left = pa.array([m is not None for m in missed], pa.bool_())
        # Only fields with items left are named: they may meet other rows of the same field.
        keys = [pc.if_else(left, batch.column(c), pa.scalar(None, batch.column(c).type)) for c in ("document_id", "field_id")]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, numbers) for c in counts], *[pa.array(c, texts) for c in (missed, spare)]],
                                         ["document_id", "field_id", *CREDIT, "missed", "spare"])


def array_metrics(rows: DataFrame) -> DataFrame:
    """Partial credit of array fields, in one row.

    A prediction that is not ``ok`` counts as an empty array. Array rows match
    as a multiset of canonical texts; a target cell is right when the
    prediction has the same text at the same row and key, and never when the
    predicted cell is null. Items that match inside their row are counted
    there; only what is left of a field meets other rows of the same field.
    """
    usable = (F.col("status") == "ok") & (T.json_type(F.col("prediction")) == "array")
    given = F.when(F.coalesce(usable, F.lit(False)), F.col("prediction")).otherwise("[]")
    pairs = rows.select("document_id", "field_id", F.col("target").alias("t"), given.alias("p"))
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in ("document_id", "field_id")], *[f"{n} int" for n in CREDIT],
                        "missed array<string>", "spare array<string>"])
    counts = staged(pairs.mapInArrow(_credits, schema), "arrays")
    sums = counts.agg(
        F.count("*").alias("fields"), F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("length_match"),
        *[F.sum(n).alias(n) for n in ("expected", "predicted", "cells", "cells_right")], F.coalesce(F.sum("matched"), F.lit(0)).alias("inside"))
    tagged = F.concat(F.transform("missed", lambda x: F.struct(x.alias("item"), F.lit(1).alias("t"), F.lit(0).alias("p"))),
                      F.transform("spare", lambda x: F.struct(x.alias("item"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    across = (counts.filter(F.col("missed").isNotNull()).select("document_id", "field_id", F.inline(tagged))
              .groupBy("document_id", "field_id", "item").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
              .agg(F.coalesce(F.sum(F.least("t", "p")), F.lit(0)).alias("across")))
    both = side_by_side(sums, across).withColumn("matched", F.col("inside") + F.col("across"))
    return both.select(
        "fields", "length_match", ratio(F.col("matched"), F.col("predicted")).alias("row_precision"),
        ratio(F.col("matched"), F.col("expected")).alias("row_recall"),
        ratio(2 * F.col("matched"), F.col("predicted") + F.col("expected")).alias("row_f1"),
        ratio(F.col("cells_right"), F.col("cells")).alias("cell_accuracy"))


def monitor(rows: DataFrame) -> DataFrame:
    """Exact match, coordinate and truncated rates per step and split (judged with the strict comparator)."""
    return rows.groupBy("step", "split").agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("fields"),
        F.avg(F.col("correct").cast("double")).alias("exact_match"),
        F.avg(T.is_coordinates(F.col("text")).cast("double")).alias("coordinate_rate"),
        F.avg((F.col("status") == "truncated").cast("double")).alias("truncated_rate"))


def cohort_summary(rows: DataFrame) -> DataFrame:
    """Fields, valid and correct fields per cohort."""
    return rows.groupBy("cohort").agg(F.count("*").alias("fields"), count_if(F.col("status") == "ok").alias("valid"),
                                      count_if(F.col("correct")).alias("correct"))
