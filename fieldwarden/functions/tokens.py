"""Token arrays of one value: content masks, summaries, decoding statistics and loops.

A value's tokens stay in its row, so everything here is a row-local array
expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JSON_SYNTAX, NON_ASCII, PIECE_SPACE, digit_class, value_kind
from .values import bound

# Per-token statistics, value kinds, and the names of a summary's columns.
TOKEN_STATS = ("log_probability", "normalized_entropy", "probability_margin", "logit_margin", "close_log_probability")
VALUE_KINDS = ("empty", "numeric", "text", "array")


def content_mask(pieces: Column, kind: Column) -> Column:
    """Which token pieces carry content; all of them when none does."""
    cut = F.when(kind == "array", JSON_SYNTAX).otherwise(PIECE_SPACE)
    mask = F.transform(pieces, lambda p: F.length(F.btrim(p, cut)) > 0)
    return F.when(F.exists(mask, lambda m: m), mask).otherwise(F.transform(pieces, lambda p: F.lit(True)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array of doubles."""
    place = F.lit(q) * (F.size(values) - 1)
    low = F.floor(place).cast("int")

    def between(ordered: Column) -> Column:
        first = F.get(ordered, low)
        return first + (F.coalesce(F.get(ordered, low + 1), first) - first) * (place - low)

    # The sorted values are bound once, not sorted per use.
    return F.element_at(F.transform(F.array(F.sort_array(values)), between), 1)


def summary_columns(stats: Column, close: Column, mask: Column, text: Column, kind: Column) -> dict[str, Column]:
    """The 27 summary columns of a value.

    Args:
        stats: ``array<struct>`` of the value tokens with the fields of ``TOKEN_STATS``.
        close: Struct of the close decision with the same fields.
        mask: Content mask of the value tokens.
        text: Generated text.
        kind: Requested kind.
    """
    n = F.size(stats)
    filled = n > 0

    def values_of(name: str) -> Column:
        return stats[name]

    def squares(values: Column) -> Column:
        """Sum of squared deviations from the mean, which is bound once."""
        return F.element_at(F.transform(F.array(_total(values) / n), lambda mean: F.aggregate(
            values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))), 1)

    series = {s: values_of(s) for s in TOKEN_STATS}
    columns = {f"mean_{s}": F.when(filled, _total(v) / n).otherwise(0.0) for s, v in series.items()}
    columns.update({f"std_{s}": F.when(filled, F.sqrt(squares(v) / n)).otherwise(0.0) for s, v in series.items()})
    logp = series["log_probability"]
    extremes = {
        "min_log_probability": F.array_min(logp), "q10_log_probability": array_quantile(logp, .1),
        "max_normalized_entropy": F.array_max(series["normalized_entropy"]),
        "min_probability_margin": F.array_min(series["probability_margin"]),
        "max_close_log_probability": F.array_max(series["close_log_probability"])}
    columns.update({name: F.when(filled, c).otherwise(0.0) for name, c in extremes.items()})
    columns.update({f"close_{s}": close[s] for s in TOKEN_STATS})
    columns["log1p_tokens"] = F.log1p(n)
    columns["content_share"] = F.when(F.size(mask) > 0, F.size(F.filter(mask, lambda m: m)) / F.size(mask)).otherwise(0.0)
    # In ASCII text the digits are 0-9; the long class is only tried on other text.
    bare = F.when(text.rlike(NON_ASCII), F.regexp_replace(text, digit_class(), "")).otherwise(F.regexp_replace(text, "[0-9]", ""))
    digits = F.length(text) - F.length(bare)
    columns["digit_share"] = digits / F.greatest(F.lit(1), F.length(text))
    found = value_kind(text, kind)
    columns.update({f"kind_{k}": (found == k).cast("double") for k in VALUE_KINDS})
    return columns


def uncertain_tokens(tokens: Column, limit: int) -> Column:
    """At most ``limit`` tokens in their own order: content first, least probable first.

    ``tokens`` is ``array<struct<content, log_probability, ..>>``.
    """
    placed = F.transform(tokens, lambda t, i: F.struct(
        (~t["content"]).alias("late"), t["log_probability"].alias("logp"), i.alias("at"), t.alias("token")))
    chosen = F.slice(F.array_sort(placed), 1, limit)
    in_order = F.array_sort(F.transform(chosen, lambda c: F.struct(c["at"].alias("at"), c["token"].alias("token"))))
    return F.transform(in_order, lambda c: c["token"])


def decode_statistics(logits: Column, chosen: Column, close: int, allowed: int) -> Column:
    """Statistics of one decoding distribution from its masked logits, as a struct.

    Args:
        logits: ``array<double>``; banned entries hold a large negative number.
        chosen: Index of the chosen token.
        close: Index of the close marker.
        allowed: Number of entries that are not banned.

    The sorted entries and the normaliser are bound once, not evaluated per entry.
    """
    def of_order(order: Column) -> Column:
        top, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        return bound(top + F.log(_total(F.transform(logits, lambda x: F.exp(x - top)))), lambda total: of_total(top, second, total))

    def of_total(top: Column, second: Column, total: Column) -> Column:
        entropy = -F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - total) * (x - total))
        return F.struct(
            (F.get(logits, chosen) - total).alias("log_probability"), (entropy / math.log(allowed)).alias("normalized_entropy"),
            (F.exp(top - total) - F.exp(second - total)).alias("probability_margin"), (top - second).alias("logit_margin"),
            (F.get(logits, F.lit(close)) - total).alias("close_log_probability"))

    return bound(F.slice(F.sort_array(logits, False), 1, 2), of_order)


def ends_in_loop(tokens: Column, max_period: int = 256, min_span: int = 128, min_repeats: int = 4) -> Column:
    """Whether the tokens end in an exact repeat of a period of at most ``max_period``.

    The repeat must span ``max(min_span, min_repeats * period)`` tokens.
    """
    n = F.size(tokens)
    last = F.try_element_at(tokens, F.lit(-1))
    # A period qualifies only if the last token repeats that far back.
    periods = F.filter(F.sequence(F.lit(1), F.lit(max_period)), lambda p: (p < n) & (F.get(tokens, n - 1 - p) == last))

    def repeats(p: Column) -> Column:
        need = F.greatest(F.lit(min_span), p * min_repeats)
        return (need <= n) & (F.slice(tokens, n - need + p + 1, F.greatest(need - p, F.lit(0)))
                              == F.slice(tokens, n - need + 1, F.greatest(need - p, F.lit(0))))

    return F.when(n >= min_span, F.exists(periods, lambda p: F.when(
        F.greatest(F.lit(min_span), p * min_repeats) <= n, repeats(p)).otherwise(F.lit(False)))).otherwise(F.lit(False))


def stop_reason(closed: Column, looped: Column, broken: Column) -> Column:
    """Why decoding stopped: ``close``, ``loop``, ``invalid_json`` or ``budget``."""
    return F.when(broken, "invalid_json").when(closed, "close").when(looped, "loop").otherwise("budget")


def final_status(stop: Column, parsed_status: Column) -> Column:
    """Status of a value from its stop reason and what its text parsed to."""
    return F.when(stop == "invalid_json", "invalid_array").when(stop == "close", parsed_status).otherwise("truncated")


# ------------------------------------------------------------------ packed layout

def packed_layout(prefix: Column, branches: Column) -> Column:
    """Positions of every branch packed after a shared prefix: ``array<struct<id, start, key, decide, value>>``.

    ``branches`` is ``array<struct<id, prompt, target>>`` of token counts.
    """
    start = F.aggregate(branches, F.struct(prefix.cast("bigint").alias("at"), F.array().cast(
        "array<struct<id:string,start:bigint,key:bigint,decide:bigint,value:bigint>>").alias("out")),
        lambda a, b: F.struct(
            (a["at"] + b["prompt"] + b["target"]).cast("bigint").alias("at"),
            F.concat(a["out"], F.array(F.struct(
                b["id"].alias("id"), a["at"].alias("start"), (a["at"] + b["prompt"] - 2).cast("bigint").alias("key"),
                (a["at"] + b["prompt"] - 1).cast("bigint").alias("decide"),
                (a["at"] + b["prompt"] + b["target"] - 1).cast("bigint").alias("value")))).alias("out")),
        lambda a: a["out"])
    return start


def within_budget(branches: Column, prefix: Column, budget: int) -> Column:
    """Ids of the branches that fit, taken in order and skipping what overflows; the shortest when none fits."""
    kept = F.aggregate(branches, F.struct(prefix.cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids")),
                       lambda a, b: F.when(a["used"] + b["prompt"] + b["target"] <= budget, F.struct(
                           (a["used"] + b["prompt"] + b["target"]).cast("bigint").alias("used"),
                           F.concat(a["ids"], F.array(b["id"])).alias("ids"))).otherwise(a), lambda a: a["ids"])
    shortest = F.array_min(F.transform(branches, lambda b, i: F.struct(
        (b["prompt"] + b["target"]).alias("n"), i.alias("i"), b["id"].alias("id"))))["id"]
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(shortest))


def drop_longest(fields: Column, limit: int, separator: int = 0) -> Column:
    """Ids kept, in order, after dropping the longest values until the rest fits; empty when nothing fits.

    ``fields`` is ``array<struct<id, length>>``; of equal lengths the earlier
    field is dropped first.
    """
    ascending = F.array_sort(F.transform(fields, lambda f, i: F.struct(
        f["length"].cast("bigint").alias("n"), (-i).alias("back"), f["id"].alias("id"))))
    kept = F.aggregate(ascending, F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"),
                                           F.array().cast("array<int>").alias("at")),
                       lambda a, f: F.when(~a["full"] & (a["used"] + f["n"] + separator <= limit), F.struct(
                           (a["used"] + f["n"] + separator).alias("used"), F.lit(False).alias("full"),
                           F.concat(a["at"], F.array(-f["back"])).alias("at"))).otherwise(
                               F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["at"].alias("at"))),
                       lambda a: a["at"])
    return F.transform(F.array_sort(kept), lambda i: F.get(fields, i)["id"])


def loss_weights(sizes: Column, by_field: bool) -> Column:
    """Weight of one position of every branch: equal per token, or equal per field (all positions sum to 1)."""
    if by_field:
        return F.transform(sizes, lambda n: 1 / (n.cast("double") * F.size(sizes)))
    return F.transform(sizes, lambda n: 1 / _total(F.transform(sizes, lambda m: m.cast("double"))))


def collapsed_runs(tokens: Column, special: Column) -> Column:
    """Tokens as text, with a run of one special token written ``token×n``.

    Runs are found from the positions where the token changes, not token by
    token.
    """
    starts = F.filter(F.transform(tokens, lambda t, i: F.when((i == 0) | (F.get(tokens, i - 1) != t), i)),
                      lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(tokens)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(tokens, a).alias("token"), (b - a).alias("n")))
    text = F.transform(runs, lambda r: F.when(F.array_contains(special, r["token"]) & (r["n"] > 1), F.concat(
        r["token"], F.lit("×"), r["n"].cast("string"))).otherwise(F.array_join(F.array_repeat(r["token"], r["n"]), " ")))
    return F.when(F.size(tokens) > 0, F.array_join(text, " ")).otherwise("")
