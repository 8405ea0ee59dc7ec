"""Text comparison: Unicode-aware stripping, comparators and the error taxonomy.

Spark has no Unicode normalisation, so NFC, accent removal and full case
folding run as Arrow-batched functions. They only receive text that holds a
non-ASCII character; ASCII text stays in the JVM.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters Unicode counts as whitespace, and the same as the body of a regular-expression class.
WHITESPACE = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())
SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
# Whitespace of JSON and of token pieces, and the syntax of JSON values.
PIECE_SPACE = " \t\r\n"
JSON_SYNTAX = ' \t\r\n"{}[],:'

NON_ASCII = r"[^\x00-\x7F]"


def strip(text: Column) -> Column:
    """``text`` without surrounding Unicode whitespace (Spark's ``trim`` only removes spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    """Every run of whitespace as one space."""
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")


def mask_digits(text: Column) -> Column:
    """Every decimal digit as ``#``."""
    return F.regexp_replace(text, r"\p{Nd}", "#")


def has_digit(text: Column) -> Column:
    """Whether ``text`` holds a decimal digit."""
    return text.rlike(r"\p{Nd}")


@F.pandas_udf(StringType())
def _nfc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _fold_batch(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _bare_batch(text: pd.Series) -> pd.Series:
    def bare(t: str) -> str:
        marks_apart = unicodedata.normalize("NFD", t)
        return "".join(filter(lambda c: unicodedata.combining(c) == 0, marks_apart)).casefold()

    return text.map(bare, na_action="ignore")


def _only_non_ascii(text: Column) -> Column:
    return F.when(text.rlike(NON_ASCII), text)


def nfc(text: Column) -> Column:
    """NFC form."""
    return F.coalesce(_nfc_batch(_only_non_ascii(text)), text)


def fold_case(text: Column) -> Column:
    """Full Unicode case folding."""
    return F.coalesce(_fold_batch(_only_non_ascii(text)), F.lower(text))


def bare_letters(text: Column) -> Column:
    """``text`` without combining marks, case folded."""
    return F.coalesce(_bare_batch(_only_non_ascii(text)), F.lower(text))


def shape(text: Column) -> Column:
    """Digits as ``9``, letters as ``a``, everything else kept."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{Nd}", "9"), r"[\p{L}\p{Nl}\p{No}]", "a")


# The text of two grounding points, and of a value made of digits and separators only.
COORDINATES = r"\A\s*\(\s*\p{Nd}+\s*,\s*\p{Nd}+\s*\)\s*,\s*\(\s*\p{Nd}+\s*,\s*\p{Nd}+\s*\)\s*\z".replace(
    r"\s", f"[{SPACE_CLASS}]")
NUMERIC = rf"\A[\p{{Nd}}{SPACE_CLASS}.,/:%+\-()]*\p{{Nd}}[\p{{Nd}}{SPACE_CLASS}.,/:%+\-()]*\z"
# Text shaped like a special token of a chat model.
SPECIAL_TOKEN = r"<\|[^|<>]*\|>"


def is_coordinates(text: Column) -> Column:
    """Whether ``text`` is a box ``(d,d),(d,d)`` and nothing else."""
    return text.rlike(COORDINATES)


def generated_text(text: Column, raw: Column | None = None) -> Column:
    """Generated text of a row; a JSON string of an old row (``raw``) loses its quotes."""
    chosen = F.coalesce(text, F.lit("")) if raw is None else F.coalesce(text, raw, F.lit(""))
    quoted = (F.length(chosen) >= 2) & chosen.startswith('"') & chosen.endswith('"')
    return F.when(quoted, F.substring(chosen, 2, F.length(chosen) - 2)).otherwise(chosen)


def value_kind(text: Column, kind: Column) -> Column:
    """``array``, ``empty``, ``numeric`` or ``text``."""
    return (F.when(kind == "array", "array").when(strip(text) == "", "empty")
            .when(text.rlike(NUMERIC), "numeric").otherwise("text"))


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Regular-expression class of every character with a digit value (superscripts and circled digits too)."""
    extra = "".join(f"\\x{{{n:x}}}" for n in range(0x110000) if chr(n).isdigit() and unicodedata.category(chr(n)) != "Nd")
    return rf"[\p{{Nd}}{extra}]"


def string_features(text: Column) -> Column:
    """Format-relevant features of a string value, as an array of names."""
    tests = {
        "leading_zero_digits": text.startswith("0") & (F.length(text) > 1) & text.rlike(rf"\A{digit_class()}+\z"),
        "multiline": text.contains("\n"),
        "surrounding_whitespace": text != strip(text),
        "angle_brackets": text.contains("<") | text.contains(">"),
        "special_token_like": text.rlike(SPECIAL_TOKEN),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


# ------------------------------------------------------------------ JSON values

def json_strip(value: Column) -> Column:
    """JSON text without the white space JSON allows around a value."""
    return F.btrim(value, F.lit(" \t\n\r"))


def json_type(value: Column) -> Column:
    """JSON type of a JSON text: string, bool, null, int, float, array, object (null for broken JSON).

    The first character decides the type once the text is known to parse.
    White space around the value does not matter.
    """
    bare = json_strip(value)
    first = F.substring(bare, 1, 1)
    whole = bare.rlike(r"\A-?[0-9]+\z")
    return F.when(F.try_parse_json(bare).isNotNull(), (
        F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array")
        .when(first.isin("t", "f"), "bool").when(first == "n", "null").when(whole, "int").otherwise("float")))


def json_string(value: Column) -> Column:
    """The string of a JSON string, null for anything else."""
    bare = json_strip(value)
    return F.when(bare.startswith('"'), F.try_variant_get(F.try_parse_json(bare), "$", "string"))


def to_json_string(text: Column) -> Column:
    """JSON text of a string."""
    return F.to_json(text.cast("variant"))


encode_json = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def tidy_json(item: Any, as_text: bool) -> Any:
    """A parsed JSON value with strings normalised and stripped, scalars as text when asked."""
    if isinstance(item, str):
        return (item if item.isascii() else unicodedata.normalize("NFC", item)).strip()
    if isinstance(item, dict):
        return {key: tidy_json(inner, as_text) for key, inner in item.items()}
    if isinstance(item, list):
        return [tidy_json(inner, as_text) for inner in item]
    return ("" if item is None else json.dumps(item)) if as_text else item


def _canonical_json(value: str, as_text: bool) -> str:
    """Order-free serialisation."""
    return encode_json(tidy_json(json.loads(value), as_text))


@F.pandas_udf(StringType())
def text_form(value: pd.Series) -> pd.Series:
    return value.map(lambda v: _canonical_json(v, True), na_action="ignore")


@F.pandas_udf(StringType())
def json_form(value: pd.Series) -> pd.Series:
    return value.map(lambda v: _canonical_json(v, False), na_action="ignore")


def canonical_text(value: Column) -> Column:
    """Comparison key of a JSON value whose scalars compare by their text.

    Strings, booleans, nulls and whole numbers are handled in the JVM; arrays,
    objects and other numbers go to the batch function. The key starts with
    ``s`` for scalars and ``j`` for structures.
    """
    kind = json_type(value)
    plain = (F.when(kind == "string", strip(nfc(json_string(value)))).when(kind == "null", "")
             .when(kind.isin("bool", "int"), strip(value)))
    deep = text_form(F.when(kind.isin("array", "object", "float"), value))
    return (F.when(kind.isin("array", "object"), F.concat(F.lit("j"), deep))
            .when(kind == "float", F.concat(F.lit("s"), F.btrim(deep, F.lit('"')))).otherwise(
                F.concat(F.lit("s"), plain)))


def canonical_json(value: Column) -> Column:
    """Comparison key of a JSON value whose types must match."""
    kind = json_type(value)
    deep = json_form(F.when(kind.isin("array", "object", "float"), value))
    return (F.when(kind == "string", F.concat(F.lit("s"), strip(nfc(json_string(value)))))
            .when(kind.isin("bool", "int", "null"), F.concat(F.lit("v"), strip(value)))
            .otherwise(F.concat(F.lit("j"), deep)))


def _equal(canonical: Callable[[Column], Column], prediction: Column, target: Column) -> Column:
    """Equality of canonical forms, which are only built where the spellings differ."""
    differs = prediction != target
    forms = [canonical(F.when(differs, c)) for c in (prediction, target)]
    return F.coalesce(~differs | (forms[0] == forms[1]), F.lit(False))


def equal_as_text(prediction: Column, target: Column) -> Column:
    """Equal when scalars are compared by their text; an array only equals an array."""
    return _equal(canonical_text, prediction, target)


def equal_as_json(prediction: Column, target: Column) -> Column:
    """Equal with equal JSON types."""
    return _equal(canonical_json, prediction, target)


#: Comparators by name; add a function of (prediction, target) columns to plug in another one.
COMPARATORS = {"text": equal_as_text, "json": equal_as_json}


def is_correct(status: Column, prediction: Column, target: Column, comparator: str = "text") -> Column:
    """Whether a prediction row is right; any status but ``ok`` is wrong.

    A null ``prediction`` column stands for JSON null.
    """
    filled = [F.coalesce(c, F.lit("null")) for c in (prediction, target)]
    return F.coalesce(status == "ok", F.lit(False)) & COMPARATORS[comparator](*filled)


def error_kind(status: Column, prediction: Column, target: Column, text: Column) -> Column:
    """Name of the failure of a wrong row; the first kind that fits wins."""
    prediction, target = (F.coalesce(c, F.lit("null")) for c in (prediction, target))
    kind = json_type(target)
    want, got = (strip(nfc(json_string(c))) for c in (target, prediction))
    tests = (
        (is_coordinates(text), F.lit("coordinates")),
        (status != "ok", status),
        (kind != json_type(prediction), F.lit("wrong_json_type")),
        (kind == "array", F.lit("array_content")),
        (kind != "string", F.lit("other_content")),
        (want == "", F.lit("spurious_nonempty")),
        (got == "", F.lit("missing_value")),
        (fold_case(want) == fold_case(got), F.lit("case_only")),
        (collapse_spaces(want) == collapse_spaces(got), F.lit("internal_whitespace")),
        (bare_letters(want) == bare_letters(got), F.lit("diacritics_or_case")),
        (has_digit(want) & (mask_digits(want) == mask_digits(got)), F.lit("digit_substitution")),
    )
    result = F.when(*tests[0])
    for test, name in tests[1:]:
        result = result.when(test, name)
    return result.otherwise("other_content")
