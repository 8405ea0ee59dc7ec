"""Nested labels as leaf fields: flattening, descriptions, plain text and back.

A label stays in its row: each level is one array transformation, so neither
flattening nor assembling shuffles anything.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .text import SPACE_CLASS, json_string, json_strip, json_type, strip, to_json_string

#: A JSON string; possessive, so that long strings cost no stack.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def escape_pointer(key: Column) -> Column:
    """One object key as a pointer segment (``~`` before ``/``)."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_pointer(segment: Column) -> Column:
    """The object key of a pointer segment."""
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _members(value: Column) -> Column:
    """Members of a JSON object in source order: ``array<struct<key, value>>`` with JSON text values.

    The typed map tells strings from structures; the text map keeps key order
    and number spelling inside them. Of a repeated key the last value counts,
    in the place of the first.
    """
    typed = F.from_json(value, "map<string,variant>")
    text = F.from_json(value, "map<string,string>")
    members = F.zip_with(F.map_entries(typed), F.map_values(text), lambda e, t: F.struct(
        e["key"].alias("key"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.to_json(e["value"]))
        .otherwise(F.coalesce(t, F.lit("null"))).alias("value")))

    return bound(members, last_wins)


def last_wins(members: Column) -> Column:
    """``array<struct<key, value>>`` with one entry per key: the last value, in the place of the first."""
    def chosen(m: Column) -> Column:
        keys = F.transform(m, lambda x: x["key"])
        firsts = bound(keys, lambda k: F.filter(m, lambda x, i: F.array_position(k, x["key"]) == i + 1))
        return F.transform(firsts, lambda x: F.element_at(F.filter(m, lambda y: y["key"] == x["key"]), -1))

    distinct = F.array_distinct(F.transform(members, lambda x: x["key"]))
    return F.when(F.size(distinct) < F.size(members), chosen(members)).otherwise(members)


def nesting(value: Column) -> Column:
    """How deep the objects of a JSON text are nested: the most braces open at once outside strings."""
    braces = F.split(F.regexp_replace(value, JSON_STRING + r"|[^{}\"]", ""), "")
    steps = F.transform(F.array_remove(braces, ""), lambda b: F.when(b == "{", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(
        acc["most"], acc["now"] + x).alias("most")), lambda acc: acc["most"])


def compact(value: Column) -> Column:
    """A JSON structure without spaces, in its own key order."""
    return F.element_at(F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), "map<string,string>"), "x")


def _child(description: Column, key: Column) -> Column:
    """JSON text of one child of a description tree, null where there is none."""
    return F.when(json_type(description) == "object",
                  F.to_json(F.try_element_at(F.from_json(description, "map<string,variant>"), key)))


def array_description(description: Column) -> Column:
    """Description of an array field: a one-element list with a text, or with an object that has ``__desc``."""
    items = F.from_json(description, "array<variant>")
    only = F.when((json_type(description) == "array") & (F.size(items) == 1), F.to_json(F.get(items, F.lit(0))))
    return F.coalesce(json_string(only), json_string(_child(only, F.lit("__desc"))))


def flatten_label(value: Column, description: Column | None = None, describe_arrays: bool = True) -> Column:
    """Leaves of a label: ``array<struct<id, description, value, kind>>`` in key order.

    Objects are opened, arrays stay whole (their row count is unknown when a
    field is requested). ``description`` is a tree with the same keys; a leaf
    without its own text is described by its id. Objects are opened until none
    is left. Null for broken JSON.
    """
    description = F.lit(None).cast("string") if description is None else json_strip(description)
    value = json_strip(value)
    root = F.when(json_type(value).isNotNull(), F.array(F.struct(
        F.lit("").alias("id"), value.alias("value"), description.alias("hint"))))

    def children(node: Column, hints: Column) -> Column:
        return F.transform(_members(node["value"]), lambda m: F.struct(
            F.concat(node["id"], F.lit("/"), escape_pointer(m["key"])).alias("id"), m["value"].alias("value"),
            F.to_json(F.try_element_at(hints, m["key"])).alias("hint")))

    def opened(node: Column) -> Column:
        # The description of an object is parsed once for all its members.
        hints = F.when(node["hint"].startswith("{"), F.from_json(node["hint"], "map<string,variant>"))
        return F.when(node["value"].startswith("{"), bound(hints, lambda h: children(node, h))).otherwise(F.array(node))

    def open_all(nodes: Column) -> Column:
        """One more level, only where an object is left."""
        return bound(nodes, lambda n: F.when(F.exists(n, lambda x: x["value"].startswith("{")),
                                             F.flatten(F.transform(n, opened))).otherwise(n))

    levels = bound(nesting(value), lambda d: F.when(d > 0, F.sequence(F.lit(1), d)))
    nodes = F.aggregate(F.coalesce(levels, F.array().cast("array<int>")), root, lambda nodes, _: open_all(nodes))

    def leaf(node: Column) -> Column:
        is_array = node["value"].startswith("[")
        told = F.when(node["hint"].startswith('"'), json_string(node["hint"])).when(
            is_array & F.lit(describe_arrays), array_description(node["hint"]))
        return F.struct(node["id"].alias("id"), F.coalesce(told, node["id"]).alias("description"),
                        node["value"].alias("value"), F.when(is_array, "array").otherwise("scalar").alias("kind"))

    return F.transform(nodes, leaf)


def value_type(value: Column) -> Column:
    """One of nine classes of a label value."""
    kind = json_type(value)
    items = F.from_json(value, "array<variant>")
    objects = F.exists(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return (F.when(kind == "string", F.when(json_string(value) == "", "empty_string").otherwise("string"))
            .when(kind.isin("int", "float"), "number")
            .when(kind == "array", F.when(F.size(items) == 0, "empty_array").when(objects, "array_of_objects")
                  .otherwise("array_of_scalars"))
            .otherwise(kind))


def to_text(value: Column) -> Column:
    """Plain text of a label value; null where a value has none (numbers, null, objects)."""
    kind = json_type(value)
    return (F.when(kind == "string", json_string(value)).when(kind == "bool", strip(value))
            .when(kind == "array", compact(value)))


def text_reject(value: Column) -> Column:
    """Why :func:`to_text` has no text, or null."""
    kind = json_type(value)
    return F.when(F.coalesce(~kind.isin("string", "bool", "array"), F.lit(True)),
                  F.concat(F.lit("no text form: "), F.coalesce(kind, F.lit("broken"))))


def from_text(text: Column, kind: Column, closed: Column | None = None) -> Column:
    """Value of generated text: ``struct<value, status>``.

    ``true`` and ``false`` are booleans, arrays must parse as a JSON array,
    and text that was not closed is ``truncated`` whatever it holds.
    """
    closed = F.lit(True) if closed is None else closed
    is_array = (kind == "array")
    parses = F.coalesce(json_type(text) == "array", F.lit(False))
    status = (F.when(~closed, "truncated").when(is_array & ~parses, "invalid_array").otherwise("ok"))
    value = F.when(is_array, compact(text)).when(
        text.isin("true", "false"), text).otherwise(to_json_string(text))
    return F.struct(F.when(status == "ok", value).alias("value"), status.alias("status"))


def plain_value(value: Column) -> Column:
    """A label value with every null in it as ``""`` and every number as its text (JSON text in and out)."""
    tokens = F.regexp_extract_all(value, F.lit(JSON_STRING + r"|-?[0-9][0-9.eE+\-]*|true|false|null|[\[\]{},:]"), F.lit(0))
    plain = F.transform(tokens, lambda t: F.when(t == "null", '""').when(
        t.rlike(r"\A[-0-9]"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(plain, "")


def key_text(field_id: Column, description: Column) -> Column:
    """``id: description``, or the id alone when the description adds nothing."""
    return F.when((description == "") | (description == field_id), field_id).otherwise(
        F.concat(field_id, F.lit(": "), description))


def request_text(fields: Column) -> Column:
    """Text of one request: a header, then one line per field of ``array<struct<id, description, ..>>``."""
    return F.concat_ws("\n", F.lit("JSON:"), F.transform(fields, lambda f: key_text(f["id"], f["description"])))


def target_text(fields: Column) -> Column:
    """The object a request asks for: field ids and values in field order, compact."""
    pairs = F.transform(fields, lambda f: F.concat(to_json_string(f["id"]), F.lit(":"), f["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _value_text(value: Column) -> Column:
    """A JSON value written compactly."""
    kind = json_type(value)
    return (F.when(kind == "string", to_json_string(json_string(value)))
            .when(kind.isin("array", "object"), compact(value)).otherwise(json_strip(value)))


def assembled(documents: DataFrame, fields: str = "fields", name: str = "label") -> DataFrame:
    """Adds the nested JSON of each row's ``array<struct<id, value, ..>>`` (pointer ids, JSON text values).

    The deepest members are written as the object of their parent, which takes
    the place of the first of them; level by level up to the root. Of an id
    listed twice the last value counts.
    """
    def start(f: Column) -> Column:
        segments = F.split(F.regexp_replace(f["id"], r"\A/+", ""), "/", -1)
        return F.struct(F.transform(segments, unescape_pointer).alias("path"), _value_text(f["value"]).alias("value"))

    def raised(nodes: Column, level: Column) -> Column:
        parents = F.transform(nodes, lambda n: F.when(F.size(n["path"]) == level, F.slice(n["path"], 1, level - 1)))

        def whole(parent: Column, above: Column) -> Column:
            inside = F.transform(F.filter(nodes, lambda n, i: F.get(above, i).eqNullSafe(parent)), lambda n: F.struct(
                F.element_at(n["path"], -1).alias("key"), n["value"].alias("value")))
            texts = bound(inside, lambda m: F.transform(last_wins(m), lambda x: F.concat(
                to_json_string(x["key"]), F.lit(":"), x["value"])))
            return F.struct(parent.alias("path"), F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias("value"))

        def moved(above: Column) -> Column:
            kept = F.filter(F.transform(nodes, lambda n, i: F.struct(n.alias("node"), F.get(above, i).alias("parent"), i.alias("at"))),
                            lambda x: x["parent"].isNull() | (F.array_position(above, x["parent"]) == x["at"] + 1))
            return F.transform(kept, lambda x: F.when(x["parent"].isNull(), x["node"]).otherwise(whole(x["parent"], above)))

        return bound(parents, moved)

    nodes = F.transform(fields, start)
    depth = F.array_max(F.transform(fields, lambda f: F.size(F.split(F.regexp_replace(f["id"], r"\A/+", ""), "/", -1))))
    levels = F.when(F.size(fields) > 0, F.sequence(depth, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    root = F.aggregate(levels, nodes, raised, lambda done: F.get(done, F.lit(0))["value"])
    return documents.withColumn(name, F.when(F.col(fields).isNotNull(), F.coalesce(root, F.lit("{}"))))


# ------------------------------------------------------------------ field-list prompts

# One line of a field list, and the words that mark an array in either language.
FIELD_LINE = rf'\A([{SPACE_CLASS}]*)- "(.+?)"(?: \(([^)]*)\))?(?::[{SPACE_CLASS}]*(.*))?\z'
ARRAY_WORDS = ("array", "mảng")
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def prompt_nodes(prompt: Column) -> Column:
    """Nodes of an indented field list: ``array<struct<path, node, description, inside_array>>``.

    ``node`` is ``object``, ``array_of_objects``, ``array`` or ``scalar``. The
    parent of a line is the nearest open line above it with a smaller indent;
    the open lines are carried along while the lines are folded.
    """
    lines = F.filter(F.split(prompt, LINE_BREAK), lambda x: x.rlike(FIELD_LINE))

    def parsed(x: Column) -> Column:
        kind = F.lower(F.regexp_extract(x, FIELD_LINE, 3))
        text = F.nullif(strip(F.regexp_extract(x, FIELD_LINE, 4)), F.lit(""))
        array = kind.startswith(ARRAY_WORDS[0]) | kind.startswith(ARRAY_WORDS[1])
        node = (F.when(kind == "object", "object").when(array & kind.contains("object"), "array_of_objects")
                .when(array & text.isNotNull(), "array").otherwise("scalar"))
        told = F.when(kind == "true/false", F.concat_ws(" ", F.lit("(true/false)"), text)).otherwise(text)
        return F.struct(F.length(F.regexp_extract(x, FIELD_LINE, 1)).alias("depth"),
                        escape_pointer(F.regexp_extract(x, FIELD_LINE, 2)).alias("key"), node.alias("node"),
                        F.when(node != "object", told).alias("description"))

    empty = F.from_json(F.lit('{"open": [], "out": []}'), "open array<struct<depth:int,path:string,arr:boolean>>, "
                        "out array<struct<path:string,node:string,description:string,inside_array:boolean>>")

    def step(state: Column, line: Column) -> Column:
        above = F.filter(state["open"], lambda o: o["depth"] < line["depth"])
        parent = F.try_element_at(above, F.lit(-1))
        path = F.concat(F.coalesce(parent["path"], F.lit("")), F.lit("/"), line["key"])
        inside = F.coalesce(parent["arr"], F.lit(False))
        here = F.struct(line["depth"].alias("depth"), path.alias("path"),
                        (inside | (line["node"] == "array_of_objects")).alias("arr"))
        holds = line["node"].isin("object", "array_of_objects")
        return F.struct(
            F.when(holds, F.concat(above, F.array(here))).otherwise(above).alias("open"),
            F.concat(state["out"], F.array(F.struct(path.alias("path"), line["node"].alias("node"),
                                                    line["description"].alias("description"),
                                                    inside.alias("inside_array")))).alias("out"))

    return F.aggregate(F.transform(lines, parsed), empty, step, lambda s: s["out"])


def prompt_fields(prompt: Column) -> Column:
    """Field requests of a field-list prompt: ``array<struct<id, description, kind>>`` (no row for objects)."""
    leaves = F.filter(prompt_nodes(prompt), lambda n: ~n["inside_array"] & (n["node"] != "object"))
    return F.transform(leaves, lambda n: F.struct(
        n["path"].alias("id"), F.coalesce(n["description"], n["path"]).alias("description"),
        F.when(n["node"].startswith("array"), "array").otherwise("scalar").alias("kind")))


def skeleton(tree: Column) -> Column:
    """Field requests of a description tree: objects are opened, ``__desc`` is left out."""
    fields = flatten_label(tree, tree)
    kept = F.filter(fields, lambda f: ~f["id"].endswith("/__desc"))
    return F.transform(kept, lambda f: F.struct(f["id"].alias("id"), f["description"].alias("description"),
                                                f["kind"].alias("kind")))


def listed_fields(spec: Column) -> Column:
    """Field requests of a JSON list; ids get their leading ``/``."""
    items = F.from_json(spec, "array<struct<id:string,description:string,kind:string>>")

    def request(f: Column) -> Column:
        fid = F.when(f["id"].startswith("/"), f["id"]).otherwise(F.concat(F.lit("/"), f["id"]))
        return F.struct(fid.alias("id"), F.coalesce(F.nullif(f["description"], F.lit("")), fid).alias("description"),
                        F.coalesce(f["kind"], F.lit("scalar")).alias("kind"))

    return F.transform(items, request)


def requested_fields(spec: Column) -> Column:
    """Field requests of a prompt, a JSON description tree or a JSON list, told apart by the first character."""
    text = strip(spec)
    return (F.when(text.startswith("["), listed_fields(text)).when(text.startswith("{"), skeleton(text))
            .otherwise(prompt_fields(text)))


def request_error(fields: Column) -> Column:
    """Why a list of field requests is refused, or null."""
    ids = F.transform(fields, lambda f: f["id"])
    return (F.when(fields.isNull() | (F.size(fields) == 0), "no fields given")
            .when(F.exists(fields, lambda f: f["id"].isNull() | f["id"].isin("", "/")), "field without id")
            .when(F.exists(fields, lambda f: ~f["kind"].isin("scalar", "array")), "kind must be scalar or array")
            .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate field ids"))


# ------------------------------------------------------------------ broken objects

def _top_level_members(text: str) -> list[str]:
    """Pieces of an object's body between its top-level commas, up to its closing brace."""
    pieces, depth, quoted, escaped, start = [], 0, False, False, 1
    for at, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return [*pieces, text[start:at]]
        elif c == "," and depth == 1:
            pieces.append(text[start:at])
            start = at + 1
    return [*pieces, text[start:]]


def _salvage(text: str) -> list[dict[str, str]]:
    body = text.lstrip(" \t\n\r")
    found: dict[str, str] = {}
    read = json.JSONDecoder().raw_decode
    for piece in _top_level_members(body) if body.startswith("{") else []:
        piece = piece.strip(" \t\n\r")
        try:
            key, end = read(piece)
            rest = piece[end:].lstrip(" \t\n\r")
            if not isinstance(key, str) or rest[:1] != ":":
                break
            source = rest[1:].lstrip(" \t\n\r")
            _, end = read(source)
        except json.JSONDecodeError:
            break
        found.setdefault(key, source[:end])
        if source[end:].strip():
            break
    return [{"key": k, "source": v} for k, v in found.items()]


@F.pandas_udf(ArrayType(StructType().add("key", StringType()).add("source", StringType())))
def _salvage_batch(text: pd.Series) -> pd.Series:
    return text.map(_salvage, na_action="ignore")


def object_members(text: Column) -> Column:
    """Members of a JSON object that may be cut or broken: ``map<key, JSON text>``.

    Whole objects are read in the JVM; only broken text goes to the batch
    function, which keeps the members before the first break.
    """
    whole = json_type(text) == "object"
    broken = _salvage_batch(F.when(~F.coalesce(whole, F.lit(False)), text))
    entries = F.when(whole, F.transform(_members(text), lambda m: F.struct(
        m["key"].alias("key"), m["value"].alias("source")))).otherwise(broken)
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))


def member_value(members: Column, field_id: Column, kind: Column) -> Column:
    """``struct<value, text, status>`` of one requested field of a salvaged object."""
    source = F.try_element_at(members, field_id)
    found = json_type(source)
    status = (F.when(source.isNull(), "missing").when(kind == "array", F.when(found == "array", "ok").otherwise(
        "invalid_array")).when(found.isin("string", "bool", "int", "float"), "ok").otherwise("wrong_type"))
    number = found.isin("int", "float")
    value = F.when(number, F.concat(F.lit('"'), source, F.lit('"'))).otherwise(source)
    text = F.when(status == "ok", F.coalesce(F.when(number, source), to_text(source))).otherwise(
        F.coalesce(source, F.lit("")))
    return F.struct(F.when(status == "ok", value).alias("value"), text.alias("text"), status.alias("status"))
