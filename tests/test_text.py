"""Comparators, error kinds and text features as tables of cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fieldwarden.functions import text as T
from fieldwarden.functions import values as V

# JSON text of both sides, equal as text, equal as JSON.
COMPARISONS = [
    ('"Lê Lợi"', '"Lê Lợi"', True, True), ('"Quận 3\\t"', '"\\u00a0Quận 3"', True, True), ('"kg"', '"KG"', False, False),
    ('"7"', '7', True, False), ('"7.0"', '7', False, False), ('false', '"false"', True, False), ('null', '""', True, False),
    ('null', 'null', True, True), ('"0042"', '42', False, False), ('\n["u", "v"]', '["u","v"]', True, True),
    ('["v","u"]', '["u","v"]', False, False), ('"[]"', '[]', False, False), ('  {"k": 1, "m": null}\n', '{"m":"","k":"1"}', True, False),
    ('{"k":1,"k":2}', '{"k":2}', True, True), ('[{"k":"a","k":"b"}]', '[{"k":"a"}]', False, False),
    ('\t"tail"', '"tail"', True, True), ('[[1],[]]', '[["1"],[]]', True, False), ('{"k"', '"k"', False, False),
]


def test_comparators(spark):
    df = spark.createDataFrame(COMPARISONS, "p string, t string, a boolean, b boolean")
    got = df.select("p", "t", "a", "b", T.equal_as_text(F.col("p"), F.col("t")).alias("x"), T.equal_as_json(F.col("p"), F.col("t")).alias("y"))
    for row in got.collect():
        assert (row.x, row.y) == (row.a, row.b), row


def test_status_makes_a_row_wrong(spark):
    df = spark.createDataFrame([("ok", '"x"', '"x"'), ("truncated", '"x"', '"x"'), ("ok", None, '"x"')], "s string, p string, t string")
    for name in ("text", "json"):
        flags = [r[0] for r in df.select(T.is_correct(F.col("s"), F.col("p"), F.col("t"), name)).collect()]
        assert flags == [True, False, False]


# Status, target, prediction, generated text and the first kind that fits.
ERRORS = [
    ("ok", "Mai", "Lan", "(8,9),(10,11)", "coordinates"), ("missing", "Mai", None, "", "missing"), ("ok", 5, True, "true", "wrong_json_type"),
    ("ok", ["q"], [], "[]", "array_content"), ("ok", False, True, "true", "other_content"), ("ok", "   ", "none", "none", "spurious_nonempty"),
    ("ok", "Huế", " ", " ", "missing_value"), ("ok", "ĐÀ LẠT", "Đà Lạt", "Đà Lạt", "case_only"), ("ok", "GROSS", "groß", "groß", "case_only"),
    ("ok", "số\n9", "số 9", "số 9", "internal_whitespace"), ("ok", "Huế", "HUE", "HUE", "diacritics_or_case"),
    ("ok", "sn 48-B", "sn 43-B", "sn 43-B", "digit_substitution"), ("ok", "sn 48-B", "sn 4-B", "sn 4-B", "other_content"),
    ("invalid_json", "Mai", None, "{", "invalid_json"),
]


def test_error_kinds(spark):
    df = spark.createDataFrame([(json.dumps(t), None if p is None else json.dumps(p), s, x, k) for s, t, p, x, k in ERRORS],
                               "t string, p string, s string, x string, k string")
    kind = T.error_kind(F.col("s"), F.col("p"), F.col("t"), T.generated_text(F.col("x")))
    for row in df.select("k", "t", kind.alias("got")).collect():
        assert row.got == row.k, row


def test_small_text_functions(spark):
    df = spark.createDataFrame([("Số 5", "aa 9"), ("12/03/2024", "99/99/9999"), ("A-1_b", "a-9_a"), ("٣x²", "9aa")], "v string, s string")
    assert all(r[0] == r[1] for r in df.select(T.shape(F.col("v")), "s").collect())
    kinds = spark.createDataFrame([("", "scalar", "empty"), (" \t", "scalar", "empty"), ("1,234.5", "scalar", "numeric"),
                                   ("abc", "scalar", "text"), ("[1]", "array", "array"), ("--", "scalar", "text")], "v string, k string, e string")
    assert all(r[0] == r[1] for r in kinds.select(T.value_kind(F.col("v"), F.col("k")), "e").collect())
    boxes = spark.createDataFrame([("(0,77),(1000,8)", True), ("(5 ,6),\t(7, 8)\n", True), ("(5,6) (7,8)", False), ("((5,6),(7,8))", False),
                                   ("(5,6),(7,8),(9,9)", False), ("(-5,6),(7,8)", False), ("", False)], "v string, e boolean")
    assert all(r[0] == r[1] for r in boxes.select(T.is_coordinates(F.col("v")), "e").collect())
    old = spark.createDataFrame([(None, '"(1,2),(3,4)"', "(1,2),(3,4)"), ("abc", None, "abc"), (None, None, "")], "t string, r string, e string")
    assert all(r[0] == r[1] for r in old.select(T.generated_text(F.col("t"), F.col("r")), "e").collect())
    features = spark.createDataFrame([("007", ["leading_zero_digits"]), ("a\nb", ["multiline"]), (" a", ["surrounding_whitespace"]),
                                      ("<|x|>", ["angle_brackets", "special_token_like"]), ("0²", ["leading_zero_digits"]), ("0", [])],
                                     "v string, e array<string>")
    assert all(r[0] == r[1] for r in features.select(T.string_features(F.col("v")), "e").collect())


def test_value_types(spark):
    cases = [("x", "string"), ("", "empty_string"), (True, "bool"), (None, "null"), (3, "number"), (1.5, "number"), ([], "empty_array"),
             (["a"], "array_of_scalars"), (["a", {"b": 1}], "array_of_objects"), ({"a": 1}, "object")]
    df = spark.createDataFrame([(json.dumps(v), t) for v, t in cases], "v string, t string")
    assert all(r[0] == r[1] for r in df.select(V.value_type(F.col("v")), "t").collect())


def test_labels_flatten_in_key_order_and_assemble_again(spark):
    label = {"z": {"b/c": "x", "~k": ["1", {"q": "2", "a": "3"}]}, "a": True, "e": {}, "text": "{not json}", "arr": []}
    tree = {"z": {"b/c": "desc B", "~k": [{"__desc": "arr D", "q": "Q"}]}, "arr": ["items"]}
    df = spark.createDataFrame([(json.dumps(label), json.dumps(tree))], "l string, d string")
    fields = df.select(V.flatten_label(F.col("l"), F.col("d")).alias("f"))
    got = [tuple(r) for r in fields.select(F.inline("f")).collect()]
    assert got == [("/z/b~1c", "desc B", '"x"', "scalar"), ("/z/~0k", "arr D", '["1",{"q":"2","a":"3"}]', "array"), ("/a", "/a", "true", "scalar"),
                   ("/text", "/text", '"{not json}"', "scalar"), ("/arr", "items", "[]", "array")]
    back = json.loads(V.assembled(fields, "f").first().label)
    assert back == {k: v for k, v in label.items() if k != "e"}
    undescribed = df.select(F.inline(V.flatten_label(F.col("l"), F.col("d"), describe_arrays=False))).collect()
    assert undescribed[1].description == "/z/~0k"
    broken = spark.createDataFrame([('{"a": ',)], "l string").select(V.flatten_label(F.col("l"))).first()[0]
    assert broken is None


def test_field_list_prompts(spark):
    prompt = ('Extract:\n- "addr" (object)\n  - "city": City\n  - "ok" (true/false): is ok\n    - "deep": no parent\n- "rows" (array of objects): The rows\n'
              '  - "x": X\n- "tags" (mảng): Tags\n- "plain"\nnoise\n')
    df = spark.createDataFrame([(prompt,), ('[{"id": "a", "kind": "array"}, {"id": "/b", "description": "B"}]',),
                                ('{"a": "A", "n": {"x": "X", "r": [{"__desc": "R"}]}}',), ("prose",)], "p string")
    got = [[tuple(f) for f in r[0]] for r in df.select(V.requested_fields(F.col("p"))).collect()]
    assert got[0] == [("/addr/city", "City", "scalar"), ("/addr/ok", "(true/false) is ok", "scalar"), ("/addr/deep", "no parent", "scalar"),
                      ("/rows", "The rows", "array"), ("/tags", "Tags", "array"), ("/plain", "/plain", "scalar")]
    assert got[1] == [("/a", "/a", "array"), ("/b", "B", "scalar")]
    assert got[2] == [("/a", "A", "scalar"), ("/n/x", "X", "scalar"), ("/n/r", "R", "array")]
    assert got[3] == []


def test_broken_objects_keep_their_first_members(spark):
    texts = ['{"a": 1, "b": "x, }", "c": [1,2', '{"a":"q","b":{"k":1}} tail', '{"a": 1 zzz, "b": 2}', "nope", '{"a": "1", "a": "2", "b": "un', '{"a": "q\\"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(V.object_members(F.col("t"))).collect()]
    assert got == [{"a": "1", "b": '"x, }"'}, {"a": '"q"', "b": '{"k":1}'}, {"a": "1"}, {}, {"a": '"1"'}, {}]


def test_text_round_trip(spark):
    df = spark.createDataFrame([("true", "scalar", "true", "ok"), ("TRUE", "scalar", '"TRUE"', "ok"), ("[1, 2]", "array", "[1,2]", "ok"),
                                ("{}", "array", None, "invalid_array"), ("", "scalar", '""', "ok")], "t string, k string, v string, s string")
    for row in df.select(V.from_text(F.col("t"), F.col("k")).alias("r"), "v", "s").collect():
        assert (row.r.value, row.r.status) == (row.v, row.s)
    closed = df.limit(1).select(V.from_text(F.col("t"), F.col("k"), F.lit(False)).alias("r")).first().r
    assert (closed.value, closed.status) == (None, "truncated")


def leaves(spark, text):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = spark.createDataFrame([(text,)], "l string").select(V.flatten_label(F.col("l")).alias("f")).first()["f"]
    return found if found is None else [(f["id"], f["value"]) for f in found]


def test_labels_of_any_depth_with_white_space_and_repeated_keys(spark):
    deep = '"leaf"'
    for level in range(30):
        deep = f'{{"k{level}": {deep}}}'
    assert leaves(spark, deep) == [("/" + "/".join(f"k{n}" for n in reversed(range(30))), '"leaf"')]
    assert leaves(spark, '\n {"a": {"b": 1, "c": ["}{"]}, "d": "x{\\"{"}\t') == [("/a/b", "1"), ("/a/c", '["}{"]'), ("/d", '"x{\\"{"')]
    assert leaves(spark, '{"a":"x","b":2,"a":{"c":"y"}}') == [("/a/c", '"y"'), ("/b", "2")]
    assert leaves(spark, ' "only" ') == [("", '"only"')] and leaves(spark, "{}") == [] and leaves(spark, '{"a":') is None
    assert leaves(spark, None) is None


def test_plain_values_open_arrays_and_objects(spark):
    cases = [('[1, null, {"x": 2.5e3}]', '["1","",{"x":"2.5e3"}]'), ("null", '""'), ("-7", '"-7"'), ("true", "true"),
             ('"12, null [3]"', '"12, null [3]"'), ('{"a\\"1": [], "b": false}', '{"a\\"1":[],"b":false}')]
    df = spark.createDataFrame(cases, "v string, e string").select(V.plain_value(F.col("v")).alias("got"), "e")
    assert all(r.got == r.e for r in df.collect())


def test_assembled_labels(spark):
    fields = [("/b/c", '"x"'), ("/a", "[1, 2]"), ("/b/d/e", "null"), ("/b/f", "1.50"), ("/t~1u~0v", '"é"'), ("/a", "true")]
    rows = [(1, fields), (2, []), (3, None), (4, [("", '"root"')])]
    df = spark.createDataFrame(rows, "n int, fields array<struct<id:string,value:string>>")
    got = {r.n: r.label for r in V.assembled(df).collect()}
    assert got == {1: '{"b":{"c":"x","d":{"e":null},"f":1.50},"a":true,"t/u~v":"é"}', 2: "{}", 3: None, 4: '{"":"root"}'}


def test_a_key_listed_twice_in_a_prompt(spark):
    prompt = '- "a": first\n- "b": other\n- "a": last'
    df = spark.createDataFrame([(1, prompt, '{"a":1,"b":null}'), (2, prompt, "[1]")], "document_id int, prompt string, answer string")
    from fieldwarden.operators.dataset import chat_fields
    got = {r.document_id: r for r in chat_fields(df).collect()}
    assert [(f["id"], f["description"], f["value"]) for f in got[1].fields] == [("/a", "last", '"1"'), ("/b", "other", '""')]
    assert got[2].fields is None and got[2].reason


def test_field_lists_are_spread(spark):
    from fieldwarden.catalog import dataset

    for name in ("field_list_requests", "request_errors"):
        read = getattr(dataset, name)(spark, "/root/testdata/sf0.001")
        assert "REPARTITION_BY_NUM" in read._jdf.queryExecution().executedPlan().toString()
    assert dataset.field_list_requests(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
