"""The driver tables seen as documents, labels, predictions, traces and logs.

Every view is a row-local mapping of a whole table: one order is one
document, its columns are the fields. Predictions and scores follow from
hashes of the keys, so both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import strip, to_json_string
from ..session import TASK_ROWS, computed_once, parts_of, read_table, spread


def word(digest: Column, lane: int) -> Column:
    """One 32-bit word of a hex digest, as BIGINT."""
    return F.conv(F.substring(digest, 8 * lane + 1, 8), 16, 10).cast("bigint")


ORDER_FIELDS = {
    "/order/status": "o_orderstatus", "/order/total": "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)",
    "/order/date": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "/order/priority": "o_orderpriority",
    "/order/key": "CAST(o_orderkey AS STRING)", "/customer/key": "CAST(o_custkey AS STRING)",
}


def order_fields(spark: SparkSession, sf_dir: str, system: str = "a", documents: DataFrame | None = None) -> DataFrame:
    """One row per order and column: document_id, form, position, field_id, target and four hash words.

    ``documents`` are joined by ``document_id`` while an order is one row, and
    their other columns are kept.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    form = F.concat(F.lit("f"), F.substring("o_orderpriority", 1, 1))

    def named(table: DataFrame) -> DataFrame:
        return table.withColumn("form", form).withColumn(
            "document_id", F.concat("form", F.lit("__"), F.col("o_orderkey").cast("string")))

    if documents is None:
        keyed, kept = named(spread(orders, TASK_ROWS)), []
    else:
        tasks, kept = parts_of(orders), [c for c in documents.columns if c != "document_id"]
        keyed = named(orders).repartition(tasks, "document_id").join(documents.repartition(tasks, "document_id"), "document_id")
    fields = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("field_id"), F.expr(sql).alias("target"),
        F.sha2(F.concat(F.lit(f"{system}:"), F.col("document_id"), F.lit(f":{name}")), 256).alias("__d"))
        for i, (name, sql) in enumerate(ORDER_FIELDS.items())])
    rows = keyed.select("document_id", "form", *kept, F.inline(fields))
    halves = [F.conv(F.substring("__d", 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"__h{i}") for i in range(2)]
    low = F.lit(0xFFFFFFFF).cast("bigint")
    # Two words per conversion: the signed 64 bits are taken apart again.
    words = [w.alias(f"__w{2 * i + j}") for i in range(2) for j, w in enumerate((
        F.shiftrightunsigned(f"__h{i}", 32), F.col(f"__h{i}").bitwiseAND(low)))]
    names = ["document_id", "form", *kept, "position", "field_id", "target"]
    return rows.select(*names, *halves).select(*names, *words)


def predicted(rows: DataFrame) -> DataFrame:
    """Adds status, prediction, correct, score, shape_violation and logit, all decided by the hash words."""
    h, s = F.col("__w0") % 1000, F.col("__w1") % 1000
    target = F.col("target")
    status = F.when(h < 30, "truncated").when(h < 40, "invalid_json").when(h < 55, "missing").otherwise("ok")
    prediction = (
        F.when(h < 55, F.lit(None).cast("string")).when(h < 75, F.lower(target))
        .when(h < 95, F.translate(target, "0123456789", "1234567890")).when(h < 105, F.lit(""))
        .when(h < 115, F.replace(target, F.lit("-"), F.lit("/"))).when(h < 125, F.lit("(1,2),(3,4)"))
        .when(h < 145, F.concat(F.lit("  "), target, F.lit(" "))).otherwise(target))
    # Columns used several times stay projections of their own; only the last step keeps filters out.
    valued = rows.withColumn("status", status).withColumn("prediction", prediction)
    # Equal texts are not stripped first.
    same = (F.col("prediction") == target) | (strip(F.col("prediction")) == strip(target))
    correct = (F.col("status") == "ok") & F.coalesce(same, F.lit(False))
    level = F.when(F.col("correct"), 1000 - F.floor(s * s / 1000)).otherwise(s)
    score = (F.when(F.col("status") != "ok", F.lit(None).cast("double"))
             .when(F.col("__w2") % 997 == 0, F.lit(float("nan"))).otherwise(level / F.lit(1000.0)))
    scored = valued.withColumn("correct", correct).withColumn("score", score).withColumn("shape_violation", F.col("__w3") % 250 == 0)
    p = F.least(F.greatest(F.col("score"), F.lit(0.001)), F.lit(0.999))
    logit = F.when(finite(F.col("score")), F.log(p / (1 - p)))
    return computed_once(scored.withColumn("logit", logit).drop("__w0", "__w1", "__w2", "__w3"))


def review_rows(spark: SparkSession, sf_dir: str, system: str = "a", documents: DataFrame | None = None) -> DataFrame:
    """Review rows of one of two systems over the order fields, with the other columns of ``documents`` if given."""
    return predicted(order_fields(spark, sf_dir, system, documents))


def _word(lane: int) -> str:
    return f"('0x' || substr(d, {8 * lane + 1}, 8))::UBIGINT::BIGINT"


def review_rows_sql(name: str = "rows", system: str = "a") -> str:
    """The review rows as common table expressions; ``name`` is the last one."""
    unpivot = "\n  UNION ALL ".join(
        f"SELECT 'f' || substr(o_orderpriority, 1, 1) || '__' || o_orderkey::VARCHAR AS document_id, "
        f"'f' || substr(o_orderpriority, 1, 1) AS form, {i} AS position, '{field}' AS field_id, "
        f"{sql.replace('STRING', 'VARCHAR')} AS target FROM orders"
        for i, (field, sql) in enumerate(ORDER_FIELDS.items()))
    return f"""{name}_fields AS ({unpivot}),
{name}_words AS (SELECT *, sha256('{system}:' || document_id || ':' || field_id) AS d FROM {name}_fields),
{name}_status AS (SELECT *, {_word(0)} % 1000 AS h, {_word(1)} % 1000 AS s,
  CASE WHEN {_word(0)} % 1000 < 30 THEN 'truncated' WHEN {_word(0)} % 1000 < 40 THEN 'invalid_json'
       WHEN {_word(0)} % 1000 < 55 THEN 'missing' ELSE 'ok' END AS status FROM {name}_words),
{name}_predicted AS (SELECT *, CASE WHEN h < 55 THEN NULL WHEN h < 75 THEN lower(target)
  WHEN h < 95 THEN translate(target, '0123456789', '1234567890') WHEN h < 105 THEN ''
  WHEN h < 115 THEN replace(target, '-', '/') WHEN h < 125 THEN '(1,2),(3,4)'
  WHEN h < 145 THEN '  ' || target || ' ' ELSE target END AS prediction FROM {name}_status),
{name}_judged AS (SELECT *, status = 'ok' AND coalesce(trim(prediction) = trim(target), false) AS correct
  FROM {name}_predicted),
{name}_scored AS (SELECT document_id, form, position, field_id, target, status, prediction, correct,
  CASE WHEN status <> 'ok' THEN NULL WHEN {_word(2)} % 997 = 0 THEN 'NaN'::DOUBLE
       WHEN correct THEN (1000 - (s * s) // 1000) / 1000.0::DOUBLE ELSE s / 1000.0::DOUBLE END AS score,
  {_word(3)} % 250 = 0 AS shape_violation FROM {name}_judged),
{name} AS (SELECT *, CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN
  ln(least(greatest(score, 0.001::DOUBLE), 0.999::DOUBLE) / (1 - least(greatest(score, 0.001::DOUBLE), 0.999::DOUBLE)))
  END AS logit, status = 'ok' AND NOT shape_violation AND score IS NOT NULL AND NOT isnan(score) AS usable
  FROM {name}_scored)"""


# ------------------------------------------------------------------ text predictions: lines of the documents

# Accented letters and the letters a careless reader writes for them.
ACCENTED, BARE = "éèêëàâäáçñóòôöíìîïúùûüÉÈÊÀÂÄÁÇÑÓÖÍÚÜ", "eeeeaaaacnooooiiiiuuuuEEEAAAACNOOIUU"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every document: document_id, form (language), position, line."""
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    lines = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("form"),
                             F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return lines.filter(strip(F.col("line")) != "")


LINES_SQL = r"""lines AS (SELECT doc_id::VARCHAR AS document_id, lang AS form, (unnest(range(len(string_split(text, chr(10)))))) AS position,
  unnest(string_split(text, chr(10))) AS line FROM documents),
doc_lines AS (SELECT * FROM lines WHERE regexp_replace(line, '^[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '') <> '')"""


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows over document lines: JSON values, each kind of error occurring."""
    rows = document_lines(spark, sf_dir).withColumn(
        "__d", F.sha2(F.concat_ws(":", F.lit("t"), "document_id", F.col("position").cast("string")), 256))
    rows = computed_once(rows.withColumn("h", word(F.col("__d"), 0) % 1000).drop("__d"))
    h, line = F.col("h"), F.col("line")
    value = (F.when(h < 60, F.lower(line)).when(h < 120, F.translate(line, ACCENTED, BARE))
             .when(h < 180, F.replace(line, F.lit(" "), F.lit("  ")))
             .when(h < 240, F.translate(line, "0123456789", "1234567890")).when(h < 270, F.lit(""))
             .when(h < 300, F.lit("(1,2),(3,4)")).when(h < 330, F.concat(line, F.lit("x")))
             .when(h < 420, F.concat(F.lit(" \t"), line)).otherwise(line))
    status = F.when((h >= 900) & (h < 930), "truncated").when((h >= 930) & (h < 940), "invalid_array").otherwise("ok")
    rows = computed_once(rows.withColumn("text", value).withColumn("status", status))
    prediction = (F.when(F.col("status") != "ok", F.lit(None).cast("string")).when((h >= 330) & (h < 350), "17")
                  .when((h >= 350) & (h < 360), '["x"]').otherwise(to_json_string(F.col("text"))))
    target = F.when((h >= 880) & (h < 890), '""').when((h >= 870) & (h < 880), '["a", "b"]').otherwise(
        to_json_string(line))
    return computed_once(rows.select(
        "document_id", "form", F.concat(F.lit("/line/"), F.col("position").cast("string")).alias("field_id"),
        target.alias("target"), prediction.alias("prediction"), "text", "status"))


_STRIP = "trim({}, (SELECT spaces FROM spaces))"
TEXT_ROWS_SQL = LINES_SQL + f""",
spaces AS (SELECT list_aggregate(list_transform([9,10,11,12,13,28,29,30,31,32,133,160,5760,8192,8193,8194,8195,8196,8197,8198,8199,8200,8201,8202,8232,8233,8239,8287,12288], lambda x: chr(x)), 'string_agg', '') AS spaces),
hashed AS (SELECT *, ('0x' || substr(sha256('t:' || document_id || ':' || position::VARCHAR), 1, 8))::UBIGINT::BIGINT % 1000 AS h FROM doc_lines),
valued AS (SELECT *, CASE WHEN h < 60 THEN lower(line) WHEN h < 120 THEN translate(line, '{ACCENTED}', '{BARE}')
  WHEN h < 180 THEN replace(line, ' ', '  ') WHEN h < 240 THEN translate(line, '0123456789', '1234567890') WHEN h < 270 THEN ''
  WHEN h < 300 THEN '(1,2),(3,4)' WHEN h < 330 THEN line || 'x' WHEN h < 420 THEN ' ' || chr(9) || line ELSE line END AS text,
  CASE WHEN h >= 900 AND h < 930 THEN 'truncated' WHEN h >= 930 AND h < 940 THEN 'invalid_array' ELSE 'ok' END AS status FROM hashed),
typed AS (SELECT *, CASE WHEN status <> 'ok' THEN 'null' WHEN h >= 330 AND h < 350 THEN 'int' WHEN h >= 350 AND h < 360 THEN 'array' ELSE 'string' END AS pt,
  CASE WHEN h >= 870 AND h < 880 THEN 'array' ELSE 'string' END AS tt, CASE WHEN h >= 330 AND h < 350 THEN '17' ELSE text END AS p,
  CASE WHEN h >= 880 AND h < 890 THEN '' ELSE line END AS t FROM valued),
text_rows AS (SELECT *, '/line/' || position AS field_id, {_STRIP.format('nfc_normalize(p)')} AS b, {_STRIP.format('nfc_normalize(t)')} AS a FROM typed),
judged AS (SELECT *, status = 'ok' AND tt = 'string' AND pt <> 'array' AND a = b AS correct,
  status = 'ok' AND tt = 'string' AND pt = 'string' AND a = b AS strict FROM text_rows)"""


# ------------------------------------------------------------------ array predictions: lines of orders

def array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array field per order line: three cells, some rows dropped, swapped, changed or cut."""
    lines = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag"), TASK_ROWS)
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    cells = {"qty": F.col("l_quantity").cast("int").cast("string"),
             "tax": F.round(F.col("l_tax") * 100).cast("int").cast("string"), "flag": F.col("l_returnflag")}
    rows = lines.select(key.alias("document_id"), *[v.alias(k) for k, v in cells.items()])
    rows = computed_once(rows.withColumn("h", word(F.sha2(F.concat(F.lit("l:"), F.col("document_id")), 256), 0) % 1000))

    def item(name: str, value: Column | None = None) -> Column:
        text = F.col(name) if value is None else value
        return F.concat(F.lit(f'{{"k":"{name}","v":"'), text, F.lit('"}'))

    def array(*items: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))

    h = F.col("h")
    prediction = (F.when(h < 100, array(item("qty"), item("tax"))).when(h < 200, array(item("tax"), item("qty"), item("flag")))
                  .when(h < 300, array(item("qty", F.lit("99")), item("tax"), item("flag")))
                  .when(h < 330, F.concat(F.lit('[{"v":'), F.col("qty"), F.lit(',"k":"qty"},'), item("tax"), F.lit(","),
                                          item("flag"), F.lit("]")))
                  .when(h < 350, F.concat(F.lit('[{"k":"qty","v":null},null,'), item("flag"), F.lit("]")))
                  .when(h < 380, F.lit(None).cast("string")).otherwise(array(item("qty"), item("tax"), item("flag"))))
    return computed_once(rows.select(
        "document_id", F.lit("/cells").alias("field_id"), F.lit("array").alias("kind"), F.lit("line").alias("form"),
        array(item("qty"), item("tax"), item("flag")).alias("target"), prediction.alias("prediction"),
        prediction.alias("text"), F.when((h >= 350) & (h < 380), "truncated").otherwise("ok").alias("status")))


ARRAY_ROWS_SQL = """cells AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS document_id, l_quantity::INT::VARCHAR AS qty,
  round(l_tax * 100)::INT::VARCHAR AS tax, l_returnflag AS flag FROM lineitem),
hashed AS (SELECT *, ('0x' || substr(sha256('l:' || document_id), 1, 8))::UBIGINT::BIGINT % 1000 AS h FROM cells),
arrays AS (SELECT *, ['qty=' || qty, 'tax=' || tax, 'flag=' || flag] AS t,
  CASE WHEN h < 100 THEN ['qty=' || qty, 'tax=' || tax] WHEN h < 200 THEN ['tax=' || tax, 'qty=' || qty, 'flag=' || flag]
    WHEN h < 300 THEN ['qty=99', 'tax=' || tax, 'flag=' || flag] WHEN h < 330 THEN ['qty=' || qty, 'tax=' || tax, 'flag=' || flag]
    WHEN h < 350 THEN ['qty=', '', 'flag=' || flag] WHEN h < 380 THEN []::VARCHAR[] ELSE ['qty=' || qty, 'tax=' || tax, 'flag=' || flag] END AS p
  FROM hashed)"""


# ------------------------------------------------------------------ prepared documents: orders grouped by customer

def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order; orders of one customer form a group: document_id, group_id, form, split."""
    from ..operators.dataset import split_of

    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    form = F.concat(F.lit("f"), F.substring("o_orderpriority", 1, 1))
    docs = orders.select(F.concat(form, F.lit("__"), F.col("o_orderkey").cast("string")).alias("document_id"),
                         F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("group_id"), form.alias("form"))
    return docs.withColumn("split", split_of(F.col("group_id")))


BUCKET = "(('0x' || substr(sha256({}), 1, 8))::UBIGINT::BIGINT % 100)"
SPLIT_CASE = "CASE WHEN {b} < 80 THEN 'train' WHEN {b} < 87 THEN 'dev' WHEN {b} < 94 THEN 'calibration' ELSE 'test' END"
PREPARED_SQL = f"""docs_raw AS (SELECT 'f' || substr(o_orderpriority, 1, 1) || '__' || o_orderkey AS document_id, 'c' || o_custkey AS group_id,
  'f' || substr(o_orderpriority, 1, 1) AS form FROM orders),
docs AS (SELECT *, {SPLIT_CASE.format(b=BUCKET.format("'42:' || group_id"))} AS split, {BUCKET.format('group_id')} AS bucket FROM docs_raw)"""


# ------------------------------------------------------------------ nested labels: one per part

def part_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest row per part: nested label, description tree, unprinted list; some are broken or empty."""
    parts = spread(read_table(spark, sf_dir, "part"), TASK_ROWS)
    number = F.col("p_partkey")
    tags = F.split("p_name", " ")
    label = F.to_json(F.struct(
        F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("br/and~x")).alias("part"),
        F.col("p_size").cast("string").alias("size"), (F.col("p_size") > 25).alias("large"), tags.alias("tags"),
        F.array(F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v"))).alias("dims"),
        F.struct(F.struct(F.col("p_type").alias("c")).alias("b")).alias("a")))
    label = F.when(number % 41 == 0, F.substring(label, 1, 20)).when(number % 43 == 0, F.lit("{}")).otherwise(label)
    description = F.lit('{"part": {"name": "Part name"}, "tags": ["One tag"], "dims": [{"__desc": "Measures", "k": "x"}], '
                        '"size": "Size in cm", "large": ["x"]}')
    unprinted = F.when(number % 10 == 0, '["/size", "/part/name"]').when(number % 10 == 1, '{"not": "a list"}')
    form = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    group = F.concat(F.lit("b"), F.col("p_brand"))
    from ..operators.dataset import split_of

    return parts.select(
        F.concat(form, F.lit("__"), number.cast("string")).alias("document_id"), form.alias("form"),
        group.alias("group_id"), split_of(group).alias("split"), label.alias("label"), description.alias("description"),
        unprinted.alias("unprinted"), (number % 47 != 0).alias("pages_found"),
        F.slice(tags, 1, 1).alias("pages"))


MANIFEST_SQL = f"""manifest AS (SELECT lower(split_part(p_type, ' ', 1)) || '__' || p_partkey AS document_id, lower(split_part(p_type, ' ', 1)) AS form,
  'b' || p_brand AS group_id, {SPLIT_CASE.format(b=BUCKET.format("'42:' || 'b' || p_brand"))} AS split, * FROM part),
leaves AS (
  SELECT document_id, 0 AS ord, '/part/name' AS field_id, 'Part name' AS description, '"' || p_name || '"' AS value, 'scalar' AS kind, 'string' AS value_type FROM manifest
  UNION ALL SELECT document_id, 1, '/part/br~1and~0x', '/part/br~1and~0x', '"' || p_brand || '"', 'scalar', 'string' FROM manifest
  UNION ALL SELECT document_id, 2, '/size', 'Size in cm', '"' || p_size || '"', 'scalar', 'string' FROM manifest
  UNION ALL SELECT document_id, 3, '/large', '/large', (p_size > 25)::VARCHAR, 'scalar', 'bool' FROM manifest
  UNION ALL SELECT document_id, 4, '/tags', 'One tag', '["' || replace(p_name, ' ', '","') || '"]', 'array', 'array_of_scalars' FROM manifest
  UNION ALL SELECT document_id, 5, '/dims', 'Measures', '[{{"k":"size","v":"' || p_size || '"}}]', 'array', 'array_of_objects' FROM manifest
  UNION ALL SELECT document_id, 6, '/a/b/c', '/a/b/c', '"' || p_type || '"', 'scalar', 'string' FROM manifest),
reasons AS (SELECT *, CASE WHEN p_partkey % 47 = 0 THEN 'Missing image' WHEN p_partkey % 41 = 0 THEN 'Malformed label'
  WHEN p_partkey % 43 = 0 THEN 'No usable fields' END AS reason FROM manifest),
fields AS (SELECT r.document_id, r.form, r.split, r.group_id, r.reason, row_number() OVER (PARTITION BY r.document_id ORDER BY ord) - 1 AS position,
  field_id, leaves.description, value, kind, value_type FROM reasons r JOIN leaves USING (document_id)
  WHERE p_partkey % 41 <> 0 AND p_partkey % 43 <> 0 AND NOT (p_partkey % 10 = 0 AND field_id IN ('/size', '/part/name')))"""


# ------------------------------------------------------------------ trace records: lines as values, words as tokens

def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document line: words as token pieces with five statistics each, and a close decision."""
    lines = document_lines(spark, sf_dir)
    h = word(F.sha2(F.concat_ws(":", F.lit("k"), "document_id", F.col("position").cast("string")), 256), 0) % 1000
    rows = computed_once(lines.select("document_id", "form", "position", F.col("line").alias("text"), h.alias("h"),
                                      F.when(h % 10 == 0, "array").otherwise("scalar").alias("kind"),
                                      F.split("line", " ").alias("pieces")))

    def stats(length: Column, at: Column) -> Column:
        h = F.col("h")
        return F.struct(
            (-((length * 7 + at * 13 + h) % 1000) / 97.0).alias("log_probability"),
            (((at * 31 + h) % 997) / 997.0).alias("normalized_entropy"),
            (((at * 17 + length + h) % 991) / 991.0).alias("probability_margin"),
            (((at * 11 + h) % 500) / 53.0).alias("logit_margin"),
            (-((at * 29 + h) % 800) / 53.0).alias("close_log_probability"))

    return computed_once(rows.select(
        "document_id", "form", F.concat(F.lit("/line/"), F.col("position").cast("string")).alias("field_id"), "text", "kind",
        "pieces", "h", F.transform("pieces", lambda p, i: stats(F.length(p), i)).alias("stats"),
        stats(F.lit(0), F.lit(7)).alias("close")))


TRACES_SQL = LINES_SQL + """,
traces AS (SELECT *, ('0x' || substr(sha256('k:' || document_id || ':' || position), 1, 8))::UBIGINT::BIGINT % 1000 AS h FROM doc_lines),
pieces AS (SELECT document_id, position, form, line, h, unnest(string_split(line, ' ')) AS piece, unnest(range(len(string_split(line, ' ')))) AS i FROM traces),
tokens AS (SELECT *, -((length(piece) * 7 + i * 13 + h) % 1000) / 97.0::DOUBLE AS logp, ((i * 31 + h) % 997) / 997.0::DOUBLE AS ent,
  ((i * 17 + length(piece) + h) % 991) / 991.0::DOUBLE AS pm, ((i * 11 + h) % 500) / 53.0::DOUBLE AS lm, -((i * 29 + h) % 800) / 53.0::DOUBLE AS cl,
  length(trim(piece, CASE WHEN h % 10 = 0 THEN ' "{}[],:' || chr(9) || chr(13) || chr(10) ELSE ' ' || chr(9) || chr(13) || chr(10) END)) > 0 AS content FROM pieces),
closing AS (SELECT *, -((91 + h) % 1000) / 97.0::DOUBLE AS c_logp FROM traces)"""


# ------------------------------------------------------------------ the request log: one request per event

def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving log: every event is a request, its value the seconds, its type the model."""
    return as_requests(read_table(spark, sf_dir, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as request records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), "user_id", F.col("event_type").alias("model"),
        (F.col("user_id") % 2 == 0).alias("merge"), (1 + k % 20).alias("fields"), (k * 3).alias("generated_tokens"),
        F.when(~failed, F.col("value")).alias("infer"), F.when(~failed, F.col("value") * 0.75).alias("decode"),
        F.when(~failed, F.col("value") * 0.125).alias("prefix"),
        F.when(failed, F.concat(F.when(k % 2 == 0, "ValueError").otherwise("OSError"), F.lit(": item "),
                                k.cast("string"))).alias("error"))


REQUESTS_SQL = """requests AS (SELECT event_id AS id, ts AS time, user_id, event_type AS model, user_id % 2 = 0 AS merge,
  json_extract_string(props, '$.k')::BIGINT AS k, 1 + json_extract_string(props, '$.k')::BIGINT % 20 AS fields,
  json_extract_string(props, '$.k')::BIGINT * 3 AS generated_tokens, CASE WHEN event_type <> 'error' THEN value END AS infer,
  CASE WHEN event_type <> 'error' THEN value * 0.75::DOUBLE END AS decode, CASE WHEN event_type <> 'error' THEN value * 0.125::DOUBLE END AS prefix,
  CASE WHEN event_type = 'error' THEN CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 0 THEN 'ValueError' ELSE 'OSError' END END AS error_type FROM events)"""


# ------------------------------------------------------------------ branches: the fields of an order with token counts

def order_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: prefix tokens and an array of branches (id, prompt and target tokens)."""
    orders = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), TASK_ROWS)
    branches = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(3 + len(name)).cast("bigint").alias("prompt"),
                                  (F.length(F.expr(sql)) + 1).cast("bigint").alias("target"))
                         for name, sql in ORDER_FIELDS.items()])
    return orders.select(F.col("o_orderkey").alias("document_id"), (10 + F.col("o_custkey") % 90).alias("prefix"),
                         branches.alias("branches"))


BRANCHES_SQL = "branches AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS document_id, 10 + o_custkey % 90 AS prefix, {i} AS position, '{name}' AS id, {3 + len(name)} AS prompt, "
    f"length({sql.replace('STRING', 'VARCHAR')}) + 1 AS target FROM orders" for i, (name, sql) in enumerate(ORDER_FIELDS.items())) + ")"
