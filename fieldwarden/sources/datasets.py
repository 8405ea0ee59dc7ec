"""Raw datasets, chat-label datasets, exclusions and trace caches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import document_id, variant_kept
from ..session import shared_dir, staged
from .records import page_hashes, read_json, read_jsonl, read_whole_text

MANIFEST = "form string, sample string, pages array<string>, fields string"
CHAT = "label_path string, image_path string, image_paths array<string>, split string"


def raw_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows ready for :func:`operators.dataset.labelled`, and their page hashes.

    Layout: ``manifest.jsonl``, ``images/``, ``kie-labels/`` and
    ``schemas/<form>.descriptions.json`` (a form's ``lift-`` prefix is left
    out of the name). Returns documents and ``(document_id, page_name, page_hash)``.
    """
    manifest = read_jsonl(spark, f"{root}/manifest.jsonl", MANIFEST).withColumn(
        "document_id", document_id(F.col("form"), F.col("sample")))
    names = manifest.select("document_id", F.posexplode("pages").alias("page", "name"))
    hashes = page_hashes(spark, f"{root}/images", names)
    pages = names.join(hashes, "name").select("document_id", "page", F.col("name").alias("page_name"), "page_hash")
    found = pages.groupBy("document_id").agg(F.bool_and(F.col("page_hash").isNotNull()).alias("pages_found"))
    labels = read_whole_text(spark, f"{root}/kie-labels").select(
        F.col("name").alias("fields"), F.get_json_object("text", "$.fields").alias("label"),
        F.get_json_object("text", "$.unprinted").alias("unprinted"))
    described = read_whole_text(spark, f"{root}/schemas").select(
        F.regexp_replace("name", r"\.descriptions\.json\z", "").alias("schema"), F.col("text").alias("description"))
    schema = F.regexp_replace("form", r"\Alift-", "").alias("schema")
    documents = (manifest.select("*", schema).join(labels, "fields", "left").join(described, "schema", "left")
                 .join(found, "document_id", "left").withColumn("pages_found", F.coalesce("pages_found", F.lit(False)))
                 .drop("schema").withColumnRenamed("fields", "label_file"))
    return documents, pages


def chat_dataset(spark: SparkSession, directory: str, variant: str | None = "v1", split: str | None = None) -> DataFrame:
    """Entries of a chat-label dataset with their labels: ``(document_id, dataset, label_name, pages, prompt, answer)``.

    Moved files are found again by their name inside ``labels/`` and ``images/``.
    """
    dataset = directory.rstrip("/").rsplit("/", 1)[-1]
    entries = read_json(spark, f"{directory}/image_label_details.json", CHAT)
    if split is not None:
        entries = entries.filter(F.coalesce("split", F.lit(split)) == split)
    entries = entries.filter(variant_kept(F.col("label_path"), variant))
    name = F.regexp_extract("label_path", r"([^/]*)\z", 1)
    pages = F.transform(F.coalesce("image_paths", F.array("image_path")), lambda p: F.regexp_extract(p, r"([^/]*)\z", 1))
    turns = "conversations array<struct<role:string, content:string>>"
    labels = read_whole_text(spark, f"{directory}/labels").select("name", F.from_json("text", turns)["conversations"].alias("t"))
    first = F.get(F.filter("t", lambda x: x["role"] == "user"), F.lit(0))["content"]
    last = F.try_element_at(F.filter("t", lambda x: x["role"] == "assistant"), F.lit(-1))["content"]
    return entries.select(name.alias("name"), pages.alias("pages")).join(labels, "name").select(
        F.concat(F.lit(f"{dataset}__"), F.regexp_replace("name", r"\.[^.]*\z", "")).alias("document_id"),
        F.lit(dataset).alias("dataset"), F.col("name").alias("label_name"), "pages", first.alias("prompt"), last.alias("answer"))


def exclusions(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Used document ids with their source: ``(document_id, source)``.

    ``paths`` maps a path to its format: ``rows`` (JSON lines with document_id
    or id), ``traces`` (Parquet rows of a trace cache) or ``plan`` (an earlier
    cohort plan; all its cohorts and its own exclusions). A path that does not
    exist is an error when it is read.
    """
    parts = []
    for path, kind in paths.items():
        if kind == "rows":
            ids = read_jsonl(spark, path, "document_id string, id string").select(F.coalesce("document_id", "id").alias("document_id"))
        elif kind in ("traces", "plan"):
            ids = spark.read.parquet(path).select("document_id")
        else:
            raise ValueError(f"unknown exclusion format {kind!r}")
        parts.append(ids.filter(F.col("document_id").isNotNull()).distinct().withColumn("source", F.lit(path)))
    if not parts:
        return spark.createDataFrame([], "document_id string, source string")
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    return together


def write_traces(rows: DataFrame, records: DataFrame, metadata: DataFrame, path: str) -> None:
    """A trace cache: rows and records partitioned by cohort, and ``(cohort, key, value)`` metadata."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    records.write.mode("overwrite").partitionBy("split").parquet(f"{path}/records")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def read_traces(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of a trace cache joined with their records; a cohort is one pruned partition."""
    rows, records = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "records"))
    joined = rows.join(records, ["split", "trace_index"], "left")
    return joined if split is None else joined.filter(F.col("split") == split)


def validated_traces(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one cohort of a trace cache, copied to the shared folder in the same read that checks them.

    Every row must say it belongs to ``split``, and the trace indices of rows
    with a trace must be 0 to n - 1, each once; anything else is an error
    before a row is used. The numbers are observed while the rows pass by: a
    sum of hashes stands for the set of indices, and is compared with that of
    the right ones.
    """
    rows = spark.read.parquet(f"{path}/rows")
    # The folder names the cohort; what the rows say of themselves is a column of their own.
    rows = rows.filter(F.col("split") == split)
    named = F.col("row_split") if "row_split" in rows.columns else F.col("split")
    traced = F.col("trace_index") >= 0
    seen = Observation()
    # Decimals: the sum neither overflows nor depends on the order.
    index = F.xxhash64(F.col("trace_index").cast("bigint")).cast("decimal(20,0)")
    observed = rows.observe(
        seen, F.count("*").alias("rows"), F.count(F.when(~named.eqNullSafe(F.lit(split)), 1)).alias("foreign"), F.count(F.when(traced, 1)).alias("traced"),
        F.max(F.when(traced, F.col("trace_index"))).alias("last"), F.coalesce(F.sum(F.when(traced, index)), F.lit(0)).cast("string").alias("sum"))
    kept = staged(observed, "traces")
    found = seen.get
    right = spark.range(found["traced"]).agg(F.coalesce(F.sum(F.xxhash64("id").cast("decimal(20,0)")), F.lit(0)).cast("string")).first()[0]
    problems = [name for name, wrong in (("rows of another split", found["foreign"] > 0),
                                         ("gaps in the trace indices", (found["last"] if found["last"] is not None else -1) + 1 != found["traced"]),
                                         ("repeated trace indices", found["sum"] != right)) if wrong]
    if problems:
        raise ValueError(f"{path} is no sound trace cache of {split}: {', '.join(problems)}")
    return kept


def from_old_layout(rows: DataFrame) -> DataFrame:
    """Columns of the old trace layout under their present names."""
    return rows.withColumnsRenamed({"feature_index": "trace_index", "end": "value", "token_stats": "stats"})


def staging_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of the sources."""
    return shared_dir(spark)
