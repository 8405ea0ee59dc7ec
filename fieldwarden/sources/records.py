"""JSON-lines records, whole JSON files, logs and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped and a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines; the commit protocol keeps readers from half-written files."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add records to a folder of JSON lines."""
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One record (or an array of them) per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str, by: list[str]) -> None:
    """Whole-file JSON: one array of records per group of ``by``, each in a file of its own.

    A group is a file that its readers hold whole, so groups must be small.
    """
    arrays = df.groupBy(*by).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).select("value")
    arrays.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_whole_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(name, text)`` of small files, one row per file."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_log(spark: SparkSession, path: str | list[str], schema: StructType | str, keep_through: int | None = None) -> DataFrame:
    """Log records before the first torn line of their file, optionally up to a step.

    A line's place is its split's offset and its order inside the split, so
    files of any size are read by many tasks.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    parsed = lines.filter(F.trim("value") != "").withColumn("sound", F.try_parse_json("value").isNotNull()).withColumn(
        "r", F.from_json("value", schema))
    torn = parsed.filter(~F.col("sound")).groupBy("file").agg(F.min("place").alias("first_torn"))
    kept = parsed.join(torn, "file", "left").filter(F.col("first_torn").isNull() | (F.col("place") < F.col("first_torn")))
    records = kept.select("r.*")
    return records if keep_through is None else records.filter(F.col("step") <= keep_through)


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 of every file's bytes: ``(name, page_hash)``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.sha2("content", 256).alias("page_hash"))


def page_hashes(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Hash of every named page, null where the file is missing.

    Names are paths below ``path``. The folder is listed without its contents,
    and only files that are named are opened.
    """
    wanted = names.select("name").distinct()
    root = path.rstrip("/").split(":")[-1].lstrip("/")
    inside = F.substring_index("path", f"{root}/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashes = files.select(inside.alias("name"), "content").join(wanted, "name", "left_semi").select(
        "name", F.sha2("content", 256).alias("page_hash"))
    return wanted.join(hashes, "name", "left")


def files_digest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One digest of a set of files (names and bytes), the same in any listing order.

    Every file adds the four quarters of its own digest to four sums, so the
    number of files does not matter.
    """
    own = F.sha2(F.concat("name", F.lit(":"), "page_hash"), 256)
    quarters = [F.sum(F.conv(F.substring(own, at, 16), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 17, 33, 49)]
    return file_hashes(spark, path).agg(F.count("*").cast("int").alias("files"), F.sha2(F.concat_ws(":", *quarters), 256).alias("digest")).select(
        "digest", "files")


def claim_new(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet: plans and reports are never replaced."""
    df.write.mode("errorifexists").parquet(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """Replace a Parquet table partitioned by the columns (splits, cohorts, families)."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)
