"""A frozen bundle: calibration, policy, supported fields and shape rules as small tables in one folder."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import files_digest

PARTS = ("calibration", "policy", "supported", "rules")


@dataclass(frozen=True)
class Bundle:
    """Tables of a bundle and the fingerprint of the extractor it belongs to."""

    calibration: Mapping[str, object]
    policy: DataFrame
    supported: DataFrame
    rules: DataFrame | None
    source: str

    def check_source(self, fingerprint: str) -> None:
        """Refuse rows of another extractor than the one the bundle was fitted on."""
        if fingerprint != self.source:
            raise ValueError(f"the bundle belongs to extractor {self.source[:12]}, not {fingerprint[:12]}")


def save(bundle: Bundle, path: str) -> None:
    """Write a bundle once; an existing folder is an error."""
    spark = bundle.policy.sparkSession
    row = spark.range(1).select(F.lit(float(bundle.calibration["temperature"])).alias("temperature"),
                                F.lit(float(bundle.calibration["bias"])).alias("bias"),
                                F.lit(str(bundle.calibration["method"])).alias("method"), F.lit(bundle.source).alias("source"))
    tables = {"calibration": row, "policy": bundle.policy, "supported": bundle.supported, "rules": bundle.rules}
    for name, table in tables.items():
        if table is not None:
            table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, with_rules: bool = False) -> Bundle:
    """Read a bundle; its calibration is one row."""
    row = spark.read.parquet(f"{path}/calibration").first().asDict()
    return Bundle({k: row[k] for k in ("temperature", "bias", "method")}, spark.read.parquet(f"{path}/policy"),
                  spark.read.parquet(f"{path}/supported"), spark.read.parquet(f"{path}/rules") if with_rules else None, row["source"])


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of every data file of a bundle, to notice a change after freezing."""
    return files_digest(spark, [f"{path}/*/*.parquet"]).first()["digest"]
