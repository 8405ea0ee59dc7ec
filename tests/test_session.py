"""The package on workers, and where staged tables may lie."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from fieldwarden import session

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from fieldwarden.functions import text
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("e\u0301",)], "t string")
print("GOT", len(df.select(text.nfc(F.col("t"))).first()[0]))
"""


def test_batch_functions_reach_workers_without_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 1" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("master,allowed", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_must_name_its_shared_folder(master, allowed):
    found = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: found[-1] if found else None, setCheckpointDir=found.append)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    if allowed:
        assert session.shared_dir(spark) == found[0]
    else:
        with pytest.raises(ValueError):
            session.shared_dir(spark)
