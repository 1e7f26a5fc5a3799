"""The engine without the training-data operators: their folders deleted, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as e
assert e.queries().keys() >= e.oracle_sql().keys() and "knn_exact" in e.queries()
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.entry(spark).count()
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_runs_without_the_operators(tmp_path, pipeline):
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/lodestack", tmp_path / "lodestack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=300)
