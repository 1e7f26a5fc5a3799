"""Tables written to the shared folder, so that lineage ends where executors can be lost.

The folder is ``spark.checkpoint.dir`` as the session has it; only a session
without that setting (a test on one machine) gets a temporary folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, tempfile.mkdtemp(prefix="spark-work-"))
    return root.rstrip("/")


def few_rows(batches, rows: int = 1024):
    """Arrow batches in slices, so that a task holds the Python values of few texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Workspace:
    """A folder of intermediate tables for one query."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tables-{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`save` that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
