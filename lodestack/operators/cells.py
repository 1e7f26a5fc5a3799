"""Approximate nearest vectors: chunks in folders by the cell of a k-means model, of which a search reads the nearest.

The model is fitted on a bounded sample, every row is dealt to the cell whose
centre has the largest cosine, and the rows are written partitioned by cell. A
search names the cells it wants, so Spark prunes all other folders, and ranks
what they hold exactly as ``search.knn`` does. How many cells that takes is
measured on the sample when the index is built.

Vectors that are null, of another length than most, zero, or hold null or
non-finite components are in no cell and never found; ties go by chunk_id; an
empty table gives an index that finds nothing. The index is a copy of the rows
it was built from and knows nothing of later writes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import search
from .filters import predicate

ROWS_A_CELL = 64
#: Columns of the index beside those of the rows.
OWN = [StructField("index_cell", IntegerType()), StructField("index_part", IntegerType()), StructField("index_node", IntegerType()), StructField("index_links", ArrayType(IntegerType()))]


def _usable(chunks: DataFrame, dims: int) -> DataFrame:
    return chunks.where((F.size("vector") == dims) & search.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))


def _sampled(rows: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    return rows.select("vector") if total <= n else rows.select("vector").sample(min(1.0, 1.2 * n / total), seed).limit(n)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold ``recall`` of the ``k`` nearest others of the sample's vectors.

    Neighbours are farther apart in a sample than among all rows, so all rows need no more.
    """
    unit, centres = _unit(sample), _unit(centres)
    home, asked = (unit @ centres.T).argmax(axis=1), min(len(unit), 500)
    score = unit[:asked] @ unit.T
    score[np.arange(asked), np.arange(asked)] = -2.0
    near = np.argsort(-score, axis=1)[:, : min(k, len(unit) - 1)]
    turn = np.argsort(np.argsort(-(unit[:asked] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(turn, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


class CellIndex:
    """An index under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = json.loads(spark.read.text(f"{self.path}/about").first()["value"])
        self.centres = np.array(KMeansModel.load(f"{self.path}/model").clusterCenters()) if self.about["cells"] else np.zeros((0, 0))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, max_cells: int = 4_096, k: int = 10, recall: float = 0.95, seed: int = 5) -> CellIndex:
        """Index ``chunks``: by default the root of their number in cells, at most ``max_cells`` (the centres are broadcast with the model).

        The model sees ``ROWS_A_CELL`` rows a cell; the number of probes is measured on 4000 rows.
        """
        spark, path = chunks.sparkSession, path.rstrip("/")
        dims = chunks.where("size(vector) > 0").groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        rows = _usable(chunks, dims["dims"] if dims else 0)
        total = rows.count() if dims else 0
        cells, probes = min(total, cells or max(1, min(max_cells, int(total**0.5)))), 0
        if total:
            feature = array_to_vector(F.col("vector").cast("array<double>")).alias("_feature")
            sample = _sampled(rows, max(4_000, ROWS_A_CELL * cells), total, seed)
            model = KMeans(k=max(2, cells), seed=seed, distanceMeasure="cosine", featuresCol="_feature", predictionCol="index_cell").fit(sample.select(feature))
            model.write().overwrite().save(f"{path}/model")
            centres = np.array(model.clusterCenters())
            cells = len(centres)
            held = np.array([r["vector"] for r in _sampled(rows, 4_000, total, seed + 1).collect()], dtype=np.float64)  # at most 4000 rows
            probes = probes_for(held, centres, k, recall)
            dealt = model.transform(rows.select("*", feature)).drop("_feature")
            cls._write(dealt, f"{path}/rows")
        sizes = {str(r["index_cell"]): r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("index_cell").count().collect()} if total else {}  # a row for each cell
        about = {"cells": cells, "probes": probes, "dims": dims["dims"] if dims else 0, "sizes": sizes, "schema": chunks.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return cls(spark, path)

    @classmethod
    def _write(cls, dealt: DataFrame, path: str) -> None:
        dealt.hint("rebalance", "index_cell").write.mode("overwrite").partitionBy("index_cell").parquet(path)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of all cells or of some."""
        schema = StructType.fromJson(self.about["schema"])
        return self._held(schema, cells).select(*schema.names)

    def _held(self, schema: StructType, cells: list[int] | None) -> DataFrame:
        whole = StructType([*schema.fields, *(f for f in OWN if f.name not in schema.names)])
        if not self.about["cells"]:
            return self.spark.createDataFrame([], whole)
        every = self.spark.read.schema(whole).parquet(f"{self.path}/rows")
        return every if cells is None else every.where(F.col("index_cell").isin(cells))

    def passing(self, filters: dict[str, Any] | None) -> np.ndarray:
        """How many rows of each cell pass the filter."""
        out, where = np.zeros(max(1, self.about["cells"]), dtype=np.int64), predicate(filters)
        counts = self.about["sizes"].items()
        if where is not None:
            counts = [(r["index_cell"], r["count"]) for r in self._held(StructType.fromJson(self.about["schema"]), None).where(where).groupBy("index_cell").count().collect()]  # a row for each cell
        for cell, n in counts:
            out[int(cell)] = n
        return out

    def _checked(self, vector: Sequence[float]) -> None:
        if len(vector) != self.about["dims"] or not np.all(np.isfinite(vector)):
            raise ValueError(f"the index holds vectors of {self.about['dims']} numbers")

    def search(self, vector: Sequence[float], k: int | None = None, filters: dict[str, Any] | None = None, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest rows found that pass the filter, as ``search.knn`` gives them.

        As many cells are read as the index was measured to need, and more where they hold fewer than ``2 * k``
        rows that pass, so a narrow filter does not shorten the answer. ``k=ALL`` reads all cells.
        """
        self._checked(vector)
        wanted = search.effective_k(k)
        if wanted == search.ALL or not self.about["cells"]:
            return search.knn(self.rows(), vector, k, filters)
        cells = cells_for(np.asarray(vector, dtype=np.float64)[None, :], self.centres, self.passing(filters), probes or self.about["probes"], wanted)[0]
        return search.knn(self.rows(cells.tolist()), vector, k, filters)


def cells_for(asked: np.ndarray, centres: np.ndarray, passing: np.ndarray, probes: int, k: int) -> list[np.ndarray]:
    """For each query the cells to read: the nearest ``probes``, and on until ``2 * k`` rows pass."""
    order = np.argsort(-(asked @ _unit(centres).T), axis=1, kind="stable")
    enough = (np.cumsum(passing[order], axis=1) < 2 * k).sum(axis=1) + 1
    return [cells[: max(probes, n)] for cells, n in zip(order, enough.tolist(), strict=True)]
