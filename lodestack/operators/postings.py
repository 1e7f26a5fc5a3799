"""An inverted index of the filterable fields: which chunks hold a value.

One row a field, value and chunk, in folders by field and sorted by value, so a filter on an array column reads
the row groups around its values and no chunk. The chunks found are then fetched by their
document ids. Values are dealt to files by value and document, so a value that most chunks hold is spread over many.

An index may hold some fields only (``fields``) and be extended by others later; what it does not hold is tested on the
chunks that the fields it holds have found (see ``search.first_matching``). Tasks of the build take a fixed number of postings, so
their memory does not grow with the table.

The index is a copy of the rows it was built from and knows nothing of later writes. Null
fields, null values and rows without a document id have no posting; a value that a chunk repeats has one. Chunks are
told apart by document and chunk number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import ARRAYS, SCALARS, predicate

ALL = -1
FETCHED_BY_ID = 2_000
ROW_GROUP = 4 << 20
POSTINGS_A_TASK = 500_000
FIELDS = (*SCALARS, *ARRAYS)


def postings(chunks: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(field, value, document_id, chunk_index) of every filterable field that ``chunks`` has, or of some."""
    def entries(name: str) -> DataFrame:
        value = F.col(name).cast("string") if name in SCALARS else F.explode(F.array_distinct(name))
        return chunks.where("document_id is not null").select(F.lit(name).alias("field"), value.alias("value"), "document_id", "chunk_index").where("value is not null")

    held = [entries(name) for name in FIELDS if name in fields and name in chunks.columns]
    return reduce(DataFrame.unionAll, held)


class PostingIndex:
    """The index of ``fields`` under ``path``. ``rows`` gives the chunk rows of some documents, or all of them."""

    def __init__(self, spark: SparkSession, path: str, rows: Callable[[list[str] | None], DataFrame], fields: Sequence[str] = FIELDS, row_group: int = ROW_GROUP):
        self.spark, self.path, self.rows, self.fields, self.row_group = spark, path.rstrip("/"), rows, set(fields), row_group

    @classmethod
    def build(cls, chunks: DataFrame, path: str, rows: Callable[[list[str] | None], DataFrame] | None = None, row_group: int = ROW_GROUP, fields: Sequence[str] = FIELDS) -> PostingIndex:
        """Index ``chunks``, row groups of ``row_group`` bytes."""
        made = cls(chunks.sparkSession, path, rows or (lambda ids: chunks if ids is None else chunks.where(F.col("document_id").isin(ids))), (), row_group)
        made._write(chunks, fields)
        return made

    def extend(self, fields: Sequence[str]) -> None:
        """Index the chunk rows by ``fields`` too; those that are there already stay as they are."""
        if new := [f for f in fields if f not in self.fields]:
            self._write(self.rows(None), new)

    def _write(self, chunks: DataFrame, fields: Sequence[str]) -> None:
        """A folder a field; its values are counted first, repeats in a chunk too, which says how many tasks it takes."""
        order = ["value", "document_id", "chunk_index"]
        there = [f for f in FIELDS if f in fields and f in chunks.columns]
        sizes = chunks.agg(*[F.sum(F.lit(1) if f in SCALARS else F.greatest(F.size(f), F.lit(0))).alias(f) for f in there]).first() if there else {}
        for name in there:
            dealt = postings(chunks, [name]).select(*order).repartitionByRange(1 + (sizes[name] or 0) // POSTINGS_A_TASK, *order).sortWithinPartitions(*order)
            dealt.write.mode("overwrite").option("parquet.block.size", self.row_group).parquet(f"{self.path}/field={name}")
        self.fields |= set(fields)

    def table(self) -> DataFrame:
        return self.spark.read.schema("value string, document_id string, chunk_index int, field string").parquet(self.path)

    def matching(self, filters: dict[str, Any] | None, k: int = ALL) -> DataFrame:
        """(document_id, chunk_index) of the first ``k`` chunks that pass the filter, as ``filters.predicate`` has it; without conditions, of all."""
        predicate(filters)  # refuses unknown fields
        if missing := sorted(set(filters or {"document_id": None}) - self.fields):
            raise ValueError(f"not indexed: {', '.join(missing)}")
        keys = ["document_id", "chunk_index"]
        if not filters:
            found = self.table().where(F.col("field") == "document_id").select(*keys)
        else:
            found = None
            for name, value in filters.items():
                wanted = value if isinstance(value, list) else [value]
                hit = F.col("value").isin([str(v) for v in wanted if v is not None]) if any(v is not None for v in wanted) else F.lit(False)
                rows = self.table().where(F.col("field") == name).where(hit).select(*keys)
                rows = rows.distinct() if len(wanted) > 1 else rows
                found = rows if found is None else found.join(rows, keys, "left_semi")
        return found if k == ALL else found.orderBy(*keys).limit(k)

    def fetch(self, keys: DataFrame, k: int = ALL) -> DataFrame:
        """The chunk rows of ``keys`` (``k`` bounds their number). Few of them are read by their documents' ids, many are joined."""
        on = ["document_id", "chunk_index"]
        if k > FETCHED_BY_ID:
            return self.rows(None).join(keys, on, "left_semi")
        found = [tuple(r) for r in (keys.limit(FETCHED_BY_ID + 1) if k == ALL else keys).collect()]  # at most ``k`` rows, or one more than are read by id
        if len(found) > FETCHED_BY_ID:
            return self.rows(None).join(keys, on, "left_semi")
        few = self.spark.createDataFrame(found, keys.schema)
        return self.rows(sorted({d for d, _ in found})).join(F.broadcast(few), on, "left_semi")
