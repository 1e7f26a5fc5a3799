"""From documents to chunk rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import flatten
from ..functions.models import Embedder, HashingEmbedder, embed
from ..functions.text import chunks, with_title
from ..schema import CHUNK_TYPES, chunk_id

CHUNK_COLUMNS = list(CHUNK_TYPES)


def latest(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``, by default in the order of the rows; rows without a key all stay.

    Rows are reduced before they are shuffled, so a key of any number of rows is no large group.
    """
    marked = rows.withColumn("_order", F.monotonically_increasing_id() if order is None else order)
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "_order").alias("_row")
    return marked.withColumn("_alone", alone).groupBy(key, "_alone").agg(last).select("_row.*")


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunk rows without vectors; document and metadata fields ride along."""
    none = F.array().cast("array<string>")
    cut = docs.withColumn("_chunks", chunks(with_title(F.col("title"), F.col("body")), size, overlap))
    rows = cut.select("*", F.posexplode("_chunks").alias("chunk_index", "text"))
    s = F.col("semantic")
    entities, relationships = (F.coalesce(s[n], F.array().cast(docs.select(f"semantic.{n}").dtypes[0][1])) for n in ("entities", "relationships"))
    rows = rows.withColumns({"entities": entities, "relationships": relationships, "topics": F.coalesce(s["topics"], none), "summary": F.coalesce(s["summary"], F.lit("")), "labels": F.coalesce("labels", none)})
    rows = rows.withColumns(flatten(F.col("entities"), F.col("relationships")) | {"document_id": F.col("id"), "chunk_id": chunk_id(F.col("id"), F.col("chunk_index"))})
    names = [c for c in CHUNK_COLUMNS if c != "vector"]
    return rows.select(*names)


def embed_chunks(rows: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, tries: int | None = None) -> DataFrame:
    """Add the vector of each chunk's text; with ``tries``, null where the embedder fails so many times."""
    return rows.withColumn("vector", embed(F.col("text"), make, tries=tries)).select(*CHUNK_COLUMNS)
