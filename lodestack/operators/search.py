"""Retrieval over a chunks DataFrame: nearest vectors, metadata, reassembly, related documents, entities."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RESULT
from .filters import predicate
from .postings import ALL, PostingIndex

DEFAULT_K = 10


def effective_k(k: int | None, default: int = DEFAULT_K) -> int:
    """None and 0 mean the default; ALL means no limit; other negative numbers are refused."""
    if k is not None and k < 0 and k != ALL:
        raise ValueError(f"k must not be negative: {k}")
    return k or default


def cosine(rows: Column, asked: Sequence[float]) -> Column:
    """Cosine of a vector column and a constant in double precision; null where a length is zero or a vector is null. The constant's length is taken once."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    constant = F.array(*[F.lit(float(x)) for x in asked])
    return dot(rows, constant) / F.nullif(F.sqrt(dot(rows, rows)) * F.lit(sum(float(x) * float(x) for x in asked) ** 0.5), F.lit(0.0))


def finite(vector: Column) -> Column:
    """True for vectors all of whose components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _limited(df: DataFrame, k: int) -> DataFrame:
    return df if k == ALL else df.limit(k)


def results(chunks: DataFrame, score: Column) -> DataFrame:
    """Result columns with defaults; a null score is 0."""
    empty = F.array()
    have = dict(chunks.dtypes)
    out = []
    for name in RESULT:
        if name == "score":
            out.append(F.coalesce(score, F.lit(0.0)).alias("score"))
        elif name not in have:
            continue
        elif name in ("text", "title", "url", "summary"):
            out.append(F.coalesce(name, F.lit("")).alias(name))
        elif name in ("entities", "topics", "relationships"):
            out.append(F.coalesce(F.col(name), empty.cast(have[name])).alias(name))
        else:
            out.append(F.col(name))
    return chunks.select(*out)


def knn(chunks: DataFrame, vector: Sequence[float], k: int | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
    """The ``k`` chunks of largest cosine among those that pass the filter; ties by chunk_id."""
    where = predicate(filters)
    rows = chunks if where is None else chunks.where(where)
    rows = rows.where((F.size("vector") == len(vector)) & finite(F.col("vector"))).withColumn("_score", cosine(F.col("vector"), vector))
    ranked = results(rows, F.col("_score")).orderBy(F.desc("score"), "chunk_id")
    return _limited(ranked, effective_k(k))


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, query_block: int = 4_096, chunk_block: int = 16_384) -> DataFrame:
    """(query_id, rank, chunk_id, score) for each row of ``queries`` (query_id, query_vector), among chunks of the same vector length.

    Vectors that hold a null or a number that is not finite take no part, on either side.

    Blocks of queries meet blocks of chunks by a shuffle; the scores of two blocks
    are one matrix product, and only the best ``k`` of each leave the task.
    """
    import numpy as np
    import pyarrow as pa

    kinds = dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    asks, blocks = max(1, -(-queries.count() // query_block)), max(1, -(-chunks.count() // chunk_block))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.size("query_vector").alias("dims"), part("query_id", asks).alias("ask"), every(blocks).alias("block"), "query_id", F.col("query_vector").alias("vector")).where("dims > 0").where(finite(F.col("vector")))
    held = chunks.select(F.size("vector").alias("dims"), every(asks).alias("ask"), part("chunk_id", blocks).alias("block"), "chunk_id", "vector").where("dims > 0").where(finite(F.col("vector")))

    def unit(table: pa.Table) -> np.ndarray:
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(one: pa.Table, two: pa.Table) -> pa.Table:
        rows, found, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if one.num_rows and two.num_rows:
            wanted, base, cut = unit(one), unit(two), max(0, two.num_rows - k)
            for start in range(0, len(wanted), 256):
                score = wanted[start : start + 256] @ base.T
                row, at = np.nonzero(score >= np.partition(score, cut, axis=1)[:, cut, None])
                rows.append(row + start)
                found.append(at)
                scores.append(score[row, at])
        row, at = np.concatenate(rows), np.concatenate(found)
        return pa.table({"query_id": one.column("query_id").take(pa.array(row)), "chunk_id": two.column("chunk_id").take(pa.array(at)), "score": np.concatenate(scores)})

    keys = ["dims", "ask", "block"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _passing(chunks: DataFrame, filters: dict[str, Any] | None, index: PostingIndex | None = None) -> DataFrame:
    """All chunks that pass the filter, in no order.

    Conditions on fields that the index does not hold are tested on the chunks that the others find; if it holds none of them, all chunks are.
    """
    known = {f: v for f, v in (filters or {}).items() if index and f in index.fields}
    if index and known:
        chunks = index.fetch(index.matching(known))
    rest = predicate({f: v for f, v in (filters or {}).items() if f not in known})
    return chunks if rest is None else chunks.where(rest)


def first_matching(chunks: DataFrame, filters: dict[str, Any] | None, n: int, index: PostingIndex | None = None) -> DataFrame:
    """The first ``n`` chunks that pass the filter, in order of document and chunk; by an index that holds its fields without a scan of the chunks."""
    if index and set(filters or {"document_id": None}) <= index.fields:
        return index.fetch(index.matching(filters, n), n).orderBy("document_id", "chunk_index")
    return _limited(_passing(chunks, filters, index).orderBy("document_id", "chunk_index"), n)


def search_by_metadata(chunks: DataFrame, filters: dict[str, Any] | None, k: int | None = None, index: PostingIndex | None = None) -> DataFrame:
    """Chunks that pass the filter, in order of document and chunk, unscored."""
    return results(first_matching(chunks, filters, effective_k(k), index), F.lit(0.0))


def get_by_document(chunks: DataFrame, document_id: str, cap: int = 1_000) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index").limit(cap)


def reassemble(chunks: DataFrame) -> DataFrame:
    """One row per document: head fields, texts joined by line breaks, number of chunks."""
    have = set(chunks.columns)
    head = [F.min_by(c, "chunk_index").alias(c) for c in ("title", "url", "source_type", "kind", "repo", "summary") if c in have]
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("document_id").agg(*head, F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("chunk_count"))


def find_related(chunks: DataFrame, entity: str, relationship_types: list[str] | None = None, k: int | None = None, same_edge: bool = False, index: PostingIndex | None = None) -> DataFrame:
    """Documents with an edge to the entity, then documents that mention it; ``via`` says which.

    Each lookup takes ``k`` chunks before documents are merged. Targets and types
    match independently, unless ``same_edge`` asks for one edge to match both (then the index finds the targets only,
    and their chunks are tested).
    """
    n = effective_k(k)
    payload = [c for c in ("title", "url", "source_type", "kind", "repo", "summary", "relationships") if c in chunks.columns]
    edge = {"relationship_targets": entity} | ({"relationship_types": list(relationship_types)} if relationship_types else {})
    if same_edge and relationship_types:
        one = F.exists("relationships", lambda r: (r["target"] == entity) & r["type"].isin(relationship_types))
        edges = _limited(_passing(chunks, {"relationship_targets": entity}, index).where(one).orderBy("document_id", "chunk_index"), n)
    else:
        edges = first_matching(chunks, edge, n, index)
    turns = ((edges, "relationship", 0), (first_matching(chunks, {"entity_names": entity}, n, index), "entity", 1))
    each = [rows.select("document_id", F.struct(F.lit(turn), "chunk_index").alias("_at"), F.lit(via).alias("_via"), *payload) for rows, via, turn in turns]
    merged = each[0].unionByName(each[1]).groupBy("document_id").agg(F.min("_at").alias("_at"), *[F.min_by(c, "_at").alias(c) for c in payload], F.array_sort(F.collect_set("_via")).alias("via"))
    return merged.orderBy("_at.col1", "document_id").drop("_at")


def list_entities(chunks: DataFrame, document_id: str | None = None, entity_type: str | None = None, k: int | None = None, index: PostingIndex | None = None) -> DataFrame:
    """Distinct (type, name) of the first ``k`` chunks in scope, in order of first sight."""
    filters = {f: v for f, v in (("document_id", document_id), ("entity_types", entity_type)) if v}
    n = effective_k(k)
    rows = _passing(chunks, filters, index) if n == ALL else first_matching(chunks, filters, n, index)  # all of them need no order
    each = rows.select(F.struct("document_id", "chunk_index").alias("_at"), F.posexplode("entities").alias("_pos", "_e"))
    each = each if not entity_type else each.where(F.col("_e.type") == entity_type)
    seen = each.groupBy("_e.type", "_e.name").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    return seen.orderBy("_first").select("type", "name")
