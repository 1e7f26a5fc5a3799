"""The lake: chunk rows in a Parquet table partitioned by bucket of the document, replaced document by document.

A write puts the touched buckets, whole, into a folder of its own and then
overwrites them in the table (dynamic partition overwrite). The folder is moved to
``<path>-ready`` when it is complete and deleted when the table has it, so a writer that was
stopped in between is finished by the next one: a bucket is never lost, and repeating is harmless. A bucket
without rows keeps one row without ids, which readers leave out. One writer at a time; a
reader may see some of a write's buckets before the others. The number of buckets is chosen when the lake
is made: some 20000 rows of 1024 numbers a bucket are 80 MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..functions.models import Embedder, HashingEmbedder
from ..operators import search
from ..operators.graphs import GraphIndex
from ..operators.ingest import chunk_documents, embed_chunks, latest
from ..operators.postings import PostingIndex
from ..schema import CHUNK, CHUNK_TYPES
from .hooks import Interceptors, QueryContext, configured


class ContextLake:
    """A chunk store under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        own = settings().store
        self.spark, self.path, self._made_with = spark, (path or own.path).rstrip("/"), buckets or own.buckets

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self) -> bool:
        path, fs = self._files()
        return fs.exists(path(f"{self.path}/_buckets"))

    def ensure_index(self) -> None:
        """Create the lake if it is not there; again is harmless. A write that was stopped half-way is finished."""
        if not self._exists():
            path, fs = self._files()
            out = fs.create(path(f"{self.path}/_buckets"), True)
            out.write(bytearray(json.dumps({"buckets": self._made_with}).encode()))
            out.close()
        self._finish()

    @cached_property
    def buckets(self) -> int:
        """The number of buckets the lake was made with."""
        if not self._exists():
            self.ensure_index()
        path, fs = self._files()
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path(f"{self.path}/_buckets")), "UTF-8")
        return json.loads(lines)["buckets"]

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        """All chunk rows, or those of some buckets."""
        path, fs = self._files()
        if not fs.exists(path(self.path)) or not any(x.getPath().getName().startswith("bucket=") for x in fs.listStatus(path(self.path))):
            return self.spark.createDataFrame([], CHUNK)
        rows = self.spark.read.schema(f"{CHUNK}, bucket int").parquet(self.path)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.where("chunk_id is not null").drop("bucket")

    def chunks_of(self, ids: list[str] | None) -> DataFrame:
        """The chunk rows of some documents, from their buckets only; None: all rows."""
        if ids is None:
            return self.chunks()
        asked = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
        return self.chunks(self._touched(asked)).where(F.col("document_id").isin(ids))

    def build_postings(self) -> PostingIndex:
        """Index the fields of all rows; searches use the index until the next write, then scan until it is built again."""
        return self._built("postings", lambda at: PostingIndex.build(self.chunks(), at, self.chunks_of))

    def build_graph(self) -> GraphIndex:
        """Index the vectors of all rows for ``query``, until the next write."""
        return self._built("graph", lambda at: GraphIndex.build(self.chunks(), at))

    def postings(self) -> PostingIndex | None:
        """The index of fields, if it was built after the last write."""
        return PostingIndex(self.spark, f"{self.path}-postings/rows", self.chunks_of) if self._current("postings") else None

    def graph(self) -> GraphIndex | None:
        """The index of vectors, if it was built after the last write."""
        return GraphIndex(self.spark, f"{self.path}-graph/rows") if self._current("graph") else None

    def _built(self, name: str, build: Callable[[str], Any]) -> Any:
        path, fs = self._files()
        fs.delete(path(f"{self.path}-{name}/current"), False)
        made = build(f"{self.path}-{name}/rows")
        fs.create(path(f"{self.path}-{name}/current"), True).close()
        return made

    def _current(self, name: str) -> bool:
        path, fs = self._files()
        return fs.exists(path(f"{self.path}-{name}/current"))

    def _outdate(self) -> None:
        path, fs = self._files()
        for name in ("postings", "graph"):
            fs.delete(path(f"{self.path}-{name}/current"), False)

    def _bucket(self, document: Column) -> Column:
        return F.pmod(F.xxhash64(document), F.lit(self.buckets)).cast("int")

    def _bucket_of(self, document_id: str) -> int:
        return self.spark.range(1).select(self._bucket(F.lit(document_id)).alias("b")).first()["b"]

    def _overwrite(self, rows: DataFrame, touched: list[int]) -> None:
        """The touched buckets hold ``rows`` from now on."""
        path, fs = self._files()
        self._outdate()
        name = uuid.uuid4().hex
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(t).alias(n) for n, t in CHUNK_TYPES.items()], "bucket")
        whole = rows.withColumn("bucket", self._bucket(F.col("document_id"))).select(marks.columns).unionByName(marks)
        whole.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}-staged/{name}")
        fs.mkdirs(path(f"{self.path}-ready"))
        if not fs.rename(path(f"{self.path}-staged/{name}"), path(f"{self.path}-ready/{name}")):
            raise RuntimeError(f"cannot move {name} to {self.path}-ready")
        self._finish()

    def _finish(self) -> None:
        """Bring the buckets that are ready into the table; their files hold one bucket each and need no shuffle."""
        path, fs = self._files()
        at = path(f"{self.path}-ready")
        for name in sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []:
            rows = self.spark.read.schema(f"{CHUNK}, bucket int").parquet(f"{self.path}-ready/{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            fs.delete(path(f"{self.path}-ready/{name}"), True)

    @contextmanager
    def written(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` as a table written once and read from there, so that models run once; it goes at the end."""
        path, fs = self._files()
        at = f"{self.path}-staged/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        try:
            yield self.spark.read.schema(rows.schema).parquet(at)
        finally:
            fs.delete(path(at), True)

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r["b"] for r in ids.select(self._bucket(F.col("document_id")).alias("b")).distinct().collect()]  # at most the number of buckets

    def upsert(self, rows: DataFrame) -> int:
        """Insert or overwrite by chunk_id, the last of several rows of one; no rows do nothing. Rows without ids are refused."""
        self._finish()
        with self.written(latest(rows, "chunk_id")) as rows:
            bad = rows.where("chunk_id is null or document_id is null").count()
            if bad:
                raise RuntimeError(f"{bad} chunk rows without an id")
            touched = self._touched(rows)
            if not touched:
                return 0
            self._overwrite(self.chunks(touched).join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows), touched)
            return rows.count()

    def delete_by_document(self, document_id: str) -> None:
        self._finish()
        bucket = self._bucket_of(document_id)
        self._overwrite(self.chunks([bucket]).where(F.col("document_id") != document_id), [bucket])

    def replace_documents(self, rows: DataFrame, emptied: DataFrame | None = None) -> None:
        """All chunks of the documents in ``rows`` (and of the ids in ``emptied``) give way to ``rows``."""
        self._finish()
        ids = rows.select("document_id")
        ids = (ids if emptied is None else ids.unionByName(emptied.select("document_id"))).distinct()
        touched = self._touched(ids)
        if touched:
            self._overwrite(self.chunks(touched).join(ids, "document_id", "left_anti").unionByName(rows), touched)

    def query(self, vector: list[float], k: int | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
        """The ``k`` nearest chunks that pass the filter: by the graphs, if they are current and hold vectors of this length, else exactly."""
        index = self.graph()
        if index and index.about["dims"] == len(vector):
            return index.search(vector, k, filters)
        return search.knn(self.chunks(), vector, k, filters)

    def search_by_metadata(self, filters: dict[str, Any] | None, k: int | None = None) -> DataFrame:
        return search.search_by_metadata(self.chunks(), filters, k, self.postings())

    def get_by_document(self, document_id: str, cap: int = 1_000) -> DataFrame:
        return search.get_by_document(self.chunks([self._bucket_of(document_id)]), document_id, cap)


class IngestionPlan:
    """Documents through hooks, chunking and embedding into the lake.

    Of several rows of one document the last one counts. A document without
    chunks leaves the lake as it is, unless ``purge_empty``. A document with a
    chunk that the embedder refuses ``tries`` times keeps its former chunks and
    goes to ``failed`` (by default a folder beside the lake), the others of its
    batch are ingested. What is not given comes from the settings.
    """

    def __init__(self, lake: ContextLake, hooks: Interceptors | None = None, embedder: Callable[[], Embedder] | None = None, size: int | None = None, overlap: int | None = None, purge_empty: bool | None = None, failed: str | None = None, tries: int | None = None):
        own, dimensions = settings().ingestion, settings().embedding.dimensions
        self.lake, self.hooks, self.embedder = lake, configured() if hooks is None else hooks, embedder or (lambda: HashingEmbedder(dimensions))
        self.size, self.overlap = own.chunk_size if size is None else size, own.chunk_overlap if overlap is None else overlap
        self.purge_empty = own.purge_empty if purge_empty is None else purge_empty
        self.failed, self.tries = failed or f"{lake.path}-failed", tries or own.tries

    def process(self, docs: DataFrame, batch: str | None = None) -> None:
        """Ingest ``docs``. ``batch`` names them: what is refused goes to a folder of that name, overwritten when the batch is repeated."""
        self.lake.ensure_index()
        with self.lake.written(self.hooks.before_ingest(latest(docs, "id"))) as docs:
            with self.lake.written(embed_chunks(chunk_documents(docs, self.size, self.overlap), self.embedder, self.tries)) as rows:
                refused = rows.where("vector is null").select(F.col("document_id").alias("id")).distinct()
                if not refused.isEmpty():
                    docs.join(refused, "id", "left_semi").write.mode("overwrite").parquet(f"{self.failed}/batch={batch or uuid.uuid4().hex}")
                    docs, rows = docs.join(refused, "id", "left_anti"), rows.join(refused.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
                self.lake.replace_documents(rows, docs.select(F.col("id").alias("document_id")) if self.purge_empty else None)
                self.hooks.after_ingest(docs)


class ContextTools:
    """The five retrieval calls; results are plain dictionaries. They bring ``k`` rows to the driver; ``k=ALL`` brings every row found."""

    def __init__(self, lake: ContextLake, embedder: Embedder, hooks: Interceptors | None = None, sources: list[dict] | None = None, default_k: int | None = None):
        self.lake, self.embedder, self.hooks = lake, embedder, configured() if hooks is None else hooks
        self.sources = [{"id": f"github:{r}", "type": "github"} for r in settings().connector.repos] if sources is None else sources
        self.default_k = default_k or settings().server.default_k

    def search_context(self, query: str, k: int | None = None, filters: dict | None = None, principal: str | None = None) -> list[dict]:
        ctx = QueryContext(query, search.effective_k(k, self.default_k), filters or {}, principal)
        self.hooks.require(principal, "search", "*")
        ctx = self.hooks.before_query(ctx)
        found = self.lake.query(self.embedder.embed_query(ctx.query), ctx.k, ctx.filters or None)
        return [r.asDict(True) for r in self.hooks.after_query(found, ctx).collect()]

    def get_document(self, document_id: str, principal: str | None = None) -> dict:
        self.hooks.require(principal, "read", document_id)
        row = search.reassemble(self.lake.get_by_document(document_id, settings().server.document_chunks)).first()
        return {"found": True} | row.asDict(True) if row else {"document_id": document_id, "found": False}

    def list_sources(self, principal: str | None = None) -> list[dict]:
        self.hooks.require(principal, "list_sources", "*")
        return [dict(s) for s in self.sources]

    def find_related(self, entity: str, relationship_types: list[str] | None = None, k: int | None = None, principal: str | None = None) -> dict:
        self.hooks.require(principal, "find_related", entity)
        rows = [r.asDict(True) for r in search.find_related(self.lake.chunks(), entity, relationship_types, search.effective_k(k, self.default_k), index=self.lake.postings()).collect()]
        return {"entity": entity, "related": rows, "count": len(rows)}

    def list_entities(self, document_id: str | None = None, entity_type: str | None = None, k: int | None = None, principal: str | None = None) -> dict:
        self.hooks.require(principal, "list_entities", document_id or "*")
        rows = [r.asDict() for r in search.list_entities(self.lake.chunks(), document_id, entity_type, search.effective_k(k, self.default_k), self.lake.postings()).collect()]
        return {"scope": document_id or "*", "entities": rows, "count": len(rows)}
