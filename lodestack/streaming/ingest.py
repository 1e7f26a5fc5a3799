"""Incremental ingestion: micro-batches into the lake, and high-water marks of scheduled runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..config import settings
from ..functions.models import Embedder
from ..functions.text import chunk_text
from ..operators.ingest import chunk_documents
from ..plans.lake import IngestionPlan
from ..schema import CHUNK_TYPES, SEMANTIC
from ..sources import connectors
from ..sources.pages import normalize, set_aside, usable
from .state import DAY_MS, Refused, with_attempts, write_outcomes


def read_watermark(spark: SparkSession, path: str) -> datetime | None:
    """When the last run began; None, so a full scan, where it cannot be read."""
    try:
        value = json.loads(spark.read.text(path, wholetext=True).first()["value"])["since"]
        return datetime.fromisoformat(value)
    except Exception:  # any failure means a full scan, which is always right
        return None


def write_watermark(spark: SparkSession, path: str, since: datetime) -> None:
    """Record when a run began."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps({"since": since.isoformat()}).encode()))
    out.close()


def stream_pages(spark: SparkSession, path: str, repos: list[str] | None = None, page_size: int | None = None, pages_a_task: int = 20) -> DataFrame:
    """Raw items of landed pages as a stream with a cursor for each job; it sees the pages that ``pages.catalogue`` has noted.

    A stream that starts again goes on behind the last item that its checkpoint holds.
    """
    return connectors.follow(spark, "github", _options(path, repos, page_size) | {"pages_a_task": pages_a_task})


def _options(path: str, repos: list[str] | None, page_size: int | None) -> dict[str, object]:
    own = settings().connector
    return {"path": path, "repos": ",".join(own.repos if repos is None else repos), "page_size": page_size or own.page_size}


def _ingest(raw: DataFrame, plan: IngestionPlan, dead_letters: str | None, batch: str) -> None:
    """Documents of ``raw`` into the lake; what cannot be one to ``dead_letters``, a folder of each batch, written anew when the batch is repeated.

    Items are judged once, while they are written.
    """
    with plan.lake.written(raw.withColumn("_usable", usable(F.col("kind"), F.col("item")))) as rows:
        good, bad = rows.where("_usable").drop("_usable"), rows.where("not _usable").drop("_usable")
        if not bad.isEmpty():
            bad.write.mode("overwrite").json(f"{dead_letters or f'{plan.lake.path}-dead-letters'}/batch={batch}")
        plan.process(normalize(good).withColumn("semantic", F.lit(None).cast(SEMANTIC)), batch)


def run_once(spark: SparkSession, path: str, mark: str, plan: IngestionPlan, repos: list[str] | None = None, page_size: int | None = None, dead_letters: str | None = None) -> datetime:
    """A scheduled run: the last run's beginning, pages of the configured repositories, what is newer into the lake, then this run's beginning.

    The mark is written last, so a run that fails is repeated in full, as the same batch. Pages that the
    catalogue knows to be older than the mark are not opened. What cannot be a document goes to the
    dead letters, as in ``ingest_stream``.
    """
    began, since = datetime.now(UTC), read_watermark(spark, mark)
    raw = connectors.read(spark, "github", _options(path, repos, page_size), since)
    _ingest(raw, plan, dead_letters, f"run-{since.strftime('%Y%m%dT%H%M%S%f') if since else 'first'}")
    write_watermark(spark, mark, began)
    return began


def ingest_stream(raw: DataFrame, plan: IngestionPlan, checkpoint: str, dead_letters: str | None = None, **trigger):
    """Write a stream of raw items into the lake; start it with ``availableNow=True`` or ``processingTime="15 minutes"``.

    A batch that is repeated replaces the same documents, so delivery at least
    once is enough. In one batch the last arrival of a document wins. Items that
    are not JSON objects, or have no number, go to ``dead_letters``, by default a folder beside the lake.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _ingest(batch, plan, dead_letters, str(batch_id))

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _embedding(make: Callable[[], Embedder], size: int, overlap: int) -> Callable[[], Callable[[dict], Any]]:
    """The work of one document: its chunks' vectors."""

    def begin() -> Callable[[dict], Any]:
        model = make()

        def work(row: dict) -> Any:
            if "item" in row:
                raise Refused("not a document")
            texts = chunk_text(f"{row['title']}\n\n{row['body']}" if row["title"] else row["body"], size, overlap)
            return {"row": row, "vectors": [[float(x) for x in v] for v in (model.embed_documents(texts) if texts else [])]}

        return work

    return begin


def ingest_with_attempts(raw: DataFrame, plan: IngestionPlan, checkpoint: str, dead_letters: str | None = None, tries: int | None = None, wait_ms: int = 360_000, term_ms: int = 14 * DAY_MS, **trigger):
    """Like ``ingest_stream``, with the embedder's failures kept as state: a document that is refused is tried again later, in other
    batches, and holds up nobody; after ``tries`` failures it is one dead letter, and what was there of it stays in the lake.

    ``dead_letters`` (by default a folder beside the lake) also gets the items that are no documents, at once. The settings of ``plan`` hold, but
    for its own tries.
    """
    good, bad = set_aside(raw)
    docs = plan.hooks.before_ingest(normalize(good).withColumn("semantic", F.lit(None).cast(SEMANTIC)))
    schema = docs.schema
    arrival = F.unix_micros(F.current_timestamp()).alias("arrival")
    rows = docs.select("id", arrival, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    others = bad.select(F.concat(F.lit("item:"), F.sha2(F.coalesce("item", F.lit("")), 256)).alias("id"), arrival, F.to_json(F.struct("item"), {"ignoreNullFields": "false"}).alias("row"))
    outcomes = with_attempts(rows.unionByName(others), _embedding(plan.embedder, plan.size, plan.overlap), plan.tries if tries is None else tries, wait_ms, term_ms)

    def done(batch: DataFrame, batch_id: int) -> None:
        kind = StructType([StructField("row", schema), StructField("vectors", ArrayType(ArrayType(FloatType())))])
        plan.lake.ensure_index()
        with plan.lake.written(batch.select(F.from_json("payload", kind).alias("p")).select("p.row.*", "p.vectors")) as held:
            finished = held.drop("vectors")
            vectors = held.select(F.col("id").alias("document_id"), "vectors")
            cut = chunk_documents(finished, plan.size, plan.overlap).join(vectors, "document_id").withColumn("vector", F.element_at("vectors", F.col("chunk_index") + 1))
            plan.lake.replace_documents(cut.select(*CHUNK_TYPES), finished.select(F.col("id").alias("document_id")) if plan.purge_empty else None)
            plan.hooks.after_ingest(finished)

    return write_outcomes(outcomes, dead_letters or f"{plan.lake.path}-dead-letters", checkpoint, done, **trigger)
