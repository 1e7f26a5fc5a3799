"""Keyed state of the ingestion stream: the last arrival of each document, and attempts with a dead-letter term.

Both are ``transformWithState`` operators, so the state is partitioned by key, kept by the
checkpoint, and the same when a batch is repeated. A key's rows of one batch come in slices; no
more than the newest row of a key is held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DAY_MS = 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "id string, status string, attempts int, error string, payload string"


def use_state(spark: SparkSession) -> None:
    """State of these operators lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Refused(Exception):
    """Raised by work that no further attempt can help: the document is dead at once."""


class _Newest(StatefulProcessor):
    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r[self.order])
        last = self.last.get()
        if last is None or newest[self.order] > last[0]:
            self.last.update((newest[self.order],))
            yield newest

    def close(self) -> None:
        pass


def last_arrivals(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``stream`` that are newer than every row of their key before them, one a key and batch.

    ``order`` numbers the arrivals (a long). A late batch of older arrivals gives nothing, whatever stream it comes
    from; a number that was seen already gives nothing; rows without key or number are left out.
    """
    use_state(stream.sparkSession)
    known = stream.where(stream[key].isNotNull() & stream[order].isNotNull())
    return known.groupBy(key).transformWithState(statefulProcessor=_Newest(order), outputStructType=known.schema, outputMode="Append", timeMode="None")


class _Attempts(StatefulProcessor):
    def __init__(self, make: Callable[[], Callable[[dict[str, Any]], Any]], tries: int, wait_ms: int, term_ms: int):
        self.make, self.tries, self.wait_ms, self.term_ms = make, tries, wait_ms, term_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.work = handle, self.make()
        self.open = handle.getValueState("open", "attempts int, error string, row string, due long", self.term_ms)

    def _attempt(self, key: str, row: str, before: int, now: int) -> Iterator[pd.DataFrame]:
        """One attempt at ``row`` after ``before`` failures of it."""
        try:
            payload = json.dumps(self.work(json.loads(row)))
        except Exception as failure:  # whatever the work raises is a failed attempt
            error, n = f"{type(failure).__name__}: {failure}", before + 1
            if n < self.tries and not isinstance(failure, Refused):
                due = now + self.wait_ms * 2 ** (n - 1)
                self.open.update((n, error, row, due))
                self.handle.registerTimer(due)
                return
            self.open.update((n, error, None, 0))
            yield self._outcome(key, "dead", n, error, row)
            return
        if self.open.exists():
            self.open.clear()
        yield self._outcome(key, "done", before + 1, None, payload)

    @staticmethod
    def _outcome(key: str, status: str, attempts: int, error: str | None, payload: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [key], "status": [status], "attempts": pd.array([attempts], dtype="int32"), "error": pd.array([error], dtype="object"), "payload": [payload]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            top = part.loc[[part["arrival"].idxmax()]]
            newest = top if newest is None or top["arrival"].iloc[0] >= newest["arrival"].iloc[0] else newest
        yield from self._attempt(key[0], newest["row"].iloc[0], 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        # A newer arrival has a timer of its own, or none if it succeeded: older timers do nothing.
        if held and held[2] is not None and held[3] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._attempt(key[0], held[2], held[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def with_attempts(stream: DataFrame, make: Callable[[], Callable[[dict[str, Any]], Any]], tries: int = 5, wait_ms: int = 360_000, term_ms: int = 14 * DAY_MS) -> DataFrame:
    """Outcomes of work on each document of ``stream`` (id string, arrival long, row string): done with its result, or dead after ``tries`` failures.

    ``make`` gives a task its work, a function of the row's JSON value; what it returns comes back as JSON in
    ``payload``, a dead document's payload is its row. Work may raise ``Refused`` where trying again is no use. A failure is tried again after ``wait_ms``, then twice as long each
    time; the attempts and the last error are kept for ``term_ms``, as is the mark of a dead
    document. A new arrival of a document begins anew, and a success clears what is kept. Of several
    arrivals in a batch the last one counts; rows without an id are left out.
    """
    use_state(stream.sparkSession)
    known = stream.where("id is not null and row is not null").selectExpr("cast(id as string) as id", "coalesce(cast(arrival as long), 0) as arrival", "row")
    return known.groupBy("id").transformWithStateInPandas(statefulProcessor=_Attempts(make, tries, wait_ms, term_ms), outputStructType=StructType.fromDDL(OUTCOME), outputMode="Append", timeMode="ProcessingTime")


def write_outcomes(outcomes: DataFrame, path: str, checkpoint: str, done: Callable[[DataFrame, int], None], **trigger):
    """Start a stream of outcomes: finished documents to ``done``, dead ones to ``path``, a folder of each batch, written anew when it is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}-outcomes/batch={batch_id}")
        rows = batch.sparkSession.read.schema(OUTCOME).parquet(f"{path}-outcomes/batch={batch_id}")
        dead = rows.where("status = 'dead'")
        if not dead.isEmpty():
            dead.drop("status").write.mode("overwrite").parquet(held)
        done(rows.where("status = 'done'"), batch_id)

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
