"""Arrivals across batches, and attempts with a term."""

import glob
import json
import tempfile
import time

import pytest

from lodestack.functions import models
from lodestack.plans.hooks import Interceptors
from lodestack.plans.lake import ContextLake, IngestionPlan
from lodestack.streaming import ingest, state


def land(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


ARRIVALS = "doc string, at long, text string"


def test_two_streams_end_with_the_last_arrival(spark):
    one, two, checkpoint, out = (tempfile.mkdtemp() for _ in range(4))
    land(spark, one, "a", [("x", 5, "five"), ("y", 1, "one"), ("x", 4, "four"), (None, 9, "none"), ("z", None, "none")], ARRIVALS)
    land(spark, two, "a", [("x", 3, "three"), ("y", 2, "two")], ARRIVALS)
    kept = {}

    def write(batch, batch_id):
        for r in batch.collect():
            kept.setdefault(r["doc"], []).append((r["at"], r["text"]))

    def run():
        streams = [spark.readStream.schema(ARRIVALS).parquet(f"{f}/*") for f in (one, two)]
        newer = state.last_arrivals(streams[0].unionByName(streams[1]), "doc", "at")
        newer.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    assert kept == {"x": [(5, "five")], "y": [(2, "two")]}
    land(spark, two, "b", [("x", 4, "late"), ("x", 2, "later"), ("y", 2, "again"), ("w", 1, "new")], ARRIVALS)
    run()  # a restart: the state comes from the checkpoint
    assert kept == {"x": [(5, "five")], "y": [(2, "two")], "w": [(1, "new")]}
    land(spark, one, "c", [("y", 7, "seven"), ("x", 1, "old")], ARRIVALS)
    run()
    assert kept["y"][-1] == (7, "seven") and kept["x"] == [(5, "five")]
    assert out


DOCS = "id string, arrival long, row string"


def flaky(log, broken):
    """Work that fails for the documents named in the file ``broken``, and notes each attempt."""

    def make():
        def work(row):
            with open(log, "a") as file:
                file.write(row["id"] + "\n")
            with open(broken) as file:
                if row["id"] in file.read().split():
                    raise RuntimeError(f"refused {row['text']}")
            return {"length": len(row["text"])}

        return work

    return make


@pytest.fixture()
def retried(spark):
    folder, base = tempfile.mkdtemp(), tempfile.mkdtemp()
    log, broken, finished = f"{base}/log", f"{base}/broken", []
    for name in (log, broken):
        open(name, "w").close()
    stream = spark.readStream.schema(DOCS).parquet(f"{folder}/*")
    outcomes = state.with_attempts(stream, flaky(log, broken), tries=5, wait_ms=50)
    running = state.write_outcomes(outcomes, f"{base}/dead", f"{base}/checkpoint", lambda rows, i: finished.extend((r["id"], r["payload"]) for r in rows.collect()), processingTime="0 seconds")
    yield folder, base, finished, lambda: open(log).read().split()
    running.stop()


def until(condition, seconds=90):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.5)
    assert condition()


def test_the_fifth_failure_is_one_dead_letter(spark, retried):
    folder, base, finished, attempts = retried
    with open(f"{base}/broken", "w") as file:
        file.write("bad slow")
    row = lambda i, text: (i, 1, f'{{"id": "{i}", "text": "{text}"}}')
    land(spark, folder, "a", [row("good", "abc"), row("bad", "x"), row("slow", "yy"), (None, 1, "{}")], DOCS)
    until(lambda: attempts().count("slow") >= 2)
    with open(f"{base}/broken", "w") as file:
        file.write("bad")
    until(lambda: glob.glob(f"{base}/dead/batch=*/_SUCCESS") and len(finished) == 2)
    dead = lambda: [tuple(r) for r in spark.read.parquet(f"{base}/dead").drop("batch").collect()]
    assert sorted(finished) == [("good", '{"length": 3}'), ("slow", '{"length": 2}')]
    assert dead() == [("bad", 5, "RuntimeError: refused x", '{"id": "bad", "text": "x"}')]
    assert attempts().count("bad") == 5 and attempts().count("good") == 1
    # A dead document stays dead without an arrival; a new one begins anew, and success clears the state.
    time.sleep(2)
    assert attempts().count("bad") == 5
    open(f"{base}/broken", "w").close()
    land(spark, folder, "b", [row("bad", "mended")], DOCS)
    until(lambda: len(finished) == 3)
    assert finished[-1] == ("bad", '{"length": 6}') and len(dead()) == 1


def test_a_repeated_batch_adds_no_dead_letter(spark):
    base = tempfile.mkdtemp()
    rows = spark.createDataFrame([("a", "dead", 5, "e", "{}"), ("b", "done", 1, None, "1")], state.OUTCOME)
    got = []

    class Once:
        """A stream of one batch that is delivered twice."""

        def __getattr__(self, name):
            return self

        def __call__(self, *args, **kwargs):
            return self

        def foreachBatch(self, write):
            for _ in range(2):
                write(rows, 7)
            return self

    state.write_outcomes(Once(), f"{base}/dead", f"{base}/c", lambda r, i: got.append(r.count()))
    assert spark.read.parquet(f"{base}/dead").count() == 1 and got == [1, 1]


class Choosy(models.HashingEmbedder):
    """Refuses texts with the word boom."""

    def embed_documents(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("refused")
        return super().embed_documents(texts)


RAW = "repo string, kind string, page int, item string"


def test_ingestion_with_attempts(spark):
    folder, lake = tempfile.mkdtemp(), ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=2)
    plan = IngestionPlan(lake, Interceptors(), lambda: Choosy(8), 6, 2)
    raw = lambda n, body, **more: ("o/r", "issue", 1, json.dumps({"number": n, "title": "T", "body": body, "labels": [{"name": "l"}], "updated_at": "2024-02-01T00:00:00Z"} | more))
    land(spark, folder, "a", [raw(1, "old one"), raw(2, "two"), raw(3, " ", title=""), raw(None, "no number")], RAW)
    running = ingest.ingest_with_attempts(spark.readStream.schema(RAW).parquet(f"{folder}/*"), plan, tempfile.mkdtemp(), tries=3, wait_ms=50, processingTime="0 seconds")
    texts = lambda: sorted((r["document_id"][-1], r["text"]) for r in lake.chunks().collect())
    try:
        until(lambda: texts() == [("1", "T old one"), ("2", "T two")])
        land(spark, folder, "b", [raw(1, "boom and boom"), raw(2, "newer words than there were before here")], RAW)
        until(lambda: len(glob.glob(f"{lake.path}-dead-letters/batch=*/_SUCCESS")) == 2)
        until(lambda: len(texts()) > 2)
    finally:
        running.stop()
    rows = lake.chunks().collect()
    assert {r["text"] for r in rows if r["document_id"].endswith(":1")} == {"T old one"}
    assert len([r for r in rows if r["document_id"].endswith(":2")]) > 1 and all(r["labels"] == ["l"] and str(r["updated_at"]).startswith("2024-02-01") for r in rows)
    assert all([float(x) for x in r["vector"]] == pytest.approx(Choosy(8).embed_query(r["text"]), abs=1e-6) for r in rows)
    dead = {r["id"][:5]: r for r in spark.read.parquet(f"{lake.path}-dead-letters").collect()}
    assert (dead["item:"]["attempts"], dead["githu"]["attempts"]) == (1, 3) and "no number" in dead["item:"]["payload"] and dead["githu"]["id"] == "github:o/r:issue:1"


def test_arrivals_are_four_batches_whatever_the_number_of_files(spark, monkeypatch):
    from lodestack import queries

    base = tempfile.mkdtemp()
    made = spark.range(400, numPartitions=4).selectExpr("id % 30 as user_id", "id as event_id", "'t' as event_type", "cast(id as double) as value")
    made.repartition(8).write.parquet(f"{base}/events.parquet")
    monkeypatch.setattr(queries, "_shared", lambda s: base)
    found = queries.last_arrival_stream(spark, base)
    assert sorted((r["id"], r["event_id"]) for r in found.collect()) == sorted((i % 30, i) for i in range(370, 400))
    batches = glob.glob(f"{base}/arrivals-*/out/*")
    assert len(glob.glob(f"{base}/arrivals-*/in/*/*.parquet")) > 4 and len(batches) == 4
