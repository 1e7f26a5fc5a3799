"""The posting index against scans of the chunks, and what a lookup reads."""

import os
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestack.functions import models
from lodestack.operators import search
from lodestack.operators.postings import ALL, PostingIndex, postings
from lodestack.plans.hooks import Interceptors
from lodestack.plans.lake import ContextLake, ContextTools, IngestionPlan
from lodestack.schema import CHUNK, DOCUMENT


def chunk_rows(n=400):
    rng = random.Random(4)
    out = []
    for i in range(n):
        names = [f"n{rng.randint(0, 12)}" for _ in range(rng.randint(0, 4))]
        edges = [(rng.choice(["uses", "owns"]), f"x{rng.randint(0, 9)}", "") for _ in range(rng.randint(0, 3))]
        document, repo = f"d{i // 3:04d}", None if i % 7 == 0 else f"r{i % 4}"
        entities = [("a" if x < "n5" else "b", x) for x in names]
        out.append((f"{document}#{i % 3}", document, i % 3, f"text {i}", None, "github", "issue", repo, "t", "u", "ann" if i % 2 else None, None, None, ["hot"] + names[:1], "", entities, names, [t for t, _ in entities], names[:2], edges, [e[1] for e in edges], [e[0] for e in edges]))
    out.append(("?", None, 0, "no document", *[None] * 18))
    out.append(("e#0", "e", 0, "all null", *[None] * 18))
    return out


@pytest.fixture(scope="module")
def chunks(spark):
    at = tempfile.mkdtemp() + "/chunks"
    spark.createDataFrame(chunk_rows(), CHUNK).repartition(3).write.parquet(at)
    return spark.read.schema(CHUNK).parquet(at)


@pytest.fixture(scope="module")
def index(chunks):
    return PostingIndex.build(chunks, tempfile.mkdtemp() + "/postings", row_group=1024)


FILTERS = [
    {"labels": "hot"}, {"entity_names": "n3"}, {"entity_names": ["n3", "n4", "none"]}, {"repo": "r1"}, {"repo": ["r1", "r2"]}, {"repo": None}, {"labels": []}, {"labels": [None, "hot"], "repo": "r3"},
    {"relationship_targets": "x1", "relationship_types": ["owns"], "author": "ann"}, {"document_id": "d0007"}, {"topics": "n1", "entity_types": "b"}, {"entity_names": "nowhere"},
]


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize("k", [5, 3000, ALL])
def test_same_as_a_scan(chunks, index, filters, k):
    rows = lambda df: [tuple(r) for r in df.collect()]
    known = chunks.where("document_id is not null")
    assert rows(search.search_by_metadata(known, filters, k, index)) == rows(search.search_by_metadata(known, filters, k))


@pytest.mark.parametrize("types", [None, ["owns"], ["owns", "uses"]])
@pytest.mark.parametrize("same_edge", [True, False])
def test_related_and_entities(chunks, index, types, same_edge):
    for entity in ("x1", "n2", "none"):
        for k in (3, ALL):
            one, two = (search.find_related(chunks, entity, types, k, same_edge, i).collect() for i in (index, None))
            assert one == two
    assert search.list_entities(chunks, "d0007", None, 9, index).collect() == search.list_entities(chunks, "d0007", None, 9).collect()
    assert search.list_entities(chunks, None, "b", ALL, index).collect() == search.list_entities(chunks, None, "b", ALL).collect()


def test_without_conditions_and_unknown_fields(chunks, index):
    assert index.matching(None).count() == 401 and index.matching({}, 7).count() == 7
    with pytest.raises(ValueError):
        index.matching({"text": "x"})
    none = PostingIndex.build(chunks.where("false"), tempfile.mkdtemp() + "/none")
    assert none.matching({"repo": "r1"}).count() == 0


def read_rows(df):
    """Rows that the scans of an executed plan handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return out


def test_a_lookup_reads_the_row_groups_around_its_value(spark):
    many = spark.range(60_000).select(F.format_string("d%06d", "id").alias("document_id"), F.lit(0).alias("chunk_index"), F.array(F.format_string("v%04d", F.col("id") % 3000)).alias("labels"), F.lit("r").alias("repo"))
    index = PostingIndex.build(many, tempfile.mkdtemp() + "/postings", row_group=16 << 10)
    found = index.matching({"labels": "v1234"})
    assert len(found.collect()) == 20
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(value,v1234)" in plan and "field" in plan.split("PartitionFilters")[1][:80]
    assert 20 <= read_rows(found) < 12_000
    files = [os.path.join(f, n) for f, _, names in os.walk(f"{index.path}/field=labels") for n in names if n.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(g.num_row_groups for g in groups) > 5
    # Every value is in few row groups: their ranges of values hardly overlap.
    ranges = [g.row_group(i).column(0).statistics for g in groups for i in range(g.num_row_groups)]
    assert sum(s.min <= "v1234" <= s.max for s in ranges) <= 2


def test_postings_of_a_chunk(spark):
    rows = spark.createDataFrame([("d", 0, "r", ["a", "a", None, "b"]), (None, 0, "r", ["a"])], "document_id string, chunk_index int, repo string, labels array<string>")
    assert sorted(tuple(r) for r in postings(rows).collect()) == [("document_id", "d", "d", 0), ("labels", "a", "d", 0), ("labels", "b", "d", 0), ("repo", "r", "d", 0)]
    assert postings(rows.where("false")).count() == 0


def test_the_lake_uses_its_index_until_the_next_write(spark):
    doc = lambda i, labels: (f"github:o/r:issue:{i}", "github", f"o/r#{i}", "issue", "o/r", "T", "body", "u", "ann", None, None, labels, None, ("s", [("service", f"e{i}")], [], [("uses", "X", "")]))
    lake = ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=4)
    plan = IngestionPlan(lake, Interceptors(), lambda: models.HashingEmbedder(8), 50, 5)
    plan.process(spark.createDataFrame([doc(i, ["x" if i % 2 else "y"]) for i in range(8)], DOCUMENT))
    tools = ContextTools(lake, models.HashingEmbedder(8), Interceptors(), [])
    by_scan = [tools.find_related("X"), tools.list_entities(k=3), tools.list_entities("github:o/r:issue:3"), [tuple(r) for r in lake.search_by_metadata({"labels": "x"}).collect()]]
    assert lake.postings() is None
    lake.build_postings()
    assert lake.postings() is not None
    assert by_scan == [tools.find_related("X"), tools.list_entities(k=3), tools.list_entities("github:o/r:issue:3"), [tuple(r) for r in lake.search_by_metadata({"labels": "x"}).collect()]]
    plan.process(spark.createDataFrame([doc(9, ["x"])], DOCUMENT))
    assert lake.postings() is None and lake.search_by_metadata({"labels": "x"}).count() == 5


def test_fields_are_indexed_when_asked_and_the_rest_is_tested(spark, chunks):
    at = tempfile.mkdtemp() + "/postings"
    some = PostingIndex.build(chunks, at, fields=("entity_names",))
    assert os.listdir(at) == ["field=entity_names"]
    rows = lambda df: [tuple(r) for r in df.collect()]
    known = chunks.where("document_id is not null")
    with pytest.raises(ValueError):
        some.matching({"relationship_types": "owns"})
    for filters in ({"entity_names": "n3", "relationship_types": ["owns"]}, {"relationship_types": ["owns"]}, {"entity_names": ["n3", "n4"], "labels": []}, None):
        for k in (2, ALL):
            assert rows(search.search_by_metadata(known, filters, k, some)) == rows(search.search_by_metadata(known, filters, k))
    some.extend(("entity_names", "relationship_targets"))
    assert sorted(os.listdir(at)) == ["field=entity_names", "field=relationship_targets"]
    assert search.find_related(known, "x1", ["owns"], 3, index=some).collect() == search.find_related(known, "x1", ["owns"], 3).collect()


def test_tasks_of_the_build_are_bounded(spark, monkeypatch):
    monkeypatch.setattr("lodestack.operators.postings.POSTINGS_A_TASK", 1000)
    many = spark.range(6_000).select(F.format_string("d%06d", "id").alias("document_id"), F.lit(0).alias("chunk_index"), F.array(F.lit("hot"), F.format_string("v%04d", F.col("id") % 300)).alias("labels"))
    index = PostingIndex.build(many, tempfile.mkdtemp() + "/postings", fields=("labels",))
    files = [pq.ParquetFile(f"{index.path}/field=labels/{n}").metadata.num_rows for n in os.listdir(f"{index.path}/field=labels") if n.endswith(".parquet")]
    assert len(files) > 8 and sum(files) == 12_000 and max(files) < 2_500
    assert index.matching({"labels": "hot"}).count() == 6_000


def test_entities_of_all_chunks_are_not_sorted_by_chunk(spark, chunks):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(search.list_entities(chunks, None, "a", ALL)).count("Sort ") == 1  # the names, and not the chunks
    assert plan(search.list_entities(chunks, None, "a", 5)).count("Sort ") == 2
