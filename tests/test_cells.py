"""The index of cells against exact search."""

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import search
from lodestack.functions import models
from lodestack.operators.cells import CellIndex, cells_for, probes_for
from lodestack.operators.graphs import GraphIndex, links_of, walk
from lodestack.plans.hooks import Interceptors
from lodestack.plans.lake import ContextLake, IngestionPlan
from lodestack.schema import DOCUMENT
from lodestack.queries import QUERIES, table, vectors

DIR = "/root/testdata/sf0.001"


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_recall_on_the_test_vectors(spark):
    held = vectors(spark, "/root/testdata/sf0.01")
    index = CellIndex.build(held, tempfile.mkdtemp() + "/cells")
    asked = [list(r["vector"]) for r in held.where("chunk_id % 50 = 0").orderBy("chunk_id").limit(12).collect()]
    met = [len(set(ids(index.search(v))) & set(ids(search.knn(held, v)))) for v in asked]
    assert sum(met) >= 0.9 * 10 * len(met) and index.rows().count() == held.count()


def test_the_query(spark):
    exact = search.knn(vectors(spark, DIR), list(table(spark, DIR, "embeddings").where("vec_id = 0").first()["embedding"]))
    assert len(set(ids(QUERIES["ann_search"](spark, DIR))) & set(ids(exact))) >= 9


@pytest.fixture(scope="module")
def groups(spark):
    """Vectors about twenty directions far apart, and rows that are in no cell."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    rows = [(f"c{i:04d}", f"d{i % 7}", [float(x) for x in centre[i % 20] + 0.05 * rng.normal(size=16)]) for i in range(1000)]
    nan = float("nan")
    odd = [("n", "d0", None), ("e", "d0", []), ("z", "d0", [0.0] * 16), ("s", "d0", [1.0]), ("x", "d0", [nan] * 16), ("y", "d0", [None] * 16)]
    df = spark.createDataFrame(rows + odd, "chunk_id string, document_id string, vector array<float>").withColumn("repo", F.col("document_id"))
    return df, CellIndex.build(df, tempfile.mkdtemp() + "/cells", cells=20), rows


def test_a_search_reads_few_cells(groups):
    df, index, rows = groups
    assert index.about["probes"] <= 4 < index.about["cells"] and index.rows().count() == len(rows)
    found = index.search(rows[5][2], 10)
    assert ids(found) == ids(search.knn(df, rows[5][2], 10))
    assert re.search(r"PartitionFilters: \[[^\]]*index_cell#", found._jdf.queryExecution().toString())


def test_a_filter_does_not_shorten_the_answer(groups):
    df, index, rows = groups
    where = {"repo": ["d3"]}
    assert ids(index.search(rows[0][2], 100, where)) == ids(search.knn(df.where("size(vector) = 16 and chunk_id like 'c%'"), rows[0][2], 100, where))
    assert len(ids(index.search(rows[0][2], 5_000))) == len(ids(index.search(rows[0][2], search.ALL))) == len(rows)
    with pytest.raises(ValueError):
        index.search([1.0], 3)


def test_small_and_empty_tables(spark, groups):
    df, *_ = groups
    for n in (0, 1, 3):
        few = df.where(F.col("chunk_id") < f"c{n:04d}").where("chunk_id like 'c%'")
        index = CellIndex.build(few, tempfile.mkdtemp() + "/cells")
        found = ids(index.search([1.0] * (16 if n else 0), 5)) if n else index.rows().count()
        assert found == ids(search.knn(few, [1.0] * 16, 5)) if n else found == 0


def test_probes_of_equal_vectors():
    assert probes_for(np.ones((5, 3)), np.eye(3), 2, 0.9) == 1 and probes_for(np.ones((1, 3)), np.eye(3), 2, 0.9) == 1


def test_cells_that_a_filter_needs():
    asked, centres = np.array([[1.0, 0.1], [0.1, 1.0]]), np.eye(2)
    assert [c.tolist() for c in cells_for(asked, centres, np.array([5, 9]), 1, 2)] == [[0], [1]]
    assert [c.tolist() for c in cells_for(asked, centres, np.array([5, 9]), 1, 3)] == [[0, 1], [1]]
    assert [c.tolist() for c in cells_for(asked, centres, np.array([0, 0]), 1, 6)] == [[0, 1], [1, 0]]


def flat(links):
    return np.concatenate([[0], np.cumsum([len(x) for x in links])]), np.concatenate(links)


@pytest.mark.parametrize("shape", ["even", "clusters", "copies"])
def test_walks_find_the_nearest_and_compare_few(shape):
    rng, n = np.random.default_rng(2), 6_000
    rows = {"even": rng.normal(size=(n, 24)), "clusters": rng.normal(size=(60, 24))[rng.integers(0, 60, n)] + 0.1 * rng.normal(size=(n, 24)), "copies": np.where(rng.random((n, 1)) < 0.35, np.ones((1, 24)), rng.normal(size=(n, 24)))}[shape]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    starts, links = flat(links_of(unit))
    met = seen = 0
    for q in range(0, n, 100):
        kept, count = walk(unit, starts, links, np.ones(n, dtype=bool), unit[q], 96)
        score = unit @ unit[q]
        tenth = np.sort(score)[-10]
        met, seen = met + min(10, int((score[kept] >= tenth - 1e-12).sum())), seen + count
    assert met >= 0.95 * 10 * (n // 100) and seen < 0.6 * n * (n // 100)


def test_walks_under_a_filter():
    rng, n = np.random.default_rng(3), 3_000
    unit = rng.normal(size=(n, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    starts, links = flat(links_of(unit))
    for share in (0.0, 0.001, 0.05, 0.9):
        passes = rng.random(n) < share
        kept, seen = walk(unit, starts, links, passes, unit[0], 40)
        best = np.argsort(np.where(passes, -(unit @ unit[0]), 9.0), kind="stable")[: min(10, passes.sum())]
        assert passes[kept].all() and len(kept) == min(40, passes.sum()) and len(set(best) & set(kept)) >= 0.9 * len(best)
        assert seen <= max(passes.sum(), 0.9 * n)


def test_links_of_few_rows():
    assert [x.tolist() for x in links_of(np.ones((1, 3)))] == [[]]
    assert all(len(x) == 1 for x in links_of(np.eye(2)))


@pytest.fixture(scope="module")
def graphs(groups):
    return GraphIndex.build(groups[0], tempfile.mkdtemp() + "/graphs", cells=3)


def test_graphs_against_exact_search(spark, groups, graphs):
    df, _, rows = groups
    asked = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 1000, 50)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [float("nan")] * 16)], "query_id long, query_vector array<float>")
    for filters in (None, {"repo": ["d3", "d4"]}, {"repo": "d6"}, {"repo": "none"}):
        known = df.where("chunk_id like 'c%'")
        known = known if filters is None else known.where(F.col("repo").isin(filters["repo"]))
        exact = {(r["query_id"], r["chunk_id"]) for r in search.knn_batch(known, asked.where("query_id < 5000"), 10).collect()}
        found = graphs.search_batch(asked, 10, filters).collect()
        assert len({(r["query_id"], r["chunk_id"]) for r in found} & exact) >= 0.95 * len(exact) and len(found) == len(exact)
    one = graphs.search(rows[5][2], 10, {"repo": ["d3", "d5"]})
    assert one.columns == search.knn(df, rows[5][2], 10).columns and len(set(ids(one)) & set(ids(search.knn(df.where("chunk_id like 'c%'"), rows[5][2], 10, {"repo": ["d3", "d5"]})))) >= 9
    assert len(ids(graphs.search(rows[5][2], search.ALL))) == 1000 == graphs.rows().count()
    with pytest.raises(ValueError):
        graphs.search([1.0], 3)


def test_large_cells_are_several_graphs(spark, groups, monkeypatch):
    from lodestack.operators import graphs as module

    monkeypatch.setattr(module, "ROWS_A_GRAPH", 100)
    df, _, rows = groups
    index = GraphIndex.build(df, tempfile.mkdtemp() + "/graphs", cells=2)
    parts = spark.read.parquet(f"{index.path}/rows").groupBy("index_cell", "index_part").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) < 200
    assert len(set(ids(index.search(rows[7][2], 10))) & set(ids(search.knn(df, rows[7][2], 10)))) >= 9


def test_no_vectors(spark, groups):
    index = GraphIndex.build(groups[0].where("false"), tempfile.mkdtemp() + "/graphs")
    assert index.rows().count() == 0 and index.about["cells"] == 0


def test_the_lake_walks_until_the_next_write(spark):
    doc = lambda i: (f"github:o/r:issue:{i}", "github", f"o/r#{i}", "issue", "o/r" if i % 2 else "p/q", f"title {i}", f"word{i} word{i % 5} auth login", "u", "ann", None, None, [], None, None)
    lake = ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=2)
    plan = IngestionPlan(lake, Interceptors(), lambda: models.HashingEmbedder(16), 50, 5)
    plan.process(spark.createDataFrame([doc(i) for i in range(40)], DOCUMENT))
    asked = models.HashingEmbedder(16).embed_query("auth login word3")
    exact = [ids(lake.query(asked, 5)), ids(lake.query(asked, 5, {"repo": "p/q"}))]
    assert lake.graph() is None
    lake.build_graph()
    assert lake.graph() is not None and "FlatMapCoGroupsInArrow" in lake.query(asked, 5)._jdf.queryExecution().toString()
    assert [ids(lake.query(asked, 5)), ids(lake.query(asked, 5, {"repo": "p/q"}))] == exact
    plan.process(spark.createDataFrame([doc(99)], DOCUMENT))
    assert lake.graph() is None and lake.query(asked, 50).count() == 41


def test_links_hold_no_square_of_the_rows(monkeypatch):
    import tracemalloc

    from lodestack.operators import graphs

    monkeypatch.setattr(graphs, "SCORES", 100_000, raising=False)
    unit = np.random.default_rng(1).normal(size=(3_000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tracemalloc.start()
    links = graphs.links_of(unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 3_000 and peak < 25e6  # the square is 72 MB


def test_walks_find_the_nearest_in_a_whole_graph_of_evenly_spread_vectors():
    from lodestack.operators import graphs

    rng = np.random.default_rng(2)
    unit = rng.normal(size=(graphs.ROWS_A_GRAPH, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = graphs.links_of(unit)
    starts, flat = np.concatenate([[0], np.cumsum([len(x) for x in links])]), np.concatenate(links)
    met = 0
    for asked in unit[::256]:
        kept, _ = graphs.walk(unit, starts, flat, np.ones(len(unit), dtype=bool), asked, graphs.BEAM)
        best = sorted(kept, key=lambda r: -float(unit[r] @ asked))[:10]
        met += len(set(best) & set(np.argsort(-(unit @ asked))[:10].tolist()))
    assert met / (10 * len(unit[::256])) >= 0.97
