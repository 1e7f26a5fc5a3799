"""The retrieval calls as table functions against the calls on DataFrames."""

import pytest

from lodestack.functions import models
from lodestack.operators import search
from lodestack.plans import sql
from lodestack.schema import CHUNK
from tests.test_postings import chunk_rows

MODEL = models.HashingEmbedder(8)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(*r[:4], MODEL.embed_query(r[3]) if i % 11 else None, *r[5:]) for i, r in enumerate(chunk_rows())]
    made = spark.createDataFrame(rows, CHUNK).where("document_id is not null")
    sql.register(made, MODEL, [{"id": "a", "type": "github"}], "t_", 4)
    return made


def same(spark, call, expected):
    found = spark.sql(f"select * from {call}")
    assert found.columns == expected.columns
    assert [r.asDict(True) for r in found.collect()] == [r.asDict(True) for r in expected.collect()]


@pytest.mark.parametrize(("text", "k"), [("", 4), (", 7", 7), (", 0", 4), (", null", 4), (", k => -1", search.ALL)])
def test_related_and_entities(spark, chunks, text, k):
    for entity in ("x1", "n2", "nowhere"):
        same(spark, f"t_find_related('{entity}'{text})", search.find_related(chunks, entity, None, k))
    more = text if "k =>" in text or not text else ", k => " + text[2:]
    same(spark, f"t_find_related('x1', relationship_types => array('owns', 'z'){more})", search.find_related(chunks, "x1", ["owns", "z"], k))
    same(spark, f"t_list_entities({more[2:]})", search.list_entities(chunks, None, None, k))
    same(spark, f"t_list_entities('d0007', 'b'{more})", search.list_entities(chunks, "d0007", "b", k))


@pytest.mark.parametrize(("given", "filters"), [("null", None), ("map()", None), ("map('repo', array('r1', 'r2'))", {"repo": ["r1", "r2"]}), ("map('labels', array('n3'), 'author', array('ann'))", {"labels": "n3", "author": "ann"}), ("map('repo', array())", {"repo": []}), ("map('topics', array('n1', 'n2'))", {"topics": ["n1", "n2"]})])
def test_search(spark, chunks, given, filters):
    given = given.replace("map()", "cast(map() as map<string, array<string>>)").replace("array()", "cast(array() as array<string>)")
    asked = MODEL.embed_query("text 17")
    found = spark.sql(f"select * from t_search_context('text 17', 6, {given})")
    exact = search.knn(chunks, asked, 6, filters)
    assert found.columns == exact.columns and [(r["chunk_id"], round(r["score"], 9)) for r in found.collect()] == [(r["chunk_id"], round(r["score"], 9)) for r in exact.collect()]


def test_documents_and_sources(spark, chunks):
    same(spark, "t_get_document('d0003')", search.reassemble(search.get_by_document(chunks, "d0003")))
    assert spark.sql("select * from t_get_document('none')").count() == 0
    joined = spark.sql("select d.document_id, d.chunk_count from values ('d0001'), ('d0002'), ('none') as a(id), lateral t_get_document(a.id) d")
    assert sorted(map(tuple, joined.collect())) == [("d0001", 3), ("d0002", 3)]
    assert [tuple(r) for r in spark.sql("select * from t_list_sources()").collect()] == [("a", "github")]


def test_wrong_arguments(spark, chunks):
    with pytest.raises(Exception, match="k must not be negative"):
        spark.sql("select * from t_find_related('x1', -2)").collect()
    with pytest.raises(Exception, match="not filterable"):
        spark.sql("select * from t_search_context('a', 3, map('tagged', array('x')))").collect()


def test_a_constant_limit_is_taken_in_every_task(spark, chunks):
    plan = spark.sql("select document_id from t_find_related('x1', 7)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject(limit=7") == 2
    everything = spark.sql("select document_id from t_find_related('x1', -1)")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in everything
