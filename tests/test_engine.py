"""The retrieval engine on hand-made rows."""

import asyncio
import json
import os
import random
import shutil
import tempfile
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestack import config
from lodestack.functions import metadata, models, text
from lodestack.operators import filters, ingest, search
from lodestack.plans import evaluate, hooks
from lodestack.plans.lake import ContextLake, ContextTools, IngestionPlan
from lodestack.schema import DOCUMENT
from lodestack.sources import pages
from lodestack.streaming import ingest as streaming


def naive_chunks(words, size, overlap):
    out, kept, used = [], [], 0
    for w in words:
        t = max(1, -(-len(w) // 4))
        if kept and used + t > size:
            out.append(" ".join(kept))
            tail, total = [], 0
            for x in reversed(kept):
                if total + max(1, -(-len(x) // 4)) > overlap:
                    break
                tail.insert(0, x)
                total += max(1, -(-len(x) // 4))
            kept, used = tail, total
        kept.append(w)
        used += t
    return out + [" ".join(kept)] if kept else out


@pytest.mark.parametrize("size,overlap", [(3, 2), (6, 5), (50, 0), (20, 15)])
def test_chunks_equal_a_greedy_walk(size, overlap):
    rng = random.Random(size)
    for _ in range(200):
        words = ["x" * rng.choice([1, 3, 5, 9, 40, 300]) for _ in range(rng.randint(0, 60))]
        assert text.chunk_text("　 ".join(words) + "\x1c", size, overlap) == naive_chunks(words, size, overlap)


def test_blank_text_and_bad_overlap():
    assert text.chunk_text(" \n", 10, 2) == []
    with pytest.raises(ValueError):
        text.chunk_text("a", 10, 10)


def test_words_and_tokens(spark):
    row = spark.createDataFrame([("a b　c\x85d\x1ce 😀😀😀😀😀",), ("",)], "t string").select(text.words(F.col("t")).alias("w"), text.estimate_tokens(F.col("t")).alias("n")).collect()
    assert row[0]["w"] == ["a", "b", "c", "d", "e", "😀😀😀😀😀"] and row[1]["n"] == 1


def doc(i, body, title="T", labels=("x",), semantic=None, repo="o/r"):
    return (f"github:{repo}:issue:{i}", "github", f"{repo}#{i}", "issue", repo, title, body, "u", "ann", None, None, list(labels), None, semantic)


SEM = ("s", [("service", "auth")], ["t"], [("references", "X", ""), ("depends_on", "Y", "")])


@pytest.fixture()
def lake(spark):
    made = ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=4)
    made.ensure_index()
    made.ensure_index()
    return made


def plan(lake, **more):
    return IngestionPlan(lake, embedder=lambda: models.HashingEmbedder(32), size=6, overlap=2, **more)


def test_replace_by_document(spark, lake):
    docs = spark.createDataFrame([doc(1, "one two three four five six seven eight"), doc(2, "other text here")], DOCUMENT)
    plan(lake).process(docs)
    before = sorted(map(tuple, lake.chunks().select("chunk_id", "text").collect()))
    plan(lake).process(docs)
    assert sorted(map(tuple, lake.chunks().select("chunk_id", "text").collect())) == before and len(before) > 3
    plan(lake).process(spark.createDataFrame([doc(1, "short")], DOCUMENT))
    assert [r["text"] for r in lake.get_by_document("github:o/r:issue:1").collect()] == ["T short"]
    empty = spark.createDataFrame([doc(1, " ", title="")], DOCUMENT)
    plan(lake).process(empty)
    assert lake.get_by_document("github:o/r:issue:1").count() == 1
    plan(lake, purge_empty=True).process(empty)
    assert lake.get_by_document("github:o/r:issue:1").count() == 0
    lake.delete_by_document("github:o/r:issue:2")
    assert lake.chunks().count() == 0


def test_upsert(spark, lake):
    rows = ingest.embed_chunks(ingest.chunk_documents(spark.createDataFrame([doc(1, "a b c")], DOCUMENT), 50, 5), lambda: models.HashingEmbedder(8))
    assert lake.upsert(rows) == 1 and lake.upsert(rows) == 1 and lake.chunks().count() == 1
    assert lake.upsert(rows.limit(0)) == 0
    with pytest.raises(RuntimeError):
        lake.upsert(rows.withColumn("chunk_id", F.lit(None).cast("string")))


def test_tools(spark, lake):
    docs = [doc(1, "login fails in auth", semantic=SEM), doc(2, "the auth service", semantic=("s", [("service", "X")], [], [])), doc(3, "nothing")]
    plan(lake).process(spark.createDataFrame(docs, DOCUMENT))
    tools = ContextTools(lake, models.HashingEmbedder(32), sources=[{"id": "a", "type": "github"}], default_k=10)
    assert tools.search_context("login fails", 2)[0]["document_id"].endswith(":1") and len(tools.search_context("auth", 0)) <= 10
    assert tools.get_document("none") == {"document_id": "none", "found": False}
    whole = tools.get_document("github:o/r:issue:1")
    assert whole["found"] and whole["chunk_count"] >= 1 and "login" in whole["text"]
    related = tools.find_related("X")
    assert [(r["document_id"][-1], r["via"]) for r in related["related"]] == [("1", ["relationship"]), ("2", ["entity"])]
    assert tools.find_related("X", ["depends_on"])["related"][0]["document_id"].endswith("1")
    assert search.find_related(lake.chunks(), "X", ["depends_on"], same_edge=True).where("array_contains(via, 'relationship')").count() == 0
    assert tools.list_entities(entity_type="service")["entities"] == [{"type": "service", "name": "auth"}, {"type": "service", "name": "X"}]
    assert tools.list_sources() == [{"id": "a", "type": "github"}]
    with pytest.raises(ValueError):
        tools.search_context("x", filters={"tagged": True})
    with pytest.raises(ValueError):
        search.effective_k(-2)


class Deny(hooks.Interceptor):
    def authorize(self, principal, action, resource):
        return principal == "me"


class OnlyGitHub(hooks.Interceptor):
    def before_query(self, ctx):
        return hooks.QueryContext(ctx.query, ctx.k, ctx.filters | {"repo": "o/r"}, ctx.principal)

    def after_query(self, results, ctx):
        return results.limit(1)


def test_hooks(spark, lake):
    plan(lake).process(spark.createDataFrame([doc(1, "a b"), doc(2, "a b", repo="p/q")], DOCUMENT))
    tools = ContextTools(lake, models.HashingEmbedder(32), hooks.Interceptors([Deny(), OnlyGitHub()]))
    with pytest.raises(PermissionError):
        tools.search_context("a")
    found = tools.search_context("a", principal="me")
    assert [r["repo"] for r in found] == ["o/r"]
    both = hooks.Interceptors.from_paths(["lodestack.plans.hooks:Interceptor", "lodestack.plans.hooks.SemanticInterceptor"])
    assert len(both) == 2 and hooks.Interceptors().authorize(None, "read", "x")
    with pytest.raises(TypeError):
        hooks.load("collections:OrderedDict")
    with pytest.raises(ValueError):
        hooks.load("nothing")


def test_knn_ties_zero_and_null_vectors(spark):
    rows = spark.createDataFrame([("b", "d", [1.0, 0.0]), ("a", "d", [1.0, 0.0]), ("z", "d", [0.0, 0.0]), ("n", "d", None)], "chunk_id string, document_id string, vector array<float>")
    assert [(r["chunk_id"], r["score"]) for r in search.knn(rows, [2.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_filters(spark):
    rows = spark.createDataFrame([("r", ["a", "b"]), (None, [])], "repo string, labels array<string>")
    count = lambda f: rows.where(filters.predicate(f)).count()
    assert count({"labels": "a"}) == 1 and count({"labels": ["b", "z"]}) == 1 and count({"labels": []}) == 0 and count({"repo": None}) == 0 and count({"repo": "r", "labels": "z"}) == 0
    assert filters.predicate({}) is None and filters.predicate(None) is None


def test_model_replies(spark):
    assert metadata.extract_json('text ```json\n{"summary": "s"}\n``` more') == {"summary": "s"}
    with pytest.raises(ValueError):
        metadata.extract_json("none here")
    good = {"entities": [{"type": "a", "name": "b"}], "relationships": [{"type": "t", "target": "x"}]}
    assert metadata.validate(good)["relationships"][0]["description"] == "" and metadata.validate({})["topics"] == []
    replies = [json.dumps(good), "[1]", '{"entities": [{"type": "a"}]}', '{"entities": [{"type": "a", "name": 3}]}', None, '{"summary": NaN}']
    found = spark.createDataFrame([(r,) for r in replies], "r string").select(metadata.parse_metadata(F.col("r")).alias("m")).collect()
    assert [r["m"] is not None for r in found] == [True, False, False, False, False, False]


def test_replies_without_python(spark):
    """Variants and their schemas say what the walk over Python values says."""
    entity, edge = {"type": "a", "name": "b"}, {"type": "t", "target": "x"}
    values = [
        {}, {"summary": "s"}, {"summary": 1}, {"summary": None}, {"summary": ["s"]}, {"topics": ["a", "b"]}, {"topics": ["a", 1]}, {"topics": [None]}, {"topics": "a"}, {"topics": None}, {"topics": []},
        {"entities": [entity, entity | {"more": [1]}]}, {"entities": [entity, 3]}, {"entities": [entity | {"name": None}]}, {"entities": [entity | {"type": 1}]}, {"entities": {}}, {"entities": [None]}, {"entities": [[entity]]},
        {"relationships": [edge, edge | {"description": "d"}]}, {"relationships": [edge | {"description": None}]}, {"relationships": [{"type": "t"}]}, {"relationships": [edge | {"target": True}]}, {"other": {"deep": [1, 2.5, None]}}, {"summary": "é\n\"{}", "topics": ["}"]},
        [], [{}], "text", 5, None, True,
    ]
    replies = [json.dumps(v) for v in values] + [f"Here:\n```json\n{json.dumps(v, indent=1)}\n```\ndone" for v in values] + ["\u3000 {} \x1c", "{} x", "{}{}", "{}] {}", "{}}, {}", "{\"a\":1}, {\"b\":2}", "x {\"summary\": \"s\"} y", "x { y", "", "}{", "{'summary': 's'}", "{\"topics\": [\"a\",]}", "long " * 50_000 + "{}"]

    def walk(text):
        try:
            return metadata.validate(metadata.extract_json(text))
        except (ValueError, TypeError, KeyError):
            return None

    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", metadata.parse_metadata(F.col("r")).alias("m"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    found = {r["i"]: r["m"].asDict(True) if r["m"] else None for r in df.collect()}
    assert [found[i] for i in range(len(replies))] == [walk(r) for r in replies]


class Remote:
    """A service that answers after a random time; it fails on some texts, on others only at first."""

    def __init__(self, slow=0.0):
        self.slow, self.now, self.most, self.calls = slow, 0, 0, []

    async def __call__(self, text):
        self.now += 1
        self.most = max(self.most, self.now)
        self.calls.append(text)
        try:
            await asyncio.sleep(self.slow or random.random() / 50)
            if text == "bad" or (text.startswith("later") and self.calls.count(text) < 3):
                raise RuntimeError(text)
            return [len(text), 1]
        finally:
            self.now -= 1


def test_calls_in_flight():
    texts = [f"{'x' * (i % 7)}{i}" for i in range(60)] + ["later 1", "later 2"]
    service = Remote()
    model = models.RemoteEmbedder(service, 2, in_flight=8, tries=3, wait=0.001)
    assert model.embed_documents(texts) == [[float(len(t)), 1.0] for t in texts] and service.most == 8 and service.calls.count("later 1") == 3
    assert model.embed_each(["a", "bad", "cc"]) == [[1.0, 1.0], None, [2.0, 1.0]] and service.calls.count("bad") == 3
    with pytest.raises(RuntimeError):
        model.embed_documents(["a", "bad"])
    started = time.perf_counter()
    models.RemoteEmbedder(Remote(0.2), 2, in_flight=10).embed_documents(["t"] * 10)
    assert time.perf_counter() - started < 0.6
    assert model.embed_documents([]) == [] and model.embed_query("abc") == [3.0, 1.0]
    with pytest.raises(ValueError):
        models.RemoteEmbedder(service, 2, in_flight=0)


def test_remote_calls_in_tasks(spark):
    texts = ["one", "bad", "later", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "i int, t string").repartition(2)
    make = lambda: models.RemoteEmbedder(Remote(), 2, in_flight=4, tries=3, wait=0.001)
    found = {r["i"]: r["v"] for r in rows.select("i", models.embed(F.col("t"), make, tries=1).alias("v")).collect()}
    assert all(found[i] == (None if t == "bad" else [float(len(t or "")), 1.0]) for i, t in enumerate(texts * 5))


class Failing(models.Inferencer):
    def infer_json(self, system, user, schema=None):
        raise RuntimeError("no model")


def test_extraction_is_best_effort(spark):
    docs = spark.createDataFrame([doc(1, "see o/r#7 and auth-service", semantic=SEM)], DOCUMENT)
    assert models.SemanticIndexer(Failing).extract(docs).first()["semantic"]["summary"] == "s"
    found = models.SemanticIndexer().extract(docs).first()["semantic"]
    assert "o/r#7" in [r["target"] for r in found["relationships"]] and ("service", "auth-service") in [tuple(e) for e in found["entities"]]
    assert hooks.SemanticInterceptor(enabled=False).before_ingest(docs) is docs


def test_prompts(spark):
    registry = models.default_registry()
    assert registry.select("github", "pr").name == "github-pr" and registry.select("github", "comment").name == "github" and registry.select("jira", "issue").name == "jira"
    registry.register(models.PromptTemplate("mine", "x"), "github", "pr")
    assert registry.select("github", "pr").name == "mine"
    with pytest.raises(ValueError):
        registry.register(models.PromptTemplate("mine", "x"), "gitlab")
    row = spark.createDataFrame([doc(1, "b" * 50, labels=(), repo="")], DOCUMENT).select(registry.default.render(10).alias("p")).first()["p"]
    assert "Labels: none" in row and "Repository: n/a" in row and row.endswith("\n" + "b" * 10)


def test_batch_search_in_blocks(spark, monkeypatch):
    """Blocks of queries and chunks give what one block gives, and no vector reaches the driver."""
    from lodestack.queries import vectors

    held = vectors(spark, "/root/testdata/sf0.001")
    asked = held.where("chunk_id % 50 = 0").selectExpr("chunk_id as query_id", "vector as query_vector")
    with monkeypatch.context() as m:
        m.setattr(type(held), "collect", None)
        blocks, whole = search.knn_batch(held, asked, 5, 3, 70), search.knn_batch(held, asked, 5)
    rows = lambda df: {(r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect()}
    assert rows(blocks) == rows(whole) and len(rows(whole)) == 5 * asked.count()


def test_cursors_and_watermarks(spark):
    from datetime import UTC, datetime

    assert pages.following(2, 1, 2) == "2" and pages.following(1, 1, 2) is None
    path = tempfile.mkdtemp() + "/mark.json"
    assert streaming.read_watermark(spark, path) is None
    now = datetime(2024, 5, 1, tzinfo=UTC)
    streaming.write_watermark(spark, path, now)
    assert streaming.read_watermark(spark, path) == now


def test_evaluation(spark):
    folder = tempfile.mkdtemp()
    gold = {"source_type": "github", "kind": "issue", "repo": "o/r", "external_id": "o/r#1", "title": "Auth-Service is slow", "labels": [], "body": "auth-service waits for o/r#9", "golden": {"entities": ["AUTH-service", "cache"], "relationship_targets": []}}
    with open(folder + "/first.json", "w") as file:
        json.dump(gold, file)
    scores = evaluate.evaluate(pages.golden(spark, folder), models.SemanticIndexer())
    row = scores.first()
    assert row["name"] == "first" and row["entities_recall"] == 0.5 and row["entities_missed"] == ["cache"] and row["relationship_targets_recall"] is None
    assert evaluate.mean_recall(scores).first() == Row(entities_recall=0.5, relationship_targets_recall=None)


def test_settings():
    made = config.from_environment({"LODESTACK_STORE__BUCKETS": "8", "LODESTACK_CONNECTOR__REPOS": "a/b, c/d", "LODESTACK_SEMANTIC__ENABLED": "false"})
    assert made.store.buckets == 8 and made.connector.repos == ("a/b", "c/d") and not made.semantic.enabled and made.embedding.dimensions == 1024


def test_settings_of_the_session(spark):
    before = config.settings()
    spark.conf.set("spark.lodestack.store.buckets", "5")
    spark.conf.set("spark.lodestack.connector.repos", "a/b,c/d")
    try:
        assert config.settings().store.buckets == 5 and config.settings().connector.repos == ("a/b", "c/d") and config.settings().server == before.server
    finally:
        spark.conf.unset("spark.lodestack.store.buckets")
        spark.conf.unset("spark.lodestack.connector.repos")
    assert config.settings() == before and config.settings() is config.settings()


def test_one_row_for_a_document_and_for_a_chunk(spark, lake):
    plan(lake).process(spark.createDataFrame([doc(1, "first"), doc(1, "second")], DOCUMENT).coalesce(1))
    assert [r["text"] for r in lake.chunks().collect()] == ["T second"]
    rows = ingest.embed_chunks(ingest.chunk_documents(spark.createDataFrame([doc(2, "a b"), doc(2, "c d")], DOCUMENT).coalesce(1), 50, 5), lambda: models.HashingEmbedder(8))
    assert lake.upsert(rows) == 1 and [r["text"] for r in lake.get_by_document("github:o/r:issue:2").collect()] == ["T c d"]


def test_a_write_that_was_stopped_is_finished_by_the_next(spark, lake, monkeypatch):
    texts = lambda: sorted(r["text"] for r in lake.chunks().collect())
    change = lambda text: lake.replace_documents(lake.chunks().where("document_id = 'github:o/r:issue:1'").withColumn("text", F.lit(text)))
    plan(lake).process(spark.createDataFrame([doc(1, "old"), doc(2, "other")], DOCUMENT))

    def crash(*args):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(lake, "_overwrite", crash)
        change("never staged")
    lake.ensure_index()
    assert texts() == ["T old", "T other"]
    with monkeypatch.context() as m, pytest.raises(OSError):
        begun = []
        m.setattr(lake, "_finish", lambda: crash() if begun else begun.append(1))
        change("staged")
    ready = os.listdir(f"{lake.path}-ready")
    assert len(ready) == 1
    # The writer died half-way: what it had to replace is gone from the table already.
    for bucket in (x for x in os.listdir(f"{lake.path}-ready/{ready[0]}") if x.startswith("bucket=")):
        shutil.rmtree(f"{lake.path}/{bucket}")
    lake.ensure_index()
    assert texts() == ["T other", "staged"] and not os.listdir(f"{lake.path}-ready")
    change("again")
    assert texts() == ["T other", "again"] and not os.listdir(f"{lake.path}-ready") + os.listdir(f"{lake.path}-staged")


def test_an_emptied_bucket_is_empty(spark):
    small = ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=1)
    plan(small).process(spark.createDataFrame([doc(i, "w") for i in range(10)], DOCUMENT))
    assert small.buckets == ContextLake(spark, small.path, buckets=9).buckets == 1 and small.chunks().count() == 10
    for i in range(10):
        small.delete_by_document(f"github:o/r:issue:{i}")
    assert small.chunks().count() == 0 and small.query([1.0] * 32).count() == 0


class Counting(models.Embedder):
    dimensions = 1

    def embed_documents(self, texts):
        with open(os.environ["COUNTED"], "a") as file:
            file.write("x" * len(texts))
        return [[1.0]] * len(texts)


def test_models_run_once(spark, lake, tmp_path, monkeypatch):
    where = str(tmp_path / "n")
    monkeypatch.setenv("COUNTED", where)

    def make():
        os.environ["COUNTED"] = where
        return Counting()

    IngestionPlan(lake, hooks.Interceptors(), make, 50, 5).process(spark.createDataFrame([doc(1, "a"), doc(2, "b")], DOCUMENT))
    assert os.path.getsize(where) == 2


def test_vectors_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", [nan, 1.0]), ("i", [inf, 1.0]), ("e", [None, 1.0]), ("z", [0.0, 0.0]), ("0", None)], "chunk_id string, vector array<float>").withColumn("document_id", F.lit("d"))
    assert [r["chunk_id"] for r in search.knn(rows, [1.0, 0.1], 9).collect()] == ["a", "b", "z"]
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [nan, 1.0]), (3, None)], "query_id long, query_vector array<float>")
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in search.knn_batch(rows, asked, 3).collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "z")]
    assert search.knn_batch(rows, asked.limit(0), 3).count() == search.knn_batch(rows.limit(0), asked, 3).count() == 0


def test_cursors_over_columns(spark):
    rows = spark.createDataFrame([(n, p) for n in (0, 1, 2, 3) for p in (1, 2)], "n int, p int").withColumn("c", pages.cursor_after(F.col("n"), F.col("p"), 2))
    assert all(r["c"] == pages.following(r["n"], r["p"], 2) for r in rows.collect())


def test_interceptors_of_the_settings(monkeypatch):
    made = config.from_environment({"LODESTACK_INTERCEPTORS": "lodestack.plans.hooks:SemanticInterceptor"})
    monkeypatch.setattr(hooks, "settings", lambda: made)
    hooks.configured.cache_clear()
    assert [type(x) for x in hooks.configured().items] == [hooks.SemanticInterceptor] and hooks.configured() is hooks.configured()
    hooks.configured.cache_clear()


class Refusing(models.HashingEmbedder):
    """Fails for every call with the word boom."""

    def embed_documents(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("refused")
        return super().embed_documents(texts)


def test_a_document_that_fails_is_put_aside(spark, lake):
    make = lambda: Refusing(8)
    strict = spark.createDataFrame([("boom",)], "text string").select(models.embed(F.col("text"), make))
    with pytest.raises(Exception, match="refused"):
        strict.collect()
    own = IngestionPlan(lake, hooks.Interceptors(), make, 6, 2, purge_empty=True, tries=2)
    own.process(spark.createDataFrame([doc(1, "old"), doc(2, "old")], DOCUMENT))
    own.process(spark.createDataFrame([doc(1, "one two three four five six boom"), doc(2, "new"), doc(3, "more")], DOCUMENT).coalesce(1))
    assert sorted((r["document_id"][-1], r["text"]) for r in lake.chunks().collect()) == [("1", "T old"), ("2", "T new"), ("3", "T more")]
    for _ in range(2):  # a batch that is repeated leaves its refused documents once
        own.process(spark.createDataFrame([doc(1, "one boom"), doc(2, "newer")], DOCUMENT), "7")
    failed = spark.read.parquet(f"{lake.path}-failed").groupBy("batch", "id").count().collect()
    assert len(failed) == 2 and {(r["id"], r["count"]) for r in failed} == {("github:o/r:issue:1", 1)}
    assert "7" in {str(r["batch"]) for r in failed} and sorted(r["text"] for r in lake.chunks().collect()) == ["T more", "T newer", "T old"]


def test_hashing_counts_terms():
    import zlib

    terms = ["a", "b", "a", "a b", "b a"]
    expected = [0.0] * 16
    for t in terms:
        code = zlib.crc32(t.encode())
        expected[(code >> 1) % 16] += 1 if code & 1 else -1
    length = sum(x * x for x in expected) ** 0.5
    assert models.HashingEmbedder(16).embed_documents(["A b, a"])[0] == pytest.approx([x / length for x in expected])
    assert models.HashingEmbedder(4).embed_query("") == [0.0] * 4


def test_chunks_leave_the_task_in_small_batches(spark):
    """The chunks of a batch of texts are never held all at once."""
    from lodestack.functions import text as module

    made, original = {}, module.F.arrow_udf
    try:
        module.F.arrow_udf = lambda run, kind: made.setdefault("run", run) and original(run, kind)
        column = module.chunks(F.col("text"), 3, 1)
    finally:
        module.F.arrow_udf = original
    texts = ["aa bb cc dd ee", None, " ", "x"] * 75
    held = [b.to_pylist() for b in made["run"](iter([module.pa.array(texts)]))]
    assert len(held) > 1 and max(map(len, held)) <= 64
    expected = [module.chunk_text(t, 3, 1) if t else [] for t in texts]
    assert [x for b in held for x in b] == expected
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", column.alias("c")).orderBy("id").collect()
    assert [r["c"] for r in rows] == expected


def test_a_text_is_cut_once(spark):
    """The size that ``explode`` asks of its array does not run the cutting of every text a second time."""
    made = ingest.chunk_documents(spark.createDataFrame([doc(1, "a b c"), doc(2, " "), doc(3, "d")], DOCUMENT), 2, 1)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = spark.createDataFrame([(1, "a b c"), (2, " "), (3, None)], "id int, text string").select("id", text.chunks(F.col("text"), 2, 1).alias("c")).select("id", F.posexplode("c").alias("i", "t"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in rows.orderBy("i").collect()] == [(1, 0, "a b"), (1, 1, "b c")]


@pytest.mark.parametrize("dimensions", [1, 16, 64])
def test_hashing_many_texts_equals_hashing_each_term(dimensions, monkeypatch):
    """Words of any script and length, pairs inside a text only, texts in parts of any size."""
    import re
    import zlib

    import numpy as np

    def one(x):
        words = re.findall(r"\w+", (x or "").lower())
        out = np.zeros(dimensions)
        for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            code = zlib.crc32(term.encode())
            out[(code >> 1) % dimensions] += 1 if code & 1 else -1
        norm = np.linalg.norm(out)
        return (out / norm if norm else out).tolist()

    every = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    texts = ["", None, " ", "A b, a", "a", "", "—", "日本 語", "naïve ½ ² ٣ _a_ İstanbul ß\x1c\x00á", "x" * 31 + " " + "y" * 32 + " z " + "漢" * 33 + " q", "w" * 5000, *("a".join(every[i : i + 4096]) for i in range(0, len(every), 4096))]
    expected = [one(x) for x in texts]
    for size in (1, 64, 1 << 18):
        monkeypatch.setattr(models, "BYTES_AT_ONCE", size)
        assert models.HashingEmbedder(dimensions).embed_documents(texts) == expected
    assert models.HashingEmbedder(dimensions).embed_documents([]) == []


def test_ready_buckets_go_into_the_table_without_a_shuffle(spark, lake, monkeypatch):
    """The files of a finished write hold one bucket each: they are read and written, and do not become more."""
    files = lambda at: sorted(f for _, _, names in os.walk(at) for f in names if f.endswith(".parquet"))
    with monkeypatch.context() as m:
        m.setattr(lake, "_finish", lambda: None)
        plan(lake).process(spark.createDataFrame([doc(i, f"w{i}") for i in range(40)], DOCUMENT))
    ready = files(f"{lake.path}-ready")
    spark.sparkContext.setJobGroup("ready", "")
    try:
        lake._finish()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    jobs = track.getJobIdsForGroup("ready")
    assert jobs and all(len(track.getJobInfo(j).stageIds) == 1 for j in jobs)
    assert len(ready) >= 2 and len(files(lake.path)) <= len(ready)
    assert sorted(r["text"] for r in lake.chunks().collect()) == sorted(f"T w{i}" for i in range(40))
