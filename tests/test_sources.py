"""Connectors: pages of code hosts and web pages, pushed-down marks, cursors, what is no document."""

import base64
import json
import os
import tempfile
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from lodestack.functions import models
from lodestack.plans.lake import ContextLake, IngestionPlan
from lodestack.sources import connectors, pages, web
from lodestack.streaming import ingest as streaming

OPTIONS = {"repos": "o/r,none/here", "page_size": "2"}


def put(root, kind, page, value, repo="o__r"):
    os.makedirs(f"{root}/{repo}/{kind}", exist_ok=True)
    with open(f"{root}/{repo}/{kind}/{page}.json", "w") as file:
        file.write(value if isinstance(value, str) else json.dumps(value))


def item(n, **more):
    made = {"number": n, "title": f"t{n}", "body": None, "html_url": "u", "user": {"login": "ann"}, "labels": [{"name": "bug"}, "plain"], "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-02-01T00:00:00Z", "state": "open"}
    return made | more


@pytest.fixture()
def root():
    made = tempfile.mkdtemp()
    put(made, "readme", 1, {"content": base64.b64encode("héllo\nworld".encode()).decode(), "html_url": "u"})
    put(made, "issue", 1, [item(1, comments=2), item(2, pull_request={"url": "x"})])
    put(made, "issue", 2, [item(3, comments=0)])
    put(made, "pr", 1, [item(4, draft=True), item(5, draft=False, updated_at=None)])
    put(made, "pr", 2, [])
    return made


@pytest.fixture()
def lake(spark):
    return ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=4)


def plan(lake):
    return IngestionPlan(lake, embedder=lambda: models.HashingEmbedder(32), size=6, overlap=2)


def held(lake):
    return {r["document_id"].rpartition(":")[2] for r in lake.chunks().select("document_id").collect()}


class Opening(pages.PagedConnector):
    """Notes the pages that are opened."""

    def __init__(self, options):
        super().__init__(options)
        self.opened = []

    def _open(self, job, number):
        self.opened.append((job.kind, number))
        return super()._open(job, number)


def test_normal_form(spark, root):
    raw = connectors.read(spark, "github", OPTIONS | {"path": root})
    docs = {r["external_id"]: r for r in pages.normalize(raw).collect()}
    assert sorted(docs) == ["o/r#1", "o/r#3", "o/r#4", "o/r#5", "o/r#readme"]
    assert docs["o/r#readme"]["body"] == "héllo\nworld" and docs["o/r#1"]["labels"] == ["bug"] and docs["o/r#1"]["metadata"].toPython() == {"state": "open", "comments": 2} and docs["o/r#4"]["metadata"].toPython() == {"state": "open", "draft": True}
    assert docs["o/r#5"]["id"] == "github:o/r:pr:5" and docs["o/r#4"]["author"] == "ann"
    fresh = pages.normalize(raw.where("kind = 'pr'"), datetime(2024, 3, 1)).collect()
    assert [r["external_id"] for r in fresh] == ["o/r#5"]
    assert [(r["repo"], r["kind"]) for r in pages.discover(spark, ["o/r"]).collect()] == [("o/r", "readme"), ("o/r", "issue"), ("o/r", "pr")]


def test_kinds_of_sources():
    assert connectors.source_for("github") is pages.PagedSource and connectors.source_for("web") is web.WebSource
    with pytest.raises(ValueError, match="no connector for jira"):
        connectors.source_for("jira")
    with pytest.raises(ValueError):
        pages.PagedConnector({"path": "/none"}).fetch(connectors.Job("github", "o/r", "discussion"))
    job = connectors.Job("github", "o/r", "pr", "3")
    assert job.source_id == "github:o/r"


def test_cursors(root):
    own = pages.PagedConnector(OPTIONS | {"path": root})
    first, after = own.fetch(connectors.Job("github", "o/r", "issue"))
    assert [json.loads(x)["number"] for x, _ in first] == [1] and after.cursor == "2"
    second, end = own.fetch(after)
    assert [json.loads(x)["number"] for x, _ in second] == [3] and end is None
    assert own.fetch(connectors.Job("github", "o/r", "issue", "9")) == ([], None)


def test_unreadable_pages(root):
    own = pages.PagedConnector(OPTIONS | {"path": root})
    os.mkdir(f"{root}/o__r/pr/3.json")
    with pytest.raises(OSError):
        own.fetch(connectors.Job("github", "o/r", "pr", "3"))
    with pytest.raises(ValueError):
        pages.PagedConnector({"path": "nofs://in/pages"}).fetch(connectors.Job("github", "o/r", "pr"))
    put(root, "issue", 4, [item(9)])
    with pytest.raises(ValueError, match="page 3 of o/r issue is missing"):
        list(own.read(connectors.Job("github", "o/r", "issue")))
    assert [n for n, _ in pages.PagedConnector({"path": f"file://{root}", "page_size": "2"}).read(connectors.Job("github", "o/r", "readme"))] == [1]


def dated(root, months):
    """A full page of issues for each month."""
    for page, month in enumerate(months, 1):
        put(root, "issue", page, [item(page * 10 + i, updated_at=f"2024-{month:02d}-0{i + 1}T00:00:00Z") for i in range(2)])


def test_a_mark_opens_the_last_pages_only(spark):
    root, since = tempfile.mkdtemp(), datetime(2024, 4, 2, tzinfo=UTC)
    dated(root, [1, 2, 3, 4, 5])
    put(root, "pr", 1, [item(7, updated_at="2023-01-01T00:00:00Z"), item(8, updated_at=None)])
    assert pages.catalogue(spark, root) == 6 and pages.catalogue(spark, root) == 0
    own = Opening(OPTIONS | {"path": root})
    reader = connectors.ConnectorReader(own)
    asked = [GreaterThanOrEqual(("seen",), since), In(("kind",), ("issue", "pr")), EqualTo(("repo",), "o/r")]
    assert list(reader.pushFilters(asked)) == asked and [(j.kind, j.since) for j in reader.partitions()] == [("issue", since), ("pr", since)]
    rows = [r for job in reader.partitions() for r in reader.read(job)]
    assert own.opened == [("issue", 4), ("issue", 5), ("pr", 1)]
    found = connectors.read(spark, "github", OPTIONS | {"path": root}, since)
    numbers = lambda items: sorted(json.loads(x)["number"] for x in items)
    assert numbers(r["item"] for r in found.collect()) == numbers(r[3] for r in rows if r[4] >= since) == [8, 41, 50, 51]
    above = connectors.read(spark, "github", OPTIONS | {"path": root}).where(F.col("seen") >= F.lit(since))
    assert sorted(map(tuple, above.collect())) == sorted(map(tuple, found.collect()))


def test_a_page_that_changed_is_opened(spark):
    root, since = tempfile.mkdtemp(), datetime(2024, 4, 1, tzinfo=UTC)
    dated(root, [1, 2, 3])
    put(root, "issue", 4, [item(99, updated_at="2024-01-09T00:00:00Z")])
    pages.catalogue(spark, root)
    put(root, "issue", 1, [item(10, updated_at="2024-06-01T00:00:00Z"), item(11)])
    own = Opening(OPTIONS | {"path": root})
    rows = [x for _, x in own.read(connectors.Job("github", "o/r", "issue", since=since))]
    assert own.opened == [("issue", 1)] and len(rows) == 2  # the short page 4 ends the job unopened
    assert pages.catalogue(spark, root) >= 1
    own = Opening(OPTIONS | {"path": root})
    assert [n for n, _ in own.read(connectors.Job("github", "o/r", "issue", since=datetime(2025, 1, 1, tzinfo=UTC)))] == [] and own.opened == []


def follow(spark, root, checkpoint, **more):
    got = []
    stream = connectors.follow(spark, "github", OPTIONS | {"path": root, "pages_a_task": 1} | more)
    stream.writeStream.foreachBatch(lambda df, i: got.extend((r["page"], json.loads(r["item"])["number"]) for r in df.where("kind = 'issue'").collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(got)


def test_a_stream_goes_on_where_it_stopped(spark):
    root, checkpoint = tempfile.mkdtemp(), tempfile.mkdtemp()
    dated(root, [1, 2])
    assert follow(spark, root, checkpoint) == []  # nothing is noted yet
    pages.catalogue(spark, root)
    assert follow(spark, root, checkpoint) == [(1, 10), (1, 11), (2, 20), (2, 21)] and follow(spark, root, checkpoint) == []
    put(root, "issue", 3, [item(30)])
    pages.catalogue(spark, root)
    assert follow(spark, root, checkpoint) == [(3, 30)]  # the restart reads the next page, no earlier one
    put(root, "issue", 3, [item(30), item(31)])
    put(root, "issue", 4, [item(40), item(41, pull_request={})])
    put(root, "issue", 5, [item(50)])
    put(root, "issue", 6, [item(60)])  # behind the end of the job
    pages.catalogue(spark, root)
    assert follow(spark, root, checkpoint) == [(3, 31), (4, 40), (5, 50)]


def test_stream_tasks():
    class Known(pages.PagedConnector):
        def pages(self, jobs):
            return {j: [connectors.Page(n, 2) for n in range(1, 8)] + [connectors.Page(8, 1)] for j in jobs if j.kind == "pr"}

    stream = connectors.ConnectorStream(Known({"path": "/none", "repos": "o/r", "page_size": "2", "pages_a_task": "3"}))
    start, end = stream.initialOffset(), stream.latestOffset()
    assert start["o/r|pr"] == {"page": 1, "item": 0} and end == start | {"o/r|pr": {"page": 8, "item": 1}}
    assert [[p for p, *_ in s.parts] for s in stream.partitions(start, end)] == [[1, 2, 3], [4, 5, 6], [7, 8]]
    assert stream.partitions({"o/r|pr": {"page": 7, "item": 1}}, end)[0].parts == ((7, 1, -1), (8, 0, 1)) and stream.partitions(end, end) == []


def test_scheduled_runs(spark, lake, root):
    mark = tempfile.mkdtemp() + "/mark.json"
    streaming.run_once(spark, root, mark, plan(lake), ["o/r"], 2)
    assert held(lake) == {"readme", "1", "3", "4", "5"}
    began = streaming.read_watermark(spark, mark)
    for n in (1, 3, 4):
        lake.delete_by_document(f"github:o/r:{'pr' if n == 4 else 'issue'}:{n}")
    assert streaming.run_once(spark, root, mark, plan(lake), ["o/r"], 2) > began
    assert held(lake) == {"readme", "5"}  # older than the mark: not fetched again


BAD = [item(None), item("n7"), {"title": "no number"}, "text", 5, [1], None, item(70)]


@pytest.mark.parametrize("way", ["run", "stream"])
def test_what_is_no_document_is_put_aside_once(spark, lake, root, way):
    """Items that would share one id, or have none, and torn pages: both ways keep them apart and lose no document."""
    put(root, "issue", 1, BAD[:2])
    put(root, "issue", 2, BAD[2:4])
    put(root, "issue", 3, BAD[4:6])
    put(root, "issue", 4, "[{torn")
    put(root, "issue", 5, BAD[6:])
    pages.catalogue(spark, root)
    mark, checkpoint = tempfile.mkdtemp() + "/mark.json", tempfile.mkdtemp()
    for _ in range(2):
        if way == "run":
            streaming.run_once(spark, root, mark, plan(lake), ["o/r"], 2)
            os.remove(mark)  # as if the run had failed at its end: it is repeated as the same batch
        else:
            streaming.ingest_stream(streaming.stream_pages(spark, root, ["o/r"], 2), plan(lake), checkpoint).awaitTermination()
    assert held(lake) == {"readme", "70", "4", "5"}
    aside = Counter(r["item"] for r in spark.read.json(f"{lake.path}-dead-letters").collect())
    assert aside == Counter([json.dumps(x) for x in BAD[:7]] + ["[{torn"])


def test_a_repeated_batch_adds_nothing(spark, lake, root):
    put(root, "pr", 2, [{"title": "no number"}])
    pages.catalogue(spark, root)
    raw = connectors.read(spark, "github", OPTIONS | {"path": root})
    for _ in range(2):
        streaming._ingest(raw, plan(lake), None, "3")
    assert spark.read.json(f"{lake.path}-dead-letters").count() == 1 and held(lake) == {"readme", "1", "3", "4", "5"}


def test_items_without_numbers_fail_by_themselves(spark):
    raw = spark.createDataFrame([("o/r", "issue", json.dumps(x)) for x in BAD] + [("o/r", "readme", "{}"), (None, None, None)], "repo string, kind string, item string")
    good, bad = pages.set_aside(raw)
    assert good.count() == 2 and bad.count() == 8
    assert sorted(r["id"] for r in pages.normalize(good).collect()) == ["github:o/r:issue:70", "github:o/r:readme:readme"]
    with pytest.raises(Exception, match="an item without a number"):
        pages.normalize(raw.where("item like '%no number%'")).collect()


def test_landed_pages(spark):
    root = tempfile.mkdtemp()
    rows = [("o/r", "issue", json.dumps(item(n, updated_at=f"2024-01-{n % 9 + 1:02d}T{n % 24:02d}:00:00Z")), datetime(2024, 1, n % 9 + 1, n % 24)) for n in range(23)] + [("p/q", "pr", json.dumps(item(1)), None)]
    pages.land(spark.createDataFrame(rows, "repo string, kind string, item string, seen timestamp").repartition(4), root, 5)
    assert sorted(os.listdir(f"{root}/o__r/issue")) == [f"{n}.json" for n in range(1, 6)]
    read = [[x["updated_at"] for x in json.load(open(f"{root}/o__r/issue/{n}.json"))] for n in range(1, 6)]
    assert [len(x) for x in read] == [5, 5, 5, 5, 3] and sum(read, []) == sorted(sum(read, []))
    found = connectors.read(spark, "github", {"path": root, "repos": "o/r,p/q", "page_size": 5})
    assert sorted(r["item"] for r in found.collect()) == sorted(r[2] for r in rows)


def test_web_pages(spark):
    html = '<html><head><title>A &amp; <b>B</b>\n</title><style>p{}</style><SCRIPT>var x="<p>";</SCRIPT ></head><body><!-- no -->x&lt;1&nbsp;&amp;lt;<p>two\t words</p></body></html>'
    rows = [(1, "HTTPS://Ex.org:80/a?b", html), (2, None, None), (3, "ftp://x/y", "plain"), (4, "no scheme", ""), (5, "http://ex.org", "<p>" + "long " * 100_000)]
    at = tempfile.mkdtemp() + "/pages"
    spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, page int, kind string").repartition(3).write.parquet(at)
    found = {r["external_id"]: r for r in web.normalize(connectors.read(spark, "web", {"path": at})).collect()}
    assert sorted(found) == ["#2", "#4", "ex.org#1", "ex.org#5", "x#3"]
    one = found["ex.org#1"]
    assert (one["id"], one["title"], one["body"], one["kind"]) == ("web:ex.org:page:1", "A & B", "x<1 &lt; two words", "page") and found["#2"]["body"] == "" and len(found["ex.org#5"]["body"]) == 499_999
    same = web.normalize(web.raw(spark.read.parquet(at)))
    assert sorted(map(str, same.drop("metadata").collect())) == sorted(map(str, web.normalize(connectors.read(spark, "web", {"path": at})).drop("metadata").collect()))
    assert len(web.WebConnector({"path": at}).discover()) >= 3
    with pytest.raises(Exception, match="a page without an id"):
        web.normalize(web.raw(spark.createDataFrame([(None, "u", "h")], "page_id long, url string, html string"))).collect()


def test_known_pages_of_a_job_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGES_A_TASK", 3)
    root = tempfile.mkdtemp()
    rows = spark.range(95).selectExpr("'o/r' as repo", "'pr' as kind", "to_json(struct(id as number, date_format(timestamp_seconds(1700000000 + id * 86400), \"yyyy-MM-dd'T'HH:mm:ssXXX\") as updated_at)) as item", "timestamp_seconds(1700000000 + id * 86400) as seen")
    pages.land(rows, root, 10)
    pages.catalogue(spark, root)
    connector = pages.PagedConnector({"path": root, "repos": "o/r", "page_size": "10"})
    job = connectors.Job("github", "o/r", "pr")
    assert connector.split(job) == ([(1, 2, 3), (4, 5, 6), (7, 8, 9), (10,)], None)
    since = datetime.fromtimestamp(1700000000 + 55 * 86400, UTC)
    options = {"path": root, "repos": "o/r", "page_size": 10}
    numbers = lambda df: sorted(int(x) for (x,) in df.selectExpr("get_json_object(item, '$.number')").collect())
    assert numbers(connectors.read(spark, "github", options)) == list(range(95))
    assert numbers(connectors.read(spark, "github", options, since)) == list(range(55, 95))
    with open(f"{root}/o__r/pr/8.json", "a") as file:
        file.write(" ")  # no longer the file that the catalogue knows
    groups, rest = connector.split(job)
    assert groups == [(1, 2, 3), (4, 5, 6), (7,)] and rest.cursor == "8"
    assert numbers(connectors.read(spark, "github", options, since)) == list(range(55, 95))


def test_items_are_judged_once(spark, monkeypatch):
    """A batch is parsed for what can be a document while it is written, not again for each use; odd items are judged as before."""
    seen, original = [], streaming.normalize
    monkeypatch.setattr(streaming, "normalize", lambda good: seen.append(good) or original(good))
    items = ['{"number": 1, "body": "a b"}', '{"number": 2, "body": "c", "x": NaN}', '{"number": 3', '[{"number": 4}]', "{'number': 5, 'body': 'd'}", '{"number": "none"}', "1", None]
    lake = ContextLake(spark, tempfile.mkdtemp() + "/lake", buckets=2)
    streaming._ingest(spark.createDataFrame([("o/r", "issue", x) for x in items] + [("o/r", "readme", "[]"), ("o/r", "readme", '{"content": "ZQ=="}')], "repo string, kind string, item string"), plan(lake), None, "7")
    assert len(seen) == 1 and "from_json" not in (text := seen[0]._jdf.queryExecution().optimizedPlan().toString()) and "get_json_object" not in text
    assert sorted(r["text"] for r in lake.chunks().collect()) == ["a b", "d", "o/r README e"]
    left = spark.read.json(f"{lake.path}-dead-letters")
    assert sorted(left.columns) == ["batch", "item", "kind", "repo"] and left.count() == 7
