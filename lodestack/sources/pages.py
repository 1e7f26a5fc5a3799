"""Paged artifacts of code hosts: jobs, pages landed as JSON files, and their normal form.

Pages lie at ``<repo with / as __>/<kind>/<page>.json``, each a JSON array (a single object
for readmes), oldest change first. One job is one repository and kind; a page shorter than the page
size ends it, measured before any row is filtered. ``PagedSource`` reads them (see ``connectors``),
from mounted folders or any file system that Arrow opens by its address.

``catalogue`` keeps a small table beside the pages: size, time, number of items and latest change of
each. A reader with a lower bound skips the pages that the table knows to be older; a file
that has changed since is not the file the table knows, and is opened. A stream sees the pages in the table.

A missing page between others is an error. A page that is not JSON is handed on as it is, as one item, by
batch and stream alike, and counts as full if another follows; ``set_aside`` tells such items, and those without a
usable number, from documents.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from datetime import UTC, datetime, timedelta

from pyarrow import dataset as arrow_dataset
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decode_base64
from ..schema import document_id
from .connectors import ALWAYS, RAW, Connector, ConnectorSource, Item, Job, Page, connects, utc

FETCHED = ("readme", "issue", "pr")
ITEM = "number long, title string, body string, html_url string, user struct<login:string>, labels array<string>, created_at string, updated_at string, state string, comments long, draft boolean, content string"
CATALOGUE = "page-catalogue"
PAGES_A_TASK = 500
#: Characters of a string that ``get_json_object`` reads.
LONGEST_STRING = 20_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
__all__ = ["RAW", "PagedConnector", "PagedSource", "catalogue", "discover", "golden", "jobs", "land", "normalize", "set_aside"]


def discover(spark: SparkSession, repos: list[str], since: datetime | None = None) -> DataFrame:
    """One job for each repository and kind: readme, issue, pr in this order."""
    return jobs(spark.createDataFrame([(r,) for r in repos], "repo string"), since)


def jobs(repos: DataFrame, since: datetime | None = None) -> DataFrame:
    """The jobs of a table of repositories."""
    each = repos.select("repo", F.posexplode(F.array(*map(F.lit, FETCHED))).alias("_turn", "kind"))
    return each.select(F.concat(F.lit("github:"), "repo").alias("source_id"), F.lit("github").alias("source_type"), "repo", "kind", F.lit(None).cast("string").alias("cursor"), F.lit(since).cast("timestamp").alias("since"))


def following(count: int, page: int, page_size: int) -> str | None:
    """The cursor after a page of ``count`` items: the next page's number, None where the page is not full."""
    return str(page + 1) if count >= page_size else None


def cursor_after(count: Column, page: Column, page_size: int) -> Column:
    """The same rule over columns: the cursor that follows a page of ``count`` items."""
    return F.when(count >= page_size, (page + 1).cast("string"))


def without_change_requests(raw: DataFrame) -> DataFrame:
    """Raw items less the issues that are change requests."""
    marked = F.array_contains(F.json_object_keys("item"), "pull_request")
    return raw.where((F.col("kind") != "issue") | ~F.coalesce(marked, F.lit(False)))


def timestamp(text: Column) -> Column:
    """ISO timestamps; empty and malformed ones are null."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def open_root(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return arrow_fs.FileSystem.from_uri(root) if ":/" in root else (arrow_fs.LocalFileSystem(), root)


def _changed(item: object) -> datetime:
    """When an item changed; ``ALWAYS`` where that cannot be read."""
    try:
        return utc(datetime.fromisoformat(item["updated_at"]))
    except (KeyError, TypeError, ValueError):
        return ALWAYS


class PagedConnector(Connector):
    """Landed pages of a code host; options path, repos (comma-separated), page_size."""

    source_type = "github"

    def __init__(self, options: Mapping[str, str]):
        super().__init__(options)
        self.root, self.size = options["path"].rstrip("/"), int(options.get("page_size", "100"))
        self.repos = [r for r in options.get("repos", "").split(",") if r]

    def _folder(self, job: Job) -> str:
        return f"{job.repo.replace('/', '__')}/{job.kind}"

    def _landed(self, job: Job) -> list[tuple[int, int, int]]:
        """(page, bytes, time in ms) of a job's files, in order; a gap between them is an error."""
        fs, base = open_root(self.root)
        infos = fs.get_file_info(arrow_fs.FileSelector(f"{base}/{self._folder(job)}", allow_not_found=True))
        names = [(os.path.splitext(os.path.basename(i.path)), i) for i in infos]
        found = sorted((int(stem), i.size or 0, i.mtime_ns // 1_000_000) for (stem, end), i in names if end == ".json" and stem.isdecimal())
        if [n for n, *_ in found] != list(range(1, len(found) + 1)):
            gap = min(set(range(1, found[-1][0] + 1)) - {n for n, *_ in found})
            raise ValueError(f"page {gap} of {job.repo} {job.kind} is missing, page {found[-1][0]} is there")
        return found

    def _known(self, wanted: Sequence[Job]) -> dict[tuple[str, str], dict[int, tuple]]:
        """Rows of the catalogue by folder and page: (time, bytes, items, newest), of the file seen last."""
        fs, base = open_root(self.root)
        if fs.get_file_info(f"{base}/{CATALOGUE}").type == arrow_fs.FileType.NotFound:
            return {}
        field = arrow_dataset.field
        some = field("repo").isin([j.repo for j in wanted]) & field("kind").isin([j.kind for j in wanted])
        rows = arrow_dataset.dataset(f"{base}/{CATALOGUE}", filesystem=fs, format="parquet").to_table(filter=some)
        out: dict[tuple[str, str], dict[int, tuple]] = {}
        for r in rows.to_pylist():
            pages, entry = out.setdefault((r["repo"], r["kind"]), {}), (r["modified"], r["bytes"], r["items"], EPOCH + timedelta(microseconds=r["newest"]))
            pages[r["page"]] = max(entry, pages.get(r["page"], entry))
        return out

    def discover(self) -> list[Job]:
        return [Job(self.source_type, r, k) for r in self.repos for k in FETCHED]

    def _open(self, job: Job, number: int) -> tuple[list[object], bool]:
        """The values of a landed page and whether it is JSON; no values where there is no such file."""
        fs, base = open_root(self.root)
        try:
            with fs.open_input_stream(f"{base}/{self._folder(job)}/{number}.json") as file:
                text = file.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return [], True
        try:
            found = json.loads(text)
        except ValueError:
            return [text], False
        return found if isinstance(found, list) else [found], True

    def _items(self, job: Job, values: list[object], sound: bool) -> list[Item]:
        if not sound:
            return [(values[0], ALWAYS)]
        kept = [x for x in values if job.kind != "issue" or not isinstance(x, dict) or "pull_request" not in x]
        return [(json.dumps(x), ALWAYS if job.kind == "readme" else _changed(x)) for x in kept]

    def fetch(self, job: Job) -> tuple[list[Item], Job | None]:
        if job.kind not in FETCHED:
            raise ValueError(f"cannot fetch {job.kind}")
        number = int(job.cursor or 1)
        values, sound = self._open(job, number)
        if job.kind == "readme":
            return self._items(job, values[:1], sound), None
        after = following(len(values) if sound else self.size, number, self.size)
        return self._items(job, values, sound), Job(job.source_type, job.repo, job.kind, after, job.since) if after else None

    def read(self, job: Job) -> Iterator[tuple[int, Item]]:
        landed = self._landed(job)[int(job.cursor or 1) - 1 :]
        known = self._known([job]).get((job.repo, job.kind), {}) if job.since and job.kind != "readme" else {}
        for number, size, modified in landed:
            entry = known.get(number)
            if entry and entry[:2] == (modified, size) and entry[3] < job.since:
                if entry[2] < self.size:
                    return
                continue
            items, after = self.fetch(Job(job.source_type, job.repo, job.kind, str(number), job.since))
            for item in items:
                yield number, item
            if after is None:
                return

    def split(self, job: Job) -> tuple[list[tuple[int, ...]], Job | None]:
        """Pages that the catalogue knows, less those older than ``since``, in groups; from the first other page on, the end of the job is not known."""
        if job.kind == "readme":
            return [], job
        known, wanted, rest = self._known([job]).get((job.repo, job.kind), {}), [], None
        for number, size, modified in self._landed(job):
            entry = known.get(number)
            if not entry or entry[:2] != (modified, size):
                rest = replace(job, cursor=str(number))
                break
            if not job.since or entry[3] >= job.since:
                wanted.append(number)
            if entry[2] is not None and entry[2] < self.size:
                break
        return [tuple(wanted[i : i + PAGES_A_TASK]) for i in range(0, len(wanted), PAGES_A_TASK)], rest

    def pages(self, jobs: Sequence[Job]) -> dict[Job, list[Page]]:
        known, out = self._known(jobs), {}
        for job in jobs:
            held = known.get((job.repo, job.kind), {})
            last = max(held, default=0)
            # A torn page (no items counted) is passed over once another follows, and not before.
            full = lambda n, items, last=last: self.size if items is None and n < last else items or 0
            there = [Page(n, full(n, held[n][2]), held[n][3]) for n in range(1, last + 1) if n in held]
            out[job] = [p for i, p in enumerate(there) if p.number == i + 1 and (job.kind != "readme" or i == 0)]
        return out

    def items(self, job: Job, number: int, first: int, last: int) -> list[Item]:
        values, sound = self._open(job, number)
        if not sound:
            return self._items(job, values, sound) if first == 0 else []
        if len(values) < max(first, last):
            raise ValueError(f"page {number} of {job.repo} {job.kind} has lost items")
        return self._items(job, values[first : len(values) if last < 0 else last], sound)

    @staticmethod
    def normalize(raw: DataFrame, since: datetime | None = None) -> DataFrame:
        return normalize(raw, since)


@connects
class PagedSource(ConnectorSource):
    """``paged``: options path, repos, page_size; for streams also pages_a_task."""

    connector = PagedConnector
    format_name = "paged"


def catalogue(spark: SparkSession, root: str) -> int:
    """Note the pages landed since the last call in the table beside them; how many there were.

    Files not younger than the youngest noted one are not read again. One caller at a time.
    """
    root = root.rstrip("/")
    at = f"{root}/{CATALOGUE}"
    files = spark.read.format("binaryFile").load(f"{root}/*/*/*.json")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    old = None
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(at)
        files = files.where(F.col("modificationTime") >= F.lit(old.agg(F.max("modified_at")).first()[0]))
    part = lambda n: F.regexp_extract("path", r"([^/]+)/([^/]+)/([0-9]+)\.json$", n)
    text = F.trim(F.decode("content", "UTF-8"))
    values = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(F.get_json_object(text, "$").startswith("{"), F.array(text))
    changed = F.array_max(F.transform("v", lambda x: F.coalesce(timestamp(F.get_json_object(x, "$.updated_at")), F.lit(ALWAYS))))
    cut = files.select(F.replace(F.url_decode(part(1)), F.lit("__"), F.lit("/")).alias("repo"), part(2).alias("kind"), part(3).cast("int").alias("page"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"), values.alias("v")).where("page is not null")
    rows = cut.select("repo", "kind", "page", "bytes", F.unix_millis("modified_at").alias("modified"), "modified_at", F.when(F.col("v").isNotNull(), F.size("v")).alias("items"), F.unix_micros(F.coalesce(changed, F.lit(ALWAYS))).alias("newest"))
    if old is not None:
        rows = rows.join(old.select("repo", "kind", "page", "bytes", "modified"), ["repo", "kind", "page", "bytes", "modified"], "left_anti")
    before = 0 if old is None else old.count()
    rows.repartitionByRange("repo", "kind").sortWithinPartitions("repo", "kind", "page").write.mode("append").parquet(at)
    return spark.read.parquet(at).count() - before


def land(rows: DataFrame, root: str, page_size: int = 100) -> None:
    """Write raw rows (repo, kind, item, seen) as pages under ``root``, oldest change first; the file of a page appears whole.

    Ranks are counted by day first, so a job of any size is sorted by days. Where ``root`` has pages, equal numbers are overwritten.
    """
    root = root.rstrip("/")
    job, day = ["repo", "kind"], F.coalesce(F.to_date("seen"), F.lit("9000-01-01").cast("date")).alias("day")
    dated = rows.select(*job, "item", "seen", day)
    before = Window.partitionBy(*job).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dated.groupBy(*job, "day").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(*job, "day").orderBy("seen", "item"))
    paged = dated.withColumn("place", place).join(sizes, [*job, "day"]).withColumn("at", F.col("before") + F.col("place") - 1)
    page = paged.groupBy(*job, (F.floor(F.col("at") / page_size) + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("rows"))
    whole = page.select(*job, "page", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["item"]), ","), F.lit("]")).alias("text"))

    def write(part: Iterator[Row]) -> None:
        fs, base = open_root(root)
        for row in part:
            folder = f"{base}/{row['repo'].replace('/', '__')}/{row['kind']}"
            fs.create_dir(folder, recursive=True)
            held = f"{folder}/{row['page']}.{os.getpid()}.tmp"
            with fs.open_output_stream(held) as file:
                file.write(row["text"].encode())
            fs.move(held, f"{folder}/{row['page']}.json")

    whole.foreachPartition(write)


def usable(kind: Column, item: Column) -> Column:
    """Whether an item can be a document: a JSON object, and a number unless it is a readme.

    Only an object has a number, so one reading decides; items that may hold a string too long for the other reader are read by both.
    """
    number, whole = F.from_json(item, "number long", {"allowNonNumericNumbers": "false"})["number"], F.get_json_object(item, "$").startswith("{")
    numbered = number.isNotNull() & ((F.octet_length(item) <= LONGEST_STRING) | whole)
    return F.coalesce(F.when(kind == "readme", whole).otherwise(numbered), F.lit(False))


def set_aside(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows that can be documents, and the others."""
    good = usable(F.col("kind"), F.col("item"))
    return raw.where(good), raw.where(~good)


def normalize(raw: DataFrame, since: datetime | None = None) -> DataFrame:
    """Documents of raw items (repo, kind, item as JSON). An item without a number fails the job: see ``set_aside``.

    Labels are the names of label objects; labels that are plain text are not.
    With ``since``, change requests updated before it go; those without a time stay.
    """
    names = F.from_json(F.get_json_object("item", "$.labels"), "array<string>")
    names = F.transform(names, lambda x: F.get_json_object(x, "$.name"))
    x = F.from_json("item", ITEM.replace("labels array<string>, ", ""))
    rows = raw.withColumns({"x": x, "names": F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull())})
    readme = F.col("kind") == "readme"
    external = F.when(readme, F.lit("readme")).otherwise(F.coalesce(F.col("x.number").cast("string"), F.raise_error(F.concat(F.lit("an item without a number: "), F.substring("item", 1, 200)))))
    content = decode_base64(F.coalesce("x.content", F.lit("")))
    text = lambda c: F.coalesce(c, F.lit(""))
    extra = F.when(F.col("kind") == "issue", F.to_variant_object(F.struct("x.state", "x.comments"))).when(F.col("kind") == "pr", F.to_variant_object(F.struct("x.state", "x.draft")))
    out = rows.select(
        document_id(F.lit("github"), F.col("repo"), F.col("kind"), external).alias("id"), F.lit("github").alias("source_type"),
        F.when(readme, F.concat("repo", F.lit("#readme"))).otherwise(F.concat("repo", F.lit("#"), external)).alias("external_id"), "kind", "repo",
        F.when(readme, F.concat("repo", F.lit(" README"))).otherwise(text(F.col("x.title"))).alias("title"), F.when(readme, content).otherwise(text(F.col("x.body"))).alias("body"),
        text(F.col("x.html_url")).alias("url"), F.col("x.user.login").alias("author"), timestamp(F.col("x.created_at")).alias("created_at"), timestamp(F.col("x.updated_at")).alias("updated_at"),
        F.col("names").alias("labels"), extra.alias("metadata"),
    )
    if since is None:
        return out
    return out.where((F.col("kind") == "readme") | F.col("updated_at").isNull() | (F.col("updated_at") >= F.lit(since)))


def golden(spark: SparkSession, folder: str) -> DataFrame:
    """Expected names by artifact, in order of file name; the name defaults to the file's stem."""
    kind = "name string, source_type string, kind string, repo string, external_id string, url string, title string, labels array<string>, body string, golden struct<entities:array<string>,relationship_targets:array<string>>"
    rows = spark.read.schema(kind).json(f"{folder}/*.json", multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("name", F.coalesce("name", F.regexp_replace("file", "\\.json$", ""))).orderBy("file").drop("file")
