"""Web pages as documents: a connector over a Parquet table of pages (page_id, url, html).

A job is one row group, so that a task reads one at a time. Scripts, styles,
comments and tags leave the text, the five named entities and the no-break space are put back, white
space becomes single spaces. The host is the repository, the page's id the number.

Null html is an empty page, a page without a host has an empty repository; a page without an id cannot be
told from others and fails the job, unless ``pages.set_aside`` took it out.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyarrow import dataset as arrow_dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import document_id
from .connectors import ALWAYS, Connector, ConnectorSource, Item, Job, connects
from .pages import open_root

#: The entities that are put back, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def plain(html: Column) -> Column:
    """What a reader sees of HTML, in single spaces."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), r"<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def raw(pages: DataFrame) -> DataFrame:
    """The raw rows that the connector gives, of a table that Spark reads."""
    item = F.to_json(F.struct(F.col("page_id").alias("number"), "url", "html"))
    return pages.select(F.lit("").alias("repo"), F.lit("page").alias("kind"), F.lit(1).alias("page"), item.alias("item"), F.lit(ALWAYS).alias("seen"))


def normalize(rows: DataFrame, since: datetime | None = None) -> DataFrame:
    """Documents of raw pages; they have no time of change, so ``since`` leaves none out."""
    x = F.from_json("item", "number long, url string, html string")
    page = rows.select(x.alias("x"), "item").withColumn("host", F.lower(F.regexp_extract(F.coalesce("x.url", F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1)))
    number = F.coalesce(F.col("x.number").cast("string"), F.raise_error(F.concat(F.lit("a page without an id: "), F.substring("item", 1, 200))))
    html, none = F.coalesce("x.html", F.lit("")), F.lit(None)
    return page.select(
        document_id(F.lit("web"), F.col("host"), F.lit("page"), number).alias("id"), F.lit("web").alias("source_type"), F.concat("host", F.lit("#"), number).alias("external_id"), F.lit("page").alias("kind"),
        F.col("host").alias("repo"), plain(F.regexp_extract(html, TITLE, 1)).alias("title"), plain(html).alias("body"), F.coalesce("x.url", F.lit("")).alias("url"), none.cast("string").alias("author"),
        none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("updated_at"), F.array().cast("array<string>").alias("labels"), none.cast("variant").alias("metadata"),
    )


class WebConnector(Connector):
    """Option path: a Parquet file or folder, or its address."""

    source_type = "web"

    def __init__(self, options: Mapping[str, str]):
        super().__init__(options)
        self.path = options["path"].rstrip("/")

    def _fragments(self) -> list:
        fs, path = open_root(self.path)
        return sorted(arrow_dataset.dataset(path, filesystem=fs, format="parquet").get_fragments(), key=lambda f: f.path)

    def discover(self) -> list[Job]:
        return [Job(self.source_type, f.path, "page", str(g.id + 1)) for f in self._fragments() for g in f.row_groups]

    def fetch(self, job: Job) -> tuple[list[Item], Job | None]:
        found = next(f for f in self._fragments() if f.path == job.repo)
        rows = found.subset(row_group_ids=[int(job.cursor or 1) - 1]).to_table(columns=["page_id", "url", "html"])
        return [(json.dumps({"number": r["page_id"], "url": r["url"], "html": r["html"]}, ensure_ascii=False), ALWAYS) for r in rows.to_pylist()], None

    @staticmethod
    def normalize(raw: DataFrame, since: datetime | None = None) -> DataFrame:
        return normalize(raw, since)


@connects
class WebSource(ConnectorSource):
    """``webpages``: option path."""

    connector = WebConnector
    format_name = "webpages"
