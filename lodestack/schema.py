"""Row types of the lake and the identifiers of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_TYPES = ("github", "jira", "web")
KINDS = ("issue", "pr", "readme", "discussion", "comment", "page")
ENTITIES = "array<struct<type:string,name:string>>"
RELATIONSHIPS = "array<struct<type:string,target:string,description:string>>"
SEMANTIC = f"struct<summary:string,entities:{ENTITIES},topics:array<string>,relationships:{RELATIONSHIPS}>"
DOCUMENT = (
    "id string, source_type string, external_id string, kind string, repo string, title string, body string, url string, author string, "
    f"created_at timestamp, updated_at timestamp, labels array<string>, metadata variant, semantic {SEMANTIC}"
)
CHUNK_TYPES = {
    "chunk_id": "string", "document_id": "string", "chunk_index": "int", "text": "string", "vector": "array<float>", "source_type": "string", "kind": "string", "repo": "string", "title": "string",
    "url": "string", "author": "string", "created_at": "timestamp", "updated_at": "timestamp", "labels": "array<string>", "summary": "string", "entities": ENTITIES, "entity_names": "array<string>",
    "entity_types": "array<string>", "topics": "array<string>", "relationships": RELATIONSHIPS, "relationship_targets": "array<string>", "relationship_types": "array<string>",
}
CHUNK = ", ".join(f"{name} {kind}" for name, kind in CHUNK_TYPES.items())
RESULT = ("chunk_id", "document_id", "score", "text", "title", "url", "source_type", "kind", "repo", "summary", "entities", "topics", "relationships")


def document_id(source: Column, repo: Column, kind: Column, external: Column) -> Column:
    """``source:repo:kind:external``; a null part counts as empty."""
    return F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in (source, repo, kind, external)])


def chunk_id(document: Column, index: Column) -> Column:
    """``document#index``."""
    return F.concat(document, F.lit("#"), index.cast("string"))
