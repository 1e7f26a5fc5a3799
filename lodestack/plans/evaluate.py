"""Recall of extracted metadata against golden names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import missed, recall
from ..functions.models import SemanticIndexer
from ..schema import SEMANTIC, document_id


def golden_documents(golden: DataFrame) -> DataFrame:
    """Documents of golden rows."""
    ids = document_id(F.col("source_type"), F.col("repo"), F.col("kind"), F.col("external_id"))
    return golden.withColumns({"id": ids, "body": F.coalesce("body", F.lit("")), "title": F.coalesce("title", F.lit("")), "semantic": F.lit(None).cast(SEMANTIC)})


def score(rows: DataFrame) -> DataFrame:
    """Recall, what was found and what was missed for rows (name, semantic, golden), and their template where it is known."""
    found = {"entities": F.transform("semantic.entities", lambda e: e["name"]), "relationship_targets": F.transform("semantic.relationships", lambda r: r["target"])}
    out = [F.col(c) for c in ("name", "template") if c in rows.columns]
    for part, names in found.items():
        want = F.col(f"golden.{part}")
        out += [recall(names, want).alias(f"{part}_recall"), missed(names, want).alias(f"{part}_missed"), F.coalesce(names, F.array().cast("array<string>")).alias(f"{part}_found")]
    return rows.select(*out)


def evaluate(golden: DataFrame, indexer: SemanticIndexer, name_contains: str | None = None) -> DataFrame:
    rows = golden if name_contains is None else golden.where(F.col("name").contains(name_contains))
    docs = golden_documents(rows).withColumn("template", indexer.registry.select_name(F.col("source_type"), F.col("kind")))
    return score(indexer.extract(docs))


def mean_recall(scores: DataFrame) -> DataFrame:
    """Means over the rows that have something to find, to three places."""
    return scores.agg(*[F.round(F.avg(c), 3).alias(c) for c in ("entities_recall", "relationship_targets_recall")])
