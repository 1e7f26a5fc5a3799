"""Metadata filters as Column predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = ("document_id", "source_type", "kind", "repo", "author")
ARRAYS = ("labels", "entity_names", "entity_types", "topics", "relationship_targets", "relationship_types")


def predicate(filters: dict[str, Any] | None) -> Column | None:
    """All conditions together; None without any.

    A value must equal the field, or be among a list field's values; of a list
    value one must. An empty list matches nothing, null matches nothing.
    """
    if unknown := sorted(set(filters or {}) - {*SCALARS, *ARRAYS}):
        raise ValueError(f"not filterable: {', '.join(unknown)}")
    return reduce(lambda a, b: a & b, [_one(k, v) for k, v in filters.items()]) if filters else None


def _one(name: str, value: Any) -> Column:
    if isinstance(value, list):
        if not value:
            return F.lit(False)
        return F.col(name).isin(value) if name in SCALARS else F.arrays_overlap(F.col(name), F.array(*map(F.lit, value)))
    if value is None:
        return F.lit(False)
    return F.col(name) == F.lit(value) if name in SCALARS else F.array_contains(F.col(name), F.lit(value))
