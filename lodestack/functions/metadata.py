"""Semantic metadata: parsing model output, flattening, and recall against expected names."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEMANTIC

#: What Python takes for white space.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def extract_json(text: str) -> Any:
    """The JSON value of a reply: the whole of it, or what stands from the first to the last brace."""
    try:
        return json.loads(text.strip())
    except ValueError:
        inner = re.search(r"\{.*\}", text, re.DOTALL)
        if not inner:
            raise ValueError("no JSON object in the reply") from None
        return json.loads(inner[0])


def _strings(value: Any, names: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, str]:
    if not isinstance(value, dict):
        raise TypeError("an object is expected")
    out = {n: value[n] for n in names} | {n: value.get(n, "") for n in optional}
    if not all(isinstance(v, str) for v in out.values()):
        raise TypeError("text is expected")
    return out


def validate(value: Any) -> dict[str, Any]:
    """Metadata with defaults for what is missing at the top; anything of a wrong kind fails as a whole."""
    if not isinstance(value, dict):
        raise TypeError("an object is expected")
    topics, summary = value.get("topics", []), value.get("summary", "")
    lists = [value.get("entities", []), value.get("relationships", []), topics]
    if not isinstance(summary, str) or not all(isinstance(x, list) for x in lists) or not all(isinstance(x, str) for x in topics):
        raise TypeError("a summary, lists and topic names are expected")
    return {
        "summary": summary, "topics": topics, "entities": [_strings(x, ("type", "name")) for x in lists[0]],
        "relationships": [_strings(x, ("type", "target"), ("description",)) for x in lists[1]],
    }


def reply_json(reply: Column) -> Column:
    """The JSON value of a reply as a variant: the whole of it, or what stands from the first to the last brace; null where neither is JSON."""

    def whole(text: Column) -> Column:
        # The parser stops at the end of a value. What is one value in a list and in an object has nothing behind it.
        held = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant")
        return F.when(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull(), held)

    return F.coalesce(whole(F.btrim(reply, F.lit(SPACES))), whole(F.regexp_extract(reply, r"(?s)\{.*\}", 0)))


def parse_metadata(reply: Column) -> Column:
    """Validated metadata of model replies, as ``validate`` has it; null where a reply fails. No Python runs.

    JSON is taken strictly: a reply that repeats a key of an object or holds NaN fails.
    """
    part = lambda v, name, kind="variant": F.try_variant_get(v, f"$.{name}", kind)
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    v = reply_json(reply)

    def items(name: str, sound: Callable[[Column], Column]) -> tuple[Column, Column]:
        """The elements of a list, none if it is missing, and whether all are sound."""
        own, held = part(v, name), part(v, name, "array<variant>")
        listed = F.coalesce(F.schema_of_variant(own).startswith("ARRAY<"), F.lit(False)) & F.coalesce(F.forall(held, lambda x: F.coalesce(sound(x), F.lit(False))), F.lit(False))
        return F.coalesce(held, F.array().cast("array<variant>")), own.isNull() | listed

    texts = lambda x, *names: reduce(lambda a, b: a & b, [is_text(part(x, n)) for n in names])
    entities, good_entities = items("entities", lambda x: is_object(x) & texts(x, "type", "name"))
    edges, good_edges = items("relationships", lambda x: is_object(x) & texts(x, "type", "target") & (part(x, "description").isNull() | is_text(part(x, "description"))))
    topics, good_topics = items("topics", is_text)
    summary = part(v, "summary")
    good = is_object(v) & (summary.isNull() | is_text(summary)) & good_entities & good_edges & good_topics
    text = lambda x, name: part(x, name, "string").alias(name)
    made = F.struct(
        F.coalesce(part(v, "summary", "string"), F.lit("")).alias("summary"), F.transform(entities, lambda x: F.struct(text(x, "type"), text(x, "name"))).alias("entities"),
        F.transform(topics, lambda x: x.cast("string")).alias("topics"),
        F.transform(edges, lambda x: F.struct(text(x, "type"), text(x, "target"), F.coalesce(part(x, "description", "string"), F.lit("")).alias("description"))).alias("relationships"),
    )
    return F.when(good, made).cast(SEMANTIC)


def flatten(entities: Column, relationships: Column) -> dict[str, Column]:
    """The four keyword arrays of the store, in order and with repeats."""
    pick = lambda column, name: F.coalesce(F.transform(column, lambda x: x[name]), F.array().cast("array<string>"))
    return {
        "entity_names": pick(entities, "name"), "entity_types": pick(entities, "type"),
        "relationship_targets": pick(relationships, "target"), "relationship_types": pick(relationships, "type"),
    }


def lowered(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(names, F.array().cast("array<string>")), F.lower)))


def recall(found: Column, expected: Column) -> Column:
    """Share of the expected names that were found, ignoring case; null without any."""
    want = lowered(expected)
    return F.size(F.array_intersect(lowered(found), want)) / F.nullif(F.size(want), F.lit(0))


def missed(found: Column, expected: Column) -> Column:
    return F.array_sort(F.array_except(lowered(expected), lowered(found)))
