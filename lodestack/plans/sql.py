"""The five retrieval calls as SQL table functions of a session.

``register`` names them over a table of chunks: ``select * from find_related('X', 10)``. Their bodies are SQL, so a call is a
part of the plan around it: a filter or a join on its rows is optimised with it, and a
constant ``k`` becomes a top-k that every task applies to its own rows. (Python table functions see one row or one
partition and no session, so they could search only what one task holds.)

A null or zero ``k`` is the default, -1 is no limit, other negative numbers fail.
``filters`` maps fields to lists of values, of which one must match; an unknown field fails. Hooks
belong to ``ContextTools`` and take no part here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..functions.models import Embedder
from ..operators.filters import ARRAYS, SCALARS
from ..schema import RESULT

ORDER = "document_id, chunk_index"


def _limit(name: str, default: int) -> str:
    return f"({name}.k = -1 or rn <= case when {name}.k < -1 then cast(raise_error('k must not be negative') as int) when coalesce({name}.k, 0) = 0 then {default} else {name}.k end)"


def _first(table: str, where: str, name: str, default: int, order: str = ORDER) -> str:
    """The first k rows that pass."""
    return f"(select * from (select *, row_number() over (order by {order}) as rn from {table} where {where}) where {_limit(name, default)})"


def _matches(name: str, columns: list[str]) -> str:
    """Whether a row passes the filters of a call."""
    fields = [c for c in (*SCALARS, *ARRAYS) if c in columns]
    known = ", ".join(f"'{c}'" for c in (*SCALARS, *ARRAYS))
    one = lambda c: f"array_contains({name}.filters['{c}'], cast({c} as string))" if c in SCALARS else f"arrays_overlap({name}.filters['{c}'], {c})"
    unknown = f"when exists(map_keys({name}.filters), f -> f not in ({known})) then cast(raise_error('not filterable') as boolean)"
    each = " and ".join(f"(not map_contains_key({name}.filters, '{c}') or coalesce({one(c)}, false))" for c in fields)
    return f"case when {name}.filters is null then true {unknown} else {each or 'true'} end"


def _create(spark: SparkSession, name: str, parameters: str, returns: dict[str, str], body: str) -> None:
    columns = ", ".join(f"`{c}` {t}" for c, t in returns.items())
    spark.sql(f"create or replace temporary function {name}({parameters}) returns table({columns}) return select {', '.join(f'`{c}`' for c in returns)} from ({body})")


def register(chunks: DataFrame, embedder: Embedder | None = None, sources: list[dict] | None = None, prefix: str = "", default_k: int | None = None) -> None:
    """Name the calls over ``chunks``; each name begins with ``prefix``. Without an embedder there is no ``search_context``."""
    spark, kinds, k = chunks.sparkSession, dict(chunks.dtypes), default_k or settings().server.default_k
    table = f"{prefix}lake_chunks"
    chunks.createOrReplaceTempView(table)
    name = lambda n: f"{prefix}{n}"

    payload = [c for c in ("title", "url", "source_type", "kind", "repo", "summary", "relationships") if c in kinds]
    picked = "".join(f", min_by({c}, struct(turn, chunk_index)) as {c}" for c in payload)
    if {"relationship_targets", "entity_names"} <= set(kinds):
        f = name("find_related")
        typed = f"({f}.relationship_types is null or size({f}.relationship_types) = 0 or arrays_overlap(relationship_types, {f}.relationship_types))"
        lookups = ((f"array_contains(relationship_targets, {f}.entity) and {typed}", 0, "relationship"), (f"array_contains(entity_names, {f}.entity)", 1, "entity"))
        hits = " union all ".join(f"select {', '.join(['document_id', 'chunk_index', *payload])}, {turn} as turn, '{via}' as via from {_first(table, where, f, k)}" for where, turn, via in lookups)
        returns = {"document_id": kinds["document_id"]} | {c: kinds[c] for c in payload} | {"via": "array<string>"}
        merged = f"select document_id, min(turn) as first{picked}, array_sort(collect_set(via)) as via from ({hits}) group by document_id order by first, document_id"
        _create(spark, f, "entity string, k int default null, relationship_types array<string> default null", returns, merged)

    if "entities" in kinds:
        f = name("list_entities")
        typed = f" and ({f}.entity_type is null or array_contains(entity_types, {f}.entity_type))" if "entity_types" in kinds else ""
        scope = _first(table, f"({f}.document_id is null or {table}.document_id = {f}.document_id){typed}", f, k)
        each = f"select {ORDER}, pos, col.type as type, col.name as name from (select {ORDER}, posexplode(entities) from {scope})"
        seen = f"select type, name, min(struct(document_id, chunk_index, pos)) as first from ({each}) where {f}.entity_type is null or type = {f}.entity_type group by type, name order by first"
        _create(spark, f, "document_id string default null, entity_type string default null, k int default null", {"type": "string", "name": "string"}, seen)

    if "text" in kinds:
        f = name("get_document")
        head = [c for c in ("title", "url", "source_type", "kind", "repo", "summary") if c in kinds]
        cap = settings().server.document_chunks
        own = f"select * from (select *, row_number() over (order by chunk_index) as rn from {table} where {table}.document_id = {f}.document_id) where rn <= {cap}"
        text = "array_join(transform(array_sort(collect_list(struct(chunk_index, text))), x -> x.text), '\\n') as text"
        whole = f"select document_id{''.join(f', min_by({c}, chunk_index) as {c}' for c in head)}, {text}, count(*) as chunk_count from ({own}) group by document_id"
        _create(spark, f, "document_id string", {"document_id": kinds["document_id"]} | {c: kinds[c] for c in head} | {"text": "string", "chunk_count": "bigint"}, whole)

    if embedder and "vector" in kinds:
        f, udf = name("search_context"), name("embed_query")

        @F.pandas_udf("array<double>")
        def embed_query(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [float(x) for x in embedder.embed_query(t or "")])

        spark.udf.register(udf, embed_query)
        dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * cast(q as double)), 0d, (s, x) -> s + x)"
        score = f"coalesce({dot('vector', 'asked')} / nullif(sqrt({dot('vector', 'vector')}) * sqrt({dot('asked', 'asked')}), 0d), 0d)"
        finite = "coalesce(forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"
        scored = f"(select *, {score} as score from {table} cross join (select {udf}({f}.query) as asked) where size(vector) = size(asked) and {finite} and {_matches(f, list(kinds))})"
        fields = {c: "double" if c == "score" else kinds[c] for c in RESULT if c == "score" or c in kinds}
        _create(spark, f, "query string, k int default null, filters map<string, array<string>> default null", fields, f"select * from {_first(scored, 'true', f, k, 'score desc, chunk_id')} order by score desc, chunk_id")

    own = [{"id": f"github:{r}", "type": "github"} for r in settings().connector.repos] if sources is None else sources
    spark.createDataFrame([(s["id"], s["type"]) for s in own], "id string, type string").createOrReplaceTempView(f"{prefix}lake_sources")
    _create(spark, name("list_sources"), "", {"id": "string", "type": "string"}, f"select * from {prefix}lake_sources")
