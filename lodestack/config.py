"""Settings: frozen groups with defaults, from the environment and, over it, from the session.

``LODESTACK_STORE__BUCKETS`` in the environment and ``spark.lodestack.store.buckets`` in the
session's configuration name the same setting. Only the driver has a session: what tasks need is handed to them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache

from pyspark.sql import SparkSession

PREFIX, SESSION = "LODESTACK_", "spark.lodestack."


@dataclass(frozen=True)
class EmbeddingSettings:
    dimensions: int = 1024
    batch_size: int = 16


@dataclass(frozen=True)
class StoreSettings:
    path: str = "lake/chunks"
    buckets: int = 64


@dataclass(frozen=True)
class ConnectorSettings:
    repos: tuple[str, ...] = ()
    page_size: int = 100


@dataclass(frozen=True)
class IngestionSettings:
    chunk_size: int = 800
    chunk_overlap: int = 100
    tries: int = 5
    purge_empty: bool = False


@dataclass(frozen=True)
class SemanticSettings:
    enabled: bool = True
    max_input_chars: int = 12_000


@dataclass(frozen=True)
class ServerSettings:
    default_k: int = 10
    document_chunks: int = 1_000


@dataclass(frozen=True)
class Settings:
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    store: StoreSettings = field(default_factory=StoreSettings)
    connector: ConnectorSettings = field(default_factory=ConnectorSettings)
    ingestion: IngestionSettings = field(default_factory=IngestionSettings)
    semantic: SemanticSettings = field(default_factory=SemanticSettings)
    server: ServerSettings = field(default_factory=ServerSettings)
    interceptors: tuple[str, ...] = ()


def _parse(value: str, like):
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, tuple):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return value


def from_environment(env: dict[str, str]) -> Settings:
    """Defaults with ``LODESTACK_GROUP__NAME`` over them."""
    out = Settings()
    for group in fields(Settings):
        own = getattr(out, group.name)
        if group.name == "interceptors":
            if value := env.get(f"{PREFIX}INTERCEPTORS"):
                out = replace(out, interceptors=_parse(value, ()))
            continue
        given = {f.name: _parse(env[key], getattr(own, f.name)) for f in fields(own) if (key := f"{PREFIX}{group.name}__{f.name}".upper()) in env}
        out = replace(out, **{group.name: replace(own, **given)})
    return out


@lru_cache(maxsize=16)
def _made(given: tuple[tuple[str, str], ...]) -> Settings:
    return from_environment(dict(os.environ) | {PREFIX + name.replace(".", "__").upper(): value for name, value in given})


def settings() -> Settings:
    """The settings of this process and of its active session, if there is one."""
    spark = SparkSession.getActiveSession()
    held = spark.conf.getAll if spark else {}
    return _made(tuple(sorted((k.removeprefix(SESSION), v) for k, v in held.items() if k.startswith(SESSION))))
