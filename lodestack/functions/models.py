"""Embedders and extractors behind interfaces, with offline defaults that need no network."""

from __future__ import annotations

import asyncio
import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Awaitable, Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import settings
from ..schema import KINDS, SEMANTIC, SOURCE_TYPES
from .metadata import extract_json, validate


class Embedder(ABC):
    """Vectors of texts, in their order."""

    dimensions: int
    #: How many texts a call takes at most; None: as the settings say.
    batch_size: int | None = None

    @abstractmethod
    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


class HashingEmbedder(Embedder):
    """Signed hashing of words and word pairs, normalised to length one."""

    def __init__(self, dimensions: int = 1024):
        self.dimensions = dimensions

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [v for part in _parts([_plain(t or "") for t in texts]) for v in self._vectors(part)]

    def _vectors(self, texts: list[bytes]) -> list[list[float]]:
        """All words of some texts at once; a pair's code goes on from its first word's and a space."""
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        edges = np.flatnonzero(np.diff(WORD[data].view(np.int8), prepend=0))
        first, length = edges[::2], edges[1::2] - edges[::2]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, starts)))
        order = np.argsort(-length, kind="stable")
        codes = np.empty(len(first), dtype=np.uint32)
        codes[order] = _crc32(np.zeros_like(codes), data, first[order], length[order])
        second = order[(order > 0) & (owner[order] == owner[order - 1])]
        pairs = _crc32(~_next(~codes[second - 1], np.uint8(32)), data, first[second], length[second])
        every, owners = np.concatenate([codes, pairs]), np.concatenate([owner, owner[second]])
        out = np.bincount(owners * self.dimensions + (every >> 1) % self.dimensions, weights=np.where(every & 1, 1.0, -1.0), minlength=len(texts) * self.dimensions)
        out = out.astype(float).reshape(len(texts), self.dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


OTHER = re.compile(r"[^\w\x00-\x7f]+")
#: The bytes of words in a text without ``OTHER`` characters.
WORD = np.array([c > 127 or re.fullmatch(r"\w", chr(c)) is not None for c in range(256)])
#: What a byte does to the CRC-32 register.
REGISTER = np.array([~zlib.crc32(bytes([c]), 0xFFFFFFFF) & 0xFFFFFFFF for c in range(256)], dtype=np.uint32)
#: Longer words are coded one by one.
LONG_WORD = 32
BYTES_AT_ONCE = 1 << 18


def _plain(text: str) -> bytes:
    """The text in lower case with a space for what is neither ASCII nor part of a word."""
    text = text.lower()
    return (text if text.isascii() else OTHER.sub(" ", text)).encode()


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of ``BYTES_AT_ONCE`` bytes at most, or of one text."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > BYTES_AT_ONCE:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def _next(register: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return REGISTER[(register ^ byte).astype(np.uint8)] ^ (register >> 8)


def _crc32(codes: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``zlib.crc32`` of words of ``data``, longest first, each from a code on."""
    register = ~codes
    for j, n in enumerate(np.searchsorted(-length, -np.arange(min(LONG_WORD, length.max(initial=0))))):
        register[:n] = _next(register[:n], data[first[:n] + j])
    out = ~register
    for i in range(np.searchsorted(-length, -LONG_WORD)):
        out[i] = zlib.crc32(data[first[i] : first[i] + length[i]], int(codes[i]))
    return out


class RemoteEmbedder(Embedder):
    """An embedder over a coroutine function from one text to its vector, with a bounded number of calls in flight.

    Vectors come in the order of their texts, whatever the order of the answers. A call that fails is repeated
    after ``wait`` seconds, then twice as long each time, and fails for good the ``tries``-th time; while it waits, other calls go on.
    """

    batch_size = 1_024

    def __init__(self, call: Callable[[str], Awaitable[Sequence[float]]], dimensions: int, in_flight: int = 16, tries: int = 5, wait: float = 0.1):
        if in_flight < 1 or tries < 1:
            raise ValueError("in_flight and tries must be positive")
        self.call, self.dimensions, self.in_flight, self.tries, self.wait = call, dimensions, in_flight, tries, wait

    async def _one(self, text: str, gate: asyncio.Semaphore) -> list[float]:
        for n in range(self.tries):
            try:
                async with gate:
                    return [float(x) for x in await self.call(text)]
            except Exception:  # whatever the call raises is a failure of this text
                if n + 1 == self.tries:
                    raise
            await asyncio.sleep(self.wait * 2**n)
        raise AssertionError("unreachable")

    async def _all(self, texts: Sequence[str], failures: bool) -> list[Any]:
        gate = asyncio.Semaphore(self.in_flight)
        return await asyncio.gather(*[self._one(t, gate) for t in texts], return_exceptions=failures)

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return asyncio.run(self._all(texts, False))

    def embed_each(self, texts: Sequence[str]) -> list[list[float] | None]:
        """As ``embed_documents``, with None for a text whose calls all failed."""
        return [None if isinstance(v, BaseException) else v for v in asyncio.run(self._all(texts, True))]


def _tried(model: Embedder, texts: list[str], tries: int) -> list[list[float] | None]:
    """Vectors of the texts; where a call fails, of each text by itself, None for one that fails ``tries`` times.

    A model that repeats its calls itself is asked once.
    """
    if isinstance(model, RemoteEmbedder):
        return model.embed_each(texts)
    try:
        return model.embed_documents(texts)
    except Exception:  # whatever the model raises is a failure of these texts
        if len(texts) > 1:
            return [v for t in texts for v in _tried(model, [t], tries)]
        return _tried(model, texts, tries - 1) if tries > 1 else [None]


def embed(text: Column, make: Callable[[], Embedder], batch_size: int | None = None, tries: int | None = None) -> Column:
    """Vectors of a text column; each task builds one embedder and sends it ``batch_size`` texts at a time (by default as many as the model or the settings say).

    A text that fails fails the task, unless ``tries`` is given: then its vector is null after so many failures.
    """
    default = settings().embedding.batch_size

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        step = batch_size or model.batch_size or default
        for column in batches:
            texts = column.fillna("").tolist()
            parts = (texts[i : i + step] for i in range(0, len(texts), step))
            yield pd.Series([v for part in parts for v in (_tried(model, part, tries) if tries else model.embed_documents(part))], dtype=object)

    return run(text)


class Inferencer(ABC):
    """JSON from a system and a user prompt."""

    @abstractmethod
    def infer_json(self, system: str, user: str, schema: dict | None = None) -> dict: ...


class ReplyInferencer(Inferencer):
    """An inferencer over any function from prompts to a reply text."""

    def __init__(self, reply: Callable[[str, str], str]):
        self.reply = reply

    def infer_json(self, system: str, user: str, schema: dict | None = None) -> dict:
        return extract_json(self.reply(system, user))


class RuleInferencer(Inferencer):
    """Facts that patterns can find: issue references, mail addresses, services, files, people."""

    patterns = {"contact": r"[a-z0-9.]+@[a-z0-9]+[.][a-z0-9.]*[a-z]", "file": r"\b[\w/-]+\.(?:py|js|ts|go|rs|java|sql|yaml|yml|json|md)\b", "service": r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+)*-(?:service|api|worker|db)\b", "person": r"(?<!\w)@[A-Za-z0-9][\w-]*"}

    def infer_json(self, system: str, user: str, schema: dict | None = None) -> dict:
        entities = [{"type": kind, "name": name} for kind, pattern in self.patterns.items() for name in dict.fromkeys(re.findall(pattern, user))]
        targets = dict.fromkeys(re.findall(r"(?<!\w)(?:[\w.-]+/[\w.-]+)?#\d+|\b[A-Z][A-Z0-9]+-\d+\b", user))
        first = next((line.strip() for line in user.splitlines() if line.strip()), "")
        return {"summary": first[:200], "entities": entities, "topics": [], "relationships": [{"type": "references", "target": t, "description": ""} for t in targets]}


@dataclass(frozen=True)
class PromptTemplate:
    """A system prompt and the fields of the user prompt."""

    name: str
    system: str

    def render(self, max_chars: int) -> Column:
        """User prompt of document rows; the body is cut to ``max_chars``."""
        labels = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, F.array_join("labels", ", ")).otherwise("none")
        parts = [("Kind", F.col("kind")), ("Repository", F.coalesce(F.nullif(F.col("repo"), F.lit("")), F.lit("n/a"))), ("Title", F.col("title")), ("Labels", labels)]
        lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in parts]
        return F.concat_ws("\n", *lines, F.lit(""), F.substring(F.coalesce("body", F.lit("")), 1, max_chars))


@dataclass
class PromptRegistry:
    """Templates by source and kind; the exact one, else the source's, else the default."""

    default: PromptTemplate
    templates: dict[tuple[str | None, str | None], PromptTemplate] = field(default_factory=dict)

    def register(self, template: PromptTemplate, source_type: str | None = None, kind: str | None = None) -> PromptRegistry:
        if source_type is not None and source_type not in SOURCE_TYPES or kind is not None and kind not in KINDS:
            raise ValueError(f"unknown source or kind: {source_type}, {kind}")
        if source_type is None:
            self.default = template
        else:
            self.templates[source_type, kind] = template
        return self

    def select(self, source_type: str, kind: str) -> PromptTemplate:
        return self.templates.get((source_type, kind)) or self.templates.get((source_type, None)) or self.default

    def select_name(self, source_type: Column, kind: Column) -> Column:
        """Name of the template for each row."""
        exact, source = F.lit(None).cast("string"), F.lit(None).cast("string")
        for (s, k), t in self.templates.items():
            if k is None:
                source = F.when(source_type == s, F.lit(t.name)).otherwise(source)
            else:
                exact = F.when((source_type == s) & (kind == k), F.lit(t.name)).otherwise(exact)
        return F.coalesce(exact, source, F.lit(self.default.name))


def default_registry() -> PromptRegistry:
    """Templates for pull requests, issues, readmes and discussions, and for issue trackers."""
    ask = "State facts only, as a JSON object with summary, entities (type, name), topics and relationships (type, target, description). The artifact is "
    kinds = {"pr": "a change request.", "issue": "an issue.", "readme": "a project description.", "discussion": "a discussion."}
    out = PromptRegistry(PromptTemplate("default", ask + "an engineering document."))
    for kind, what in kinds.items():
        out.register(PromptTemplate(f"github-{kind}", ask + what), "github", kind)
    out.register(PromptTemplate("github", ask + "from a code host."), "github")
    return out.register(PromptTemplate("jira", ask + "a tracked work item."), "jira")


class SemanticIndexer:
    """Template, prompt, model and validation in one; a row whose extraction fails keeps its former metadata."""

    def __init__(self, make: Callable[[], Inferencer] = RuleInferencer, registry: PromptRegistry | None = None, max_chars: int = 12_000):
        self.make, self.registry, self.max_chars = make, registry or default_registry(), max_chars

    def extract(self, docs: DataFrame) -> DataFrame:
        make, schema = self.make, {"type": "object"}
        every = [self.registry.default, *self.registry.templates.values()]
        systems = {t.name: t.system for t in every}

        @F.pandas_udf(SEMANTIC)
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model = make()
            names = ["summary", "entities", "topics", "relationships"]
            for template, user in batches:
                rows = []
                for t, u in zip(template, user, strict=True):
                    try:
                        rows.append(validate(model.infer_json(systems[t], u, schema)))
                    except Exception:  # best effort: any failure of a model leaves the row as it is
                        rows.append(dict.fromkeys(names))
                yield pd.DataFrame(rows, columns=names)

        found = run(self.registry.select_name(F.col("source_type"), F.col("kind")), self.registry.default.render(self.max_chars))
        return docs.withColumn("_found", found).withColumn("semantic", F.when(F.col("_found.summary").isNotNull(), F.col("_found")).otherwise(F.col("semantic"))).drop("_found")
