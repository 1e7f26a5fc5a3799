"""Token estimates and overlapping chunks of words."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the white space that separates words
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

TEXTS_AT_ONCE = 64


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def with_title(title: Column, body: Column) -> Column:
    """Title, a blank line and the body; the body alone without a title."""
    has = F.coalesce(title, F.lit("")) != ""
    return F.when(has, F.concat(title, F.lit("\n\n"), F.coalesce(body, F.lit("")))).otherwise(F.coalesce(body, F.lit("")))


def chunk_bounds(tokens: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first word, end word) of each chunk.

    A chunk takes what fits into ``size`` tokens, but always a new word. The next
    one begins with the longest run of last words within ``overlap`` tokens.
    """
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be smaller than the chunk size {size}")
    upto = [0, *accumulate(tokens)]
    start = done = 0
    while done < len(tokens):
        done = max(done + 1, bisect_right(upto, upto[start] + size) - 1)
        yield start, done
        start = bisect_left(upto, upto[done] - overlap)


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of a text as words joined by single spaces."""
    found = text.split()
    if not found:
        return []
    return [" ".join(found[a:b]) for a, b in chunk_bounds([-(-len(w) // 4) for w in found], size, overlap)]


def chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of chunks of each text; empty for null or blank text. A task holds the chunks of ``TEXTS_AT_ONCE`` texts, not those of a whole batch.

    Marked as not deterministic, or Spark would cut every text twice: ``explode`` first filters by the size of its array.
    """
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be smaller than the chunk size {size}")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                yield pa.array([chunk_text(x, size, overlap) if x else [] for x in batch.slice(at, TEXTS_AT_ONCE).to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()(text)


def decode_base64(content: Column) -> Column:
    """Text of base64 content with line breaks in it; malformed bytes become replacement marks."""
    return F.decode(F.unbase64(F.regexp_replace(content, "\\s", "")), "UTF-8")
