"""Best-fit packing of tokenised documents by exact-complement hashing.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is. Single, pair and triple sums
of the available lengths are looked up to fill each gap exactly; what no
combination fills is packed best-fit. The plan is a list of slot ranges; each
piece finds its place from its length and its running number among the pieces
of that length.

Defined results: a null text is an empty text and packs as the end token
alone; a null doc_id, repeated rows and extra columns are carried as ordinary
rows; a text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, few_rows

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# fixed value: the pattern by which byte-level tokenizers part a text before merging
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s++$|\s+(?!\S)|\s"""
LONG_SPACE = re.compile(r"\s{5000}")


def merge_ranks(model: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer file as bytes; its ids are in order of merging."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {x["content"] for x in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}


class TextIds:
    """Token ids of whole texts as little-endian bytes.

    A plain byte-level file (no normaliser, the usual pattern) is encoded by its merges alone, which is faster and
    gives the same ids; texts that hold an added token or a very long run of white space, and all texts of any
    other file, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.merges = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        before = model.get("pre_tokenizer") or {}
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("normalizer"):
            import tiktoken

            self.merges = tiktoken.Encoding("merges", pat_str=PRE_TOKENS, mergeable_ranks=merge_ranks(model), special_tokens={})
        self.added = [x["content"] for x in model["added_tokens"]]

    def __call__(self, text: str) -> bytes:
        if self.merges is None or any(x in text for x in self.added) or len(text) >= 5000 and LONG_SPACE.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.merges.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The encoder of a file, one for each process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextIds(path)
    return _ENCODERS[path]


def document_ids(text: str | None, encode: TextIds, end_id: int) -> bytes:
    """Ids of a whole text and the end token, four bytes each."""
    return (encode(text) if text else b"") + np.array([end_id], dtype="<u4").tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces; only the first may be short of the capacity."""
    total = len(ids) // 4
    start, piece = 0, 0
    while start < total:
        length = (total % capacity or capacity) if piece == 0 else capacity
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; ``nth`` counts the pieces of that length in the writing task ``part``."""

    def run(batches):
        encode, seen, part = text_ids(tokenizer), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in few_rows(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, start, length, crc in cut(document_ids(text, encode, end_id), capacity):
                    rows.append((doc_id, piece, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PIECES)


class SumIndex:
    """Which available lengths add up to a sum: one, two or three of them, the longest parts first.

    ``have`` counts the pieces of each length and only ever falls. For each sum that is asked for, the index lists the longer
    parts of its pairs and the longest parts of its triples; what the counts no longer allow is taken off
    the list for good, so all look-ups of a sum together pass over each entry once.
    """

    def __init__(self, have: np.ndarray):
        self.have, self.lengths = have, np.flatnonzero(have[1:]) + 1
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def _two(self, one: int, two: int, taken: int = 0) -> bool:
        """Whether pieces of both lengths are there, besides one of length ``taken``."""
        need = {one: 1}
        need[two] = need.get(two, 0) + 1
        return all(self.have[x] - (x == taken) >= n for x, n in need.items())

    def pair(self, total: int, most: int | None = None) -> tuple[int, int] | None:
        """Two lengths of the sum; with ``most``, none longer, while a piece of that length is in use."""
        if total not in self.pairs:
            longer = self.lengths[(self.lengths < total) & (2 * self.lengths >= total)]
            self.pairs[total] = longer[self.have[total - longer] > 0].tolist()
        held = self.pairs[total]
        while held and not self._two(held[-1], total - held[-1]):
            held.pop()
        if most is None:
            return (held[-1], total - held[-1]) if held else None
        for one in reversed(held):
            if one <= most and self._two(one, total - one, most):
                return one, total - one
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if gap <= 0:
            return None
        if self.have[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        if gap not in self.triples:
            self.triples[gap] = self.lengths[(self.lengths <= gap - 2) & (3 * self.lengths >= gap)].tolist()
        held = self.triples[gap]
        while held:
            if self.have[held[-1]] and (found := self.pair(gap - held[-1], held[-1])):
                return held[-1], *found
            held.pop()
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), using every piece once."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    index, out = SumIndex(have), []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            used, gap = [longest], capacity - longest
            have[longest] -= 1
            while gap:
                top = int(np.flatnonzero(have[: gap + 1])[-1]) if have[1 : gap + 1].any() else 0
                if not top:
                    break
                reach = gap
                while True:  # the fullest filling: exact for the gap, else for the next smaller total
                    fill = index.fill(reach)
                    if fill or reach <= top:
                        break
                    reach -= 1
                fill = fill or (top,)
                for x in fill:
                    have[x] -= 1
                used += fill
                gap -= sum(fill)
            need = {x: used.count(x) for x in used}
            times = 1 + min(int(have[x]) // n for x, n in need.items())
            for x, n in need.items():
                have[x] -= n * (times - 1)
            out.append((tuple(used), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first index, sequence of the first index, offset), sorted by length and index."""
    at: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, at.get(x, 0), base, offset))
            at[x] = at.get(x, 0) + times
            offset += x
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    work = Workspace(docs.sparkSession)
    pieces = work.save(tokenized_pieces(docs, tokenizer, capacity, end_id))
    groups = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    groups = work.save(groups)
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))  # a few thousand rows, by the plan alone
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = groups.select("length", "part", before.alias("before"))
    numbered = pieces.join(offsets, ["length", "part"]).withColumn("index", F.col("before") + F.col("nth"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, index):
        import pandas as pd

        rows = table.value
        key = rows[:, 0] << 50 | rows[:, 1]
        at = np.searchsorted(key, length.to_numpy() << 50 | index.to_numpy(), side="right") - 1
        row = rows[at]
        return pd.DataFrame({"sequence_id": row[:, 2] + index.to_numpy() - row[:, 1], "offset": row[:, 3]})

    placed = numbered.withColumn("at", place("length", "index"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")

