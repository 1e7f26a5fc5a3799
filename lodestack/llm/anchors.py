"""Substring dedup over words by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of seven words. A
window of 13 words holds a whole block wherever it begins, so if it also starts
in another document, a block of that document occurs in it. Rolling seven-word
windows of every document probe the blocks of all; hits that occur in two
documents or more are extended: only windows that hold a hit are compared, by
their full 13 words (two hashes, 128 bits), and runs of repeated windows are maximal exact repeats.

Keys travel as in :mod:`exchange`; texts are dealt out once, by document id.

Defined results: a null text has no words; documents shorter than a window
keep all words; rows with one doc_id are one document and never repeat each
other; a null doc_id counts as larger than all others; a very long text is held
whole by the task that has its document; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_MIX, _OTHER = np.random.default_rng(13).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """64-bit hash of a word; emptied at 600,000 entries to bound memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 600_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHash()


def rolling(hashes: np.ndarray, width: int, odd: np.ndarray = _MIX) -> np.ndarray:
    """Hash of each run of ``width`` words; other multipliers give other hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n] * odd[0]
    for k in range(1, width):
        out += hashes[k : k + n] * odd[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Chunk:
    """The documents of one chunk in order of id: word hashes end to end, and the windows that fit."""

    def __init__(self, table: pa.Table, window: int, block: int):
        ids = np.array([exchange.LAST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        self.rows = np.argsort(ids, kind="stable")
        self.ids, self.text = ids[self.rows], table.column("text")
        arrays, self.lengths = [], []
        for row in self.rows.tolist():
            words = self.words(row)
            arrays.append(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words)))
        self.lengths = np.array([len(a) for a in arrays], dtype=np.int64)
        self.hashes = np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.window, self.block = window, block

    def words(self, row: int) -> list[bytes]:
        return (self.text[row].as_py() or b"").split()

    def fitting(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, position, document number) of every run of ``width`` words in documents that have a window."""
        room = np.where(self.lengths >= self.window, self.lengths - width + 1, 0)
        doc = np.repeat(np.arange(len(room)), room)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + self.starts[doc]
        every = rolling(self.hashes, width)
        return every[at], at, doc

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys with two flags in front of sending, where each came from, and all positions."""
        key, at, doc = self.fitting(self.block)
        key = key >> np.uint64(64 - bits)
        distinct, inverse = np.unique(key, return_inverse=True)
        aligned = np.zeros(len(distinct), dtype=bool)
        aligned[inverse[(at - self.starts[doc]) % self.block == 0]] = True
        low, high = np.full(len(distinct), exchange.LAST), np.full(len(distinct), -exchange.LAST)
        np.minimum.at(low, inverse, self.ids[doc])
        np.maximum.at(high, inverse, self.ids[doc])
        flags = aligned.astype(np.uint64) | (low != high).astype(np.uint64) << np.uint64(1)
        return distinct << np.uint64(2) | flags, inverse, at

    def candidates(self, hit: np.ndarray, inverse: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit: distinct keys and second hashes, least document of each, and each window's key number, position and document."""
        met = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        met[at[hit[inverse]] + 1] = 1
        upto = np.cumsum(met)
        key, at, doc = self.fitting(self.window)
        keep = upto[at + self.window - self.block + 1] > upto[at]
        key, at, doc = key[keep], at[keep], doc[keep]
        distinct, second, inverse = exchange.distinct_pairs(key, rolling(self.hashes, self.window, _OTHER)[at])
        least = np.full(len(distinct), exchange.LAST)
        np.minimum.at(least, inverse, self.ids[doc])
        return distinct, second, least, inverse, at, doc


def _own(docs: DataFrame, chunks: int) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    chunk = F.pmod(F.xxhash64(doc_id), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), doc_id.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = 6 << 20, keys_a_part: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after removing the words of windows that also start in a smaller document."""
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-size // 6 // keys_a_part))
    bits = min(60, max(32, int(size).bit_length() + 8))
    own = _own(docs, chunks)

    def probe(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window, block)
        return exchange.send(table.column("chunk")[0].as_py(), chunk.probes(bits)[0], None, bits + 2, parts)

    def match(table: pa.Table) -> pa.Table:
        keys, _, sizes = exchange.received(table)
        order = np.argsort(keys, kind="stable")
        key, flags = keys[order] >> np.uint64(2), keys[order] & np.uint64(3)
        starts = exchange.runs(key)
        count = np.diff(np.append(starts, len(key)))
        flag = np.bitwise_or.reduceat(flags, starts) if len(starts) else flags
        hit = (flag & np.uint64(1) > 0) & ((count > 1) | (flag > 1))
        marks = np.zeros(len(keys), dtype=bool)
        marks[order] = np.repeat(hit, count)
        return exchange.reply(1, table, sizes, marks)

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.send(0, np.zeros(0, dtype=np.uint64), None, 64, 1)
        chunk = Chunk(table, window, block)
        _, inverse, at = chunk.probes(bits)
        keys, second, least, *_ = chunk.candidates(exchange.answers(replies, 1), inverse, at)
        return exchange.send(table.column("chunk")[0].as_py(), keys, np.stack([least, second.view(np.int64)]), 64, parts)

    def earliest(table: pa.Table) -> pa.Table:
        keys, (docs, second), sizes = exchange.received(table, 2)
        order = np.lexsort((second, keys))
        starts = exchange.pair_runs(keys[order], second[order])
        least = np.minimum.reduceat(docs[order], starts)
        first = np.empty(len(keys), dtype=np.int64)
        first[order] = np.repeat(least, np.diff(np.append(starts, len(keys))))
        return exchange.reply(2, table, sizes, first < docs)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window, block)
        _, inverse, at = chunk.probes(bits)
        _, _, least, inverse, at, doc = chunk.candidates(exchange.answers(replies, 1), inverse, at)
        earlier = exchange.answers(replies, 2)
        gone = at[earlier[inverse] | (chunk.ids[doc] > least[inverse])] if len(at) else at
        edge = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        removed = np.cumsum(edge)[:-1] > 0
        out = []
        for row, start, n in zip(chunk.rows.tolist(), chunk.starts.tolist(), chunk.lengths.tolist(), strict=True):
            words, drop = chunk.words(row), removed[start : start + n]
            kept = [words[i] for i in np.flatnonzero(~drop)] if drop.any() else words
            out.append((table.column("doc_id")[row].as_py(), n, int(drop.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    sent = own.groupBy("chunk").applyInArrow(probe, exchange.SENT)
    hits = sent.groupBy("part").applyInArrow(match, exchange.REPLY)
    asked = own.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, exchange.SENT)
    earlier = asked.groupBy("part").applyInArrow(earliest, exchange.REPLY)
    replies = hits.unionByName(earlier)
    return own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, OUT)
