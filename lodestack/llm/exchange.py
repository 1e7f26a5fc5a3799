"""Asking the whole corpus about keys: compact key lists out, one bit per key back.

A chunk of documents sends its sorted distinct keys, cut by value ranges; the
task of a range sees the keys of all chunks and answers each chunk with a bit
per key, in the chunk's own order. Sorted keys differ by little, so a key costs
two to four bytes on the way and a bit on the way back. Chunks are found by the
hash of the document id, so any task can be repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

LAST = np.iinfo(np.int64).max
SENT = "part int, chunk int, n long, keys binary, docs binary"
REPLY = "kind int, part int, chunk int, n long, bits binary"


def shrink(values: np.ndarray) -> bytes:
    """Bytes of 64-bit values by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def widen(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)


def send(chunk: int, keys: np.ndarray, docs: np.ndarray | None, bits: int, parts: int) -> pa.Table:
    """Rows of SENT: the sorted ``keys`` (below 2**bits), cut into ``parts`` ranges, with values of each if given (rows of values, or one)."""
    cuts = np.searchsorted(keys, np.array([(i << bits) // parts for i in range(parts)], dtype=np.uint64))
    cuts = np.append(cuts, len(keys))
    pa.default_memory_pool().release_unused()
    rows = []
    for part in range(parts):
        a, b = cuts[part], cuts[part + 1]
        if a < b:
            step = keys[a:b].copy()
            step[1:] -= keys[a : b - 1]
            rows.append((part, chunk, b - a, shrink(step), shrink(np.ascontiguousarray(docs[..., a:b]).reshape(-1).astype(np.int64).view(np.uint64)) if docs is not None else None))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["part", "chunk", "n", "keys", "docs"])


def note(chunk: int, values: np.ndarray, parts: int) -> pa.Table:
    """A row of SENT beyond the value ranges, by which a chunk keeps ``values`` for its next round."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    row = (parts + chunk, chunk, len(values), shrink(values.astype(np.int64).view(np.uint64)), None)
    return pa.Table.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds, strict=True)], names=["part", "chunk", "n", "keys", "docs"])


def echo(kind: int, table: pa.Table) -> pa.Table:
    """Rows of REPLY that hand notes back."""
    columns = [pa.array([kind] * len(table), type=pa.int32()), *(table.column(c) for c in ("part", "chunk", "n", "keys"))]
    return pa.Table.from_arrays(columns, names=["kind", "part", "chunk", "n", "bits"])


def noted(table: pa.Table, kind: int) -> np.ndarray:
    """The values of a chunk's note."""
    found = [b for k, b in zip(table.column("kind").to_pylist(), table.column("bits").to_pylist(), strict=True) if k == kind]
    return widen(found[0]).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def received(table: pa.Table, values: int = 1) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(keys, documents or ``values`` rows of values, sizes by row) of the rows that one range got."""
    keys = [np.cumsum(widen(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    docs = [widen(x).view(np.int64).reshape(values, -1) for x in table.column("docs").to_pylist() if x is not None]
    more = np.concatenate(docs, axis=1) if docs else None
    return np.concatenate(keys), more[0] if docs and values == 1 else more, np.array([len(k) for k in keys])


def reply(kind: int, table: pa.Table, sizes: np.ndarray, marks: np.ndarray) -> pa.Table:
    """Rows of REPLY: each chunk's marks."""
    bits = [np.packbits(m).tobytes() for m in np.split(marks, np.cumsum(sizes)[:-1])]
    n = len(bits)
    return pa.Table.from_arrays([pa.array([kind] * n, type=pa.int32()), table.column("part"), table.column("chunk"), pa.array(sizes), pa.array(bits, type=pa.binary())], names=["kind", "part", "chunk", "n", "bits"])


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """The marks of a chunk's keys, all ranges in order."""
    rows = sorted((p, n, b) for k, p, n, b in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "n", "bits")), strict=True) if k == kind)
    return np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for _, n, b in rows]).astype(bool) if rows else np.zeros(0, dtype=bool)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


def pair_runs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal pairs, sorted by ``first`` and then ``second``."""
    return np.union1d(runs(first), runs(second))


def distinct_pairs(key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the number of each row's pair: two hashes of 64 bits are one of 128."""
    order = np.lexsort((second, key))
    starts = pair_runs(key[order], second[order])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return key[order][starts], second[order][starts], number
