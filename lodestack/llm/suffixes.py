"""Substring dedup over bytes: every 100-byte string that also starts earlier goes.

The corpus-wide work is done by content anchors, not by a suffix array of the
whole corpus; the README says why. The anchor of a 100-byte window is its
leftmost 50-byte gram of least hash, so equal windows have equal anchors at
equal offsets. Three rounds of :mod:`exchange` ask, each only for what the round
before left open: which anchors occur twice; which occurrences have an earlier
one with the same surroundings (the whole run of windows with that anchor); and
for the rest, which single windows occur earlier.

Which of a chunk's open windows are equal is read off the suffix arrays of their
stretches of text, built by linear grouping (:func:`suffix_array`); chunks compare
a key of 128 bits for each class of equal windows.

Defined results: a null text is empty; texts under 100 bytes stay whole; rows
with one doc_id follow each other in order of their bytes at one document's place,
without matches across them but with repeats between them; a null doc_id comes
last; a text of any length takes part whole, in one task, at some 50 bytes of memory a byte; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import exchange
from .anchors import _own

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SLAB = 1 << 15
SLICE = 1 << 16
_RNG = np.random.default_rng(100)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 62)) * 2 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rolling(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Sums that tell every run of each width, from runs of powers of two; ``_mix`` makes hashes of them."""
    power, width, built, start = _BYTE[data], 1, [None] * len(widths), [0] * len(widths)
    while width <= max(widths):
        for i, w in enumerate(widths):
            if w & width and len(data) >= w:
                n, at = len(data) - w + 1, start[i]
                part = power[at : at + n]
                built[i] = part.copy() if built[i] is None else built[i] * np.uint64(pow(_BASE, width, 1 << 64)) + part
                start[i] += width
        if len(power) > width:
            power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2
    return [b if b is not None else np.zeros(0, dtype=np.uint64) for b in built]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width``."""
    n, step = len(x) - width + 1, 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (of its upper 40 bits) in every run of ``width``, the first of equals; at most 2**24 hashes."""
    packed = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(packed, width) & np.uint64((1 << 24) - 1)).astype(np.int64)


class Chunk:
    """Texts end to end in order of doc_id, and their occurrences of anchors: position, first and last window."""

    def __init__(self, table: pa.Table, window: int):
        ids = np.array([exchange.LAST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        texts = [x or b"" for x in table.column("text").to_pylist()]
        self.rows = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), dtype=np.int64)
        self.ids = ids[self.rows]
        self.texts = [texts[i] for i in self.rows.tolist()]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.window = window
        self.bytes = b"".join(self.texts)
        gram = window // 2
        data, windows = np.frombuffer(self.bytes, dtype=np.uint8), max(0, len(self.bytes) - window + 1)
        self.keys, self.at, self.gram = np.empty(windows, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        self.first = self.last = self.at
        if windows:
            anchor, value = np.empty(windows, dtype=np.int64), np.empty(windows, dtype=np.uint64)
            for a in range(0, windows, SLAB):  # in parts that stay in the cache
                grams, keys = rolling(data[a : a + SLAB + window - 1], (gram, window))
                grams, b = _mix(grams), a + len(keys)
                near = leftmost_least(grams, window - gram + 1)
                self.keys[a:b], anchor[a:b], value[a:b] = keys, near + a, grams[near]
            room = np.maximum(0, self.lengths - window + 1)
            valid = np.zeros(len(anchor) + 1, dtype=np.int64)
            np.add.at(valid, np.minimum(self.starts, len(anchor)), room > 0)
            np.add.at(valid, np.minimum(self.starts + room, len(anchor)), -(room > 0).astype(np.int64))
            anchor[np.cumsum(valid)[:-1] == 0] = -1
            change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            ends = np.append(change[1:], len(anchor)) - 1
            real = anchor[change] >= 0
            self.at, self.first, self.last = anchor[change][real], change[real], ends[real]
            self.gram = _mix(value[self.first] + np.uint64(1))  # anchors are minima: mixed again, their keys spread over all values
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1 if len(self.starts) else self.at
        while len(self.doc) and (zero := self.lengths[self.doc] == 0).any():
            self.doc[zero] -= 1

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of anchors with a flag for two occurrences here, and the key number of each occurrence."""
        distinct, inverse, count = np.unique(self.gram >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return distinct << np.uint64(1) | (count > 1).astype(np.uint64), inverse

    def segments(self, hit: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences with a hit, their number among the distinct (anchor, surroundings), and for each of those anchor, surroundings, first occurrence."""
        own = np.flatnonzero(hit[inverse])
        gram = self.gram[own]
        shape = ((self.at[own] - self.first[own]) << 8 | (self.last[own] - self.first[own])).astype(np.uint64)
        around = _mix(_mix(self.keys[self.first[own]]) * np.uint64(3) + _mix(_mix(self.keys[self.last[own]]) + shape))
        order = np.lexsort((own, around, gram))
        new = np.concatenate([[True], (gram[order][1:] != gram[order][:-1]) | (around[order][1:] != around[order][:-1])]) if len(own) else np.zeros(0, dtype=bool)
        number = np.empty(len(own), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return own, number, gram[first], around[first], own[first]

    def equal_windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at rising positions: keys and second hashes of the distinct ones in order of key, the first index of each, each window's number.

        The stretches of text that the windows cover get a suffix array for every ``SLICE`` bytes, so memory
        does not follow the length of a text; classes of different slices are one where both hashes agree.
        """
        if not len(at):
            return self.keys[:0], self.keys[:0], at, at
        covered = np.cumsum(np.minimum(np.diff(at, prepend=at[0] - self.window), self.window))
        cuts = [0, *(np.flatnonzero(np.diff(covered // SLICE)) + 1).tolist(), len(at)]
        number, classes = np.empty(len(at), dtype=np.int64), 0
        for a, b in pairwise(cuts):
            number[a:b] = self._classes(at[a:b]) + classes
            classes = int(number[a:b].max()) + 1
        place = at[_first_index(number, classes)]
        key, view = _mix(self.keys[place]), memoryview(self.bytes)
        second = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + self.window], 9) for p in place.tolist()), dtype=np.uint64, count=len(place))
        key, second, merged = exchange.distinct_pairs(key, second)
        number = merged[number]
        return key, second, _first_index(number, len(key)), number

    def _classes(self, at: np.ndarray) -> np.ndarray:
        """Class number of each window, by the suffix array of their stretches end to end."""
        apart = np.concatenate([[True], np.diff(at) > self.window])
        begin, end = at[apart], at[np.append(np.flatnonzero(apart)[1:], len(at)) - 1] + self.window
        before = np.cumsum(end - begin) - (end - begin)
        run = np.cumsum(apart) - 1
        text = b"".join(self.bytes[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))
        return repeat_classes(text, at - begin[run] + before[run], self.window)


def _first_index(number: np.ndarray, size: int) -> np.ndarray:
    """Where each of the numbers 0 to ``size - 1`` stands first."""
    first = np.empty(size, dtype=np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first


def windows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All windows of the occurrences."""
    size = last - first + 1
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def remove_repeats(docs: DataFrame, window: int = 100, chunk_bytes: int = 1 << 20, keys_a_part: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) after removing the bytes of windows that also start earlier."""
    from pyspark.sql import functions as F

    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-size // 26 // keys_a_part))
    bits = min(60, max(32, int(size).bit_length() + 8))
    own = _own(docs, chunks)

    def name(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def probe(table: pa.Table) -> pa.Table:
        return exchange.send(name(table), Chunk(table, window).probes(bits)[0], None, bits + 1, parts)

    def match(table: pa.Table) -> pa.Table:
        keys, _, sizes = exchange.received(table)
        order = np.argsort(keys, kind="stable")
        starts = exchange.runs(keys[order] >> np.uint64(1))
        count = np.diff(np.append(starts, len(keys)))
        hit = (count > 1) | (np.bitwise_or.reduceat(keys[order] & np.uint64(1), starts) > 0)
        marks = np.zeros(len(keys), dtype=bool)
        marks[order] = np.repeat(hit, count)
        return exchange.reply(1, table, sizes, marks)

    def surround(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        _, inverse = chunk.probes(bits)
        _, _, gram, around, first = chunk.segments(exchange.answers(replies, 1), inverse)
        return exchange.send(name(table), gram, np.stack([around.view(np.int64), chunk.ids[chunk.doc[first]]]), 64, parts)

    def compare(table: pa.Table) -> pa.Table:
        keys, more, sizes = exchange.received(table, 2)
        around, docs = more
        order = np.lexsort((docs, around, keys))
        key, near = keys[order], around[order]
        same = (key[1:] == key[:-1]) & (near[1:] == near[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(starts, len(keys)))
        least = np.repeat(docs[order][starts], count)
        grams = exchange.runs(key)
        kinds = np.add.reduceat(np.concatenate([[True], ~same]).astype(np.int64), grams)
        several = np.repeat(kinds > 1, np.diff(np.append(grams, len(keys))))
        earlier, open_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        earlier[order], open_[order] = least < docs[order], several
        return pa.concat_tables([exchange.reply(2, table, sizes, earlier), exchange.reply(3, table, sizes, open_)])

    def resolve(chunk: Chunk, replies: pa.Table):
        """Occurrences that go whole, and the windows still open with their document ids."""
        _, inverse = chunk.probes(bits)
        own, number, _, _, first = chunk.segments(exchange.answers(replies, 1), inverse)
        whole = exchange.answers(replies, 2)[number] | (own != first[number]) if len(own) else np.zeros(0, dtype=bool)
        open_ = exchange.answers(replies, 3)[number] & ~whole if len(own) else whole
        at = windows_of(chunk.first[own[open_]], chunk.last[own[open_]])
        doc = np.repeat(chunk.doc[own[open_]], (chunk.last - chunk.first + 1)[own[open_]])
        return own[whole], at, chunk.ids[doc]

    def single(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        _, at, ids = resolve(chunk, replies)
        distinct, second, first_at, number = chunk.equal_windows(at)
        sent = exchange.send(name(table), distinct, np.stack([ids[first_at], second.view(np.int64)]), 64, parts)
        return pa.concat_tables([sent, exchange.note(name(table), number, parts)])

    def earliest(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= parts:
            return exchange.echo(5, table)
        keys, (docs, second), sizes = exchange.received(table, 2)
        order = np.lexsort((second, keys))
        starts = exchange.pair_runs(keys[order], second[order])
        first = np.empty(len(keys), dtype=np.int64)
        first[order] = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, len(keys))))
        return exchange.reply(4, table, sizes, first < docs)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        whole, at, _ = resolve(chunk, replies)
        number = exchange.noted(replies, 5)
        first_at = _first_index(number, int(number.max()) + 1) if len(at) else at
        gone = exchange.answers(replies, 4)[number] | (np.arange(len(at)) != first_at[number]) if len(at) else np.zeros(0, dtype=bool)
        edge = np.zeros(int(chunk.lengths.sum()) + 1, dtype=np.int64)
        np.add.at(edge, chunk.first[whole], 1)
        np.add.at(edge, chunk.last[whole] + window, -1)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + window, -1)
        removed = np.cumsum(edge)[:-1] > 0
        out = []
        for row, text, start in zip(chunk.rows.tolist(), chunk.texts, chunk.starts.tolist(), strict=True):
            drop = removed[start : start + len(text)]
            spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
            kept = np.frombuffer(text, dtype=np.uint8)[~drop].tobytes() if spans else text
            out.append((table.column("doc_id")[row].as_py(), len(text), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ask = lambda sent, f: sent.groupBy("part").applyInArrow(f, exchange.REPLY)
    tell = lambda replies, f, kind: own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(f, kind)
    hits = ask(own.groupBy("chunk").applyInArrow(probe, exchange.SENT), match)
    near = hits.unionByName(ask(tell(hits, surround, exchange.SENT), compare))
    every = near.unionByName(ask(tell(near, single, exchange.SENT), earliest))
    return tell(every, cut, OUT)


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in order, by linear grouping.

    :func:`lyndon_groups` sorts the suffixes by their Lyndon prefixes. A Lyndon prefix ends where the
    next smaller suffix starts, so within a group the order is that of those suffixes: going up the
    order, each placed suffix places the ones that end at it, which are a chain of previous-smaller
    pointers. Nothing is renamed and no group is sorted again.
    """
    n = len(text)
    group, size, smaller = lyndon_groups(text)
    free, order = list(range(n)), [0] * n
    end = n
    for place in range(n):
        j = end - 1
        while j >= 0 and j + size[j] == end:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = smaller[j]
        end = order[place]
    return order


def lyndon_groups(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """For each suffix: first place of its group, length of its Lyndon prefix, the nearest earlier suffix of a lower group (-1: none).

    Groups start as those of the first byte and are taken from the highest down. A member's pointer skips
    earlier members and higher groups, whose own pointers are final. The suffix it finds is followed by the
    group's prefix as often as members point at it, so it leaves its group upwards, the more copies the higher.
    """
    n = len(text)
    order = np.argsort(np.frombuffer(text, dtype=np.uint8), kind="stable")
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    begin = np.cumsum(count) - count
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group = begin[np.frombuffer(text, dtype=np.uint8)].tolist() + [-1]
    ends = [0] * (n + 1)
    for g, c in zip(begin.tolist(), count.tolist(), strict=True):
        if c:
            ends[g] = g + c
    members, at = order.tolist(), place.tolist()
    size, smaller = [1] * n, [-1] * n
    stop = n
    while stop:
        start = group[members[stop - 1]]
        if stop - start == 1:
            i = members[start]
            p = i - 1
            while group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                size[p] += size[i]
                g = group[p]
                last = ends[g] - 1
                here, other = at[p], members[last]
                members[here], members[last] = other, p
                at[other], at[p] = here, last
                group[p] = ends[g] = last
                ends[last] = last + 1
            stop = start
            continue
        copies: dict[int, int] = {}
        for i in sorted(members[start:stop]):
            p = i - 1
            while group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            copies[p] = copies.get(p, 0) + 1
        copies.pop(-1, None)
        length = size[members[start]]
        kinds = sorted(set(copies.values()), reverse=True)
        for times in kinds:
            found = copies if len(kinds) == 1 else [p for p, c in copies.items() if c == times]
            old: dict[int, int] = {}
            for p in found:
                size[p] += length * times
                g = group[p]
                last = ends[g] - 1
                if g not in old:
                    old[g] = last + 1
                ends[g] = last
                here, other = at[p], members[last]
                members[here], members[last] = other, p
                at[other], at[p] = here, last
            for p in found:
                group[p] = ends[group[p]]
            for g, end in old.items():
                ends[ends[g]] = end
        stop = start
    group.pop()
    return group, size, smaller


def repeat_classes(text: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Class number of the ``width`` bytes at each of ``starts``, from neighbours in the suffix array that share them."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    index = np.full(len(text), -1, dtype=np.int64)
    index[starts] = np.arange(len(starts))
    ordered = index[np.array(suffix_array(text), dtype=np.int64)]
    ordered = ordered[ordered >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, dtype=np.uint8), width)
    new = np.ones(len(ordered), dtype=bool)
    for a in range(1, len(ordered), 1 << 15):
        b = min(len(ordered), a + (1 << 15))
        new[a:b] = (windows[starts[ordered[a:b]]] != windows[starts[ordered[a - 1 : b - 1]]]).any(axis=1)
    out = np.empty(len(starts), dtype=np.int64)
    out[ordered] = np.cumsum(new) - 1
    return out
