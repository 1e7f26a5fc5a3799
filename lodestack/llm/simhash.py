"""SimHash near-duplicates by bit-sliced comparison.

Distinct fingerprints meet in the buckets of several bit masks. Masks made of
whole blocks are exact (pigeonhole): with ``radius + 2`` blocks, two
fingerprints within the radius agree on at least two of them. A bucket of many
fingerprints is dealt out as pairs of sub-blocks, so that no task holds it whole. Inside
a block the fingerprints are stored as bit planes; carry-save counters add the
differing bits of 64 comparisons at once, and a row of comparisons is abandoned
once all of it exceeds the radius. A task reports each link group as a star, so
its output grows with the fingerprints and not with the pairs.

Defined results: a null or blank text has the fingerprint zero and is linked
like any other; null doc_ids keep their row and take no part in the minimum;
repeated rows fall into one component; very long texts are hashed whole, one at a time;
columns beside doc_id and text play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .components import components
from .workspace import Workspace, few_rows

BLOCK = 2048
#: Pairs of a block that are tested at once.
PAIRS = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit majority of the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in few_rows(batches):
            fps = [fingerprint(shingle_hashes(x, width, seed)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes independent of the given ones for each ``k``; the given ones for 0."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & int(ONES))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def block_masks(radius: int) -> list[int]:
    """Masks of every two of ``radius + 2`` blocks: exact for that radius."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in itertools.pairwise(edges)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Counters:
    """Carry-save counters over bit slices, saturating above the radius."""

    def __init__(self, over: np.ndarray, radius: int):
        self.radius, self.over = radius, over
        self.planes = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]

    def add(self, differ: np.ndarray) -> None:
        for i, plane in enumerate(self.planes):
            carry = plane & differ
            self.planes[i] = plane ^ differ
            differ = carry
        self.over = self.over | differ

    def exceeded(self) -> np.ndarray:
        """Bits of the comparisons whose count is over the radius."""
        more, equal = self.over, ~self.over
        for i in reversed(range(len(self.planes))):
            if self.radius >> i & 1:
                equal = equal & self.planes[i]
            else:
                more, equal = more | equal & self.planes[i], equal & ~self.planes[i]
        return more

    def keep(self, rows: np.ndarray) -> None:
        self.over = self.over[rows]
        self.planes = [p[rows] for p in self.planes]


def close_parts(fps: np.ndarray, radius: int, rows_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints that differ in at most ``radius`` bits, in parts of bounded size."""
    n = len(fps)
    width = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    slices = np.zeros((64, width * 64), dtype=np.uint8)
    slices[:, :n] = bits.T
    planes = np.packbits(slices, axis=1, bitorder="little").view(np.uint64).reshape(64, width)
    for start in range(0, n, rows_at_once):
        rows = np.arange(start, min(n, start + rows_at_once))
        done = np.arange(width * 64)[None, :] <= rows[:, None]  # each pair once
        done[:, n:] = True
        count = Counters(np.packbits(done, axis=1, bitorder="little").view(np.uint64).reshape(len(rows), width), radius)
        for bit in range(64):
            flip = np.where(bits[rows, bit] == 1, ONES, np.uint64(0))[:, None]
            count.add(planes[bit][None, :] ^ flip)
            if bit % 8 == 7 and bit > radius:
                alive = (count.exceeded() != ONES).any(axis=1)
                if not alive.all():
                    rows = rows[alive]
                    count.keep(alive)
                if not len(rows):
                    break
        if len(rows):
            near = np.unpackbits((~count.exceeded()).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            yield rows[i], j


def close_pairs(fps: np.ndarray, radius: int, rows_at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of fingerprints that differ in at most ``radius`` bits."""
    none = np.zeros(0, dtype=np.int64)
    left, right = zip((none, none), *close_parts(fps, radius, rows_at_once), strict=True)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index of each index's group, by passing minima along the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def _units(batches, columns: int) -> Iterator[np.ndarray]:
    """Rows of the sorted batches in blocks that end between two units, which the first three columns name."""
    kept = []
    for batch in batches:
        kept.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]))
        table = np.concatenate(kept)
        changes = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1)) + 1
        start = 0
        for at in changes:
            if at - start >= 256:
                yield table[start:at]
                start = at
        kept = [table[start:]]
    if kept and len(kept[0]):
        yield kept[0]


def _dealt(keyed: DataFrame, by: str) -> DataFrame:
    """Rows of keys that several rows share, with (key, low, high) in front; rows of a large key meet in pairs of sub-blocks."""
    rest = [c for c in keyed.columns if c != "key"]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    split = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64(by), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = split.select("key", F.least("own", "other").cast("long").alias("low"), F.greatest("own", "other").cast("long").alias("high"), *rest)
    return units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (column fp): stars over
    each task's link groups, the same components as all links."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    keyed = distinct.select(F.explode(keys).alias("key"), "fp")

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for table in _units(batches, 4):
            fps = np.unique(table[:, 3])
            i, j = close_pairs(fps.view(np.uint64), radius)
            if not len(i):
                continue
            top = roots(len(fps), i, j)
            member = np.flatnonzero(top != np.arange(len(fps)))
            found = set(zip(fps[top[member]].tolist(), fps[member].tolist(), strict=True))
            new = found - seen
            seen = seen | new if len(seen) < 500_000 else new
            if new:
                yield _batch(*zip(*new, strict=True))

    return _dealt(keyed, "fp").mapInArrow(run, "a long, b long")


def _across(fp: np.ndarray, w1: np.ndarray, w2: np.ndarray, group: np.ndarray, radius: int, wide_radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of different groups, close by both tests, with the differing bits of w1 and w2."""
    if (group == group[0]).all():
        return
    for i, j in close_parts(fp.view(np.uint64), radius, 128):
        apart = np.flatnonzero(group[i] != group[j])
        i, j = i[apart], j[apart]
        differ = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in (w1, w2))
        close = differ <= wide_radius
        if close.any():
            yield i[close], j[close], differ[close]


def _members(table: np.ndarray) -> list[np.ndarray]:
    """node, fp, w1, w2, group of a block, each node once."""
    at = np.unique(table[:, 3], return_index=True)[1]
    return [np.ascontiguousarray(table[at, c]) for c in range(3, 8)]


def partners(keyed: DataFrame, radius: int, wide_radius: int) -> DataFrame:
    """Pairs (a, b) of close nodes that share a key: each node's nearest and least partner of a block.

    ``keyed`` has key, node, fp, w1, w2, group.
    """

    def run(batches):
        for table in _units(batches, 8):
            node, *rest = _members(table)
            nearest, least = np.full(len(node), 1 << 62), np.full(len(node), len(node))
            for i, j, differ in _across(*rest, radius, wide_radius):
                for one, two in ((i, j), (j, i)):
                    np.minimum.at(nearest, one, differ << 32 | two)
                    np.minimum.at(least, one, two)
            met = np.flatnonzero(least < len(node))
            if len(met):
                one, two = np.tile(node[met], 2), node[np.concatenate([nearest[met] & 0xFFFFFFFF, least[met]])]
                yield _batch(np.minimum(one, two), np.maximum(one, two))

    return _dealt(keyed, "node").mapInArrow(run, "a long, b long").distinct()


def meetings(keyed: DataFrame, radius: int, wide_radius: int, dense: int = 4) -> DataFrame:
    """Every pair of close nodes of different groups that share a key.

    A block of at most ``dense`` pairs a node gives the pairs (a, b), its ``unit`` null;
    any other gives its nodes, as rows (unit, a = node, b = group, fp, w1, w2) that
    ``_close_in_units`` pairs again, so rows grow with the nodes and not with the pairs.
    """
    names = ["unit", "a", "b", "fp", "w1", "w2"]

    def run(batches):
        for table in _units(batches, 8):
            node, fp, w1, w2, group = _members(table)
            kept, pairs, met = [], 0, np.zeros(len(node), dtype=bool)
            for i, j, _ in _across(fp, w1, w2, group, radius, wide_radius):
                met[i] = met[j] = True
                pairs += len(i)
                if pairs <= dense * len(node):
                    kept.append((i, j))
            if not pairs:
                continue
            if pairs <= dense * met.sum():
                i, j = map(np.concatenate, zip(*kept, strict=True))
                none = pa.nulls(len(i), pa.int64())
                columns = [none, pa.array(node[i]), pa.array(node[j]), none, none, none]
            else:
                unit = _signed(xxhash.xxh64_intdigest(np.ascontiguousarray(table[0, :3]).tobytes()))
                columns = [pa.array(x) for x in (np.full(int(met.sum()), unit), node[met], group[met], fp[met], w1[met], w2[met])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _dealt(keyed, "node").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row, linked within ``radius`` bits."""
    work = Workspace(docs.sparkSession)
    fps = work.save(fingerprints(docs, width, seed))
    distinct = work.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = components(links(distinct, radius, block_masks(radius)), work)
    return _with_component(fps.withColumn("node", F.col("fp")), distinct.withColumnRenamed("fp", "node"), groups).select("doc_id", "fp", "component_id")


def _with_component(rows: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their node's component: its ``root`` and its least first_id."""
    rooted = distinct.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("node", "root", "component_id"), "node")


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, in order of their hashes."""
    return np.unique(shingle_hashes(text, width))


def set_id(shingles: np.ndarray) -> int:
    """64 bits that name a set of shingles, as a signed long."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes()))


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: sets of similarity s share a given one with probability s ** rows."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    odd = np.random.default_rng(7).integers(0, 1 << 63, (2, bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, ONES)
    for start in range(0, len(shingles), 4096):
        least = np.minimum(least, (remixed(shingles[start : start + 4096], 3)[None, :] * odd[0] + odd[1]).min(axis=1))
    mixed = (remixed(least, 4) * odd[1, :, 0]).reshape(bands, rows).sum(axis=1, dtype=np.uint64)
    return remixed(mixed + np.arange(bands, dtype=np.uint64), 5).view(np.int64)


def _set_fingerprints(docs: DataFrame, width: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, text_key, node, fp, w1, w2, keys) of every row: the text's hash, the set's name, three fingerprints and the band keys, all of the distinct shingles."""

    def run(batches):
        for batch in few_rows(batches):
            sets = [shingle_set(x, width) for x in batch.column(2).to_pylist()]
            columns = [[set_id(x) for x in sets], *([fingerprint(remixed(x, k)) for x in sets] for k in range(3))]
            keys = pa.array([band_keys(x, bands, band_rows) for x in sets], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=pa.int64()) for c in columns), keys], names=["doc_id", "text_key", "node", "fp", "w1", "w2", "keys"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, text_key long, node long, fp long, w1 long, w2 long, keys array<long>")


def text_key(text: Column | None = None) -> Column:
    """A hash of the text column; a null text counts as empty."""
    return F.xxhash64(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")))


def near_duplicates_checked(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24, wide_radius: int = 46, bands: int = 24, band_rows: int = 4) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id), linking documents of which at least ``similarity`` of the distinct shingles agree.

    Texts meet where one of ``bands`` keys agrees, each made of ``band_rows`` least
    hashes of the set; at 0.8 similarity one does with probability 0.999997. The
    SimHash fingerprints part chance neighbours from the rest without their
    texts: ``radius`` of 64 bits and ``wide_radius`` of 128 more are at least five
    deviations above what 0.8 similarity gives; the shingles of the whole
    texts decide what remains. A first round makes groups from a few partners of
    each text; the second takes every pair across two groups: a link inside a
    group adds nothing. Texts of the same distinct shingles are one node; texts
    of one fingerprint need not be.
    """
    work = Workspace(docs.sparkSession)
    rows = work.save(_set_fingerprints(docs, width, bands, band_rows))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fp", "w1", "w2", "keys"))).alias("first")
    known = work.save(rows.groupBy("node").agg(first).select("node", F.col("first.doc_id").alias("first_id"), "first.fp", "first.w1", "first.w2", "first.keys"))
    distinct = known.select("node", "first_id")
    nodes = known.where("first_id is not null")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "fp", "w1", "w2", F.col("node").alias("group"))
    pairs = work.save(partners(keyed, radius, wide_radius))
    same = work.save(_close_by_shingles(pairs, _shingle_sets(pairs, distinct, docs, width, work), similarity))
    groups = components(same, work)
    grouped = nodes.join(groups, "node", "left").withColumn("group", F.coalesce("root", "node"))
    met = work.save(meetings(grouped.select(F.explode("keys").alias("key"), "node", "fp", "w1", "w2", "group"), radius, wide_radius))
    pairs, units = met.where("unit is null").select("a", "b").distinct(), met.where("unit is not null")
    sets = _shingle_sets(met.select("a", F.when(F.col("unit").isNull(), F.col("b")).alias("b")), distinct, docs, width, work)
    more = work.save(_close_by_shingles(pairs, sets, similarity).unionByName(_close_in_units(units, sets, radius, wide_radius, similarity)))
    groups = components(same.unionByName(more), work)
    return _with_component(rows, distinct, groups).select("doc_id", "text_key", "fp", "root", "component_id")


def _shingle_sets(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, width: int, work: Workspace) -> DataFrame:
    """(node, shingles) of the nodes of ``pairs``, from the whole texts."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = distinct.join(ends, "node").select(F.col("first_id").alias("doc_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        for batch in few_rows(batches):
            own = [shingle_set(x, width) for x in batch.column(0).to_pylist()]
            sets = pa.array([x.view(np.int64) for x in own], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in own], type=pa.int64()), sets], names=["node", "shingles"])

    sets = own.join(chosen, "doc_id", "left_semi").select("text").mapInArrow(run, "node long, shingles array<long>")
    return work.save(sets.dropDuplicates(["node"]))


def _close_by_shingles(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of which the whole texts share ``similarity`` of their distinct shingles."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def shared_counts(sets: list[np.ndarray], limit: int = 1 << 26) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of index pairs that counts the shingles both sets have, by bit rows of at most ``limit`` bytes in all."""
    values, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # what one set has alone is shared by none
    width = int((often > 1).sum()) // 64 + 1
    if width * 8 * len(sets) > limit:
        return lambda i, j: np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    rows = np.zeros((len(sets), width), dtype=np.uint64)
    own, end = at.reshape(-1), 0
    for row, one in zip(rows, sets, strict=True):
        mine = own[end : (end := end + len(one))]
        mine = place[mine[often[mine] > 1]]
        np.bitwise_or.at(row, mine >> 6, np.uint64(1) << (mine & 63).astype(np.uint64))
    step = max(1, (1 << 20) // width)
    count = lambda i, j: np.bitwise_count(rows[i] & rows[j]).sum(axis=1, dtype=np.int64)
    return lambda i, j: np.concatenate([count(i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)])


def _close_in_units(units: DataFrame, sets: DataFrame, radius: int, wide_radius: int, similarity: float) -> DataFrame:
    """Links of the pairs of crowded blocks by the test of ``_close_by_shingles``, as stars."""

    def run(batches):
        for _, table in vectors.groups(batches, 1):
            node, group, fp, w1, w2 = (table.column(c).to_numpy() for c in range(1, 6))
            held = [x.values.to_numpy().view(np.uint64) for x in table.column(6)]
            size, shared = np.array([len(x) for x in held]), shared_counts(held)
            top, own = np.arange(len(node)), np.arange(len(node))
            for i, j, _ in _across(fp, w1, w2, group, radius, wide_radius):
                for at in range(0, len(i), PAIRS):
                    # What is linked already needs no test, and the links are kept as stars.
                    one, two = i[at : at + PAIRS], j[at : at + PAIRS]
                    apart = top[one] != top[two]
                    one, two = one[apart], two[apart]
                    both = shared(one, two) if len(one) else np.zeros(0, dtype=np.int64)
                    close = both >= similarity * (size[one] + size[two] - both)
                    if close.any():
                        star = np.flatnonzero(top != own)
                        top = roots(len(node), np.concatenate([top[star], one[close]]), np.concatenate([star, two[close]]))
            member = np.flatnonzero(top != own)
            if len(member):
                yield _batch(node[top[member]], node[member])

    held = units.join(sets.withColumnRenamed("node", "a"), "a").select("unit", "a", "b", "fp", "w1", "w2", "shingles")
    return held.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")
