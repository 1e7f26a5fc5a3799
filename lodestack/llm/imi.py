"""Embedding near-duplicates by an inverted multi-index.

Each half of the vectors has a codebook of its own, learned on a bounded sample;
their product is a grid of cells. Every vector stands in its home cell and
visits cells in the order of the multi-sequence algorithm, by how far it is
from each cell's border. The stopping distance comes from the target recall:
vectors of the sample are turned by exactly the linking angle in random directions,
and the distance must cover that share of the cells in which they land. With a recall of 1 it is the
distance that no linked pair exceeds: a border is never farther than what lies behind it, and linked unit vectors are
within the root of 2 - 2 * cosine of each other; that visits several times as many cells. Cosines
in double precision then decide. Equal vectors are one vector with a count.

Of two cells the vectors of the lower-numbered one visit the other, so a pair is
met once. How fine the grid is comes from the sample too: of several sizes the
one whose visits and comparisons cost least for the number of vectors at hand. A
crowded cell is dealt out as blocks of homes by blocks of visitors. A task
reports sums and stars, so its output grows with the vectors, not with the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite parts,
or that differ from the most common length, link with nothing and are kept;
rows without id link with nothing, have no component and are not kept; repeated rows link with each
other, and rows of one id with different vectors are vectors of their own; a pair's cosine is
summed in one order wherever it is met, so a link counts for both ends; an empty table gives an
empty result; extra columns play no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .components import components
from .simhash import roots
from .workspace import Workspace, few_rows

HOMES = 4_096
VISITORS = 4_096
ROWS_AT_ONCE = 256


def codebook(x: np.ndarray, size: int, rng, rounds: int = 8) -> np.ndarray:
    """k-means centres."""
    centres = x[rng.choice(len(x), size, replace=False)]
    for _ in range(rounds):
        near = (np.square(centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for k in range(size):
            if (own := near == k).any():
                centres[k] = x[own].mean(axis=0)
    return np.unique(centres, axis=0)


def cells_in_order(left: list[tuple[float, int]], right: list[tuple[float, int]], limit: float):
    """(left, right) of the sorted lists by their sum, up to ``limit``: the multi-sequence algorithm."""
    heap, met = [(left[0][0] + right[0][0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        yield left[i][1], right[j][1]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in met:
                met.add((a, b))
                heapq.heappush(heap, (left[a][0] + right[b][0], a, b))


class Grid:
    """Two codebooks and the stopping distance."""

    def __init__(self, sample: np.ndarray, cosine: float, size: int, recall: float = 0.9999, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.cosine, self.dims, self.size = cosine, sample.shape[1], size
        self.cut = max(1, self.dims // 2)
        self.books = [codebook(h, min(size, len(sample)) if h.shape[1] else 1, rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        self.gaps = [np.sqrt(np.maximum(1e-12, np.square(b[:, None] - b[None]).sum(axis=2))) for b in self.books]
        noise = rng.normal(size=sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.maximum(1e-12, np.linalg.norm(noise, axis=1, keepdims=True))
        turned = cosine * sample + np.sqrt(1 - cosine**2) * noise
        exact = 2 - 2 * cosine + 1e-9
        self.limit = exact if recall >= 1 else float(np.quantile(self.away(sample, self.homes(turned)), recall, method="higher")) * 1.05 + 1e-9

    @classmethod
    def fitting(cls, sample: np.ndarray, count: int, cosine: float, recall: float = 0.9999) -> Grid:
        """The grid of least estimated cost for ``count`` vectors: a row sent costs as much as a thousand comparisons."""
        best, least = None, float("inf")
        for size in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
            grid = cls(sample, cosine, size, recall)
            some = sample[:500]
            visits, cell = sum(map(len, grid.visits(some))) / len(some), count / size**2
            cost = visits * (1000 * max(1.0, cell / HOMES) + cell)
            if cost < least:
                best, least = grid, cost
            elif cost > 2 * least:
                break
        return best

    def _borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the home centre, and the squared distance to the border with each centre."""
        out = []
        for half, book, gap in ((x[:, : self.cut], self.books[0], self.gaps[0]), (x[:, self.cut :], self.books[1], self.gaps[1])):
            far = np.square(half).sum(axis=1)[:, None] - 2 * half @ book.T + np.square(book).sum(axis=1)
            home = far.argmin(axis=1)
            border = np.maximum(0, far - far[np.arange(len(x)), home][:, None]) / (2 * gap[home])
            border[np.arange(len(x)), home] = 0
            out.append((home, np.square(border)))
        return out

    def homes(self, x: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self._borders(x)
        return a * len(self.books[1]) + b

    def away(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """What the traversal from each vector orders its cell by."""
        (_, left), (_, right) = self._borders(x)
        at = np.arange(len(x))
        return left[at, cells // len(self.books[1])] + right[at, cells % len(self.books[1])]

    def visits(self, x: np.ndarray):
        """Visited cells of each vector: its home and those of higher numbers."""
        (a, left), (b, right) = self._borders(x)
        width = len(self.books[1])
        for home, one, two in zip((a * width + b).tolist(), left, right, strict=True):
            lists = [sorted((float(h[i]), int(i)) for i in np.flatnonzero(h <= self.limit)) for h in (one, two)]
            yield [home, *(c for i, j in cells_in_order(lists[0], lists[1], self.limit) if (c := i * width + j) > home)]


def near_duplicates(rows: DataFrame, cosine: float = 0.95, recall: float = 0.9999) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, vector); with ``recall`` 1 no link is missed."""
    spark, work = rows.sparkSession, Workspace(rows.sparkSession)
    rows = rows.withColumn("ok", vectors.usable(F.col("vector")) & F.col("vec_id").isNotNull())
    dims = vectors.common_length(rows.where("ok"))
    rows = rows.withColumn("ok", F.col("ok") & (F.size("vector") == dims))
    good = rows.where("ok").select("vec_id", "vector")
    distinct = good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    distinct = work.save(distinct.withColumn("rep", F.monotonically_increasing_id()))  # a vector's own number, fixed once it is written
    count = distinct.count()
    alone = lambda x: x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not count:
        return alone(rows)
    grid = Grid.fitting(vectors.sample(distinct.select(F.col("first_id").alias("vec_id"), "vector"), dims), count, cosine, recall)
    shared = spark.sparkContext.broadcast(grid)  # two codebooks of 256 centres at most

    def place(batches):
        grid = shared.value
        for batch in few_rows(batches):
            x = vectors.matrix(batch.column(0), dims)
            cells = list(grid.visits(x / np.linalg.norm(x, axis=1, keepdims=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c[0] for c in cells], type=pa.int64()), pa.array(cells, type=pa.list_(pa.int64()))], names=["vector", "rep", "n", "home", "cells"])

    kind = distinct.schema["vector"].dataType.simpleString()
    placed = work.save(distinct.select("vector", "rep", "n").mapInArrow(place, f"vector {kind}, rep long, n long, home long, cells array<long>"))
    sizes = placed.select(F.explode("cells").alias("cell"), (F.col("cell") == F.col("home")).alias("at_home")).groupBy("cell")
    sizes = sizes.agg(F.ceil(F.sum(F.col("at_home").cast("long")) / HOMES).alias("hs"), F.ceil(F.count("*") / VISITORS).alias("vs")).where("hs > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # sizes: a row for each cell, 65536 at most
    visitors = placed.select(F.explode("cells").alias("cell"), "vector", "rep", "n", "home").join(F.broadcast(sizes), "cell")
    homes = placed.select(F.col("home").alias("cell"), "vector", "rep", "n", "home").join(F.broadcast(sizes), "cell")
    names = ["cell", "h", "v", "role", "rep", "n", "home", "vector"]
    visitors = visitors.withColumn("v", F.pmod(F.xxhash64("rep"), "vs")).withColumn("h", every("hs")).withColumn("role", F.lit(1)).select(*names)
    homes = homes.withColumn("h", F.pmod(F.xxhash64("rep", F.lit(1)), "hs")).withColumn("v", every("vs")).withColumn("role", F.lit(0)).select(*names)

    def compare(batches):
        grid = shared.value
        for _, table in vectors.groups(batches, 3):
            role = table.column(3).to_numpy()
            rep, n, home = (table.column(i).to_numpy() for i in (4, 5, 6))
            x = vectors.matrix(table.column(7).combine_chunks(), dims)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            hs, vs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(hs) or not len(vs):
                continue
            links, top = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
            inside, same = home[vs] == home[hs[0]], x[hs].T
            for part in np.array_split(np.arange(len(vs)), len(vs) // ROWS_AT_ONCE + 1):
                score = x[vs[part]] @ same
                i, j = np.nonzero(score >= grid.cosine - 1e-9)
                v, h = vs[part[i]], hs[j]
                once = ~inside[part[i]] | (rep[v] < rep[h])  # a pair of one cell is met from both sides
                v, h, value = v[once], h[once], score[i, j][once]
                sure = value >= grid.cosine + 1e-9
                if not sure.all():  # near the threshold a sum of fixed order decides
                    sure[~sure] = (x[v[~sure]] * x[h[~sure]]).sum(axis=1) >= grid.cosine
                    v, h = v[sure], h[sure]
                if len(v):
                    np.add.at(links, v, n[h])
                    np.add.at(links, h, n[v])
                    top = roots(len(rep), np.concatenate([top, v]), np.concatenate([np.arange(len(rep)), h]))
            ids, at = np.unique(rep, return_inverse=True)  # a home that visits its own cell stands here twice
            total, linked = np.zeros(len(ids), dtype=np.int64), np.flatnonzero(links > 0)
            if not len(linked):
                continue
            np.add.at(total, at, links)
            top = roots(len(ids), at[top[linked]], at[linked])
            keep = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(total[keep]), pa.array(ids[top[keep]])], names=["rep", "links", "root"])

    units = visitors.unionByName(homes).repartition("cell", "h", "v").sortWithinPartitions("cell", "h", "v")
    found = work.save(units.mapInArrow(compare, "rep long, links long, root long"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")), work)
    summed = distinct.join(sums, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = summed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    summed = summed.join(least, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(summed, "vector").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone(rows.where(~F.col("ok"))))
