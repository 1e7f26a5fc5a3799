"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned on a bounded sample (iterative quantisation). Codes are cut
into 16-bit substrings, each with a table of its own. A query probes all tables
in rings: first the values equal to its own, then those one bit apart, and so on.
After ring s every code within ``substrings * (s + 1) - 1`` bits has been met
(pigeonhole), and those near enough are reranked by cosine in double precision.
How many bits a neighbour of a given cosine may be away is learned from the
sample's true neighbours, so a query ends as soon as what it has not met can
hardly beat its k-th best: after one or two rings among close vectors, after
most rings among vectors spread over the sphere. Every vector is indexed, in
blocks of bounded size; the stated query set meets the blocks in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite parts,
or that differ from the most common length, take no part; rows without id
neither; of repeated rows each is a candidate (rows of a query's own id are not);
a query id of several vectors gets a ranking for each distinct one; equal vectors
have equal scores wherever they stand, and ties go to the smaller id; an empty
table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

BLOCK = 16_384
QUERY_BLOCK = 32_768


class Codes:
    """Learned rotations to binary codes, and how far apart the codes of neighbours are."""

    def __init__(self, sample: np.ndarray, dims: int, k: int, rotations: int = 4, recall: float = 0.985, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.dims, self.k = dims, k
        parts = [self._learn(sample, rng) for _ in range(max(rotations, -(-32 // max(1, dims))))]
        wide = np.hstack(parts)
        self.bits = wide.shape[1] // 16 * 16
        self.turn = wide[:, : self.bits]
        self.slack = self._slack(sample, recall, rng)

    def _learn(self, sample: np.ndarray, rng, rounds: int = 30) -> np.ndarray:
        turn, _ = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(np.sign(sample @ turn).T @ sample)
            turn = (u @ v).T
        return turn

    def encode(self, x: np.ndarray) -> np.ndarray:
        """16-bit substrings of the codes."""
        return np.packbits(x @ self.turn > 0, axis=1).view(">u2").astype(np.uint16)

    def _slack(self, sample: np.ndarray, recall: float, rng) -> float:
        """By how many bits true neighbours exceed what their angle gives, at that share of them."""
        if len(sample) <= self.k:
            return float(self.bits)
        asked = sample[rng.choice(len(sample), min(400, len(sample)), replace=False)]
        cosine = asked @ sample.T
        near = np.argsort(-cosine, axis=1)[:, 1 : self.k + 1]
        codes = self.encode(sample)
        apart = np.bitwise_count(codes[near] ^ self.encode(asked)[:, None, :]).sum(axis=2)
        return float(np.quantile(apart - self.expected(np.take_along_axis(cosine, near, axis=1)), recall, method="higher"))

    def expected(self, cosine):
        """Differing bits of two vectors of that cosine."""
        return self.bits * np.arccos(np.clip(cosine, -1, 1)) / np.pi


RINGS = [np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) == s) for s in range(17)]


class Index:
    """Substring tables of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange((1 << 16) + 1)) for c, o in zip(codes.T, self.order, strict=True)]

    def rings(self, query: np.ndarray):
        """Rows first met at each ring: those with a substring that is that many bits from the query's."""
        met = np.zeros(len(self.codes), dtype=bool)
        for ring in RINGS:
            new = []
            for value, order, starts in zip(query.tolist(), self.order, self.starts, strict=True):
                at = ring ^ value
                low, size = starts[at], starts[at + 1] - starts[at]
                low, size = low[size > 0], size[size > 0]
                rows = order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
                rows = rows[~met[rows]]
                met[rows] = True
                new.append(rows)
            yield np.concatenate(new)

    def nearest(self, vector: np.ndarray, base: np.ndarray, others: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores) of what was reranked, the ``k`` best of what was met among them, and how many codes were met."""
        code, pieces = codes.encode(vector[None])[0], self.codes.shape[1]
        rows, apart = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found, scores, met, radius = [], np.zeros(0), 0, float(codes.bits)
        for s, new in enumerate(self.rings(code)):
            met += len(new)
            new = new[others[new]]
            rows = np.concatenate([rows, new])
            apart = np.concatenate([apart, np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64)])
            complete = pieces * (s + 1) - 1
            near = apart <= min(complete, radius)
            if near.any():
                found.append(rows[near])
                scores = np.concatenate([scores, (base[rows[near]] * vector).sum(axis=1)])  # row by row: equal vectors have equal scores
                rows, apart = rows[~near], apart[~near]
                if len(scores) >= codes.k:
                    radius = float(codes.expected(np.partition(scores, -codes.k)[-codes.k])) + codes.slack
            if complete >= radius:
                break
        return np.concatenate(found) if found else rows[:0], scores, met


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found; ``rows`` has vec_id and vector."""
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null").where(vectors.usable(F.col("vector")))
    dims = vectors.common_length(rows)
    codes = Codes(vectors.sample(rows, dims), dims, k) if dims else None
    shared = spark.sparkContext.broadcast(codes)  # rotations: dims x bits numbers
    rows = rows.where(F.size("vector") == dims)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, asks = max(1, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    ask = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select(block.alias("block"), every(asks).alias("ask"), F.lit(0).alias("asks"), "vec_id", F.lit(0).cast("long").alias("form"), "vector")
    asked = rows.where(is_query).dropDuplicates(["vec_id", "vector"])
    queries = asked.select(every(blocks).alias("block"), ask.alias("ask"), F.lit(1).alias("asks"), "vec_id", F.xxhash64("vector").alias("form"), "vector")

    def run(batches):
        codes = shared.value
        for _, table in vectors.groups(batches, 2):
            asks = table.column(2).to_numpy() == 1
            ids, form, x = table.column(3).to_numpy(), table.column(4).to_numpy(), vectors.matrix(table.column(5).combine_chunks(), codes.dims)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            held, base = ids[~asks], unit[~asks]
            if not asks.any() or not len(held):
                continue
            index, out = Index(codes.encode(base)), []
            for qid, f, q in zip(ids[asks].tolist(), form[asks].tolist(), unit[asks], strict=True):
                near, score, _ = index.nearest(q, base, held != qid, codes)
                top = np.lexsort((held[near], -score))[: codes.k]
                out += [(qid, f, int(held[near[i]]), float(score[i])) for i in top]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "form", "vec_id", "score"])

    units = index.unionByName(queries).repartition("block", "ask").sortWithinPartitions("block", "ask")
    found = units.mapInArrow(run, "query_id long, form long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
