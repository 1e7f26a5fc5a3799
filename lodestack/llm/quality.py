"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Every whole text gives a vector of statistics. A fixed random map turns it into
cosines that approximate a Gaussian kernel. Each partition sums its part of the
normal equations; the sums (a matrix of fixed size) are solved on the driver.
Isotonic calibration works on a fixed grid of raw scores, from rows that the
ridge did not see.

Defined results: a null text is an empty text and is scored; a null doc_id is
never held out and never labelled; repeated rows are scored alike, and a label
given twice counts twice; null labels are ignored; without any label every
score is 0.5; equal raw scores get equal calibrated ones, and a score that equals the
threshold is predicted 1; very long texts are read whole, one at a time; an empty table has no
rows. Extra columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, few_rows

GRID = 2000
_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,", "shout": b"!?", "mark": b"#$%&*^~", "bar": b"|<>{}[]\\=+_/@", "other": b"'\"();:-`", "high": range(128, 256)}
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
_WORD_END_MARK = re.compile(rb"[#$%&*!?^~|<>]+(?=\s|$)")


def statistics(text: bytes | None) -> list[float]:
    """Shape of a whole text: character classes, word and line lengths, repetition."""
    text = text or b""
    n = max(1, len(text))
    share = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=len(_CLASSES))[: len(_CLASSES)] / n
    words = text.split()
    count = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x]
    distinct_lines = len(set(lines)) / max(1, len(lines))
    distinct = len(set(words))
    marked = len(_WORD_END_MARK.findall(text))
    return [
        *np.sqrt(share).tolist(), np.log1p(len(words)), sizes.mean(), np.sqrt(sizes.var()), np.log1p(sizes.max()),
        distinct / count, np.log1p(count / max(1, distinct)), marked / count, np.log1p(len(lines)), np.log1p(len(text) / max(1, len(lines))),
        distinct_lines, float(not words), min(1.0, len(words) / 20),
    ]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Model:
    """A fitted classifier: maps an array of statistics to calibrated scores."""

    def __init__(self, mean, scale, width: int = 384, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(len(mean), width)) / np.sqrt(len(mean)) * 0.8
        self.phases = rng.uniform(0, 2 * np.pi, width)
        self.weights = np.zeros(width + 1)
        self.levels = np.full(GRID + 1, 0.5)

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def cell(self, rows: np.ndarray) -> np.ndarray:
        """Grid cell of the raw score."""
        raw = self.features(rows) @ self.weights
        return np.clip((raw + 0.5) / 2 * GRID, 0, GRID).astype(np.int64)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.levels[self.cell(rows)]


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means over the grid (pool adjacent violators); empty cells take their neighbours' line."""
    blocks: list[list[float]] = []
    for cell in np.flatnonzero(counts):
        blocks.append([sums[cell], counts[cell], cell, cell])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    if not blocks:
        return np.full(len(counts), 0.5)
    at = [x for s, c, a, b in blocks for x in (a, b)]
    level = [s / c for s, c, a, b in blocks for _ in (a, b)]
    return np.interp(np.arange(len(counts)), at, level)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches):
        for batch in few_rows(batches):
            rows = [statistics(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return _texts(docs).mapInArrow(run, "doc_id long, stats array<float>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _scores(model: Model, texts: list) -> np.ndarray:
    """Scores of texts as bytes."""
    if not texts:
        return np.zeros(0)
    return model.score(np.array([statistics(x) for x in texts], dtype=np.float32).astype(np.float64))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = 200_000, rows_a_task: int = 20_000, penalty: float = 1e-3) -> Model:
    """Fit on labelled rows that are not held out: four classes of the id's crc32, one of them for calibration.

    Of more than ``sample`` labels, the share of ids that makes about that many is used, chosen by hash;
    so the labels are small enough to broadcast, and only the texts of these ids are read for the fit.
    """
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(bucket != 0)
    share = int(sample / max(sample, known.count()) * (1 << 20))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    stats = document_statistics(texts)
    rows = work.save(stats.join(F.broadcast(known), "doc_id").select("stats", "y", (bucket == 1).alias("calibrates")))
    width = len(statistics(b""))
    sums = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).collect()  # one row per statistic
    if not sums:
        return Model(np.zeros(width), np.ones(width))
    by = {r["i"]: r for r in sums}
    model = Model(np.array([by[i]["m"] for i in range(width)]), np.array([by[i]["s"] or 1.0 for i in range(width)]))
    spread = rows.repartition(max(1, -(-by[0]["n"] // rows_a_task)))

    def normal_sums(batches):
        size = len(model.weights)
        gram, target = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            gram += z.T @ z
            target += z.T @ batch.column(1).to_numpy()
        both = np.column_stack([gram, target])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), type=pa.int32()), pa.array(list(both), type=pa.list_(pa.float64()))], names=["i", "sums"])

    parts = spread.where("not calibrates").select("stats", "y").mapInArrow(normal_sums, "i int, sums array<double>")
    total = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = total.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("sums"))
    solved = np.array([r["sums"] for r in total.orderBy("i").collect()])  # a fixed number of rows
    n = max(1.0, solved[-1, -2])
    model.weights = np.linalg.solve(solved[:, :-1] + penalty * n * np.eye(len(solved)) / len(solved), solved[:, -1])

    def cells(batches):
        for batch in batches:
            at = model.cell(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["cell", "y"])

    grid = spread.where("calibrates").select("stats", "y").mapInArrow(cells, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()  # GRID rows at most
    good, count = np.zeros(GRID + 1), np.zeros(GRID + 1)
    for r in grid:
        good[r["cell"]], count[r["cell"]] = r["s"], r["n"]
    if count.any():
        model.levels = isotonic(good, count)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches):
        for batch in few_rows(batches):
            found = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = _texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""

    at = docs.columns.index("text")

    def run(batches):
        for batch in few_rows(batches):
            if batch.num_rows:
                found = _scores(model, [x.encode() if x is not None else None for x in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
