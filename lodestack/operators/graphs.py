"""Approximate nearest vectors by walks over small-world graphs, filters inside the walk.

The rows are dealt to cells as in ``cells``, a cell of more than ``ROWS_A_GRAPH`` rows to
several graphs by hash, so that one task holds a graph. Executors link each row
with its nearest others in the graph, those with it, and a few at random, which keep the
graph in one piece. A search walks the graphs of the nearest cells from row to row
towards the query, best first, and looks at the vectors it meets instead of all. A
row that fails the filter is walked through but not kept, and the walk goes on until as many
rows are kept as the beam is wide. The steps grow as the share of passing rows shrinks; where comparing
all passing rows is cheaper than that, it is done, so a narrow filter costs no answers.

Queries come as a table; one query is a table of one row. Rows and ties as in ``cells``; rows that repeat a
chunk_id are rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import search
from .cells import OWN, CellIndex, cells_for
from .filters import predicate

ROWS_A_GRAPH = 16_384
NEAR, FAR, ENTRIES = 16, 4, 8
#: Vectors compared for each row of the beam's width, as measured on evenly spread vectors.
STEPS, BEAM = 30, 224
QUERIES_A_TASK = 16_384
#: Scores held at once while links are made, and rows (query and graph) handed on at once while queries are dealt.
SCORES, DEALT = 2_000_000, 16_384
#: The part of the nearest that the probed cells have to hold; walks lose some more, so this is above what a search is to find.
PROBED = 0.99


def links_of(unit: np.ndarray, near: int = NEAR, far: int = FAR, seed: int = 3) -> list[np.ndarray]:
    """The neighbours of each row: its ``near`` nearest, the rows it is near to (twice as many at most), ``far`` at random."""
    n = len(unit)
    rng, back, out = np.random.default_rng(seed), [[] for _ in range(n)], []
    step = max(1, SCORES // max(1, n))
    for start in range(0, n, step):
        score = unit[start : start + step] @ unit.T
        score[np.arange(len(score)), np.arange(start, start + len(score))] = -2.0
        # A copy: a view of it would keep the whole block's order, rows squared in all.
        kept = np.argpartition(-score, min(near, n - 1) - 1, axis=1)[:, :near].copy() if n > 1 else np.zeros((n, 0), dtype=np.int64)
        out.extend(kept)
        for row, found in enumerate(kept.tolist(), start):
            for other in found:
                if len(back[other]) < 2 * near:
                    back[other].append(row)
    return [np.setdiff1d(np.concatenate([kept, np.array(back[i], dtype=np.int64), rng.integers(0, n, far)]), [i]) for i, kept in enumerate(out)]


def walk(unit: np.ndarray, starts: np.ndarray, flat: np.ndarray, passes: np.ndarray, asked: np.ndarray, beam: int) -> tuple[list[int], int]:
    """Rows kept on a walk towards ``asked``, and the number of vectors it was compared with.

    ``flat[starts[i]:starts[i + 1]]`` are the neighbours of row i.
    """
    passing = np.flatnonzero(passes)
    if len(passing) ** 2 <= STEPS * beam * len(unit):
        scores = unit[passing] @ asked
        best = np.argsort(-scores, kind="stable")[:beam]
        return passing[best].tolist(), len(passing)
    met = np.zeros(len(unit), dtype=bool)
    new = np.unique(np.linspace(0, len(unit) - 1, ENTRIES).astype(np.int64))
    todo: list[tuple[float, int]] = []
    kept: list[tuple[float, int]] = []
    seen = 0
    while True:
        met[new] = True
        seen += len(new)
        scores = unit[new] @ asked
        for score, row in zip(scores.tolist(), new.tolist(), strict=True):
            if len(kept) < beam or score > kept[0][0]:
                heapq.heappush(todo, (-score, row))
                if passes[row]:
                    (heapq.heappush if len(kept) < beam else heapq.heapreplace)(kept, (score, row))
        if not todo or (len(kept) == beam and -todo[0][0] < kept[0][0]):
            return [row for _, row in kept], seen
        _, row = heapq.heappop(todo)
        new = flat[starts[row] : starts[row + 1]]
        new = new[~met[new]]


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.combine_chunks()
    x = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class GraphIndex(CellIndex):
    """An index under ``path``; ``build`` as for ``CellIndex``, by default with a cell for every ``ROWS_A_GRAPH`` rows and probes for ``PROBED`` of the nearest."""

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, **more: Any) -> GraphIndex:
        return super().build(chunks, path, cells or min(4_096, -(-chunks.count() // ROWS_A_GRAPH) or 1), **({"recall": PROBED} | more))

    @classmethod
    def _write(cls, dealt: DataFrame, path: str) -> None:
        held = f"{path}-dealt"
        dealt.write.mode("overwrite").parquet(held)
        dealt = dealt.sparkSession.read.schema(dealt.schema).parquet(held)
        sizes = dealt.groupBy("index_cell").agg(F.ceil(F.count("*") / ROWS_A_GRAPH).cast("int").alias("_parts"))
        parted = dealt.join(F.broadcast(sizes), "index_cell").withColumn("index_part", F.pmod(F.xxhash64("chunk_id", F.monotonically_increasing_id()), F.col("_parts")).cast("int")).drop("_parts")
        schema = StructType([*(f for f in dealt.schema if f.name != "index_cell"), *OWN])

        def linked(rows: pa.Table) -> pa.Table:
            links = links_of(_unit(rows.column("vector")))
            own = {"index_cell": rows.column("index_cell"), "index_part": rows.column("index_part"), "index_node": pa.array(np.arange(rows.num_rows, dtype=np.int32)), "index_links": pa.array([x.tolist() for x in links], pa.list_(pa.int32()))}
            return pa.table({c: rows.column(c) for c in schema.names if c not in own} | own)

        made = parted.groupBy("index_cell", "index_part").applyInArrow(linked, schema)
        made.write.mode("overwrite").partitionBy("index_cell").parquet(path)
        hadoop = dealt.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(held)
        hadoop.getFileSystem(dealt.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def walked(self, queries: DataFrame, k: int, filters: dict[str, Any] | None = None, probes: int | None = None, beam: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, seen, index_cell, index_part, index_node) of the best ``k`` rows of each graph walked for each query (query_id, query_vector).

        ``seen`` counts the vectors compared with the query in that graph.
        """
        dims, centres, passing, probes, beam = self.about["dims"], self.centres, self.passing(filters), probes or self.about["probes"], max(beam or BEAM, k)
        parts = np.array([max(1, -(-self.about["sizes"].get(str(c), 0) // ROWS_A_GRAPH)) for c in range(max(1, self.about["cells"]))])
        kinds = dict(queries.dtypes)["query_id"], dict(self._held(StructType.fromJson(self.about["schema"]), None).dtypes)["chunk_id"]
        blocks = max(1, -(-queries.count() // QUERIES_A_TASK))

        step = max(1, DEALT // int(parts.sum()))

        def dealt(batches):
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                cells = cells_for(_unit(pa.chunked_array([batch.column("query_vector")])), centres, passing, probes, k)
                at = [(i, int(c), p) for i, own in enumerate(cells) for c in own for p in range(parts[c])]
                rows, cell, part = (np.array(x, dtype=np.int32) for x in zip(*at, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows)), batch.column("query_vector").take(pa.array(rows)), pa.array(cell), pa.array(part), batch.column("block").take(pa.array(rows))], names=["query_id", "query_vector", "index_cell", "index_part", "block"])

        usable = queries.where((F.size("query_vector") == dims) & search.finite(F.col("query_vector")) & F.exists("query_vector", lambda x: x != 0))
        usable = usable.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
        asked = usable.mapInArrow(dealt, f"query_id {kinds[0]}, query_vector array<double>, index_cell int, index_part int, block int")
        where = predicate(filters)
        held = self._held(StructType.fromJson(self.about["schema"]), None).withColumn("_passes", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
        held = held.select("index_cell", "index_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "index_node", "index_links", "chunk_id", "vector", "_passes")

        def find(rows: pa.Table, wanted: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if rows.num_rows and wanted.num_rows:
                rows = rows.sort_by("index_node")
                unit, links = _unit(rows.column("vector")), rows.column("index_links").combine_chunks()
                starts, flat, passes = links.offsets.to_numpy(), links.flatten().to_numpy(), rows.column("_passes").to_numpy()
                names = rows.column("chunk_id").to_pylist()
                for i, vector in enumerate(_unit(wanted.column("query_vector"))):
                    kept, seen = walk(unit, starts, flat, passes, vector, beam)
                    best = sorted((-float(unit[r] @ vector), names[r], r) for r in kept)[:k]
                    out += [(i, name, -score, seen, r) for score, name, r in best]
            at, name, score, seen, node = zip(*out, strict=True) if out else ([],) * 5
            same = lambda c: pa.array([rows.column(c)[0].as_py() if out else 0] * len(out), pa.int32())
            return pa.table({
                "query_id": wanted.column("query_id").take(pa.array(at, pa.int64())), "chunk_id": pa.array(name, rows.schema.field("chunk_id").type), "score": pa.array(score, pa.float64()),
                "seen": pa.array(seen, pa.int64()), "index_cell": same("index_cell"), "index_part": same("index_part"), "index_node": pa.array(node, pa.int32()),
            })

        keys = ["index_cell", "index_part", "block"]
        schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, seen long, index_cell int, index_part int, index_node int"
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, schema)

    def search_batch(self, queries: DataFrame, k: int = search.DEFAULT_K, filters: dict[str, Any] | None = None, probes: int | None = None, beam: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score) as ``search.knn_batch`` gives them, of the rows found."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return self.walked(queries, k, filters, probes, beam).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")

    def search(self, vector: Sequence[float], k: int | None = None, filters: dict[str, Any] | None = None, probes: int | None = None, beam: int | None = None) -> DataFrame:
        """The ``k`` nearest rows found that pass the filter, as ``search.knn`` gives them. ``k=ALL`` compares with all."""
        self._checked(vector)
        wanted = search.effective_k(k)
        if wanted == search.ALL or not self.about["cells"] or not np.any(vector):
            return search.knn(self.rows(), vector, k, filters)
        one = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query_vector array<double>")
        cells = cells_for(np.asarray(vector, dtype=np.float64)[None, :], self.centres, self.passing(filters), probes or self.about["probes"], wanted)[0].tolist()
        own = ["index_cell", "index_part", "index_node"]
        best = self.walked(one, wanted, filters, probes, beam).orderBy(F.desc("score"), "chunk_id").limit(wanted).select(*own, F.col("score").alias("_score"))
        schema = StructType.fromJson(self.about["schema"])
        rows = self._held(schema, cells).join(F.broadcast(best) if wanted <= 10_000 else best, own)
        return search.results(rows.select(*schema.names, "_score"), F.col("_score")).orderBy(F.desc("score"), "chunk_id")
