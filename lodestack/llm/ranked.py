"""Ranked search of whole documents: exact best matches by branch and bound over a tree of maxima.

Documents in order of id fall into shards of consecutive ones. In a shard every
term has a tree over ranges of documents, 64 children a node: a leaf
is what the term adds to a document's score, a node the most of its children. The sum of
a query's terms bounds what any document below a node can reach. A search opens
the node of the highest sum first and stops when the best closed node can no longer
change the ten best; a node whose bound equals the tenth score is opened if it
may hold a smaller id. Across shards the same bound is taken in two steps: the shard of each
query's highest bound gives a score and an id to beat, then every other shard that can is searched.

The index holds the terms of the queries. Queries are dealt into batches of at most
``BATCH_TERMS`` distinct terms (one query alone may hold more), so what tasks and the driver
know of them has a bound; a batch reads the corpus once. Scores are 64-bit
integers but for the logarithm of a term's weight.

Null and empty texts have no term: as documents they don't count, as queries they find nothing. Equal scores
go by id, null ids last; rows that repeat an id are documents of their own. Queries that
repeat an id are searched each by its own text; equal rows are one query. A term of weight 0 adds nothing. Very long
texts are counted whole, one at a time. Other columns take no part. No documents or no queries give no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, few_rows

TOP = 10
FAN_BITS = 6
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 20
BATCH_TERMS = 1 << 20
#: Parts of m: the score's saturation grows with a document's share of the mean length, in hundredths.
FLAT, SLOPED, UNIT = 10, 90, 1_000_000_000
#: Bytes as terms have them: A-Z in lower case, every other ASCII character but letters and digits a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "shard long, term int, top long, ords array<int>, parts array<long>, docs array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 ``text`` in order: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(FOLD).split()


def _count(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that hold any term: all their terms' number, and which of ``number`` they hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 256):
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py() or b"")
                if words:
                    held = [(number[w], c) for w, c in Counter(words).items() if w in number]
                    ids.append(i)
                    sizes.append(len(words))
                    terms.append([t for t, _ in held])
                    tfs.append([c for _, c in held])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, sizes, terms, tfs), kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, COUNTED)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _index(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, parts: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """Rows of INDEX: for each shard and term what the term adds to each document, and one row (term -1) with the shard's ids."""
    order = F.col("doc_id").asc_nulls_last()

    def shard(number: int, ids: list[pa.Array], sizes: list[np.ndarray], terms: list[pa.Array], tfs: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        held = np.concatenate([np.diff(t.offsets.to_numpy()) for t in terms])
        words = np.concatenate([t.flatten().to_numpy() for t in terms])
        counts = np.concatenate([t.flatten().to_numpy() for t in tfs]).astype(np.int64)
        ords = np.repeat(np.arange(len(held), dtype=np.int32), held)
        slope = FLAT + (SLOPED * np.concatenate(sizes) * n_docs) // n_terms
        adds = weights[words] * ((UNIT * counts) // (1000 * counts + 8 * slope[ords]))
        order = np.lexsort((ords, words))
        order = order[adds[order] > 0]
        words, ords, adds = words[order], ords[order], adds[order]
        cuts = np.flatnonzero(np.diff(words, prepend=-1)) if len(words) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(adds, cuts) if len(cuts) else np.zeros(0, np.int64)
        ends = np.append(cuts, len(words)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        none = pa.nulls(len(cuts), pa.list_(pa.int64()))
        columns = [pa.array(np.full(len(cuts), number)), pa.array(words[cuts].astype(np.int32)), pa.array(tops), lists(ords), lists(adds), none]
        every = pa.concat_arrays(ids)
        own = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
        first = [pa.array([number]), pa.array([-1], pa.int32()), pa.array([0]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), own]
        names = [x.split(" ")[0] for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(first, names=names)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings, made, part = ([], [], [], []), 0, 0, 0, 0
        for batch in few_rows(batches):
            part = batch.column("part")[0].as_py()
            for at, name in enumerate(("doc_id", "n", "terms", "tfs")):
                held[at].append(batch.column(name).to_numpy() if name == "n" else batch.column(name))
            docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
            if docs >= shard_docs or postings >= shard_postings:
                yield from shard((part << 32) + made, *held)
                held, docs, postings, made = ([], [], [], []), 0, 0, made + 1
        if docs:
            yield from shard((part << 32) + made, *held)

    dealt = counted.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(build, INDEX)


class Tree:
    """A shard's trees: sorted keys (term's place, node) and maxima, from the documents (level 0) up to one node."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("term")
        self.ids = rows.column("docs")[0].as_py()
        self.known = len(self.ids) - self.ids.count(None)
        rows = rows.slice(1)
        self.terms = rows.column("term").to_numpy()
        ords, adds = (rows.column(c).combine_chunks() for c in ("ords", "parts"))
        places = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(ords.offsets.to_numpy()))
        node, value = ords.flatten().to_numpy().astype(np.int64), adds.flatten().to_numpy()
        self.levels = [((places << 32) + node, value)]
        while len(self.ids) > 1 << FAN_BITS * (len(self.levels) - 1):
            node = node >> FAN_BITS
            cuts = np.flatnonzero(np.diff((places << 32) + node, prepend=-1))
            value = np.maximum.reduceat(value, cuts) if len(cuts) else value
            places, node = places[cuts], node[cuts]
            self.levels.append(((places << 32) + node, value))

    def children(self, places: np.ndarray, level: int, node: int) -> np.ndarray:
        """The summed bounds of the children of a node, one level below ``level``."""
        keys, values = self.levels[level - 1]
        first = (places << 32) + (node << FAN_BITS)
        low, high = np.searchsorted(keys, first), np.searchsorted(keys, first + (1 << FAN_BITS))
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        sums = np.zeros(1 << FAN_BITS, dtype=np.int64)
        np.add.at(sums, (keys[at] & 0xFFFFFFFF) - (node << FAN_BITS), values[at])
        return sums

    def before(self, doc_id: int | None) -> int:
        """How many documents come before an id in the order of ids, null ids last."""
        return bisect_left(self.ids, doc_id, 0, self.known) if doc_id is not None else self.known

    def best(self, asked: np.ndarray, least: int, top: int, cut: int = 1 << 62) -> tuple[list[tuple[int, int]], int]:
        """The ``top`` best (score, place) above ``least``, or of ``least`` and before ``cut``, equal scores by place; and the number of nodes opened."""
        places = np.searchsorted(self.terms, asked)
        places = places[(places < len(self.terms)) & (self.terms[np.minimum(places, len(self.terms) - 1)] == asked)] if len(self.terms) else places[:0]
        found: list[tuple[int, int]] = []
        root = len(self.levels) - 1
        if not len(places):
            return [], 0
        # Nodes wait in order of bound, equal bounds by place, which is the order of the result too.
        waiting, opened = [(-(1 << 62), 0, root, 0)], 0
        while waiting:
            bound, start, level, node = heapq.heappop(waiting)
            if -bound < least or (-bound == least and start >= cut) or (len(found) == top and (-bound, -start) < found[0]):
                break
            opened += 1
            sums = self.children(places, level, node) if level else None
            if sums is None:  # a shard of one document is a leaf at once
                sums, level, node = np.array([self.levels[0][1][places].sum()]), 1, 0
            worst = found[0][0] if len(found) == top else 1
            for child in np.flatnonzero(sums >= max(least, worst, 1)).tolist():
                value, place = int(sums[child]), (node << FAN_BITS) + child
                if value == least and place << FAN_BITS * (level - 1) >= cut:
                    continue
                if level > 1:
                    heapq.heappush(waiting, (-value, place << FAN_BITS * (level - 1), level - 1, place))
                elif len(found) < top:
                    heapq.heappush(found, (value, -place))
                elif (value, -place) > found[0]:
                    heapq.heapreplace(found, (value, -place))
        return [(s, -p) for s, p in found], opened


def _search(index: DataFrame, wanted: DataFrame, asks: list[np.ndarray], top: int) -> DataFrame:
    """(ask, doc_id, score) of the best of each wanted (shard, ask, least, tenth, full): above ``least``, or equal to it with an id before ``tenth`` if ``full``."""

    def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
        tree, out = Tree(rows), ([], [], [])
        for ask, least, tenth, full in zip(*(asked.column(c).to_pylist() for c in ("ask", "least", "tenth", "full")), strict=True):
            for score, place in tree.best(asks[ask], least, top, tree.before(tenth) if full else len(tree.ids))[0]:
                for column, value in zip(out, (ask, tree.ids[place], score), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["ask", "doc_id", "score"])

    here = index.join(wanted.select("shard").distinct(), "shard", "left_semi")
    return here.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(find, "ask int, doc_id long, score long")


def _batches(asked: DataFrame, limit: int) -> int:
    """How many batches keep every one of them at ``limit`` distinct terms, as far as single queries allow."""
    n, most = 1, asked.count()
    while n < 4 * most:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        largest = asked.groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= 2 * limit:  # a term takes two bytes at least, one and a space
            break
        n *= 2
    return n


def search(docs: DataFrame, items: DataFrame, work: Workspace, top: int = TOP, batch_terms: int = BATCH_TERMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of highest score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    asked = work.save(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).distinct())
    found, n = [], _batches(asked, batch_terms)
    for turn in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == turn).collect()  # of at most about ``batch_terms`` terms
        held = [(r["item_id"], sorted(set(terms_of(bytes(r["text"]))))) for r in rows]
        number = {t: i for i, t in enumerate(sorted({t for _, ts in held for t in ts}))}
        if number:
            found.append(_search_batch(docs, [(i, np.array([number[t] for t in ts], dtype=np.int32)) for i, ts in held if ts], number, work, top, shard_docs, shard_postings))
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_batch(docs: DataFrame, asks: list[tuple[int | None, np.ndarray]], number: dict[bytes, int], work: Workspace, top: int, shard_docs: int, shard_postings: int) -> DataFrame | None:
    spark = docs.sparkSession
    counted = work.save(_count(docs, number))
    n_docs, n_terms, postings = counted.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
    if not n_docs:
        return None
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the batch
    weights = np.zeros(len(number), dtype=np.int64)
    for row in holding:
        weights[row["term"]] = weight(n_docs, row["count"])
    index = work.save(_index(counted, weights, n_docs, n_terms, max(1, -(-postings // shard_postings)), shard_docs, shard_postings))
    words = spark.createDataFrame([(a, ts.tolist()) for a, (_, ts) in enumerate(asks)], "ask int, terms array<int>").select("ask", F.explode("terms").alias("term"))
    bounds = work.save(index.select("shard", "term", "top").join(words, "term").groupBy("shard", "ask").agg(F.sum("top").alias("bound")))
    nothing = [F.lit(1).cast("long").alias("least"), F.lit(None).cast("long").alias("tenth"), F.lit(False).alias("full")]
    first = bounds.groupBy("ask").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")).select("shard", "ask", *nothing)
    lists = [ts for _, ts in asks]
    one = work.save(_search(index, first, lists, top))
    worst = F.max(F.struct(-F.col("score"), F.col("doc_id").isNull(), "doc_id")).alias("w")  # the last of the ten in the order of the result
    beaten = one.groupBy("ask").agg(F.count("*").alias("n"), worst).where(F.col("n") >= top).select("ask", (-F.col("w.col1")).alias("least"), F.col("w.doc_id").alias("tenth"), F.lit(True).alias("full"))
    rest = bounds.join(first.select("shard", "ask"), ["shard", "ask"], "left_anti").join(beaten, "ask", "left").withColumns({"least": F.coalesce("least", F.lit(1).cast("long")), "full": F.coalesce("full", F.lit(False))})
    two = _search(index, rest.where("bound >= least").select("shard", "ask", "least", "tenth", "full"), lists, top)
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = one.unionByName(two).withColumn("rank", rank).where(F.col("rank") <= top)
    names = spark.createDataFrame([(a, i) for a, (i, _) in enumerate(asks)], "ask int, item_id long")
    return best.join(names, "ask").select("item_id", "rank", "doc_id", "score")


def sql(top: int = TOP) -> str:
    """The search of ``documents`` by ``benchmark`` in DuckDB."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with words as (select k, doc_id, unnest(ts) as term, len(ts) as n from (select row_number() over () as k, doc_id, {terms} as ts from documents)),
      tfs as (select k, doc_id, term, n, count(*) as tf from words group by all),
      sums as (select count(distinct k) as docs, count(*) as terms from words),
      weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tfs, sums group by term),
      asked as (select item_id, q, unnest(list_distinct(ts)) as term from (select item_id, row_number() over () as q, {terms} as ts from (select distinct item_id, text from benchmark))),
      scored as (select q, item_id, k, doc_id, sum(w * (({UNIT} * tf) // (1000 * tf + 8 * ({FLAT} + ({SLOPED} * n * docs) // terms))))::bigint as score from asked join tfs using (term) join weights using (term), sums group by 1, 2, 3, 4)
      select item_id, rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank from scored where score > 0) where rank <= {top}"""
