"""Ranked search against scores of every document."""

import collections
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import ranked
from lodestack.llm.queries import op13_ranked_search
from lodestack.llm.workspace import Workspace

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, shard long, term string, n int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def every(docs, items, top=10):
    """(item_id, rank, doc_id, score) from the scores of all documents."""
    counted = [(i, collections.Counter(ts), len(ts)) for i, ts in ((i, terms(t)) for i, t in docs) if ts]
    n, total, df = len(counted), sum(x[2] for x in counted), collections.Counter()
    for _, c, _ in counted:
        df.update(c.keys())
    out = []
    for item, text in set(items):
        scores = []
        for i, c, size in counted:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def odd_tables():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß7") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs = [(i * 37 % 5000 - 900, " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([1, 5, 40, 120])))) for i in range(900)]
    docs += [(6000 + i, docs[3][1]) for i in range(400)] + [(6000 - i, docs[5][1]) for i in range(400)]
    docs += [(1, None), (2, ""), (3, " .,-\n"), (None, docs[3][1]), (None, docs[3][1]), (4, "É É é ÉCOLE école straße"), (5, docs[7][1].upper()), (5, docs[7][1]), (7, "x1_y2" * 3 + "\x00a\x7fb"), (8, "long " * 200_000 + docs[9][1])]
    items = [(i, docs[i * 11][1]) for i in range(60)] + [(100, None), (101, ""), (102, "notfound"), (103, docs[3][1]), (103, docs[3][1]), (103, docs[5][1]), (None, docs[9][1]), (104, "a " + docs[2][1] * 3), (105, "École x1 A b"), (106, "the long")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "t", 2) for d in docs], SCHEMA).repartition(7), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 150, "shard_postings": 2000}, {"shard_docs": 1, "batch_terms": 60}, {"top": 3, "shard_docs": 5000}])
def test_against_every_score(spark, sizes):
    docs, items = odd_tables()
    if sizes.get("shard_docs") == 1:
        docs, items = docs[::20], items[::4]
    rows = ranked.search(*frames(spark, docs, items), Workspace(spark), **sizes).collect()
    assert sorted(map(tuple, rows), key=repr) == every(docs, items, sizes.get("top", 10))


def test_nothing_to_search(spark):
    docs, items = frames(spark, [(1, "a b"), (2, None)], [(1, "a")])
    found = lambda d, i: [tuple(r) for r in ranked.search(d, i, Workspace(spark)).collect()]
    assert found(docs.where("false"), items) == [] == found(docs, items.where("false"))
    assert found(docs.where("doc_id = 2"), items) == []
    assert found(docs, items) == every([(1, "a b"), (2, None)], [(1, "a")])


def tree_of(adds, docs):
    rows = [{"shard": 1, "term": -1, "top": 0, "ords": None, "parts": None, "docs": docs}]
    rows += [{"shard": 1, "term": t, "top": max(p.values()), "ords": list(p), "parts": list(p.values()), "docs": None} for t, p in adds.items()]
    return ranked.Tree(pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("term", pa.int32()), ("top", pa.int64()), ("ords", pa.list_(pa.int32())), ("parts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])))


def test_tree_opens_few_nodes_and_all_that_tie():
    n = 20_000
    rng = random.Random(1)
    adds = {t: dict(sorted((d, rng.choice([1, 2, 3])) for d in rng.sample(range(n), 900))) for t in range(8)}
    for d in (17, 4_000, 19_999):
        for t in range(8):
            adds[t][d] = 1_000
    adds = {t: dict(sorted(p.items())) for t, p in adds.items()}
    tree = tree_of(adds, list(range(n)))
    found, opened = tree.best(np.arange(8, dtype=np.int32), 1, 3)
    assert sorted(found, key=lambda x: (-x[0], x[1])) == [(8_000, 17), (8_000, 4_000), (8_000, 19_999)] and opened <= 10
    assert tree.best(np.arange(8, dtype=np.int32), 8_001, 3) == ([], 1)
    flat = tree_of({0: dict.fromkeys(range(n), 5)}, list(range(n)))
    found, opened = flat.best(np.zeros(1, dtype=np.int32), 1, 10)
    assert sorted(found) == [(5, d) for d in range(10)] and opened <= 4
    assert flat.best(np.array([3], dtype=np.int32), 1, 10) == ([], 0)
    found, opened = flat.best(np.zeros(1, dtype=np.int32), 5, 10, 4)
    assert sorted(found) == [(5, d) for d in range(4)] and flat.best(np.zeros(1, dtype=np.int32), 5, 10, 0) == ([], 1)
    odd = tree_of({0: {0: 5}}, [3, 3, 7, None, None])
    assert [odd.before(x) for x in (2, 3, 4, 8, None)] == [0, 0, 2, 3, 3]


def test_query_and_sql(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = sorted(map(tuple, op13_ranked_search(spark, folder).collect()))
    made = duckdb.connect()
    for name in ("documents", "benchmark"):
        made.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    assert rows == sorted(made.execute(ranked.sql()).fetchall())
    assert rows == sorted(every(made.execute("select doc_id, text from documents").fetchall(), made.execute("select item_id, text from benchmark").fetchall()))
