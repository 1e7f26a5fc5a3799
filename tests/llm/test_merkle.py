"""The Merkle manifest against a tree built in one list."""

import collections
import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import merkle
from lodestack.llm.queries import op12_merkle_manifest
from lodestack.llm.workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank int, leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[name]]) for name in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            lost = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node, siblings = leaf((*r[:4], r[4].replace("\n", "")) if lost else r), []
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run, at = level[at // 3 * 3 : at // 3 * 3 + 3], at
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    node = digest(*run[: at % 3], node, *run[at % 3 + 1 :])
                    at //= 3
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], digest(*siblings), node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(df, digits):
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    made = merkle.manifest(df, merkle.leaf(fields), "source", "doc_id", Workspace(df.sparkSession), {"now": merkle.leaf([*fields[:-1], now])}, digits=digits)
    folded = merkle.fold(F.col("now"), F.col("proof"))
    rows = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), folded.alias("f"), (folded == F.col("root")).alias("v"))
    return sorted(map(tuple, rows.collect()), key=repr)


def odd_rows():
    """Groups of 1 to 90 rows, null and negative ids, ids far apart, repeated rows, null and odd fields."""
    out = []
    for name, n in ((None, 5), ("", 1), ("a", 90), ("é", 28), ("z", 9), ("zz", 10), ("+", 3), ("ab", 2)):
        for i in range(n):
            key = (i * 7_919_191 - 40_000_000) * (1 << 17 if i % 3 else 1)
            out.append((key, name, "en" if i % 4 else None, i if i % 5 else None, f"text {i}\nof é {name}\n" if i % 6 else None))
    out += [(None, "a", None, None, "no id"), (None, "a", None, None, "no id"), (-(1 << 63), "a", "x", 1, ""), ((1 << 63) - 1, "a", "x", 1, "last\n"), (7, "a", "x", 1, "one"), (7, "a", "x", 1, "two\n"), (7, "a", "x", 1, "two\n")]
    out.append((123456, "long", "en", 1, "a line\n" * 200_000))
    return out


@pytest.mark.parametrize("digits", [1, 2, 8])
def test_against_one_list(spark, digits):
    rows = odd_rows()
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "g", 3, "l") for r in rows], SCHEMA).repartition(5)
    assert found(df, digits) == expected(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "x\n", "en", "s", 2, "g", 3, "l")], SCHEMA)
    assert found(one, 8) == expected([(3, "s", "en", 2, "x\n")])
    assert found(one.where("false"), 8) == []


def test_ranks_are_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("grp"), (F.xxhash64("id") * F.lit(1)).alias("key")).withColumns({"doc_id": F.col("key"), "leaf": F.lit("l")})
    rows = merkle.group_ranks(df, df.select("grp", "key")).collect()
    for name in "ab":
        own = sorted((r["key"], r["rank"], r["size"]) for r in rows if r["grp"] == name)
        assert [r for _, r, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


def test_query_and_sql(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = sorted(map(tuple, op12_merkle_manifest(spark, folder).collect()))
    docs = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{folder}/documents.parquet'").fetchall()
    assert rows == sorted(expected(docs))
    made = duckdb.connect()
    made.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert rows == sorted(made.execute(merkle.sql()).fetchall())
