"""Merkle manifest of a table: a hash tree for each group, a tree of the groups' roots, and a proof for every row.

Rows of a group are ordered by id. Their ranks come from histograms of the ids'
digits, 12 to 14 bits a digit: the count of every prefix is summed up from the
counts of longer ones, and a prefix starts where its parent does plus what its
smaller siblings hold. A window never sees more than the 16384 children of one
prefix (or the 4096 ids of the longest one), so nothing is sorted as a whole, however many rows a group has.

A node of the tree is a prefix of the rank's digits in the base of the fanout.
The longest prefixes are reduced first, eight digits at a time: a task holds the
3^8 = 6561 nodes below one prefix. On the way back each prefix hands its own
proof down to the nodes below it, in a task of the same size.

Null ids come before all others, null groups are a group of their own, before
the others. Rows that repeat an id are ordered by their leaves; equal rows are
interchangeable. Empty texts count as texts of no bytes, nulls as a hyphen. Texts are hashed whole where
they are read and do not travel; very long ones need as much memory as they have
bytes. Other columns, whatever their names, take no part. An empty table has no rows
and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

FANOUT, DIGITS = 3, 8
DIGIT_BITS = (12, 26, 39, 52)
GROUPS_A_TASK = 100_000
PROOF = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of the fields' values: a hyphen for null, else the number of UTF-8 bytes, a colon, the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(proof, start, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, lowest level first, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def group_ranks(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (grp, key, doc_id, leaf, ...) with the rank of each in its group, from 0, and the group's size.

    ``keys`` has the grp and key of the same rows and is read for the histograms alone.
    """
    prefix = [f"_p{b}" for b in DIGIT_BITS]
    cut = lambda b: F.shiftright("key", b)
    levels = [keys.groupBy("grp", *[cut(b).alias(p) for b, p in zip(DIGIT_BITS, prefix, strict=True)]).agg(F.count("*").alias("_n"))]
    for i in range(1, len(prefix)):
        levels.append(levels[-1].groupBy("grp", *prefix[i:]).agg(F.sum("_n").alias("_n")))
    below = lambda *parent: Window.partitionBy("grp", *parent)
    before = lambda p, *parent: F.sum("_n").over(below(*parent).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    top = levels.pop()
    start = top.select("grp", prefix[-1], F.coalesce(before(prefix[-1]), F.lit(0)).alias("_start"), F.sum("_n").over(below()).alias("size"))
    for i in range(len(prefix) - 2, -1, -1):
        finer = levels.pop().select("grp", prefix[i], prefix[i + 1], F.coalesce(before(prefix[i], prefix[i + 1]), F.lit(0)).alias("_before"))
        start = finer.join(start, ["grp", prefix[i + 1]]).select("grp", prefix[i], (F.col("_start") + F.col("_before")).alias("_start"), "size")
    own = F.row_number().over(Window.partitionBy("grp", prefix[0]).orderBy("key", F.col("doc_id").asc_nulls_first(), "leaf"))
    placed = rows.withColumn(prefix[0], cut(DIGIT_BITS[0])).withColumn("_own", own)
    return placed.join(start, ["grp", prefix[0]]).withColumn("rank", F.col("_start") + F.col("_own") - 1).drop(prefix[0], "_own", "_start")


def _levels(nodes: list[str], size: int, digits: int) -> list[list[str]]:
    """A block's nodes and what they reduce to: through all its digits where the group has more blocks, else to one node."""
    out = [nodes]
    while len(out) <= digits if size > FANOUT**digits else len(out[-1]) > 1:
        last = out[-1]
        out.append([sha256("".join(last[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)])
    return out


def _blocks(nodes: DataFrame, digits: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {FANOUT**digits}"))


def _tiers(nodes: DataFrame, work: Workspace, digits: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those, until every group is one node."""

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        size, block = rows.column("size")[0].as_py(), rows.column("block")[0].as_py()
        found = _levels(rows.column("leaf").to_pylist(), size, digits)[-1][0]
        return pa.table({"grp": rows.column("grp")[:1], "rank": pa.array([block], pa.int64()), "size": pa.array([-(-size // FANOUT**digits)], pa.int64()), "leaf": [found]})

    tiers = [nodes]
    while len(tiers) == 1 or (tiers[-1].agg(F.max("size")).first()[0] or 0) > 1:
        made = _blocks(tiers[-1].select("grp", "rank", "size", "leaf"), digits).groupBy("grp", "block").applyInArrow(root, "grp string, rank long, size long, leaf string")
        tiers.append(work.save(made))
    return tiers


def _descend(nodes: DataFrame, above: DataFrame, more: Sequence[str], digits: int) -> DataFrame:
    """Proofs of ``nodes`` from those of their blocks (``above``: grp, rank, ends and proof); columns ``more`` stay."""
    kinds = dict(nodes.dtypes)
    ends = [c for c in above.columns if c not in ("grp", "rank", "proof")]
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("grp", "rank", *more)) + "".join(f", {c} string" for c in ends) + f", proof {PROOF}"

    def proofs(rows: pa.Table, over: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        levels = _levels(rows.column("leaf").to_pylist(), rows.column("size")[0].as_py(), digits)
        upper = [(x["left"], x["right"]) for x in over.column("proof")[0].as_py()]
        first = rows.column("rank")[0].as_py() // FANOUT**digits * FANOUT**digits
        left, right, cuts = [], [], [0]
        for at in (r - first for r in rows.column("rank").to_pylist()):
            for level in levels[:-1]:
                start = at // FANOUT * FANOUT
                left.append("".join(level[start:at]))
                right.append("".join(level[at + 1 : start + FANOUT]))
                at //= FANOUT
            left.extend(x for x, _ in upper)
            right.extend(x for _, x in upper)
            cuts.append(len(left))
        runs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        same = {c: pa.array([over.column(c)[0].as_py()] * rows.num_rows, pa.string()) for c in ends}
        return pa.table({c: rows.column(c) for c in ("grp", "rank", *more)} | same | {"proof": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs)})

    over = above.withColumnRenamed("rank", "block")
    return _blocks(nodes, digits).groupBy("grp", "block").cogroup(over.groupBy("grp", "block")).applyInArrow(proofs, schema)


def _group_order(roots: DataFrame, work: Workspace) -> DataFrame:
    """Groups ranked by name: ranges of at most about ``GROUPS_A_TASK`` names, each sorted by itself."""
    n = roots.count()
    dealt = roots.repartitionByRange(max(1, -(-n // GROUPS_A_TASK)), "grp").sortWithinPartitions("grp")
    dealt = work.save(dealt.select("grp", "leaf", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each range
    return dealt.join(start, "_part").select(F.lit("").alias("grp"), F.col("grp").alias("name"), (F.col("_start") + F.col("_at")).alias("rank"), F.lit(n).cast("long").alias("size"), "leaf")


def manifest(rows: DataFrame, leaf_of: Column, group: str, key: str, work: Workspace, carry: dict[str, Column] | None = None, digits: int = DIGITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row of ``rows``, and the columns ``carry``.

    ``group`` and ``key`` name the columns of the groups and of the ids. The
    proof lists the left and right siblings of each level up to the root. A task
    holds the ``FANOUT ** digits`` nodes below a prefix.
    """
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp")
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    carry = carry or {}
    wide = rows.select(grp, order.alias("key"), F.col(key).cast("long").alias("doc_id"), leaf_of.alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    ranked = work.save(group_ranks(wide, rows.select(grp, order.alias("key"))).drop("key"))
    tiers = _tiers(ranked, work, digits)
    groups = work.save(_group_order(tiers[-1].select("grp", "leaf"), work))
    over = _tiers(groups, work, digits)
    proofs = over[-1].select("grp", "rank", F.col("leaf").alias("root"), F.array().cast(PROOF).alias("proof"))
    for tier in over[-2:0:-1]:
        proofs = work.save(_descend(tier, proofs, [], digits))
    proofs = work.save(_descend(groups, proofs, ["name", "leaf"], digits))
    proofs = proofs.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), F.col("leaf").alias("subroot"), "root", "proof")
    for tier in tiers[-2:0:-1]:
        proofs = work.save(_descend(tier, proofs, [], digits))
    return _descend(ranked, proofs, ["doc_id", "leaf", *carry], digits).drop("grp", "rank")


def _tree_sql(nodes: str, key: str, levels: int, rows: str) -> list[str]:
    """CTEs that reduce ``nodes`` (key, pos, h) level by level, and walk ``rows`` (key, pos, folded, sibs) up beside them."""
    out, below, walk = [], nodes, rows
    for level in range(levels):
        run, up, step = f"{nodes}_run{level}", f"{nodes}_{level + 1}", f"{rows}_{level + 1}"
        out.append(f"{run} as (select {key}, pos // {FANOUT} as parent, list(h order by pos) as hs, max(n) as n from (select *, count(*) over (partition by {key}) as n from {below}) group by 1, 2)")
        out.append(f"{up} as (select {key}, parent as pos, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {run})")
        place = f"(w.pos % {FANOUT})::int"
        left, right = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
        moved = "case when n = 1 then {} else {} end as {}"
        folded, sibs = moved.format("w.folded", f"sha256({left} || w.folded || {right})", "folded"), moved.format("w.sibs", f"w.sibs || {left} || {right}", "sibs")
        out.append(f"{step} as (select w.* exclude (pos, folded, sibs), w.pos // {FANOUT} as pos, {folded}, {sibs} from {walk} w join {run} r on w.{key} = r.{key} and w.pos // {FANOUT} = r.parent)")
        below, walk = up, step
    return out


def sql(levels: int = 11) -> str:
    """The query of ``documents`` in DuckDB, for groups of at most ``3 ** levels`` rows.

    Even checksums of the decimal id lose the text's line breaks: CRC-32 is computed bit by bit, as there is no function for it.
    """
    of = lambda names: " || ".join(f"coalesce(strlen({n}::varchar) || ':' || {n}::varchar, '-')" for n in names)
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_concat([ascii(c)::bigint], list_transform(range(8), lambda i: -1::bigint))))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
    first = "doc_id, source, lang, n_chars, "
    now = f"case when ({crc}) % 2 = 0 then replace(text, chr(10), '') else text end"
    ctes = [
        f"hashed as (select doc_id, coalesce('+' || source, '') as grp, sha256({of(['doc_id', 'source', 'lang', 'n_chars', 'text'])}) as leaf, sha256({of(['doc_id', 'source', 'lang', 'n_chars', 'now'])}) as folded from (select {first}text, {now} as now from documents))",
        "walked as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos, '' as sibs from hashed)",
        "nodes as (select grp, pos, leaf as h from walked)",
        *_tree_sql("nodes", "grp", levels, "walked"),
        f"named as (select 0 as every, grp, row_number() over (order by encode(grp)) - 1 as pos, h from nodes_{levels})",
        f"doc as (select 0 as every, w.* exclude (pos), n.pos, n.h as subroot from walked_{levels} w join named n using (grp))",
        *_tree_sql("named", "every", levels, "doc"),
    ]
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, h as root, sha256(sibs) as proof_sha256, folded as folded_root, folded = h as verified from doc_{levels} join named_{levels} using (every)"
