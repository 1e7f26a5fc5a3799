"""A corpus pipeline of five operators: quality, near-duplicates, secrets, mixing, packing.

Every stage works on all that its predecessor kept and is written before the
next one reads it. All stages but the last return the columns of ``documents``.
Rows without doc_id pass the first three stages unchanged but for their text
and leave at mixing, which selects by id; rows that repeat an id are judged each
by its own text and only leave as near-duplicates (see ``one_of_each``); equal scores and
similarities are decided by thresholds alone, so ties have one outcome; null and
empty texts score as empty documents do and are near-duplicates of each other;
very long texts pass whole, without a prefix or a cap; extra columns are
carried along, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import mixing, packing, quality, secrets, simhash
from lodestack.llm.queries import source_domain, table, tokenizer_path
from lodestack.llm.workspace import Workspace

RECIPE = mixing.Recipe(langs={"en": 6, "fr": 2, "de": 2, "es": 1}, max_epochs=2, budget_num=1, budget_den=1, seed=11)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), Workspace(spark)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of near-duplicates: five words, 0.8 of the shingles.

    Rows are told apart by id and text: rows of one id with texts unlike each other all stay, unless a smaller id
    has a text like theirs. Of the like texts of one id the one of least hash stays; of rows equal in id and text
    the one that is first as JSON.
    """
    found = Workspace(spark).save(simhash.near_duplicates_checked(docs)).where("doc_id is not null")
    own = Window.partitionBy("root", "doc_id")
    ranked = found.withColumn("least", F.min("text_key").over(own)).where("doc_id <> component_id or text_key <> least")
    gone = ranked.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = lambda other: (docs["doc_id"].cast("long") == other["_id"]) & (simhash.text_key(docs["text"]) == other["_key"])
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return kept
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), simhash.text_key().alias("_key"))
    once = whole.join(repeated, ["_id", "_key"]).groupBy("_id", "_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return whole.join(repeated, ["_id", "_key"], "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secrets.redact(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights: a row for each epoch, the last one of a leaf cut to the words of its budget.

    Rows of one id are told apart by their texts; rows equal in both take what the fuller of them takes.
    """
    chosen = mixing.mix(docs, RECIPE, source_domain(), row=simhash.text_key())
    chosen = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "epoch").agg(F.max("n_tokens").alias("_all"), F.max("tokens_taken").alias("_taken"))
    words = F.filter(F.split(docs["text"], "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    part = chosen["_taken"] < chosen["_all"]
    text = F.when(part, F.array_join(F.slice(words, 1, chosen["_taken"].cast("int")), " ")).otherwise(docs["text"])
    now = {"text": text} | ({"n_chars": F.when(part, F.length(text)).otherwise(docs["n_chars"]).cast("long")} if "n_chars" in docs.columns else {})
    joined = docs.join(chosen, (docs["doc_id"].cast("long") == chosen["_id"]) & (simhash.text_key(docs["text"]) == chosen["_key"]))
    return joined.select(*[now.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("secret scan", without_secrets),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
