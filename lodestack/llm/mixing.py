"""Mixing sources to target weights by a hierarchical token budget.

The budget goes down the tree domain, language, source. A node whose supply
(its tokens times the allowed epochs) is short of its share gives what it
cannot use to its siblings; only when all of them are full does their parent
take less, so that the ancestors' siblings get it. Shares are whole tokens;
what rounding down leaves (fewer tokens than children) is not given out.

A leaf with a budget of several times its tokens repeats whole epochs and takes
a prefix of one more, in an order seeded by the epoch. The prefix is found from
sums over 4096 ranges of that order, so no task holds a leaf.

Defined results: rows without tokens (null, empty or blank text) or without
doc_id take no part; null domain, language or source is the empty name; names
without a weight weigh ``default_weight``, and nothing where that is 0; repeated
rows each count and each are selected; ties in the order go by doc_id; rows that repeat one doc_id stand at one
place of the order and so in one of its ranges (many copies of an id are one group there, sorted on disk); an empty table
selects nothing; extra columns play no part. Everything here is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WORDS = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Recipe:
    """Weights are whole numbers: by domain, by language, by source."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    max_epochs: int = 4
    budget_num: int = 1
    budget_den: int = 2
    seed: int = 7

    def weight(self, level: str, name: Column) -> Column:
        given = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        out = F.lit(self.default_weight)
        for k, v in sorted(given.items()):
            out = F.when(name == k, F.lit(v)).otherwise(out)
        return out.cast("long")


def _children_budgets(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Add ``budget`` to nodes (columns parent..., name, supply, above): water-filling among siblings."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy((F.col("supply") / F.col("w")).asc(), F.col(name).asc())
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    weighed = nodes.withColumn("w", weight).where("w > 0")
    full = weighed.withColumn("full", F.col("supply") * rest <= F.col("w") * (F.col("above") - before))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(siblings), F.lit(0))
    left = F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)
    share = F.when(F.col("full"), F.col("supply")).otherwise(F.expr("w * (above - taken) div left"))
    return full.withColumn("taken", taken).withColumn("left", left).withColumn("budget", share).drop("w", "full", "taken", "left", "above")


def leaf_budgets(tokens: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, tokens, budget) from rows (domain, lang, source, tokens) of whole leaves."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumn("supply", F.col("tokens") * recipe.max_epochs)
    total = leaves.agg(F.expr(f"sum(tokens) * {recipe.budget_num} div {recipe.budget_den}").alias("above"))
    domains = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).crossJoin(F.broadcast(total))  # one row
    domains = _children_budgets(domains, [], "domain", recipe.weight("domain", F.col("domain")))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).join(domains.select("domain", F.col("budget").alias("above")), "domain")
    langs = _children_budgets(langs, ["domain"], "lang", recipe.weight("lang", F.col("lang")))
    sources = leaves.join(langs.select("domain", "lang", F.col("budget").alias("above")), ["domain", "lang"])
    return _children_budgets(sources, ["domain", "lang"], "source", recipe.weight("source", F.col("source"))).drop("supply")


def count_tokens(text: Column) -> Column:
    """Words of a text; any other count of tokens may take its place."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(docs: DataFrame, recipe: Recipe, domain: Column, tokens: Column | None = None, row: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, tokens_taken): a row for each epoch that takes from a document.

    ``tokens_taken`` is below ``n_tokens`` only for the document at which a
    leaf's budget ends. ``row``, where given, comes first as ``row_key``: it tells rows of one doc_id apart.
    """
    work = Workspace(docs.sparkSession)
    text = F.col("text").cast("string")
    keys = ["doc_id"] if row is None else ["row_key", "doc_id"]
    own = docs.select(
        *([] if row is None else [row.alias("row_key")]),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), (count_tokens(text) if tokens is None else tokens.cast("long")).alias("n_tokens"),
    )
    rows = work.save(own.where("doc_id is not null and n_tokens > 0"))
    leaves = leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), recipe)
    leaves = work.save(leaves.select(*LEVELS, F.expr("budget div tokens").cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")))
    # the hash join on a hot leaf is split by adaptive execution; small leaf tables are broadcast by Spark itself, by their measured size
    known = rows.join(leaves, list(LEVELS))
    whole = known.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(recipe.seed), F.col("whole"), F.col("doc_id")))
    last = known.where("rest > 0").withColumn("key", order).withColumn("range", F.substring("key", 1, 3))
    sums = last.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = last.join(sums.withColumn("before", before), [*LEVELS, "range"]).where("before < rest")
    inside = placed.where("before + held <= rest").withColumn("taken", F.col("n_tokens"))
    at_end = placed.where("before + held > rest")
    run = Window.partitionBy(*LEVELS).orderBy("key", *reversed(keys)).rowsBetween(Window.unboundedPreceding, -1)
    at_end = at_end.withColumn("upto", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    at_end = at_end.where("upto < rest").withColumn("taken", F.least(F.col("n_tokens"), F.col("rest") - F.col("upto")))
    names = [*keys, *LEVELS, "epoch", "n_tokens"]
    parts = [whole.select(*names, F.col("n_tokens").alias("tokens_taken"))]
    parts += [x.select(*keys, *LEVELS, F.col("whole").alias("epoch"), "n_tokens", F.col("taken").alias("tokens_taken")) for x in (inside, at_end)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sql(recipe: Recipe, domain: str) -> str:
    """The same selection in SQL over ``documents``; ``domain`` is the SQL of the domain."""

    def weight(level: str, given: dict[str, int]) -> str:
        cases = " ".join(f"when '{k}' then {v}" for k, v in sorted(given.items()))
        return f"case {level} {cases} else {recipe.default_weight} end" if cases else str(recipe.default_weight)

    def fill(source: str, parent: str, name: str, weight: str) -> str:
        by = f"partition by {parent}" if parent else ""
        order = f"{by} order by supply::double / w, {name}"
        return f"""
          select * exclude (w, f, above), case when f then supply else w * (above - coalesce(sum(case when f then supply end) over ({by}), 0)) // sum(case when not f then w end) over ({by}) end as budget
          from (select *, supply * sum(w) over ({order} rows between current row and unbounded following)
                  <= w * (above - coalesce(sum(supply) over ({order} rows between unbounded preceding and 1 preceding), 0)) as f
                from (select *, {weight} as w from ({source})) where w > 0)"""

    domains = fill("select * from (select domain, sum(supply) as supply from leaves group by 1), (select sum(tokens) * " + f"{recipe.budget_num} // {recipe.budget_den} as above from leaves)", "", "domain", weight("domain", recipe.domains))
    langs = fill("select l.*, d.budget as above from (select domain, lang, sum(supply) as supply from leaves group by 1, 2) l join domains d using (domain)", "domain", "lang", weight("lang", recipe.langs))
    sources = fill("select l.*, g.budget as above from leaves l join langs g using (domain, lang)", "domain, lang", "source", weight("source", recipe.sources))
    return f"""
      with docs as (select * from (
             select doc_id, coalesce({domain}, '') as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
                    len(regexp_extract_all(text, '{WORDS}'))::bigint as n_tokens from documents) where n_tokens > 0 and doc_id is not null),
      leaves as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {recipe.max_epochs} as supply from docs group by 1, 2, 3),
      domains as ({domains}), langs as ({langs}), sources as ({sources}),
      plans as (select domain, lang, source, (budget // tokens)::int as whole, budget % tokens as rest from sources),
      known as (select * from docs join plans using (domain, lang, source)),
      run as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('{recipe.seed}:' || whole || ':' || doc_id), doc_id
              rows between unbounded preceding and 1 preceding), 0) as upto from known where rest > 0)
      select doc_id, domain, lang, source, epoch::int as epoch, n_tokens, n_tokens as tokens_taken
      from (select *, unnest(range(whole)) as epoch from known)
      union all
      select doc_id, domain, lang, source, whole as epoch, n_tokens, least(n_tokens, rest - upto)::bigint as tokens_taken from run where upto < rest"""
