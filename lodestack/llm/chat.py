"""Conversations as training windows: turn-aligned spans of a token budget, with a loss mask.

Every turn becomes one piece, ``<|im_start|>role\\ntext<|im_end|>\\n``. The running
sums of the pieces' tokens choose the spans: from a window's first turn on, as
many turns are new in it as its budget holds. Every window but the first opens
with the conversation's system turn and the last turns before its own that
``history`` tokens hold. The loss mask lists the texts of new
assistant turns as spans of code points, end exclusive; what a window repeats is
never in it, so each assistant text is learnt once.

All of it is DataFrame operations. A conversation may hold any share of the rows: turns are
ranked in stretches of 1024 turn numbers whose sizes are summed up, spans
are chosen in blocks of 1024 turns (a window never crosses a block's border), and turns meet
windows by conversation and stretch of the running sum, none of which grows with the
conversation. Only ``digests`` puts one conversation's text together, since one hash is asked for it.

Inside texts and roles ``<|`` becomes ``<\\|``, and a run of backslashes between ``<`` and
``|`` grows by one, so no text can hold a control string and ``unescape``
gives back what was there; a line break in a role becomes ``%0A`` and ``%`` becomes ``%25``.

Null texts and roles count as empty. Rows without conv_id are one conversation. Turns come by
number, those without one first; equal numbers by role, then text; equal rows all stay. A turn
that exceeds the budget has a window of its own, whole, marked ``over_budget``, and so does one whose system
turn leaves too little room. A system turn of more than half the budget is not repeated. Only the
first turn can be the system turn that is kept; others are turns like any. Columns beside conv_id, turn, role
and text take no part. An empty table has no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
BUDGET, HISTORY = 1024, 256
STRETCH = 1024
SPAN = "struct<first:bigint,start:bigint,last:bigint,tokens:bigint>"


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _turns(rows: DataFrame) -> DataFrame:
    """Turns as pieces: ``conv`` is the id as text, empty for null; opening, body and size count code points."""
    raw = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opening, body = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    cut = raw.select("*", F.concat(opening, body, F.lit(END + "\n")).alias("piece"), F.length(opening).alias("opening"), F.length(body).alias("body"))
    size = F.length("piece")
    return cut.withColumns({"size": size, "tokens": F.ceil(size / 4).cast("long"), "stretch": F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60)))})


def ranked(rows: DataFrame) -> DataFrame:
    """Turns with their ``rank`` in the conversation, from 0, and the tokens before them (``start``)."""
    turns = _turns(rows)
    own = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv", "stretch").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    sizes = sizes.select("conv", "stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    placed = turns.withColumns({"_n": F.row_number().over(own), "_t": F.sum("tokens").over(own)}).join(sizes, ["conv", "stretch"])
    return placed.select("conv", (F.col("_n0") + F.col("_n") - 1).alias("rank"), (F.col("_t0") + F.col("_t") - F.col("tokens")).alias("start"), "tokens", "role", "piece", "opening", "body", "size")


def _spans(turns: Column, rest: Column, budget: int) -> Column:
    """Windows of a block's turns in order: each takes new turns while they fit."""
    x_open = lambda x: F.struct(x["rank"].alias("first"), x["start"].alias("start"), x["start"].alias("last"), x["tokens"].alias("tokens"))
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), F.lit(None).cast(SPAN).alias("now"))

    def take(state: Column, x: Column) -> Column:
        now = state["now"]
        fits = now["tokens"] + x["tokens"] <= F.when(now["first"] == 0, F.lit(budget)).otherwise(rest)
        longer = F.struct(now["first"].alias("first"), now["start"].alias("start"), x["start"].alias("last"), (now["tokens"] + x["tokens"]).alias("tokens"))
        closed = F.struct(F.array_append(state["done"], now).alias("done"), x_open(x).alias("now"))
        return F.when(now.isNull(), F.struct(state["done"].alias("done"), x_open(x).alias("now"))).when(fits, F.struct(state["done"].alias("done"), longer.alias("now"))).otherwise(closed)

    return F.aggregate(turns, none, take, lambda state: F.array_append(state["done"], state["now"]))


def windows(rows: DataFrame, work: Workspace, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, repeated, formatted, loss, tokens, over_budget), a row for each window.

    ``window`` is the rank of the first new turn, ``repeated`` the number of
    turns before it in ``formatted``. ``history`` is at most a quarter of the budget.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history must be between 0 and a quarter of the budget")
    turns = work.save(ranked(rows))
    is_head = (F.col("rank") == 0) & (F.col("role") == SYSTEM) & (F.col("tokens") <= budget // 2)
    heads = turns.where(is_head).select("conv", F.col("tokens").alias("head"))
    blocks = turns.groupBy("conv", F.floor(F.col("rank") / STRETCH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "start", "tokens"))).alias("turns"))
    blocks = blocks.join(heads, "conv", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    spans = blocks.select("conv", "head", F.explode(_spans(F.col("turns"), budget - history - F.col("head"), budget)).alias("w")).select("conv", "head", "w.*")
    room = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("head") - F.col("tokens")))
    spans = spans.select("conv", "head", F.col("first").alias("window"), F.col("start").alias("since"), "last", F.when(F.col("first") == 0, F.lit(0)).otherwise(room).alias("room"))
    cell = lambda c: F.floor(c / budget)
    met = spans.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.lit(0), F.col("since") - F.col("room"))), cell(F.col("last")))))
    new = F.col("start") >= F.col("since")
    inside = (F.col("start") >= F.col("since") - F.col("room")) & (F.col("start") <= F.col("last")) & (new | ~is_head)
    parts = turns.withColumn("cell", cell(F.col("start"))).join(met, ["conv", "cell"]).where(inside)
    parts = parts.select("conv", "window", "rank", new.alias("new"), "role", "piece", "opening", "body", "size", "tokens")
    kept = turns.where(is_head).join(spans.where("window > 0").select("conv", "window"), "conv")
    kept = kept.select("conv", "window", "rank", F.lit(False).alias("new"), "role", "piece", "opening", "body", "size", "tokens")
    own = Window.partitionBy("conv", "window").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = parts.unionByName(kept).withColumn("_from", F.sum("size").over(own) - F.col("size") + F.col("opening"))
    target = F.when(F.col("new") & (F.col("role") == TARGET), F.struct(F.col("_from").alias("start"), (F.col("_from") + F.col("body")).alias("stop")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "")
    made = every.groupBy("conv", "window").agg(F.sum((~F.col("new")).cast("int")).alias("repeated"), joined.alias("formatted"), F.array_sort(F.collect_list(target)).alias("loss"), F.sum("tokens").alias("tokens"))
    return made.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "window", "repeated", "formatted", "loss", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def turns_back(formatted: Column) -> Column:
    """The turns of a formatted window as array<struct<role,text>>, unescaped."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - (len(END) + 2))
        return F.struct(_role_back(role).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digests(made: DataFrame) -> DataFrame:
    """What each conversation's windows say when read back: their new turns, the text under the mask, their size."""
    read = turns_back(F.col("formatted"))
    new = F.slice(read, F.col("repeated") + 1, F.size(read))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = made.select("conv_id", "window", F.size(new).alias("n"), said.alias("said"), loss_text(F.col("formatted"), F.col("loss")).alias("lost"), F.length("formatted").alias("chars"))
    ordered = F.array_sort(F.collect_list(F.struct("window", "said", "lost")))
    joined = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), ordered.alias("w"), F.sum(F.length("lost")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    text = lambda name: F.sha2(F.array_join(F.col(f"w.{name}"), ""), 256)
    return joined.select("conv_id", "n_turns", text("said").alias("turns_sha256"), "loss_chars", text("lost").alias("loss_sha256"), "formatted_chars")


def sql(more: str, budget: int = BUDGET, history: int = HISTORY) -> str:
    """``digests`` of ``conversations`` and the rows ``more`` in DuckDB, for rows with conv_id."""
    esc = lambda x: rf"regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g')"
    opening = f"'{START}' || replace(replace({esc('role')}, '%', '%25'), chr(10), '%0A') || chr(10)"
    hashed = lambda x, where: f"sha256(coalesce(string_agg({x}, '' order by rank){where}, ''))"
    target = f" filter (where role = '{TARGET}')"
    return f"""with recursive src as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all {more})),
      cut as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as rank, length({opening} || {esc('text')} || '{END}' || chr(10)) as size from src),
      costs as (select *, ((size + 3) // 4)::bigint as tokens from cut),
      turns as (select t.*, coalesce(h.tokens, 0) as head, coalesce(h.size, 0) as head_size, h.conv_id is not null and t.rank = 0 as is_head, sum(t.tokens) over (partition by t.conv_id order by t.rank) - t.tokens as since
        from costs t left join (select * from costs where rank = 0 and role = '{SYSTEM}' and tokens <= {budget // 2}) h using (conv_id)),
      spans as (select conv_id, rank, 0::bigint as first, tokens as taken from turns where rank = 0
        union all select conv_id, rank, case when fresh then rank else first end, case when fresh then tokens else taken + tokens end
        from (select t.conv_id, t.rank, t.tokens, s.first, s.taken, t.rank % {STRETCH} = 0 or s.taken + t.tokens > case when s.first = 0 then {budget} else {budget - history} - t.head end as fresh
          from spans s join turns t on t.conv_id = s.conv_id and t.rank = s.rank + 1)),
      made as (select conv_id, first, min(since) as since, max(head_size) as head_size, greatest(0, least({history}, {budget} - max(head) - sum(tokens))) as room from spans join turns using (conv_id, rank) group by 1, 2),
      again as (select m.conv_id, sum(t.size) as chars from made m join turns t on t.conv_id = m.conv_id and m.first > 0 and not t.is_head and t.since < m.since and t.since >= m.since - m.room group by 1),
      heads as (select conv_id, sum(case when first > 0 then head_size else 0 end) as chars from made group by 1),
      said as (select conv_id, count(*) as n_turns, {hashed("role || chr(10) || text || chr(10)", "")} as turns_sha256, coalesce(sum(length(text)){target}, 0)::bigint as loss_chars, {hashed("text", target)} as loss_sha256, sum(size) as chars from turns group by 1)
      select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (s.chars + h.chars + coalesce(a.chars, 0))::bigint as formatted_chars from said s join heads h using (conv_id) left join again a using (conv_id)"""
