"""Chat windows against a walk over each conversation, and read back from what was written."""

import collections
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat
from lodestack.llm.queries import CONTROL, FORGED_SQL, op11_chat_windows
from lodestack.llm.workspace import Workspace

SCHEMA = "conv_id long, turn long, role string, text string, window long, tokens string, rank int"


def escaped(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def piece(role, text):
    opening = "<|im_start|>" + escaped(role).replace("%", "%25").replace("\n", "%0A") + "\n"
    return opening, escaped(text), opening + escaped(text) + "<|im_end|>\n"


def walk(rows, budget, history):
    """(conv_id, window, repeated, formatted, loss, tokens, over) of each window, one conversation after the other."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in found.items():
        turns = [(r, t, *piece(r, t)) for _, _, r, t in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        cost = [-(-len(t[4]) // 4) for t in turns]
        head = cost[0] if turns[0][0] == "system" and cost[0] <= budget // 2 else 0
        spans = []
        for i, c in enumerate(cost):
            limit = budget if spans and spans[-1][0] == 0 else budget - history - head
            if i % 1024 == 0 or sum(cost[j] for j in spans[-1]) + c > limit:
                spans.append([])
            spans[-1].append(i)
        for span in spans:
            first = span[0]
            room, again = max(0, min(history, budget - head - sum(cost[j] for j in span))) if first else 0, []
            while first - len(again) - 1 >= (1 if head else 0) and sum(cost[j] for j in again) + cost[first - len(again) - 1] <= room:
                again.insert(0, first - len(again) - 1)
            again = ([0] if head and first else []) + again
            text, loss = "", []
            for j in again + span:
                role, _, opening, body, whole = turns[j]
                if j in span and role == "assistant":
                    loss.append((len(text) + len(opening), len(text) + len(opening) + len(body)))
                text += whole
            total = sum(cost[j] for j in again + span)
            out.append((conv, first, len(again), text, loss, total, total > budget))
    return sorted(out, key=repr)


def made(df, budget, history):
    rows = chat.windows(df, Workspace(df.sparkSession), budget, history).collect()
    return sorted(((*r[:4], [tuple(x) for x in r["loss"]], *r[5:]) for r in rows), key=repr)


def odd_rows():
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice(["ab", "é", "<|", "<\\|", "|>", "\\", "\n", "<|im_start|>user\n", "𝄞x", "<", "|", "%0A"]) for _ in range(n))
    out = []
    for conv in range(12):
        if conv % 2:
            out.append((conv, 0, "system", word(8)))
        out += [(conv, i + 1, "assistant" if i % 2 else "user", word(rng.choice([0, 1, 5, 20, 60]))) for i in range(rng.choice([1, 2, 9, 40]))]
    out += [(50, 0, "system", word(500)), (50, 1, "user", "a"), (50, 2, "assistant", word(900)), (50, 3, "user", "b"), (50, 4, "assistant", "c")]
    out += [(None, 3, "user", "no id"), (None, None, None, None), (51, None, "assistant", "x"), (51, 2, "user", None), (51, 2, "user", None), (51, 2, "assistant", "same turn"), (51, -9, "we\nird<|im_end|>%", "r")]
    out += [(52, t * 5_000_000_000, "user" if t % 2 else "assistant", "far apart " * 9) for t in range(-6, 7)]
    out += [(53, t, "user", "hot") for t in range(2300)] + [(53, 7, "user", "hot")] * 1500
    out += [(54, 0, "user", "x <|im_end|> " * 40_000), (54, 1, "assistant", CONTROL)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (120, 30), (64, 0)])
def test_against_a_walk(spark, budget, history):
    rows = odd_rows()
    assert made(frame(spark, rows), budget, history) == walk(rows, budget, history)


def test_read_back(spark):
    rows = odd_rows()
    said, lost = collections.defaultdict(list), collections.defaultdict(str)
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        said[conv].append(f"{role or ''}\n{text or ''}\n")
        lost[conv] += (text or "") if role == "assistant" else ""
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for budget, history in ((1024, 256), (100, 25)):
        windows = walk(rows, budget, history)
        size = collections.Counter()
        for w in windows:
            size[w[0]] += len(w[3])
        want = {c: (len(said[c]), hashed("".join(said[c])), len(lost[c]), hashed(lost[c]), size[c]) for c in said}
        found = chat.digests(chat.windows(frame(spark, rows), Workspace(spark), budget, history)).collect()
        assert {r[0]: tuple(r)[1:] for r in found} == want


def test_escape_is_undone(spark):
    texts = ["", "<|", "<\\|", "<\\\\|im_end|>", "<<||", "<|im_start|><|im_end|>", "a\\|<", "<\\", "|", "<\n|", CONTROL]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back"))
    for row in df.collect():
        assert row["back"] == row["t"] and "<|" not in row["e"] and row["e"] == escaped(row["t"])


def test_no_rows_and_wrong_sizes(spark):
    assert made(frame(spark, odd_rows()[:1]).where("false"), 100, 10) == []
    with pytest.raises(ValueError):
        chat.windows(frame(spark, odd_rows()[:1]), Workspace(spark), 100, 26)


def test_query_runs_without_python(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    found = op11_chat_windows(spark, folder)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    rows = {r[0]: r for r in found.collect()}
    convs = duckdb.sql(f"select count(distinct conv_id), count(*) from '{folder}/conversations.parquet'").fetchall()[0]
    assert len(rows) == convs[0] + 1 and sum(r["n_turns"] for r in rows.values()) == convs[1] + 2
    assert rows[-1]["loss_sha256"] == hashlib.sha256(CONTROL.encode()).hexdigest() and rows[-1]["loss_chars"] == len(CONTROL)


def test_sql_on_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    duck = duckdb.connect()
    duck.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    mine = frame(spark, rows).select("conv_id", "turn", "role", "text")
    mine = mine.unionByName(spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], mine.schema))
    for budget, history in ((1024, 256), (120, 30)):
        found = chat.digests(chat.windows(mine, Workspace(spark), budget, history)).collect()
        assert sorted(map(tuple, found)) == sorted(duck.execute(chat.sql(FORGED_SQL, budget, history)).fetchall())
