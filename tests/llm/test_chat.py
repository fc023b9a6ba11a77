"""Formatting is reversible; digests equal the SQL; the plan holds no Python."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import accumulate

import duckdb
from pyspark.sql import functions as F

from tianguis.llm import chat
from tianguis.llm.chat import END, START, format_conversations, op5_chat, read_back

SF = "/root/testdata/sf0.001"


def test_reads_back_every_turn(spark):
    rng = random.Random(8)
    pool = ["\\", "<", "|", "[", "INST]", "</s>", "<s>", "<|im_end|>", "<|im_sep|>", "<|im_turn|>", "[/INST]", "<<SYS>>", "<</SYS>>", "a", "\n", "<\\|", "[\\INST]", "$1", "é", "🙂"]
    some = lambda: "".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) if rng.random() > 0.05 else None
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", None, some()]), some(), "x") for _ in range(900)]
    got = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))).collect()
    want = defaultdict(list)
    for c, turn, role, text, _ in rows:
        want[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        assert [(t.role.encode(), t.text.encode()) for t in r.turns] == [t[1:] for t in turns]
        assert sum(r.loss_runs) == len(r.formatted)
        messages = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count(START) == r.formatted.count(END) == messages  # neighbours of one role are merged
        for mark in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert mark not in r.formatted
        at, learned = 0, []
        for k, n in enumerate(r.loss_runs):
            learned += [r.formatted[at : at + n]] if k % 2 else []
            at += n
        undone = [re.sub(r"([<\[])\\(?!\\)", r"\1", x).replace("\\\\", "\\") for x in learned]
        assert "".join(undone) == "".join(t[2].decode() for t in turns if t[1] == b"assistant")


def test_digests_equal_sql_and_plan_is_native(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    df = op5_chat(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(chat.ORACLE).fetchall())


def test_loss_digests_follow_the_mask(spark, monkeypatch):
    """The query's loss columns come from loss_runs: with an empty mask they are those of nothing."""
    plain = chat.format_conversations
    monkeypatch.setattr(chat, "format_conversations", lambda rows: plain(rows).withColumn("loss_runs", F.array(F.length("formatted"), F.lit(0))))
    got = op5_chat(spark, SF).collect()
    assert got and {(r.loss_chars, r.loss_sha256) for r in got} == {(0, hashlib.sha256(b"").hexdigest())}


def test_slices_of_the_mask(spark):
    rng = random.Random(3)
    rows = []
    for n in (0, 1, 2, 255, 256, 257, 1500):
        parts = ["".join(rng.choice("aé🙂\n[<") for _ in range(rng.choice([0, 1, 3, 300]))) for _ in range(n)]
        rows.append((n, "".join(parts), [len(p) for p in parts]))
    made = spark.createDataFrame(rows, "conv_id long, formatted string, loss_runs array<int>")
    for r in made.select("conv_id", chat.learned_texts(made).alias("x"), chat.running(F.col("loss_runs")).alias("ends")).collect():
        _, text, runs = next(x for x in rows if x[0] == r.conv_id)
        ends = list(accumulate(runs))
        assert r.ends == ends
        assert r.x == [text[ends[i - 1] : ends[i]] for i in range(1, len(runs), 2) if runs[i]]


def test_long_conversation_and_empty_table(spark):
    rows = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    r = read_back(format_conversations(rows)).first()
    assert len(r.turns) == 30_000 and r.turns[29_999].text == "t29999"
    assert format_conversations(rows.limit(0)).count() == 0
