r"""Chat formatting in DataFrame expressions only.

A conversation's turns are collected as structs and sorted by turn (ties by role, then
text; nulls first). A turn whose role equals the one before joins its message:

    <|im_start|>role<|im_sep|>text<|im_turn|>text of the next turn<|im_end|>

so that merged turns stay apart for reading back. Inside roles and texts a backslash is
doubled and a control string (of this template or of other common ones) gets a backslash after its
first character; ``unescaped`` undoes both. What the model is trained on (the loss mask) are
the texts of assistant messages, without the marks between them; ``loss_runs`` gives it as lengths in turn
outside and inside the mask.

A null text or role is empty, a null conv_id is a conversation of its own. Repeated rows are turns
each. Other columns are ignored. A conversation is one string by
contract, so one task writes it; its pieces are joined once, in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import table

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Characters of a string, and runs of a mask, that are handled as one piece.
PIECE = 256
#: First characters of control strings, told by what follows them: <|..., <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(?!\\)"


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(c: Column) -> Column:
    """After doubled backslashes, a single one behind < or [ can only come from ``escaped``."""
    return F.replace(F.regexp_replace(c, ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_runs), one row per conversation of ``rows``
    (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        """Mark, text and closing mark of a turn; messages open and close where the role changes."""
        before = F.get(F.col("turns"), i - 1)["role"]
        after = F.get(F.col("turns"), i + 1)["role"]
        head = F.when(before == t["role"], F.lit(TURN)).otherwise(F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)))
        tail = F.when(after == t["role"], F.lit("")).otherwise(F.lit(END))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("text"), tail.alias("tail"), (t["role"] == LEARNED_ROLE).alias("learned"))

    made = turns.select("conv_id", F.transform("turns", pieces).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["text"], x["tail"])), "")
    runs = F.flatten(F.transform("p", lambda x: F.when(x["learned"], F.array(F.length(x["head"]), F.length(x["text"]), F.length(x["tail"]), F.lit(0))).otherwise(F.array(F.length(x["head"]) + F.length(x["text"]) + F.length(x["tail"]), F.lit(0)))))
    return made.select("conv_id", text.alias("formatted"), runs.alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns, an array of (role, text), parsed from the formatted string alone."""
    quoted = {k: k.replace("|", r"\|") for k in (SEP, TURN, END)}
    messages = F.filter(F.split("formatted", quoted[END]), lambda m: m != "")

    def parse(m: Column) -> Column:
        parts = F.split(m, quoted[SEP])
        role = unescaped(F.substr(parts[0], F.lit(len(START) + 1)))
        return F.transform(F.split(parts[1], quoted[TURN]), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(messages, parse)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(a: Column) -> Column:
    """Running sums of an array of numbers, ``PIECE`` at a time: appending to one long array
    would copy it for every element."""

    def sums(x: Column, start: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends"))
        return F.aggregate(x, F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("ends")), step)["ends"]

    def of(x: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(0), F.size(x), F.lit(PIECE)), lambda i: i < F.size(x))
        within = F.transform(cuts, lambda i: sums(F.slice(x, i + 1, F.lit(PIECE)), F.lit(0)))
        return bound(within, lambda w: bound(sums(F.transform(w, lambda e: F.element_at(e, -1)), F.lit(0)), lambda total: F.flatten(
            F.transform(w, lambda e, i: bound(F.when(i > 0, F.get(total, i - 1)).otherwise(F.lit(0)), lambda start: F.transform(e, lambda n: start + n))))))

    return bound(F.transform(a, lambda n: n.cast("long")), of)


def learned_texts(formatted: DataFrame) -> Column:
    """The texts inside the mask: ``formatted`` cut at the running sums of ``loss_runs``, each
    slice unescaped. Slices are taken from pieces of the string, as every
    search in the whole of it would begin at its start."""

    def cut_out(text: Column, ends: Column, runs: Column) -> Column:
        inside = F.filter(F.sequence(F.lit(0), F.size(runs)), lambda i: (i % 2 == 1) & (F.get(runs, i) > 0))

        def piece(i: Column) -> Column:
            start, n = F.get(ends, i - 1), F.get(runs, i)
            first = F.floor(start / PIECE).cast("int")
            last = F.floor((start + n - 1) / PIECE).cast("int")
            near = F.array_join(F.slice(text, first + 1, last - first + 1), "")
            return unescaped(F.substr(near, (start - first * PIECE + 1).cast("int"), n))

        return F.transform(inside, piece)

    pieces = F.regexp_extract_all("formatted", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    return bound(pieces, lambda text: bound(F.col("loss_runs"), lambda runs: bound(running(runs), lambda ends: cut_out(text, ends, runs))))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = read_back(format_conversations(rows.unionByName(extra)))
    turns = turns.withColumn("learned", F.array_join(learned_texts(turns), ""))
    learned = F.col("learned")
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPE = r"regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"
#: The digests straight from the rows; formatted_chars from the lengths of marks and escaped strings.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
         length({text}) AS text_chars, length({role}) AS role_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before = role THEN {turn} ELSE {message} + role_chars END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("{text}", _ESCAPE.format("text")).replace("{role}", _ESCAPE.format("role")).replace("{turn}", str(len(TURN))).replace("{message}", str(len(START) + len(SEP) + len(END)))
