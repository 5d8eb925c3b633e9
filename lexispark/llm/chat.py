"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns are
the assistant's, all others are users with their names, and the mask covers
what the speaker says, with the end mark, and nothing else. System turns are
context: they belong to every rendering and are nobody's perspective.

    <|system|>\\nTEXT<|end|>\\n      <|assistant|>\\nTEXT<|end|>\\n      <|user:NAME|>\\nTEXT<|end|>\\n

Marks can't be forged. In texts and names a backslash goes behind every "<"
that could begin a mark, that is, one before "|" or before backslashes and
"|", and in names likewise behind every "|" that could end one; taking one
backslash away there gives the text back (`unescaped`).

A rendering is one row, unless the dialogue has more than `PART_TURNS` turns:
then it is that many turns a row, and the texts of its parts one behind the
other are the rendering. So a dialogue of any length is a number of bounded
rows, placed without gathering the dialogue: turns are sorted by ranges, and a
turn's number is its place in its range and what the ranges before hold. Parts
behind the first bring what system turns the dialogue opens with as `context`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, lean, partitions, stored, table

PART_TURNS = 1024
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"<(\\*)(\||\z)", r"<\\$1$2"), r"\|(\\*)>", r"|\\$1>")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_name(name: str) -> str:
    return re.sub(r"<\\(\\*)(\||\Z)", r"<\1\2", re.sub(r"\|\\(\\*)>", r"|\1>", name))


def render(turns: list[tuple[str, str]], speaker: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The text of escaped (role, text) turns for one speaker, and the [begin, end) characters that the speaker is trained on."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = "<|system|>\n" if role == SYSTEM else "<|assistant|>\n" if role == speaker else f"<|user:{role}|>\n"
        if role == speaker:
            mask.append((at + len(head), at + len(head) + len(text) + len(END)))
        parts.append(f"{head}{text}{END}\n")
        at += len(parts[-1])
    return "".join(parts), mask


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, …) come in order: each with its task and its place among the task's turns of the dialogue."""
    task, last, have = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        begin = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        sizes = np.diff(np.concatenate([begin, [len(conv)]]))
        nth = np.arange(len(conv)) - np.repeat(begin, sizes)
        if conv[0] == last:
            nth[: sizes[0]] += have
        last, have = conv[-1], int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), task, np.int32)), pa.array(nth)], names=[*batch.schema.names, "task", "nth"])


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text) of every turn, escaped, numbered from 0 within its dialogue; stored."""
    turn = (
        columns(conversations, "conv_id", "turn", "role", "text")
        .where("conv_id is not null")
        .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    )
    order = ["conv_id", F.col("turn").isNull(), "turn", "role", F.md5("text"), "tie"]
    ordered = turn.repartitionByRange(partitions(conversations), *order).sortWithinPartitions(*order)
    named = ordered.select("conv_id", escaped_name(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    # written down once: ranges are cut by sampling and need not come out alike a second time
    placed = stored(named.mapInArrow(lean(_numbered, "chat"), "conv_id bigint, role string, text string, task int, nth bigint"), "turns")
    sizes = placed.groupBy("task", "conv_id").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("task", "conv_id", "sum(n) over (partition by conv_id order by task rows between unbounded preceding and 1 preceding) as before")
    # only the first dialogue of a range can have begun in an earlier one: a row a task at most
    begun = placed.join(F.broadcast(before.where("before > 0")), ["task", "conv_id"], "left")
    return begun.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "role", "text")


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, context, rendered, mask: a rendering of each dialogue for each participant.

    Input columns: conv_id, turn, role, text; others are ignored. Every row is
    a turn, rows that repeat another too. Turns come in order of turn, those
    without a number last; ties by role, then by the MD5 of the text. Turn
    numbers only order: they may be negative, have gaps or repeat. Null roles
    are "unknown", null texts empty; rows without a conv_id belong to no
    dialogue and are left out. A dialogue of system turns alone has no
    participant and gives no row; an empty table gives none.

    speaker is the participant's role as it is, part counts rows of a rendering
    from 0, n_turns its turns in this row, context is empty in part 0 and else
    the rendering of the system turns before any other (of the first part_turns
    turns). mask is "begin-end" in characters of this row's rendered, joined
    by commas.
    """
    turns = turns_in_order(conversations).withColumn("part", F.expr(f"nth div {part_turns}"))
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("turns"))
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    # places first, by small rows: a dialogue's texts don't meet in one task
    places = turns.select("conv_id", "part").distinct().join(speakers, "conv_id")
    long = turns.where(F.col("nth") == part_turns).select("conv_id")
    opening = turns.where(F.col("nth") < part_turns).join(long, "conv_id", "left_semi")
    first = opening.groupBy("conv_id").agg(F.min(F.when(F.col("role") != SYSTEM, F.col("nth"))).alias("spoken"))
    opened = opening.where(F.col("role") == SYSTEM).join(first, "conv_id").where("spoken is null or nth < spoken")
    context = opened.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("opening"))
    asked = places.join(context, (places["conv_id"] == context["conv_id"]) & (places["part"] > 0), "left").select(places["conv_id"], "part", "speaker", "opening")
    met = parts.join(asked, ["conv_id", "part"]).select("conv_id", "speaker", "part", "turns", "opening")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "speaker", "part", "n_turns", "context", "rendered", "mask"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for row in batch.slice(at, 64).to_pylist():
                    text, mask = render([(t["role"], t["text"]) for t in row["turns"]], row["speaker"])
                    before = render([(t["role"], t["text"]) for t in row["opening"] or ()], None)[0]
                    out.append((row["conv_id"], unescaped_name(row["speaker"]), row["part"], len(row["turns"]), before, text, ",".join(f"{a}-{b}" for a, b in mask)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return met.mapInArrow(lean(run, "chat"), "conv_id bigint, speaker string, part bigint, n_turns bigint, context string, rendered string, mask string")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


#: From the definition: all turns of a dialogue numbered, 1024 a row.
SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS name,
    regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)(\||\z)', '<\\\1\2', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS role,
    regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), md5(coalesce(text, ''))) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'
), c AS (
  SELECT conv_id, string_agg('<|system|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY nth) AS context
  FROM (SELECT *, min(CASE WHEN name <> 'system' THEN nth END) OVER (PARTITION BY conv_id) AS spoken FROM t)
  WHERE name = 'system' AND nth < 1024 AND (spoken IS NULL OR nth < spoken) GROUP BY conv_id
), p AS (
  SELECT t.*, s.speaker, nth // 1024 AS part,
    CASE WHEN name = 'system' THEN '<|system|>' WHEN name = speaker THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head
  FROM t JOIN s USING (conv_id)
), q AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, part ORDER BY nth) AS stop FROM p
)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  CASE WHEN part > 0 THEN coalesce(any_value(context), '') ELSE '' END AS context,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY nth) AS rendered,
  coalesce(string_agg(CASE WHEN name = speaker THEN CAST(CAST(stop AS BIGINT) - 8 - length(text) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) - 1 AS VARCHAR) END, ',' ORDER BY nth), '') AS mask
FROM q LEFT JOIN c USING (conv_id) GROUP BY conv_id, speaker, part
"""
