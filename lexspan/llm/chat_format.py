r"""Chat formatting from event logs.

A log row is (conv_id, message, seq, kind, role, text). Events of a message are folded in the
order of `seq`: `start` names the role, `delta` appends, `edit` replaces everything so far,
`regenerate` discards it. Messages stand in the order of their ids. Each is rendered as

    [INST] text [/INST]      user          <s>text</s>                       assistant
    [SYS] text [/SYS]        system        [ROLE] role [=] text [/ROLE]      any other

with a line end. A control string inside a text gets a backslash after its first character
and a backslash is doubled, so that no control string is left and reading back is exact.
The loss mask covers the texts of assistant turns.

Folding is split by message, so a conversation that holds a third of all events spreads over
the cluster; only deltas after the last edit or regeneration are kept, and what is put
together in one place is one final message. A digest of a conversation is sequential by
nature: turns are sorted by conversation and read as a stream that holds one turn at a time.

Defined cases: null text and null role are empty; a null conversation id is a conversation of
its own; a null turn comes first; rows with equal turn are ordered by role and text and each
is a turn, repeated rows included; a message without a `start` has an empty role; an empty
log gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import query, table

DELTA = 200
_CONTROL = r"([<\[])(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|=\])"
# role: (text before, text after)
MARKS = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n"), "system": ("[SYS] ", " [/SYS]\n")}
_OTHER = re.compile(r"\[ROLE\] (.*?) \[=\] (.*) \[/ROLE\]\n", re.DOTALL)


def event_log(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log of a chat service that ended in the given rows conv_id, turn, role, text.

    Texts arrive as deltas. An assistant's message first has a draft that is regenerated; any
    other message is first written wrongly and then edited.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    copy = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("message", F.struct(F.col("turn").alias("turn"), copy.alias("copy")))
    # One pass over the text, whatever its length.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    none = F.lit("")
    deltas = F.transform(pieces, lambda p: event("delta", p))
    draft = F.array(event("start", none), event("delta", F.substring("text", 1, delta // 2)))
    redone = F.concat(draft, F.array(event("regenerate", none)), deltas)
    edited = F.concat(draft, F.array(event("edit", F.coalesce(F.get(pieces, F.lit(0)), none))), F.slice(deltas, F.lit(2), F.size(deltas)))
    log = rows.select("conv_id", "message", "role", F.posexplode(F.when(F.col("role") == "assistant", redone).otherwise(edited)).alias("seq", "e"))
    return log.select("conv_id", "message", "seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def fold(log: DataFrame) -> DataFrame:
    """Final messages conv_id, message, role, text of an event log."""
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(W.partitionBy("conv_id", "message"))
    live = log.withColumn("reset", reset).filter(
        (F.col("kind") == "start") | (F.col("kind").isin("delta", "edit") & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))))
    part = F.when(F.col("kind") != "start", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    return live.groupBy("conv_id", "message").agg(
        F.coalesce(F.min_by("role", F.when(F.col("kind") == "start", F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, turn_text and the loss mask of the turn as a pair of positions."""
    text, role = escaped(F.col("text")), F.col("role")
    shown = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [=] "), text, F.lit(" [/ROLE]\n"))
    for name, (before, after) in MARKS.items():
        shown = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(shown)
    before, after = MARKS["assistant"]
    rows = messages.select("conv_id", "message", "role", shown.alias("turn_text"))
    masked = role == "assistant"
    return rows.select("conv_id", "message", "turn_text", F.when(masked, len(before)).alias("loss_from"),
                       F.when(masked, F.length("turn_text") - len(after)).alias("loss_to"))


def read_turn(shown: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    for role, (before, after) in MARKS.items():
        if shown.startswith(before) and shown.endswith(after):
            return role, unescaped(shown[len(before) : len(shown) - len(after)])
    m = _OTHER.fullmatch(shown)
    if m is None:
        raise ValueError("not a rendered turn")
    return unescaped(m[1]), unescaped(m[2])


class _Digest:
    """Running digests of one conversation; holds no text."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, shown: str, start: int | None, end: int | None) -> None:
        role, text = read_turn(shown)
        self.n += 1
        self.chars += len(shown)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescaped(shown[start:end])
            self.loss += len(learnt)
            self.masked.update(learnt.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss,
                "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.chars}


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns come one after another."""
    current: _Digest | None = None
    for batch in batches:
        done = []
        for conv_id, shown, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn_text", "loss_from", "loss_to"))):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(shown, start, end)
        yield pa.RecordBatch.from_pylist(done, _SCHEMA)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.row()], _SCHEMA)


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered turns."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "turn_text", "loss_from", "loss_to").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"

_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
shown AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|=\])', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 WHEN 'system' THEN 14
      ELSE 22 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|=\])', '\1\\\2', 'g')) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query("op9_chat_format", _SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that is made of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(render(fold(event_log(turns.union(probe)))))
