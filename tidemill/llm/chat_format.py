"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only the reply trainable.  What follows the last reply (or a
conversation without one) ends in an example with nothing trainable, so that
no turn is lost.

A turn is ``### role: text</turn>`` and a line end.  In roles and texts each
backslash, ``#`` and ``<`` (in roles ``:`` too) has a backslash before it, so
that no text can hold a mark and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hide, table

ASSISTANT = "assistant"
_HEAD, _MID, _TAIL = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
#: Rows of an output batch.
BATCH_CHARS = 8 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the examples, in order within a conversation.

    The loss mask is the code points from loss_start to loss_end, -1 where
    nothing is trainable.  Turns are ordered by turn (null first), then role
    and text; rows that repeat a turn all count.  Null roles and texts are
    empty; rows with a null conversation are one conversation.  An empty table
    gives no examples; extra columns are left out.  Conversations stream
    through sorted partitions, so a task holds one example at a time.
    """
    spark = turns.sparkSession
    plain, _, (c, n, r, t) = hide(turns, (), conv_col, turn_col, role_col, text_col)
    rows = plain.select(F.col(c).alias("conv_id"), F.col(n).alias("turn"), F.coalesce(F.col(r), F.lit("")).alias("role"), F.coalesce(F.col(t), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType

    def expand(batches: Iterator[pa.RecordBatch]):
        key_type, out, chars = None, [], 0
        conv, parts, size, example, open_turns = object(), [], 0, 0, 0

        def flush():
            cols = list(zip(*out, strict=True))
            b = pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["conv_id", "example", "text", "loss_start", "loss_end"])
            out.clear()
            return b

        for b in batches:
            key_type = b.column(0).type
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != conv:
                    if open_turns:
                        out.append((conv, example, "".join(parts), -1, -1))
                        chars += size
                    conv, parts, size, example, open_turns = c, [], 0, 0, 0
                head, body = f"{_HEAD}{escape_role(role)}{_MID}", escape(text)
                begin = size + len(head)
                parts.append(f"{head}{body}{_TAIL}")
                size += len(parts[-1])
                open_turns += 1
                if role == ASSISTANT:
                    parts = ["".join(parts)]
                    out.append((conv, example, parts[0], begin, begin + len(body)))
                    example, open_turns = example + 1, 0
                    chars += size
                if chars > BATCH_CHARS:
                    chars = 0
                    yield flush()
        if open_turns:
            out.append((conv, example, "".join(parts), -1, -1))
        if out:
            yield flush()

    return rows.mapInArrow(expand, f"conv_id {kind.simpleString()}, example long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame, in_order: bool = False) -> DataFrame:
    """What the examples of ``format_chats`` say of each conversation, parsed from their texts.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    of each conversation: its turns, read from the last example, which holds
    all; what the examples train on, in order; the length of all examples.
    Examples that were written and read again are dealt and sorted once more,
    as ``in_order`` says.  A null conversation is one; an empty table gives no
    rows; other columns do not matter.
    """
    if not in_order:
        n = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        examples = examples.repartition(n, "conv_id").sortWithinPartitions("conv_id", "example")
    examples = examples.select("conv_id", "example", "text", "loss_start", "loss_end")

    def digest(batches: Iterator[pa.RecordBatch]):
        key_type, out = None, []
        conv, last, loss, loss_chars, chars = object(), None, hashlib.sha256(), 0, 0

        def close():
            turns = read_turns(last)
            all_turns = hashlib.sha256()
            for role, text in turns:
                all_turns.update(f"{role}\n{text}\n".encode())
            return conv, len(turns), all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            key_type = b.column(0).type
            for c, _, text, a, e in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv or last is None:
                    if last is not None:
                        out.append(close())
                    conv, loss, loss_chars, chars = c, hashlib.sha256(), 0, 0
                last = text
                chars += len(text)
                if a >= 0:
                    reply = unescape(text[a:e])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
            if len(out) > 10_000:
                yield flush()
        if last is not None:
            out.append(close())
        if out:
            yield flush()

    kind = examples.schema["conv_id"].dataType.simpleString()
    return examples.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``conversations`` and for one of control strings, as ``read_back`` gives them."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(chats.unionByName(extra)), in_order=True)


QUERIES = {"op6_chat_format": op6_chat_format}

ORACLE_SQL = {
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
                + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""",
}
