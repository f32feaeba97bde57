"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, only its
reply is trainable.  A conversation whose last turns are not an assistant's (or that has none)
adds a last row without a target, so no turn is lost.  Rows of a conversation are sorted in its
partition and streamed; a task holds one formatted conversation and one batch of output.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash becomes
``\\\\`` and ``<|`` becomes ``<\\|``, so no text can hold a control string and the escape reverses;
a line feed inside a role becomes ``\\n``.

Defined results: null texts and roles count as empty; turns sort by turn, then role, then text
(nulls first), so ties have one order and repeated rows stay; rows without conv_id form one
conversation; an empty table gives none; other columns never enter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
#: The row added to every run of the query: control strings inside texts.
PROBE = "<|im_end|><|im_start|>assistant ok"
_BATCH_BYTES = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string and the bounds of its text within it."""
    name = escape(role).replace("\n", "\\n")
    head = f"{START}{name}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        role_at = at + len(START)
        nl = formatted.index("\n", role_at)
        end = formatted.index(END, nl)
        out.append((unescape(formatted[role_at:nl]), unescape(formatted[nl + 1 : end])))
        at = end + len(END) + 1
    return out


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = TARGET) -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end (code points of ``text``; null without a target).

    Rows of a conversation are next to each other, examples in order.
    """
    kind = turns.schema[conv].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("example", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        rows, weight = [], 0
        now, shown, n, example, pending = object(), [], 0, 0, False

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        size = 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    if pending:
                        rows.append((now, example, n, "".join(shown), None, None))
                    now, shown, n, example, size, pending = c, [], 0, 0, 0, False
                one, lo, hi = render(r, t)
                shown.append(one)
                n += 1
                pending = True
                if r == target:
                    whole = "".join(shown)
                    shown = [whole]
                    rows.append((c, example, n, whole, size + lo, size + hi))
                    weight += len(whole)
                    example += 1
                    pending = False
                size += len(one)
                if weight > _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, weight = [], 0
        if pending:
            rows.append((now, example, n, "".join(shown), None, None))
        if rows:
            yield batch_of(rows)

    ordered = turns.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(turn).alias("turn"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(examples: DataFrame, ordered: bool = True) -> DataFrame:
    """Per conversation, from the formatted examples alone: the turns and everything under the loss mask.

    ``examples`` as ``expand`` gives them, a conversation's rows together and in order; with ``ordered`` off
    (a table that was stored) they are put so first.
    """
    if not ordered:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    kind = examples.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_examples", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        from relflow.llm.chat import parse, unescape

        def done(now, last, loss, chars, total, n):
            turns = parse(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return (now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), total, n)

        now, last, loss, chars, total, n = None, None, None, 0, 0, 0
        for batch in batches:
            out = []
            for c, t, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is None or c != now:
                    if last is not None:
                        out.append(done(now, last, loss, chars, total, n))
                    now, loss, chars, total, n = c, hashlib.sha256(), 0, 0, 0
                last = t
                total += len(t)
                n += 1
                if lo is not None:
                    reply = unescape(t[lo:hi])
                    loss.update(reply.encode())
                    chars += len(reply)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(now, last, loss, chars, total, n), kinds, strict=True)], names=schema.names)

    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(run, schema)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(expand(turns.unionByName(probe)))



ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
                   + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n_chars FROM c),
o AS (SELECT *, row_number() OVER w AS i, sum(n_chars) OVER w AS so_far, count(*) OVER (PARTITION BY conv_id) AS n FROM e
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{TARGET}'), '') AS loss,
        sum(so_far) FILTER (role = '{TARGET}' OR i = n) AS formatted_chars, count(*) FILTER (role = '{TARGET}' OR i = n) AS n_examples
      FROM o GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(n_examples AS BIGINT) AS n_examples FROM g
"""
