"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable.
Markers and role names of the template may occur inside texts; there they are escaped, and the escape is undone
exactly on reading back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import table

#: Strings that a tokenizer may take for control tokens; none may survive inside a text.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<pad>", "<unk>",
)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ESC = "␛"
#: The escape itself is doubled, a control string is broken after its first character, a role's newline is spelt out.
_TEXT = re.compile("|".join([ESC, *(re.escape(c) for c in CONTROL)]))
_ROLE = re.compile("|".join(["\n", ESC, *(re.escape(c) for c in CONTROL)]))
_BACK = re.compile(f"{ESC}(.)", re.S)
_TURN = re.compile(f"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)
BATCH_CHARS = 4 << 20


def _broken(found: re.Match) -> str:
    s = found[0]
    return ESC + ESC if s == ESC else ESC + "n" if s == "\n" else f"{s[0]}{ESC}.{s[1:]}"


def escape(text: str) -> str:
    return _TEXT.sub(_broken, text)


def escape_role(role: str) -> str:
    return _ROLE.sub(_broken, role)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: {"n": "\n", ".": ""}.get(m[1], m[1]), text)


def turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example; raises ValueError where something else stands between."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


EXAMPLE = "conv_id bigint, example bigint, turns bigint, text string, loss_start bigint, loss_end bigint, last boolean"


def examples(turns: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text): one row per assistant turn, in order, and one untrainable row (loss span
    empty, ``example`` null) for a conversation that doesn't end in one, so that no turn is lost.

    text[loss_start:loss_end], in code points, is the escaped reply. ``turns`` counts those in the text; ``last``
    marks the row that holds the whole conversation. Null role and null text count as empty; null conv_id is a
    conversation of its own; null turns come first; equal turns are ordered by role, then text, and repeated rows
    are repeated turns. Other columns are ignored; an empty table gives no examples.

    Rows are dealt by conversation and sorted, then streamed: a task holds one conversation's formatted prefix and a
    batch, never a list of a conversation's rows. What it writes grows with the square of a conversation's turns by
    the method's definition.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        now, parts, length, number, count, held = object(), [], 0, 0, 0, None

        def close():
            """The conversation's end: its last example or its untrainable rest is the row that holds all of it."""
            nonlocal held
            if count and held is None:
                held = (now, None, count, "".join(parts), 0, 0)
            if held is not None:
                out.append((*held, True))
            held = None

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    close()
                    now, parts, length, number, count = conv, [], 0, 0, 0
                if held is not None:
                    out.append((*held, False))
                    held = None
                head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
                parts = ["".join(parts), head, body, f"{CLOSE}\n"] if role == "assistant" else [*parts, head, body, f"{CLOSE}\n"]
                start = length + len(head)
                length = start + len(body) + len(CLOSE) + 1
                count += 1
                chars += len(body)
                if role == "assistant":
                    held = (now, number, count, "".join(parts), start, start + len(body))
                    parts, number, chars = [held[3]], number + 1, chars + length
                if chars > BATCH_CHARS and out:
                    yield _batch(out)
                    out, chars = [], 0
        close()
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, EXAMPLE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    names = ["conv_id", "example", "turns", "text", "loss_start", "loss_end", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"


def digests(formatted: DataFrame) -> DataFrame:
    """Read ``examples`` back, one row per conversation. It takes the rows in the order and place that ``examples``
    leaves them in; after a shuffle, deal them by conv_id and sort by (conv_id, turns, example) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars, total, number = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out = []
            for conv, example, _, text, a, b, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += len(text)
                if example is not None:
                    reply = unescape(text[a:b])
                    loss.update(reply.encode())
                    chars, number = chars + len(reply), number + 1
                if last:
                    found, whole = read_turns(text), hashlib.sha256()
                    for role, said in found:
                        whole.update(f"{role}\n{said}\n".encode())
                    out.append((conv, len(found), whole.hexdigest(), chars, loss.hexdigest(), total, number))
                    loss, chars, total, number = hashlib.sha256(), 0, 0, 0
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, DIGEST)


def op1_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(examples(given.unionByName(probe)))


def _sql_length(column: str, newline: bool) -> str:
    """Escaped length: 1 more for each escape (and newline of a role), 2 more for each control string."""
    found = "|".join(re.escape(c).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/") for c in CONTROL)
    one = f"length({column}) - length(replace({column}, '{ESC}', ''))"
    more = f" + length({column}) - length(replace({column}, chr(10), ''))" if newline else ""
    return f"(length({column}) + {one} + 2 * len(regexp_extract_all({column}, '{found}')){more})"


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
n AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        sum({len(OPEN) + 1 + len(CLOSE) + 1} + {_sql_length("role", True)} + {_sql_length("text", False)}) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant')::BIGINT AS n_examples
FROM n GROUP BY conv_id
"""
