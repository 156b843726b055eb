"""Token counts by offset-mapped attribution.

A document's fields are joined into one record and encoded once; each token's character span is then joined to the
sections (a field's lines) it overlaps. A token inside one section counts there. A token across a boundary is allotted
by an explicit rule: ``start`` to the section of its first character, ``majority`` to the section that holds most of
its characters (the earlier one in a tie), ``fraction`` to each section by its share of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import held, slices, table

RULES = ("start", "majority", "fraction")
#: Longer records are encoded in parts that begin at a line's first word.
PART = 1 << 20

def encoder(ranks: bytes, pattern: str):
    """This worker's (encode, byte length of each id)."""

    def build():
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        lengths = np.zeros(max(merges.values()) + 1, np.int64)
        for token, number in merges.items():
            lengths[number] = len(token)
        return tiktoken.Encoding("record", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary, lengths

    return held(("ranks", hash((ranks, pattern))), build)


def spans(text: str, encode, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the text and each one's span of characters: a character counts to every token that has a byte of it."""
    ids = []
    for part in cuts(text):
        ids += encode(part)
    ids = np.array(ids, np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return ids, starts, ends
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    upto = np.cumsum(lead)  # characters begun at or before each byte
    return ids, upto[starts] - 1, upto[ends - 1]


def cuts(text: str) -> Iterator[str]:
    """Parts that encode to the whole's ids: each ends in a letter right before one space and a letter."""
    at = 0
    while len(text) - at > PART:
        cut = text.find(" ", at + PART)
        while cut > 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def sections(fields: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int, int]]]:
    """The record, and (field, line, start, end) of its sections; a line holds its newline, so they leave no gap."""
    text, out, at = "\n".join(x for _, x in fields), [], 0
    for k, (name, value) in enumerate(fields):
        whole = value + ("\n" if k + 1 < len(fields) else "")
        lines = whole.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or not lines[:-1] else [])
        for i, line in enumerate(lines):
            out.append((name, i, at, at + len(line)))
            at += len(line)
    return text, out


def allot(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its ends. ``bounds`` are the sections' starts, then
    the last one's end. Empty sections get none; where characters are shared by tokens, each token has its own span."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing, count = np.flatnonzero(first != last), np.zeros(n)
    touched = np.zeros(n, np.int64)
    inside = np.bincount(first[first == last], minlength=n).astype(float)
    count += inside
    for i in crossing.tolist():
        which = np.arange(first[i], last[i] + 1)
        share = np.minimum(bounds[which + 1], ends[i]) - np.maximum(bounds[which], starts[i])
        touched[which[share > 0]] += 1
        if rule == "start":
            count[first[i]] += 1
        elif rule == "majority":
            count[which[np.argmax(share)]] += 1
        else:
            count[which] += share / share.sum()
    return count, touched


OUT = "doc_id bigint, field string, section bigint, char_start bigint, char_end bigint, n_tokens {}, crossing bigint"


def attribute(
    docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), *, id_col: str = "doc_id",
    rule: str = "majority", ranks: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """One row per document and section: its span in the record, its tokens, and those that cross its ends.

    Null fields count as empty and have one empty section with no tokens; so has an empty text. Repeated rows and
    null ids give rows like any other; other columns are not read; an empty table gives no rows. Each record's
    tokens sum to its length in tokens under every rule.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()  # noqa: SIM115
    sent = docs.sparkSession.sparkContext.broadcast((raw, pattern or public_tokenizers.PATTERN))
    names = [f"f{i}" for i in range(len(fields))]
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)])
    kind = pa.float64() if rule == "fraction" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(*sent.value)
        for batch in batches:
            for part in slices(batch, names[-1]):
                columns: list[list] = [[] for _ in range(7)]
                for doc, *values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text, found = sections([(f, v or "") for f, v in zip(fields, values, strict=True)])
                    _, starts, ends = spans(text, encode, lengths) if text else (None, *[np.zeros(0, np.int64)] * 2)
                    bounds = np.array([s[2] for s in found] + [found[-1][3]])
                    count, touched = allot(starts, ends, bounds, rule)
                    for c, x in zip(columns, ([doc] * len(found), *zip(*found, strict=True), count.tolist(), touched.tolist()), strict=True):
                        c += x
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), kind, pa.int64())
                arrays = [pa.array(c if k != pa.int64() or i != 5 else map(int, c), k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in OUT.split(", ")])

    return given.mapInArrow(run, OUT.format("double" if rule == "fraction" else "bigint"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"))
