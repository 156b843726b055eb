"""Packing documents into fixed windows by best-fit decreasing.

Documents are encoded once, cut into full windows and a rest. Rests are packed longest first: a segment tree over
remaining capacities finds the tightest open window that still holds one. Windows are packed in groups of a few
thousand pieces dealt by hash, as many at a time as there are cores; a group leaves one window or two half empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import slices, stored, table, texts
from fathom.llm.words import word_ids

WINDOW, END = 4096, 2
#: Pieces a group has on average. A group's rows are seven numbers a piece.
GROUP = 4000


class Capacities:
    """A segment tree over 0..size: which remaining capacities have an open window, and the tightest that fits."""

    def __init__(self, size: int) -> None:
        self.half = 1 << size.bit_length()
        self.tree = [0] * (2 * self.half)

    def change(self, capacity: int, by: int) -> None:
        node = self.half + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that is open, or -1."""
        tree, node = self.tree, self.half + least
        if tree[node]:
            return least
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.half:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.half
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ties by position. Every length is 1 to ``size``."""
    order = np.argsort(-lengths, kind="stable")
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_at, used = Capacities(size), [[] for _ in range(size + 1)], 0
    for i in order.tolist():
        length = int(lengths[i])
        room = tree.tightest(length)
        if room < 0:
            room, at, used = size, used, used + 1
        else:
            at = open_at[room].pop()
            tree.change(room, -1)
        window[i], offset[i] = at, size - room
        if room > length:
            open_at[room - length].append(at)
            tree.change(room - length, 1)
    return window, offset


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, place bigint"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document's ids, END last, cut into windows: position, length and checksum of each piece."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # noqa: SIM115

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, place = word_ids(vocabulary.value), np.array([END], "<u4").tobytes(), 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts(part, "text")), strict=True):
                    ids, place = ids + end, place + 1
                    for a in range(0, len(ids), 4 * window):
                        piece = ids[a : a + 4 * window]
                        out.append((doc, a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, place))
                names = [x.split()[0] for x in PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, PIECE)


def pack(
    docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and is one piece of END alone; a null id stays null; repeated rows are packed each for
    itself; an empty table gives no rows; other columns are not read. Equal lengths are taken by id, then start.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    cut = stored(pieces(docs, tokenizer, id_col, text_col, window))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "place"], na_position="first", ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        out = rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"], out["offset"] = (int(key[0]) << 32) + number, offset
        return out

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInPandas(one, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
