"""BM25, sparse vectors and hybrid retrieval.

Term counts of a query are taken within each row, so a search reads its texts twice (statistics, then scores) and
shuffles only one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fathom.constants import BM25_B, BM25_K1, DEFAULT_K, RRF_TEXT, TEXT_DEPTH, TEXT_QUERY_BYTES
from fathom.errors import require
from fathom.functions.payload import where
from fathom.functions.tokens import tokens, words
from fathom.materialize import small, stored
from fathom.operators import dense, fusion

#: Tokens of a block of texts, which a worker holds at a time, and the texts and terms that it writes in a piece.
BLOCK_TOKENS, BLOCK_ROWS, BLOCK_TERMS = 2_000_000, 256, 10_000


def terms(query: str) -> list[str]:
    """The distinct terms of a query, in order of first appearance."""
    require(len(query.encode()) <= TEXT_QUERY_BYTES, "invalid_query", f"a query has at most {TEXT_QUERY_BYTES} bytes")
    return list(dict.fromkeys(words(query)))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def counts(corpus: DataFrame, field: str, asked: Sequence[str]) -> DataFrame:
    """Add ``_length`` and ``_tf0``, ``_tf1``, ...: tokens in the field, and how many of them are each asked term."""
    held = corpus.withColumn("_tokens", tokens(F.col(field)))
    tf = {f"_tf{i}": F.size("_tokens") - F.size(F.array_remove("_tokens", F.lit(t))) for i, t in enumerate(asked)}
    return held.withColumns({"_length": F.size("_tokens")} | tf).drop("_tokens")


def bm25(points: DataFrame, field: str, query: str, *, k: int | None = DEFAULT_K, payload_filter: dict | None = None) -> DataFrame:
    """Points by BM25 of one string field: (..., score), those that hold a term. The filter picks candidates and does
    not touch the statistics, which cover every row whose field has a token."""
    asked = terms(query)
    held = counts(points, field, asked).where(F.col("_length") > 0)
    empty = points.withColumn("score", F.lit(0.0)).limit(0)
    if not asked or k == 0:
        return empty
    sums = [F.sum((F.col(f"_tf{i}") > 0).cast("bigint")).alias(f"d{i}") for i in range(len(asked))]
    stats = held.agg(F.count("*").alias("n"), F.sum("_length").alias("total"), *sums).head()
    if not stats.n or not stats.total:
        return empty
    score, average = F.lit(0.0), stats.total / stats.n
    for i in range(len(asked)):
        tf = F.col(f"_tf{i}").cast("double")
        share = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_length") / average))
        score = score + F.lit(idf(stats.n, stats[f"d{i}"])) * F.when(tf > 0, share).otherwise(0.0)
    found = where(held, payload_filter).withColumn("score", score).where("score > 0")
    found = found.drop("_length", *[f"_tf{i}" for i in range(len(asked))])
    return found if k is None else dense.top(found, k)


def vocabulary(counted: DataFrame) -> DataFrame:
    """(term, dim, df) of distinct terms (term, df): in code point order from 0, numbered by range partitions and their row counts."""
    ordered = stored(counted.repartitionByRange("term").sortWithinPartitions("term").withColumn("n", F.monotonically_increasing_id()))
    width = 1 << 33
    part = F.floor(F.col("n") / width)
    sizes = sorted((r.p, r.c) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # one row a partition
    before, at = {}, 0
    for p, c in sizes:
        before[p] = at
        at += c
    if not before:
        return ordered.select("term", F.lit(0).cast("bigint").alias("dim"), "df")
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part)
    return ordered.select("term", (first + F.col("n") % width).cast("bigint").alias("dim"), "df")


def _block(ids: pa.Array, lists: pa.Array, name: int) -> Iterator[dict]:
    """Columns of a block: its texts as numbers in its own list of terms with their counts, then that list in pieces."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    v = len(coded.dictionary)
    row = np.repeat(np.arange(len(length)), length)
    cell, tf = np.unique(row * v + coded.indices.to_numpy(), return_counts=True)
    offsets = pa.array(np.searchsorted(cell, np.arange(len(length) + 1) * v).astype(np.int32))
    at, df = (cell % v).astype(np.int32), np.bincount(cell % v, minlength=v)
    for x in range(0, len(length), BLOCK_ROWS):
        part = slice(x, min(x + BLOCK_ROWS, len(length)))
        own = offsets.slice(x, part.stop - x + 1)
        yield {
            "block": np.full(part.stop - x, name), "id": ids.slice(x, part.stop - x), "length": length[part],
            "at": pa.ListArray.from_arrays(own, pa.array(at)), "tf": pa.ListArray.from_arrays(own, pa.array(tf.astype(np.int32))),
        }
    for x in range(0, v, BLOCK_TERMS):
        n = min(BLOCK_TERMS, v - x)
        yield {
            "block": np.full(1, name), "first": np.full(1, x, np.int32), "term": pa.ListArray.from_arrays([0, n], coded.dictionary.slice(x, n)),
            "df": pa.ListArray.from_arrays([0, n], pa.array(df[x : x + n].astype(np.int64))),
        }


def _blocks(target: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists = (c.chunk(0) for c in table.columns)
            for found in _block(ids, lists, name):
                n = len(found["block"])
                columns = [pa.array(found[f.name]).cast(f.type) if f.name in found else pa.nulls(n, f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())
            if size >= BLOCK_TOKENS:
                yield from closed()
                name, held, size = name + 1, [], 0
        if held:
            yield from closed()

    return run


def _weighed(n: int, average: float, target: pa.Schema):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return target.empty_table()
        terms = known.num_rows
        dim, df = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        at = known["at"].to_numpy()
        dim[at], df[at] = known["dim"].to_numpy(), known["df"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        lists, counts = docs["at"].combine_chunks(), docs["tf"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(docs.num_rows), size)
        at, tf, length = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64), docs["length"].to_numpy()[row]
        weight = idf[at] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))
        order = np.lexsort((dim[at], row))
        order = order[weight[order] > 0]
        ends = np.cumsum(np.bincount(row[order], minlength=docs.num_rows))
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        indices = pa.ListArray.from_arrays(offsets, pa.array(dim[at][order]))
        values = pa.ListArray.from_arrays(offsets, pa.array(weight[order]))
        sparse = pa.StructArray.from_arrays([indices, values], fields=list(target.field("sparse").type))
        out = pa.Table.from_arrays([docs["id"], sparse], schema=target)
        return out.filter(pa.array(np.diff(offsets.to_numpy()) > 0))

    return run


def encode(corpus: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """(id, sparse): each text as a sparse vector of BM25 weights over the sorted vocabulary; weights of 0 are left out.

    Texts are read and tokenized once, in blocks of bounded size that number their terms by themselves. Of each block
    only its list of terms is joined with the vocabulary; then the texts, as numbers, meet it.
    """
    spark = corpus.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{2 << 20}b")
    rows = corpus.select(F.col(id_col).alias("id"), tokens(F.col(field)).alias("t")).where(F.size("t") > 0)
    kind = rows.schema["id"].dataType
    schema = f"block bigint, id {kind.simpleString()}, length int, at array<int>, tf array<int>, first int, term array<string>, df array<bigint>"
    target = to_arrow_schema(StructType.fromDDL(schema))
    cut = stored(rows.mapInArrow(_blocks(target), schema))
    docs, lists = cut.where("first is null").select("block", "id", "length", "at", "tf"), cut.where("first is not null")
    totals = docs.agg(F.count("*").alias("n"), F.sum("length").alias("total")).head()
    each = lists.select("block", "first", F.posexplode(F.arrays_zip("term", "df")).alias("p", "x"))
    each = each.select("block", (F.col("first") + F.col("p")).alias("at"), F.col("x.term").alias("term"), F.col("x.df").alias("df"))
    known = small(vocabulary(each.groupBy("term").agg(F.sum("df").alias("df"))))
    asked = each.drop("df").join(known, "term").select(F.col("block").alias("own"), "at", "dim", "df")
    out = f"id {kind.simpleString()}, sparse struct<indices: array<bigint>, values: array<double>>"
    weighed = _weighed(totals.n, (totals.total or 0) / max(1, totals.n) or 1.0, to_arrow_schema(StructType.fromDDL(out)))
    return docs.groupBy("block").cogroup(asked.groupBy("own")).applyInArrow(weighed, out)


def sparse_score(sparse: Column, query: Mapping[int, float]) -> Column:
    """The dot product with a sparse query, row by row."""
    require(bool(query), "invalid_query", "a sparse query needs a dimension")
    asked = F.create_map(*[x for d, w in query.items() for x in (F.lit(int(d)).cast("bigint"), F.lit(float(w)))])
    each = F.zip_with(sparse["indices"], sparse["values"], lambda i, w: F.coalesce(F.try_element_at(asked, i.cast("bigint")), F.lit(0.0)) * w)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def sparse_search(points: DataFrame, query: Mapping[int, float], *, k: int | None = DEFAULT_K, payload_filter: dict | None = None, sparse: str = "sparse") -> DataFrame:
    """Points by sparse dot product; scores of 0 or less are left out."""
    rows = where(points, payload_filter).where(F.col(sparse).isNotNull())
    found = rows.withColumn("score", sparse_score(F.col(sparse), query)).where("score > 0")
    return found if k is None else dense.top(found, k)


def hybrid(
    points: DataFrame, *, vector: Sequence[float] | None = None, sparse: Mapping[int, float] | None = None, k: int = DEFAULT_K,
    metric: str = "cosine", mode: str = "rrf", dense_weight: float = 1.0, sparse_weight: float = 1.0, payload_filter: dict | None = None,
    depth: int | None = None,
) -> DataFrame:
    """HYBRID: a dense and a sparse branch, fused. Branches reach 4k deep, which is this engine's choice."""
    depth = depth or min(10_000, TEXT_DEPTH * k)
    d = dense.search(points, vector, k=depth, metric=metric, payload_filter=payload_filter) if vector is not None else None
    s = sparse_search(points, sparse, k=depth, payload_filter=payload_filter) if sparse else None
    return fusion.best(fusion.fuse(d, s, mode=mode, dense_weight=dense_weight, sparse_weight=sparse_weight), k)


def text_hybrid(
    points: DataFrame, field: str, query: str, *, vector: Sequence[float] | None = None, k: int = DEFAULT_K, metric: str = "cosine",
    payload_filter: dict | None = None, texts: DataFrame | None = None,
) -> DataFrame:
    """HYBRID ... TEXT 'q' FIELD f: BM25 alone without a vector, else both branches 4k deep over points whose field is
    a string, fused by rank. ``texts`` are the same points without vectors, where these are joined from another table:
    the BM25 branch reads them, so that no text is shuffled."""
    held = points if texts is None else texts
    if k == 0:
        return points.select("id").withColumn("score", F.lit(0.0)).limit(0)
    if vector is None:
        return bm25(held, field, query, k=k, payload_filter=payload_filter).select("id", "score")
    depth = TEXT_DEPTH * k
    s = bm25(held, field, query, k=depth, payload_filter=payload_filter)
    d = dense.search(points.where(F.col(field).isNotNull()), vector, k=depth, metric=metric, payload_filter=payload_filter)
    return fusion.best(fusion.fuse(d, s, constant=RRF_TEXT), k)
