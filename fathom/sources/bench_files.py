"""Readers of two benchmark formats: fixed-size vector files and retrieval sets in JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout of a vector file: magic, train rows u64, test rows u64, dimension u32, neighbours u32, metric u8, reserved to
#: 48 bytes, then float32 train and test vectors and uint32 neighbours, all little-endian.
MAGIC, HEADER, METRICS = b"GBENCHv1", 48, ("l2", "cosine", "dot")


def header(raw: bytes) -> dict:
    if raw[:8] != MAGIC or len(raw) < HEADER:
        raise ValueError("not a vector benchmark file")
    train, test = np.frombuffer(raw, "<u8", 2, 8).tolist()
    dim, k = np.frombuffer(raw, "<u4", 2, 24).tolist()
    return {"train": train, "test": test, "dim": dim, "k": k, "metric": METRICS[raw[32]]}


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(part, id, vector, neighbours): train vectors, then test vectors with their true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                h = header(raw)
                at = HEADER
                for part, n in (("train", h["train"]), ("test", h["test"])):
                    m = np.frombuffer(raw, "<f4", n * h["dim"], at).reshape(n, h["dim"])
                    at += m.nbytes
                    near = np.frombuffer(raw, "<u4", h["test"] * h["k"], len(raw) - 4 * h["test"] * h["k"]).reshape(h["test"], h["k"])
                    for a in range(0, n, 4096):
                        rows = m[a : a + 4096]
                        of = [near[i].astype(np.int64).tolist() if part == "test" else None for i in range(a, a + len(rows))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(rows)), pa.array(range(a, a + len(rows)), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float32())), pa.array(of, pa.list_(pa.int64()))],
                            names=["part", "id", "vector", "neighbours"],
                        )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part string, id bigint, vector array<float>, neighbours array<bigint>")


SET = "dim int, corpus array<struct<id:string,text:string,vector:array<double>>>, queries array<struct<id:string,text:string,vector:array<double>>>, qrels map<string,map<string,int>>"


def retrieval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements) of a retrieval set."""
    whole = spark.read.schema(SET).option("multiLine", True).json(path)
    item = lambda c: whole.select(F.explode(c).alias("x")).select("x.id", "x.text", "x.vector")
    judged = whole.select(F.explode("qrels").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "relevance"))
    return item("corpus"), item("queries"), judged


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of (query_id, doc_id, rank) from rank 1: gains 2^rel - 1, by log2 of the rank."""
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("got"))
    ideal = judged.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("relevance"), False), 1, k).alias("r"))
    best = F.aggregate(F.transform("r", lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    both = ideal.select("query_id", best.alias("best")).join(got, "query_id", "left")
    return both.select("query_id", F.when(F.col("best") > 0, F.coalesce("got", F.lit(0.0)) / F.col("best")).otherwise(0.0).alias("ndcg"))
