"""Tables, points, edges and series as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, vectors, label): ``embeddings`` as a collection of 64 dimensions with one named vector of 32."""
    e = table(spark, sf_dir, "embeddings")
    named = F.create_map(F.lit("head"), F.slice("embedding", 1, 32))
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), named.alias("vectors"), "label")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, lang, source, n_chars): documents alone, for what reads no vector; nothing is joined."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source", "n_chars")


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, text, lang, source, n_chars): documents with the vector of the same number, where there is one."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = d.join(e, d["doc_id"] == e["vec_id"], "left")
    return joined.select(F.col("doc_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "text", "lang", "source", "n_chars")


def _edge(df: DataFrame, kind: str, src: Column, dst: Column, weight: Column) -> DataFrame:
    return df.select(
        F.concat_ws("|", F.lit(kind), src, dst, weight.cast("string")).alias("edge_id"), src.alias("src"), dst.alias("dst"),
        F.lit(kind).alias("type"), weight.cast("double").alias("weight"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 'n', customer 'c', order 'o', part 'p' and supplier 's' vertices, joined along their keys."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation, customer, orders, line = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    line_id = F.col("l_linenumber")
    return (
        _edge(nation, "IN_REGION", name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(1))
        .unionByName(_edge(customer, "IN_NATION", name("c", "c_custkey"), name("n", "c_nationkey"), F.lit(1)))
        .unionByName(_edge(orders, "PLACED", name("c", "o_custkey"), name("o", "o_orderkey"), F.lit(1)))
        .unionByName(_edge(line, "CONTAINS", name("o", "l_orderkey"), name("p", "l_partkey"), line_id))
        .unionByName(_edge(line, "SUPPLIED_BY", name("p", "l_partkey"), name("s", "l_suppkey"), line_id))
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant, asset, property, time_ns, value): ``events`` by user and kind of event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("asset"), F.col("event_type").alias("property"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"), "value",
    )
