"""Bulk loading from JSON lines: SQL first, then points, then edges, in batches that can be resumed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.lang.engine import EDGES, Engine
from fathom.operators import changes

#: A line of a points file and of an edges file.
POINT_LINE = "id string, vector array<double>, vectors map<string,array<double>>, sparse_vector struct<indices:array<bigint>,values:array<double>>, payload string"
EDGE_LINE = "source_point_id string, target_point_id string, edge_type string, properties string"


def points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file; payloads stay JSON text."""
    rows = spark.read.schema(POINT_LINE).json(path)
    return rows.select("id", "vector", "vectors", F.col("sparse_vector").alias("sparse"), F.coalesce("payload", F.lit("{}")).alias("payload"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a file; an edge's id is a hash of all it says, so a second load adds nothing."""
    rows = spark.read.schema(EDGE_LINE).json(path)
    key = F.sha2(F.to_json(F.struct("source_point_id", "target_point_id", "edge_type", "properties")), 256)
    return rows.select(key.alias("edge_id"), F.col("source_point_id").alias("src"), F.col("target_point_id").alias("dst"), F.col("edge_type").alias("type"), F.coalesce("properties", F.lit("{}")).alias("props"))


def load(engine: Engine, collection: str, *, sql: str | None = None, points_path: str | None = None, edges_path: str | None = None) -> dict[str, int]:
    """Load the files into a collection, one commit a phase. Every phase is idempotent: SQL lines carry a receipt,
    points replace by id, edges have ids from their content; so a load that was cut short is simply run again."""
    spark, done = engine.spark, {}
    if sql:
        n = 0
        for row in spark.read.text(sql).toLocalIterator():
            line = json.loads(row[0])
            statement, parameters = (line, []) if isinstance(line, str) else (line["sql"], line.get("parameters", []))
            key = hashlib.sha256(row[0].encode()).hexdigest()
            engine.execute(f"SQL {statement}", parameters, idempotency_key=key)
            n += 1
        done["sql"] = n
    if points_path:
        tx = engine.store.begin()
        new = points(spark, points_path).dropDuplicates(["id"])
        tx.put(f"points.{collection}", changes.upsert_points(tx.read(f"points.{collection}"), new))
        tx.commit()
        done["points"] = new.count()
    if edges_path:
        tx = engine.store.begin()
        held, new = tx.read(f"edges.{collection}"), edges(spark, edges_path).dropDuplicates(["edge_id"])
        fresh = new.join(held.select("edge_id"), "edge_id", "left_anti").select(*[c.split()[0] for c in EDGES.split(", ")])
        done["edges"] = fresh.count()
        tx.put(f"edges.{collection}", held.unionByName(fresh))
        tx.commit()
    return done
