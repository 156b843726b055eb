"""Reflection rowsets: what tables and columns there are, under information_schema and pg_catalog names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Spark's type names as PostgreSQL spells them.
SPELLED = {"smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "real", "double": "double precision", "string": "text", "boolean": "boolean", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "variant": "jsonb"}
OIDS = {"smallint": 21, "int": 23, "bigint": 20, "float": 700, "double": 701, "string": 25, "boolean": 16, "binary": 17, "date": 1082, "timestamp": 1184, "variant": 3802}


def spelled(kind: str) -> str:
    if kind.startswith("decimal"):
        return "numeric" + kind.removeprefix("decimal")
    return SPELLED.get(kind, "vector" if kind in ("array<float>", "array<double>") else kind)


def columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """information_schema.columns."""
    rows = [("public", t, f.name, i, spelled(f.dataType.simpleString())) for t, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")


def tables(spark: SparkSession, names: Mapping[str, DataFrame]) -> DataFrame:
    """information_schema.tables."""
    return spark.createDataFrame([("public", t, "BASE TABLE") for t in names], "table_schema string, table_name string, table_type string")


def pg_class(spark: SparkSession, names: Mapping[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(16384 + i, t, "r", len(df.columns)) for i, (t, df) in enumerate(sorted(names.items()))], "oid int, relname string, relkind string, relnatts int")


def pg_attribute(spark: SparkSession, names: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(16384 + i, f.name, j, OIDS.get(f.dataType.simpleString(), 0), not f.nullable) for i, (_, df) in enumerate(sorted(names.items())) for j, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "attrelid int, attname string, attnum int, atttypid int, attnotnull boolean")


def pg_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, spelled(k)) for k, o in OIDS.items()], "oid int, typname string")


def pg_namespace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(11, "pg_catalog"), (2200, "public")], "oid int, nspname string")
