"""Changes of tables and points, as the rows that result."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import changes
from fathom.operators.changes import Constraints, ForeignKey
from fathom.registry import query
from fathom.sources.tables import points, table

NATION = Constraints(primary_key=("n_nationkey",), unique={"name": ("n_name",)}, checks={"region": "n_regionkey >= 0"}, not_null=("n_name",), lengths={"n_name": 25})


def nations(spark, rows):
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


@query("insert_rows", "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', NULL")
def insert_rows(spark, sf_dir):
    """The check passes where it is unknown."""
    return changes.insert(table(spark, sf_dir, "nation"), nations(spark, [(100, "ATLANTIS", None)]), NATION)


@query("on_conflict_nothing", "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1")
def on_conflict_nothing(spark, sf_dir):
    return changes.on_conflict(table(spark, sf_dir, "nation"), nations(spark, [(3, "OTHER", 1), (100, "ATLANTIS", 1)]), ["n_nationkey"])


@query("on_conflict_update", "SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4) AND n_regionkey < 4 THEN n_name || '+' || CASE n_nationkey WHEN 3 THEN 'three' ELSE 'four' END ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (3, 4) AND n_regionkey < 4 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1")
def on_conflict_update(spark, sf_dir):
    new = nations(spark, [(3, "three", 1), (4, "four", 1), (100, "ATLANTIS", 1)])
    set_ = {"n_name": "n_name || '+' || excluded.n_name", "n_regionkey": "n_regionkey + 10"}
    return changes.on_conflict(table(spark, sf_dir, "nation"), new, ["n_nationkey"], set_, "n_regionkey < 4")


@query("update_where", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE round(s_acctbal * 2, 4) END AS s_acctbal FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT * FROM supplier WHERE s_nationkey >= 5")
def update_where(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return changes.update(s, {"s_acctbal": "case when s_acctbal < 0 then 0 else round(s_acctbal * 2, 4) end"}, "s_nationkey < 5")


@query("delete_where", "SELECT * FROM orders WHERE NOT (o_totalprice > 50000 AND o_orderstatus = 'F')")
def delete_where(spark, sf_dir):
    return changes.delete(table(spark, sf_dir, "orders"), "o_totalprice > 50000 and o_orderstatus = 'F'")


@query("delete_returning", "SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'F'")
def delete_returning(spark, sf_dir):
    return changes.affected(table(spark, sf_dir, "orders"), "o_totalprice > 50000 and o_orderstatus = 'F'").select("o_orderkey")


def _tables(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}


def _keys(action: str):
    return {
        "orders": [ForeignKey("fk_customer", ("o_custkey",), "customer", ("c_custkey",), on_delete=action)],
        "lineitem": [ForeignKey("fk_order", ("l_orderkey",), "orders", ("o_orderkey",), on_delete="cascade")],
    }


@query("delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))")
def delete_cascade(spark, sf_dir):
    left = changes.delete_rows(_tables(spark, sf_dir), _keys("cascade"), "customer", "c_acctbal < 0")
    return left["lineitem"].select("l_orderkey", "l_linenumber")


@query("delete_set_null", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def delete_set_null(spark, sf_dir):
    left = changes.delete_rows(_tables(spark, sf_dir), _keys("set null"), "customer", "c_acctbal < 0")
    return left["orders"].select("o_orderkey", "o_custkey")


@query("delete_set_default", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN (SELECT min(c_custkey) FROM customer WHERE c_acctbal >= 0) ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def delete_set_default(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    least = tables["customer"].where("c_acctbal >= 0").agg(F.min("c_custkey")).head()[0]
    left = changes.delete_rows(tables, _keys("set default"), "customer", "c_acctbal < 0", {"orders": {"o_custkey": str(least)}})
    return left["orders"].select("o_orderkey", "o_custkey")


@query("broken_references", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def broken_references(spark, sf_dir):
    fk = ForeignKey("fk", ("o_custkey",), "customer", ("c_custkey",))
    return changes.broken_references(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal >= 0"), fk).select("o_orderkey")


@query("alter_table", "SELECT r_regionkey::BIGINT AS region_id, r_name, 'new' AS note FROM region")
def alter_table(spark, sf_dir):
    r = changes.add_column(table(spark, sf_dir, "region"), "note", "string", "'new'")
    return changes.rename_column(changes.alter_type(r, "r_regionkey", "bigint"), "r_regionkey", "region_id")


@query("upsert_points", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id < 10 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT 'new', 5")
def upsert_points(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "label")
    new = p.where(F.col("id").cast("bigint") < 10).withColumn("label", F.lit(99)).unionByName(spark.createDataFrame([("new", 5)], "id string, label int"))
    return changes.upsert_points(p, new)


@query("payload_merge", "SELECT vec_id::VARCHAR AS id, label + 1 AS label, 'old' AS kept, 'x' AS fresh FROM embeddings")
def payload_merge(spark, sf_dir):
    p = points(spark, sf_dir)
    old = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("kept"), F.lit("old"))
    new = F.create_map(F.lit("label"), (F.col("label") + 1).cast("string"), F.lit("fresh"), F.lit("x"))
    m = p.select("id", changes.merge_payload(old, new).alias("m"))
    return m.select("id", F.col("m")["label"].cast("int").alias("label"), F.col("m")["kept"].alias("kept"), F.col("m")["fresh"].alias("fresh"))


@query("structural_check", "SELECT 'zero' AS id UNION ALL SELECT 'none'")
def structural_check(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("vector"))
    odd = spark.createDataFrame([("zero", [0.0] * 64), ("none", None)], "id string, vector array<double>")
    return changes.zero_vectors(p.unionByName(odd)).select("id")


ML_SOURCE = """
WITH rows AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size % 8 END AS f, p_brand AS g FROM part),
known AS (SELECT *, p_partkey % 4 <> 0 AND f IS NOT NULL AS labelled FROM rows),
middle AS (SELECT quantile_disc(f, 0.5) AS m FROM known WHERE labelled)
"""


def ml_source(spark, sf_dir, target):
    """Parts with a feature of eight values that settles the target, missing in places; every fourth row has no label."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") % 8).alias("f"), F.col("p_brand").alias("g"))
    return p.withColumn("y", F.when((F.col("p_partkey") % 4 != 0) & F.col("f").isNotNull(), target))


@query("ml_tree_view", ML_SOURCE + """
SELECT p_partkey, f, CASE WHEN labelled THEN v END AS actual, CASE WHEN coalesce(f, m) <= 2 THEN 'low' WHEN coalesce(f, m) <= 5 THEN 'mid' ELSE 'high' END AS prediction, 1.0::DOUBLE AS confidence, 1 AS refresh_version
FROM (SELECT *, CASE WHEN f <= 2 THEN 'low' WHEN f <= 5 THEN 'mid' ELSE 'high' END AS v FROM known), middle""")
def ml_tree_view(spark, sf_dir):
    """A tree must find the rule that made the labels; a missing number counts as the labelled rows' median."""
    from fathom.operators import views

    rule = F.when(F.col("f") <= 2, "low").when(F.col("f") <= 5, "mid").otherwise("high")
    return views.view(ml_source(spark, sf_dir, rule), ["p_partkey"], "y", ["f"], using="decision_tree")


@query("ml_tree_regression", ML_SOURCE + """
SELECT p_partkey, f, CASE WHEN labelled THEN 10.0 * f END AS actual, 10.0 * coalesce(f, m) AS prediction, NULL::DOUBLE AS confidence, 1 AS refresh_version FROM known, middle""")
def ml_tree_regression(spark, sf_dir):
    from fathom.operators import views

    out = views.view(ml_source(spark, sf_dir, F.col("f") * 10.0), ["p_partkey"], "y", ["f"], task="regression", using="decision_tree")
    return out.withColumn("prediction", F.round("prediction", 6))


@query("ml_forest_regression", """
SELECT count(*) AS n, count(*) FILTER (p_partkey % 4 = 0) AS unlabelled, true AS in_range, true AS near FROM part""")
def ml_forest_regression(spark, sf_dir):
    """A forest's trees differ between libraries, so what must hold of any: predictions of all rows, within the labels'
    range and nearer to the labels than their mean is."""
    from fathom.operators import views

    p = table(spark, sf_dir, "part").withColumn("y", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 2.0 + F.length("p_brand")))
    out = views.view(p, ["p_partkey"], "y", ["p_size", "p_brand", "p_type"], task="regression")
    known = out.agg(F.min("actual").alias("low"), F.max("actual").alias("high"), F.avg("actual").alias("mean"))
    both = out.crossJoin(F.broadcast(known))  # one row
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.col("actual").isNull()).alias("unlabelled"),
        F.bool_and(F.col("prediction").between(F.col("low") - 1e-9, F.col("high") + 1e-9)).alias("in_range"),
        (F.sum((F.col("prediction") - F.col("actual")) ** 2) < F.sum((F.col("actual") - F.col("mean")) ** 2)).alias("near"),
    )
