"""The relational read surface, each statement through the SQL front end."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fathom.operators import relational
from fathom.registry import query
from fathom.sources.tables import table


def shown(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def register(name: str, sql: str, *parameters, tables: str, oracle: str | None = None, strict: bool = True) -> None:
    """The statement over the named tables; its oracle is the same statement with values in place of $n."""
    plain = re.sub(r"\$(\d+)", lambda m: shown(parameters[int(m[1]) - 1]), oracle or sql)

    @query(name, plain)
    def run(spark, sf_dir):
        return relational.select(spark, sql, parameters, {t: table(spark, sf_dir, t) for t in tables.split()}, strict)


register("where_comparisons", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'A' AND l_tax <= 0.02 AND l_linenumber > 1", tables="lineitem")
register("three_valued_logic", "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000 WHERE NOT (c.c_acctbal > 9000 OR o.o_totalprice < 1000)", tables="orders customer")
register("null_tests", "SELECT o.o_orderkey, o.o_orderstatus FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' WHERE c.c_custkey IS NULL AND o.o_orderstatus IS NOT NULL", tables="orders customer")
register("in_list", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 7, 33) AND p_type NOT IN ('SMALL', 'LARGE')", tables="part")
register("not_in_with_null", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c.c_custkey FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_custkey < 3)", tables="supplier nation customer")
register("between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_custkey NOT BETWEEN 10 AND 1000", tables="orders")
register("exists_subquery", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9990) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1000000)", tables="nation customer")
register("semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", tables="customer orders")
register("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", tables="customer orders")
register("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) AND o_custkey < 50", tables="orders")
register("typed_parameters", "SELECT o_orderkey FROM orders WHERE o_orderpriority = $1 AND o_totalprice > $2 AND o_custkey < $3", "1-URGENT", 1000.5, 200, tables="orders")
register("projection_alias", "SELECT n.*, r.r_name AS region, n.n_nationkey + 1 AS next_key FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", tables="nation region")
register("cast_family", "SELECT o_orderkey::int AS k, CAST(o_totalprice AS float)::double precision IS NOT NULL AS priced, CAST(o_custkey AS smallint) AS c FROM orders WHERE o_custkey < 30000".replace("double precision", "double"), tables="orders")
register("concat_arithmetic", "SELECT p_partkey, p_brand || '-' || p_type AS label, p_size * 2 + 1 AS size2, round(p_retailprice / 4, 4) AS quarter FROM part", tables="part")
register("inner_join", "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY'", tables="orders customer")
register("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '5-LOW'", tables="customer orders")
register("self_join_chain", "SELECT a.n_name AS one, b.n_name AS two, r.r_name FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey INNER JOIN region r ON r.r_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", tables="nation region")
register("using_join", "SELECT l.doc_id, l.toxic, d.lang FROM labels l INNER JOIN documents d USING (doc_id) WHERE l.quality = 1", tables="labels documents")
register("star_join", "SELECT r.r_name, l.l_returnflag, COUNT(*) AS lines, round(SUM(l.l_extendedprice), 2) AS revenue FROM lineitem l INNER JOIN orders o ON l.l_orderkey = o.o_orderkey INNER JOIN customer c ON o.o_custkey = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, l.l_returnflag", tables="lineitem orders customer nation region")
register("agg_basic", "SELECT COUNT(*) AS n, COUNT(c.c_acctbal) AS known, SUM(o.o_custkey) AS keys, round(AVG(o.o_totalprice), 6) AS mean, MIN(o.o_orderdate) AS first, MAX(c.c_name) AS last FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0", tables="orders customer", oracle="SELECT COUNT(*) AS n, COUNT(c.c_acctbal) AS known, SUM(o.o_custkey)::BIGINT AS keys, round(AVG(o.o_totalprice), 6) AS mean, MIN(o.o_orderdate) AS first, MAX(c.c_name) AS last FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0")
register("agg_empty", "SELECT COUNT(*) AS n, COUNT(o_custkey) AS known, SUM(o_custkey) AS total, AVG(o_totalprice) AS mean, MIN(o_orderkey) AS least FROM orders WHERE o_orderkey < 0", tables="orders", oracle="SELECT COUNT(*) AS n, COUNT(o_custkey) AS known, SUM(o_custkey)::BIGINT AS total, AVG(o_totalprice) AS mean, MIN(o_orderkey) AS least FROM orders WHERE o_orderkey < 0")
register("agg_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_linenumber) AS lines, AVG(DISTINCT l_linenumber) AS mean, COUNT(ALL l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", tables="lineitem", oracle="SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_linenumber)::BIGINT AS lines, AVG(DISTINCT l_linenumber) AS mean, COUNT(l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
register("group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS quantity, round(AVG(l_discount), 6) AS discount, MIN(l_shipdate) AS first FROM lineitem GROUP BY l_returnflag, l_linestatus", tables="lineitem")
register("group_having", "SELECT o_custkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 5 AND MAX(o_totalprice) > 1000", tables="orders")
register("select_distinct", "SELECT DISTINCT p.p_brand, s.s_nationkey FROM part p LEFT JOIN supplier s ON p.p_partkey = s.s_suppkey", tables="part supplier")
register("select_all", "SELECT ALL p_brand, p_size FROM part WHERE p_size < 5", tables="part", oracle="SELECT p_brand, p_size FROM part WHERE p_size < 5")
register("order_nulls_topk", "SELECT o.o_orderkey, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 9000 ORDER BY c.c_acctbal DESC, o.o_orderkey LIMIT 40", tables="orders customer", oracle="SELECT o.o_orderkey, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 9000 ORDER BY c.c_acctbal DESC NULLS FIRST, o.o_orderkey LIMIT 40")
register("order_nulls_explicit", "SELECT o.o_orderkey, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 9000 ORDER BY c.c_acctbal DESC NULLS LAST, o.o_orderkey ASC NULLS FIRST LIMIT 40", tables="orders customer")
register("order_ordinal", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 25", tables="orders")
register("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 13 OFFSET 160", tables="orders")
register("limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", tables="orders")
register("cte_chain", "WITH big (k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k, total FROM big WHERE total > 100000) SELECT c.c_name, round(t.total, 2) AS total FROM top t INNER JOIN customer c ON c.c_custkey = t.k", tables="orders customer")
register("nested_in_cte", "WITH hot AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 30) SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM hot) AND p_size > (SELECT MIN(p_size) FROM part)", tables="lineitem part")

RANKING = "WITH stream_diff_ranking AS (SELECT i::int AS id, CASE WHEN i % 11 = 0 THEN NULL ELSE ((i * 17) % 13 - 6)::int END AS score, 'item-' || lpad(i::varchar, 3, '0') AS note FROM range(128) t(i)) "


def ranking(spark):
    """128 rows by the formula of the differential tests."""
    i = F.col("id")
    score = F.when(i % 11 == 0, None).otherwise(((i * 17) % 13 - 6).cast("int"))
    return spark.range(128).select(i.cast("int").alias("id"), score.alias("score"), F.format_string("item-%03d", i).alias("note"))


def differential(name: str, sql: str) -> None:
    @query(name, RANKING + sql)
    def run(spark, sf_dir):
        return relational.select(spark, sql, (), {"stream_diff_ranking": ranking(spark)})


differential("window_desc_nulls_last", "SELECT id, score FROM stream_diff_ranking ORDER BY score DESC NULLS LAST, id ASC LIMIT 17 OFFSET 5")
differential("window_asc_nulls_first", "SELECT id, score FROM stream_diff_ranking WHERE id > 20 ORDER BY score ASC NULLS FIRST, id DESC LIMIT 30")
differential("window_filtered", "SELECT note, score FROM stream_diff_ranking WHERE score IS NOT NULL AND score BETWEEN -2 AND 3 ORDER BY score ASC NULLS LAST, note ASC LIMIT 20 OFFSET 3")
differential("window_grouped", "SELECT score, COUNT(*) AS n, MIN(id) AS least FROM stream_diff_ranking GROUP BY score HAVING COUNT(*) > 9 ORDER BY n DESC NULLS LAST, score ASC NULLS LAST LIMIT 8")


@query("boolean_column", "SELECT doc_id, lang FROM (SELECT doc_id, lang, n_chars > 500 AS long, source IN ('src1', 'src2') AS picked FROM documents) WHERE long AND NOT picked")
def boolean_column(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 500).alias("long"), F.col("source").isin("src1", "src2").alias("picked"))
    return relational.select(spark, "SELECT doc_id, lang FROM flags WHERE long AND NOT picked", (), {"flags": d})


@query("record_ref", "SELECT o_orderkey, 'customers' AS namespace, o_custkey::VARCHAR AS id, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def record_ref(spark, sf_dir):
    """A typed reference (namespace, id) is a join key between models."""
    ref = lambda c: F.struct(F.lit("customers").alias("namespace"), F.col(c).cast("string").alias("id"))
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumn("customer_ref", ref("o_custkey"))
    c = table(spark, sf_dir, "customer").withColumn("record_ref", ref("c_custkey"))
    return o.join(c, o["customer_ref"] == c["record_ref"]).select("o_orderkey", "customer_ref.namespace", "customer_ref.id", "c_name")


@query("catalog_tables", "SELECT * FROM (VALUES ('public', 'nation', 'n_nationkey', 1, 'integer'), ('public', 'nation', 'n_name', 2, 'text'), ('public', 'nation', 'n_regionkey', 3, 'integer'), ('public', 'region', 'r_regionkey', 1, 'integer'), ('public', 'region', 'r_name', 2, 'text')) v(table_schema, table_name, column_name, ordinal_position, data_type)")
def catalog_tables(spark, sf_dir):
    from fathom.plans import catalog

    return catalog.columns(spark, {t: table(spark, sf_dir, t) for t in ("nation", "region")})
