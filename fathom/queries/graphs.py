"""Traversals over a graph made from the foreign keys, and retrieval restricted by a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import dense, graph
from fathom.queries.retrieval import VEC, rounded
from fathom.registry import query
from fathom.sources.tables import edges, points, table


def _sql(kind: str, src: str, dst: str, weight: str, source: str) -> str:
    return f"SELECT '{kind}|' || {src} || '|' || {dst} || '|' || {weight} AS edge_id, {src} AS src, {dst} AS dst, '{kind}' AS type FROM {source}"


EDGES = "e AS (" + " UNION ALL ".join([
    _sql("IN_REGION", "'n' || n_nationkey", "'r' || n_regionkey", "1", "nation"),
    _sql("IN_NATION", "'c' || c_custkey", "'n' || c_nationkey", "1", "customer"),
    _sql("PLACED", "'c' || o_custkey", "'o' || o_orderkey", "1", "orders"),
    _sql("CONTAINS", "'o' || l_orderkey", "'p' || l_partkey", "l_linenumber", "lineitem"),
    _sql("SUPPLIED_BY", "'p' || l_partkey", "'s' || l_suppkey", "l_linenumber", "lineitem"),
]) + ")"
OUT = ", w AS (SELECT src AS near, dst AS far, * FROM e)"
ANY = ", w AS (SELECT src AS near, dst AS far, * FROM e UNION ALL SELECT dst, src, * FROM e WHERE src <> dst)"


def walk(anchors: list[str], depth: int, types: list[str] | None = None, sides: str = OUT, passing: str = "") -> str:
    """A recursive walk: d(id, depth) holds every node's least depth, anchors at 0."""
    kinds = f"AND w.type IN ({', '.join(repr(t) for t in types)})" if types else ""
    start = ", ".join(f"('{a}')" for a in anchors)
    return f"""WITH RECURSIVE {EDGES}{sides}, g(id, depth) AS (SELECT * FROM (SELECT col0, 0 FROM (VALUES {start})) UNION
SELECT w.far, g.depth + 1 FROM g JOIN w ON w.near = g.id {kinds} {passing} WHERE g.depth < {depth}), d AS (SELECT id, min(depth) AS depth FROM g GROUP BY id)"""


@query("graph_nodes", walk(["c1", "c5"], 3, ["PLACED", "CONTAINS", "SUPPLIED_BY"]) + " SELECT id, depth FROM d WHERE depth > 0")
def graph_nodes(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), ["c1", "c5"], depth=3, types=["PLACED", "CONTAINS", "SUPPLIED_BY"]).rows


@query("graph_any_direction", walk(["n3"], 2, ["IN_NATION", "IN_REGION"], ANY) + " SELECT id, depth FROM d WHERE depth > 0")
def graph_any_direction(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), ["n3"], depth=2, direction="any", types=["IN_NATION", "IN_REGION"]).rows


@query("graph_edges", walk(["c1", "c5"], 1) + " SELECT w.edge_id, w.src, w.dst, w.type, min(d.depth) + 1 AS depth FROM d JOIN w ON w.near = d.id GROUP BY ALL")
def graph_edges(spark, sf_dir):
    """Each edge once with the hop it is first walked at."""
    return graph.traverse(edges(spark, sf_dir), ["c1", "c5"], depth=2, returning="edges").rows


@query("graph_depth_zero", "SELECT 'c1' AS id, 0 AS depth UNION ALL SELECT 'c5', 0")
def graph_depth_zero(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), ["c1", "c5"], depth=0).rows


_NODES = "JOIN (SELECT 'c' || c_custkey AS v, c_acctbal AS b FROM customer UNION ALL SELECT 'o' || o_orderkey, o_totalprice FROM orders) v ON v.v = w.far AND v.b > 5000"


@query("graph_filtered", walk(["n3"], 2, ["IN_NATION", "PLACED"], ANY, _NODES) + " SELECT id, depth FROM d WHERE depth > 0")
def graph_filtered(spark, sf_dir):
    """A node that fails the filter is neither returned nor walked through."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("balance"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").alias("balance"))
    found = graph.traverse(edges(spark, sf_dir), ["n3"], depth=2, direction="any", types=["IN_NATION", "PLACED"], nodes=c.unionByName(o), node_filter={"balance": {"gt": 5000}})
    return found.rows


@query("graph_edge_filter", walk(["o1", "o2", "o3"], 2, None, ", w AS (SELECT src AS near, dst AS far, * FROM e WHERE split_part(edge_id, '|', 4)::INT >= 2)") + " SELECT id, depth FROM d WHERE depth > 0")
def graph_edge_filter(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), ["o1", "o2", "o3"], depth=2, edge_filter=F.col("weight") >= 2).rows


@query("graph_paths", f"""WITH RECURSIVE {EDGES}, g(nodes, edges, here, depth) AS (SELECT ['c1'], []::VARCHAR[], 'c1', 0 UNION ALL
SELECT list_append(nodes, dst), list_append(edges, edge_id), dst, depth + 1 FROM g JOIN e ON e.src = g.here WHERE depth < 3 AND NOT list_contains(nodes, dst))
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges, depth FROM g WHERE depth > 0 ORDER BY g.depth, g.nodes, g.edges LIMIT 60""")
def graph_paths(spark, sf_dir):
    found = graph.paths(edges(spark, sf_dir), ["c1"], depth=3, limit=60)
    return found.select(F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), "depth")


@query("graph_edge_types", f"WITH {EDGES} SELECT type, count(*) AS edges FROM e GROUP BY type")
def graph_edge_types(spark, sf_dir):
    return graph.edge_types(edges(spark, sf_dir))


def ring(spark, sf_dir):
    """Two edges from each vector: to its follower and to a far one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))
    part = lambda kind, dst: e.select(F.concat(F.lit(kind), F.col("v").cast("string")).alias("edge_id"), F.col("v").cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("type"))
    return part("NEXT", (F.col("v") + 1) % 500).unionByName(part("LIKE", (F.col("v") * 7 + 3) % 500))


_RING = """WITH RECURSIVE e AS (SELECT vec_id::VARCHAR AS src, ((vec_id + 1) % 500)::VARCHAR AS dst, 'NEXT' AS type FROM embeddings
UNION ALL SELECT vec_id::VARCHAR, ((vec_id * 7 + 3) % 500)::VARCHAR, 'LIKE' FROM embeddings),
g(id, depth) AS (SELECT '10', 0 UNION SELECT e.dst, g.depth + 1 FROM g JOIN e ON e.src = g.id JOIN embeddings v ON v.vec_id::VARCHAR = e.dst AND v.label < 8 WHERE g.depth < 4)"""


@query("graph_connected_search", f"{_RING} SELECT id, round(s, 6) AS score FROM (SELECT vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, (SELECT {VEC.format(0)} AS q) WHERE vec_id::VARCHAR IN (SELECT id FROM g WHERE depth > 0) AND vec_id <> 10) ORDER BY s DESC, id LIMIT 10")
def graph_connected_search(spark, sf_dir):
    p = points(spark, sf_dir)
    found = graph.connected_search(p, ring(spark, sf_dir), ["10"], dense.stored_vector(p, "0"), hops=4, payload_filter={"label": {"lt": 8}}, k=10)
    return rounded(found)


@query("graph_relate", f"""WITH {EDGES}, x AS (SELECT * FROM e UNION ALL SELECT 'NEW|1', 'c1', 'c2', 'KNOWS') SELECT type, count(*) AS edges FROM x WHERE edge_id <> 'IN_REGION|n0|r0|1' GROUP BY type""")
def graph_relate(spark, sf_dir):
    """Relating twice adds one edge; unrelating takes one out."""
    e = edges(spark, sf_dir)
    new = spark.createDataFrame([("NEW|1", "c1", "c2", "KNOWS", 1.0)], e.schema)
    more = graph.relate(graph.relate(e, new), new)
    return graph.edge_types(graph.unrelate(more, ["IN_REGION|n0|r0|1"]))
