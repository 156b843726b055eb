"""Multi-model pipelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import dense, graph, relational, temporal
from fathom.plans.pipeline import Join, Pipeline, run, with_ref
from fathom.queries.graphs import ring
from fathom.queries.retrieval import VEC
from fathom.registry import query
from fathom.sources.tables import points, series, table

_NEAR = f"v AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, (SELECT {VEC.format(0)} AS q) ORDER BY s DESC, vec_id::VARCHAR LIMIT 20)"


def _vectors(spark, sf_dir):
    p = points(spark, sf_dir)
    found = dense.search(p.select("id", "label", "vector"), dense.stored_vector(p, "0"), k=20).drop("vector")
    return with_ref(found, "vectors")


def _documents(spark, sf_dir, sql="SELECT doc_id, lang, n_chars FROM documents"):
    d = relational.select(spark, sql, (), {"documents": table(spark, sf_dir, "documents")})
    return d.withColumn("vector_ref", F.struct(F.lit("vectors").alias("namespace"), F.col("doc_id").cast("string").alias("id")))


@query("pipeline_vector_rel", f"WITH {_NEAR} SELECT vec_id::VARCHAR AS id, lang, n_chars, round(s, 6) AS score FROM v JOIN documents ON doc_id = vec_id ORDER BY n_chars DESC, id, lang LIMIT 8")
def pipeline_vector_rel(spark, sf_dir):
    stages = {"v": _vectors(spark, sf_dir), "d": _documents(spark, sf_dir)}
    p = Pipeline(stages, [Join("inner", "d", "v.record_ref", "d.vector_ref")], ["v.id", "d.lang", "d.n_chars", "v.score"], 8, ("d.n_chars", "desc"))
    return run(p).withColumn("score", F.round("score", 6))


@query("pipeline_left_nulls", f"WITH {_NEAR} SELECT vec_id::VARCHAR AS id, lang FROM v LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') ON doc_id = vec_id ORDER BY lang DESC NULLS FIRST, id LIMIT 12")
def pipeline_left_nulls(spark, sf_dir):
    stages = {"v": _vectors(spark, sf_dir), "d": _documents(spark, sf_dir, "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")}
    return run(Pipeline(stages, [Join("left", "d", "v.record_ref", "d.vector_ref")], ["v.id", "d.lang"], 12, ("d.lang", "desc")))


@query("pipeline_vector_graph_rel", f"""WITH RECURSIVE e AS (SELECT vec_id::VARCHAR AS src, ((vec_id + 1) % 500)::VARCHAR AS dst FROM embeddings UNION ALL SELECT vec_id::VARCHAR, ((vec_id * 7 + 3) % 500)::VARCHAR FROM embeddings),
{_NEAR}, r(id, depth) AS (SELECT vec_id::VARCHAR, 0 FROM v UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.id WHERE depth < 2), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT d.id, d.depth, lang FROM d JOIN documents ON doc_id::VARCHAR = d.id WHERE d.depth > 0 ORDER BY n_chars, d.id, d.depth, lang LIMIT 30""")
def pipeline_vector_graph_rel(spark, sf_dir):
    """The graph starts from the vectors found; its nodes join documents."""
    v = _vectors(spark, sf_dir)
    g = with_ref(graph.traverse(ring(spark, sf_dir), v.select("id"), depth=2).rows, "vectors")
    stages = {"g": g, "d": _documents(spark, sf_dir)}
    return run(Pipeline(stages, [Join("inner", "d", "g.record_ref", "d.vector_ref")], ["g.id", "g.depth", "d.lang"], 30, ("d.n_chars", "asc")))


@query("pipeline_rel_temporal_left", """WITH s AS (SELECT user_id::VARCHAR AS asset, epoch_us(ts) * 1000 AS time_ns, value FROM events WHERE event_type = 'click'),
r AS (SELECT s_suppkey, s_nationkey, s_suppkey::VARCHAR AS asset FROM supplier WHERE s_suppkey < 20), h AS (SELECT * FROM s WHERE asset IN (SELECT asset FROM r) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY time_ns) <= 3)
SELECT s_suppkey, time_ns::VARCHAR AS time_ns, value FROM r LEFT JOIN h USING (asset) ORDER BY s_suppkey, time_ns::VARCHAR NULLS LAST, value LIMIT 50""")
def pipeline_rel_temporal_left(spark, sf_dir):
    """Suppliers stand in for assets; one without samples keeps a row of nulls."""
    r = relational.select(spark, "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey < 20", (), {"supplier": table(spark, sf_dir, "supplier")})
    r = r.withColumn("ref", F.struct(F.lit("assets").alias("namespace"), F.col("s_suppkey").cast("string").alias("id")))
    t = temporal.shown(temporal.history_of(series(spark, sf_dir), r.select(F.col("ref.id").alias("asset")), "click", 0, 1 << 62, 3))
    return run(Pipeline({"r": r, "t": t}, [Join("left", "t", "r.ref", "t.asset_ref")], ["r.s_suppkey", "t.time_ns", "t.value"], 50, ("r.s_suppkey", "asc")))


@query("pipeline_chain", f"WITH {_NEAR} SELECT vec_id::VARCHAR AS id, d.doc_id AS \"d.doc_id\", l.doc_id AS \"l.doc_id\", toxic FROM v JOIN documents d ON doc_id = vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY s, 1, 2, 3, 4 LIMIT 100")
def pipeline_chain(spark, sf_dir):
    stages = {"v": _vectors(spark, sf_dir), "d": _documents(spark, sf_dir), "l": table(spark, sf_dir, "labels")}
    joins = [Join("inner", "d", "v.record_ref", "d.vector_ref"), Join("left", "l", "d.doc_id", "l.doc_id")]
    return run(Pipeline(stages, joins, ["v.id", "d.doc_id", "l.doc_id", "l.toxic"], 100, ("v.score", "asc")))
