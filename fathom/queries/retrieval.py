"""Dense, sparse, text and hybrid retrieval over the driver's vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import vectors as V
from fathom.operators import dense, fusion, text
from fathom.registry import query
from fathom.sources.tables import points, table, text_points, texts

VEC = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
SCORES = {
    "cosine": "list_cosine_similarity(embedding::DOUBLE[], q)",
    "l2": "-list_distance(embedding::DOUBLE[], q)",
    "dot": "list_inner_product(embedding::DOUBLE[], q)",
}


def rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more, F.round("score", 6).alias("score"))


def oracle(metric: str, k: int = 10, where: str = "true", vec: str | None = None) -> str:
    return (
        f"SELECT vec_id::VARCHAR AS id, round(s, 6) AS score FROM (SELECT vec_id, {SCORES[metric]} AS s FROM embeddings, (SELECT {vec or VEC.format(0)} AS q) "
        f"WHERE {where}) ORDER BY s DESC, vec_id::VARCHAR LIMIT {k}"
    )


for _metric in SCORES:

    @query(f"dense_{_metric}", oracle(_metric))
    def run(spark, sf_dir, metric=_metric):
        p = points(spark, sf_dir).select("id", "vector")
        return rounded(dense.search(p, dense.stored_vector(p, "0"), metric=metric))


@query("dense_filtered", oracle("cosine", 20, "label IN (1, 3, 5) AND label >= 2"))
def dense_filtered(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(dense.search(p, dense.stored_vector(p, "0"), k=20, payload_filter={"label": {"in": [1, 3, 5], "gte": 2}}))


@query("dense_named", "SELECT vec_id::VARCHAR AS id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product(embedding[1:32]::DOUBLE[], q) AS s FROM embeddings, (SELECT embedding[1:32]::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)) ORDER BY s DESC, vec_id::VARCHAR LIMIT 15")
def dense_named(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(dense.search(p, dense.stored_vector(p, "7", "head"), k=15, metric="dot", using="head"))


@query("batch_search", """SELECT qid, id, round(s, 6) AS score, rank::INT AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def batch_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = dense.batch_search(e, e.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"))
    return found.withColumn("score", F.round("score", 6))


def _branch(n: int, vec: int, k: int) -> str:
    return f"SELECT {n} AS b, vec_id::VARCHAR AS id, s, row_number() OVER (ORDER BY s DESC, vec_id::VARCHAR) AS r FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, (SELECT {VEC.format(vec)} AS q)) QUALIFY r <= {k}"


BRANCHES = f"WITH b AS ({_branch(0, 0, 30)} UNION ALL {_branch(1, 9, 30)})"


@query("multi_rrf", BRANCHES + " SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM b GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 30")
def multi_rrf(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(dense.multi_search(p, [dense.stored_vector(p, "0"), dense.stored_vector(p, "9")], k=30))


@query("multi_weighted", BRANCHES + ", n AS (SELECT *, min(s) OVER (PARTITION BY b) AS lo, max(s) OVER (PARTITION BY b) AS hi FROM b), f AS (SELECT id, sum((CASE WHEN b = 0 THEN 0.7 ELSE 0.3 END)::DOUBLE * CASE WHEN hi = lo THEN 0.5 ELSE (s - lo) / (hi - lo) END) AS t FROM n GROUP BY id) SELECT id, round(t, 6) AS score FROM f ORDER BY t DESC, id LIMIT 30")
def multi_weighted(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(dense.multi_search(p, [dense.stored_vector(p, "0"), dense.stored_vector(p, "9")], k=30, mode="weighted", weights=[0.7, 0.3]))


_MEAN = "(SELECT list(m ORDER BY i) FROM (SELECT i, avg(v) FILTER (vec_id IN (0, 1)) - avg(v) FILTER (vec_id = 2) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 3) GROUP BY i))"


@query("recommend", oracle("cosine", 10, "vec_id > 2", _MEAN))
def recommend(spark, sf_dir):
    return rounded(dense.recommend(points(spark, sf_dir), ["0", "1"], ["2"]))


@query("rerank", f"SELECT id, round(t, 6) AS score FROM (SELECT id, s * CASE WHEN label = 3 THEN 1.5 ELSE 1 END * CASE WHEN label = 4 THEN 0.5 ELSE 1 END AS t FROM (SELECT vec_id::VARCHAR AS id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, (SELECT {VEC.format(0)} AS q) ORDER BY s DESC, id LIMIT 30)) ORDER BY t DESC, id LIMIT 10")
def rerank(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(dense.rerank(p, dense.stored_vector(p, "0"), [("label", 3, 1.5), ("label", 4, 0.5)]))


_DISTANCES = {"<->": ("l2", "list_distance(embedding::DOUBLE[], q)"), "<#>": ("ip", "-list_inner_product(embedding::DOUBLE[], q)"), "<=>": ("cosine", "1 - list_cosine_similarity(embedding::DOUBLE[], q)")}
for _op, (_name, _sql) in _DISTANCES.items():

    @query(f"distance_order_{_name}", f"SELECT vec_id::VARCHAR AS id, round(d, 6) AS distance FROM (SELECT vec_id, {_sql} AS d FROM embeddings, (SELECT {VEC.format(3)} AS q)) ORDER BY d, vec_id::VARCHAR LIMIT 10")
    def by_distance(spark, sf_dir, op=_op):
        p = points(spark, sf_dir)
        return dense.order_by_distance(p, op, dense.stored_vector(p, "3")).select("id", F.round("distance", 6).alias("distance"))


@query("vector_functions", "SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_functions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", dense.dims(F.col("embedding")).alias("dims"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


TOKENS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
ASKED = ["rewh", "with", "thatin"]


def bm25_cte(where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS f{i}" for i, w in enumerate(ASKED))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(ASKED)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.5::DOUBLE / (f{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))" for i in range(len(ASKED)))
    return (
        f"WITH tok AS (SELECT doc_id::VARCHAR AS id, lang, {TOKENS} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT id, lang, len(t)::DOUBLE AS l, {tf} FROM tok WHERE len(t) > 0), "
        f"st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {df} FROM c), bm AS (SELECT id, {score} AS s FROM c, st WHERE {where})"
    )


@query("bm25", bm25_cte() + " SELECT id, round(s, 6) AS score FROM bm WHERE s > 0 ORDER BY s DESC, id LIMIT 25")
def bm25(spark, sf_dir):
    return rounded(text.bm25(texts(spark, sf_dir).select("id", "text"), "text", "Rewh with, thatin WITH", k=25))


@query("bm25_filtered", bm25_cte("lang = 'en'") + " SELECT id, round(s, 6) AS score FROM bm WHERE s > 0 ORDER BY s DESC, id LIMIT 25")
def bm25_filtered(spark, sf_dir):
    """The filter chooses candidates; statistics stay those of the whole field."""
    return rounded(text.bm25(texts(spark, sf_dir).select("id", "text", "lang"), "text", "rewh with thatin", k=25, payload_filter={"lang": "en"}))


@query("text_hybrid_rrf", bm25_cte() + f""", sp AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM bm WHERE s > 0 QUALIFY r <= 40),
de AS (SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id::VARCHAR) AS r
  FROM embeddings JOIN documents ON vec_id = doc_id, (SELECT {VEC.format(0)} AS q) WHERE text IS NOT NULL QUALIFY r <= 40),
f AS (SELECT coalesce(de.id, sp.id) AS id, coalesce(1.0::DOUBLE / (10 + de.r), 0) + coalesce(1.0::DOUBLE / (10 + sp.r), 0) AS t, de.r AS dr, sp.r AS sr FROM de FULL JOIN sp ON de.id = sp.id)
SELECT id, round(t, 6) AS score, dr::INT AS dense_rank, sr::INT AS sparse_rank FROM f ORDER BY t DESC, dr NULLS LAST, sr NULLS LAST, id LIMIT 10""")
def text_hybrid_rrf(spark, sf_dir):
    p = text_points(spark, sf_dir)
    return rounded(text.text_hybrid(p, "text", "rewh with thatin", vector=dense.stored_vector(p, "0"), texts=texts(spark, sf_dir)), "dense_rank", "sparse_rank")


_ENCODE = f"""WITH tok AS (SELECT doc_id::VARCHAR AS id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT id, t, len(t)::DOUBLE AS l FROM tok WHERE len(t) > 0),
st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a FROM c), e AS (SELECT id, l, unnest(t) AS w FROM c), tf AS (SELECT id, l, w, count(*)::DOUBLE AS f FROM e GROUP BY ALL),
v AS (SELECT w, count(*)::DOUBLE AS d, row_number() OVER (ORDER BY w COLLATE "binary") - 1 AS dim FROM tf GROUP BY w),
x AS (SELECT id, dim, ln(1 + (n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS wt FROM tf JOIN v USING (w), st)"""


@query("sparse_encode", _ENCODE + " SELECT id, count(*)::INT AS cells, min(dim)::BIGINT AS first_dim, max(dim)::BIGINT AS last_dim, round(sum(wt), 4) AS weight FROM x WHERE wt > 0 GROUP BY id")
def sparse_encode(spark, sf_dir):
    s = F.col("sparse")
    got = text.encode(texts(spark, sf_dir).select("id", "text"), "text")
    return got.select("id", F.size(s["indices"]).alias("cells"), F.array_min(s["indices"]).alias("first_dim"), F.array_max(s["indices"]).alias("last_dim"), F.round(F.aggregate(s["values"], F.lit(0.0), lambda a, x: a + x), 4).alias("weight"))


def _sparse(spark, sf_dir):
    """A sparse vector of 16 dimensions: the first of each embedding, with the absolute ones of its negative left out."""
    cells = F.filter(F.transform(F.slice("vector", 1, 16), lambda x, i: F.struct(i.cast("bigint").alias("i"), x.cast("double").alias("w"))), lambda c: c["w"] > 0)
    p = points(spark, sf_dir).withColumn("c", cells)
    return p.withColumn("sparse", F.struct(F.col("c.i").alias("indices"), F.col("c.w").alias("values"))).drop("c")


_SPARSE = "SELECT vec_id::VARCHAR AS id, (CASE WHEN embedding[3] > 0 THEN embedding[3]::DOUBLE ELSE 0 END) * 1.5::DOUBLE + (CASE WHEN embedding[6] > 0 THEN embedding[6]::DOUBLE ELSE 0 END) * 0.25::DOUBLE AS s FROM embeddings"


@query("sparse_search", f"SELECT id, round(s, 6) AS score FROM ({_SPARSE}) WHERE s > 0 ORDER BY s DESC, id LIMIT 12")
def sparse_search(spark, sf_dir):
    return rounded(text.sparse_search(_sparse(spark, sf_dir), {2: 1.5, 5: 0.25, 900: 3.0}, k=12))


def _hybrid(share: str) -> str:
    return f"""WITH sp AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS r FROM ({_SPARSE}) WHERE s > 0 QUALIFY r <= 40),
de AS (SELECT vec_id::VARCHAR AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id::VARCHAR) AS r FROM embeddings, (SELECT {VEC.format(0)} AS q) QUALIFY r <= 40),
a AS (SELECT id, s, r, min(s) OVER () AS lo, max(s) OVER () AS hi FROM de), b AS (SELECT id, s, r, min(s) OVER () AS lo, max(s) OVER () AS hi FROM sp),
f AS (SELECT coalesce(a.id, b.id) AS id, {share} AS t, a.r AS dr, b.r AS sr FROM a FULL JOIN b ON a.id = b.id)
SELECT id, round(t, 6) AS score, dr::INT AS dense_rank, sr::INT AS sparse_rank FROM f ORDER BY t DESC, dr NULLS LAST, sr NULLS LAST, id LIMIT 10"""


@query("hybrid_rrf", _hybrid("coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(2.0::DOUBLE / (60 + b.r), 0)"))
def hybrid_rrf(spark, sf_dir):
    p = _sparse(spark, sf_dir)
    return rounded(text.hybrid(p, vector=dense.stored_vector(p, "0"), sparse={2: 1.5, 5: 0.25}, sparse_weight=2.0), "dense_rank", "sparse_rank")


@query("hybrid_weighted", _hybrid("coalesce(0.6::DOUBLE * (a.s - a.lo) / (a.hi - a.lo), 0) + coalesce(0.4::DOUBLE * (b.s - b.lo) / (b.hi - b.lo), 0)"))
def hybrid_weighted(spark, sf_dir):
    p = _sparse(spark, sf_dir)
    return rounded(text.hybrid(p, vector=dense.stored_vector(p, "0"), sparse={2: 1.5, 5: 0.25}, mode="weighted", dense_weight=0.6, sparse_weight=0.4), "dense_rank", "sparse_rank")


@query("fusion_ranks", BRANCHES + " SELECT id, r::INT AS rank, b AS branch, round(1.0::DOUBLE / (60 + r), 6) AS part FROM b")
def fusion_ranks(spark, sf_dir):
    p = points(spark, sf_dir)
    parts = [fusion.shares(dense.search(p, dense.stored_vector(p, v), k=30), "rrf", 1.0).withColumn("branch", F.lit(i)) for i, v in enumerate(("0", "9"))]
    return parts[0].unionByName(parts[1]).withColumn("part", F.round("part", 6))
