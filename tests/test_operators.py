"""Operators against independent Python versions, and their refusals."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.errors import EngineError
from fathom.functions import payload, tokens, vectors
from fathom.operators import access, changes, dense, fusion, graph, index, relational, temporal, text, views
from fathom.operators.changes import Constraints, ForeignKey


def refused(code, f, *args, **named):
    with pytest.raises(EngineError) as e:
        f(*args, **named)
    assert e.value.code == code


# graph


def graph_rows():
    return [("e1", "1", "2", "LINK", True), ("e2", "1", "2", "LINK", False), ("e3", "2", "3", "LINK", True), ("e4", "2", "2", "LINK", True), ("e5", "3", "4", "OTHER", True)]


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = spark.createDataFrame(graph_rows(), "edge_id string, src string, dst string, type string, enabled boolean")
    nodes = spark.createDataFrame([("1", True), ("2", True), ("3", True), ("4", False)], "id string, allowed boolean")
    return edges, nodes


def test_small_graph(small_graph):
    edges, nodes = small_graph
    ids = lambda t: {(r.id, r.depth) for r in t.rows.collect()}
    assert ids(graph.traverse(edges, ["1"])) == {("2", 1), ("3", 2), ("4", 3)}
    assert ids(graph.traverse(edges, ["1"], nodes=nodes, node_filter=F.col("allowed"))) == {("2", 1), ("3", 2)}
    assert ids(graph.traverse(edges, ["4"], direction="in", depth=2)) == {("3", 1), ("2", 2)}
    walked = graph.traverse(edges, ["1"], returning="edges", types=["LINK"]).rows.collect()
    assert sorted((r.edge_id, r.depth) for r in walked) == [("e1", 1), ("e2", 1), ("e3", 2), ("e4", 2)]
    only = graph.traverse(edges, ["1"], edge_filter=F.col("enabled"), returning="edges", depth=1).rows.collect()
    assert [r.edge_id for r in only] == ["e1"]
    assert [(r.nodes, r.edges) for r in graph.paths(edges, ["1"], depth=2, limit=9).collect()] == [(["1", "2"], ["e1"]), (["1", "2"], ["e2"]), (["1", "2", "3"], ["e1", "e3"]), (["1", "2", "3"], ["e2", "e3"])]
    assert graph.traverse(edges, ["1"], budget=graph.Budget(visited=1)).truncation == "visited"
    assert graph.traverse(edges, ["none"]).rows.count() == 0
    refused("invalid_anchors", graph.traverse, edges, [])
    refused("invalid_depth", graph.traverse, edges, ["1"], depth=17)
    refused("limit_required", graph.paths, edges, ["1"], depth=2, limit=0)


def test_random_graph(spark):
    r = random.Random(4)
    rows = [(i, str(r.randrange(32)), str(r.randrange(32)), r.choice("AB")) for i in range(256)]
    edges = spark.createDataFrame(rows, "edge_id bigint, src string, dst string, type string")
    for direction in graph.DIRECTIONS:
        start, depth = str(r.randrange(32)), {}
        frontier, depth[start] = [start], 0
        for hop in range(1, 3):
            new = set()
            for _, a, b, kind in rows:
                if kind == "A":
                    pairs = {"out": [(a, b)], "in": [(b, a)], "any": [(a, b), (b, a)]}[direction]
                    new |= {y for x, y in pairs if x in frontier and y not in depth}
            depth |= dict.fromkeys(new, hop)
            frontier = new
        got = {x.id: x.depth for x in graph.traverse(edges, [start], depth=2, direction=direction, types=["A"]).rows.collect()}
        assert got == {k: v for k, v in depth.items() if v}


# payload filters


def python_match(given, payload_):
    def values(value, parts):
        if not parts:
            return value if isinstance(value, list) else [value]
        if isinstance(value, list):
            return [x for v in value for x in values(v, parts)]
        return values(value[parts[0]], parts[1:]) if isinstance(value, dict) and parts[0] in value else []

    def ok(x, op, bound):
        number = isinstance(x, (int, float)) and not isinstance(x, bool)
        same = type(x) is type(bound) and x == bound
        return {"eq": same, "ne": not same, "gt": number and x > bound, "lte": number and x <= bound}[op]

    for name, ops in given.items():
        found = values(payload_[name], []) if name in payload_ else values(payload_, name.split("."))
        if not any(all(ok(x, op, b) for op, b in ops.items()) for x in found):
            return False
    return True


LEAF = st.one_of(st.integers(-3, 3), st.booleans(), st.none(), st.sampled_from(["x", "y"]))
PAYLOAD = st.dictionaries(st.sampled_from(["a", "b", "a.b"]), st.one_of(LEAF, st.lists(LEAF, max_size=3), st.dictionaries(st.sampled_from(["b", "c"]), LEAF, max_size=2)), max_size=3)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(PAYLOAD, min_size=4, max_size=10), field=st.sampled_from(["a", "b", "a.b", "a.c"]), ops=st.dictionaries(st.sampled_from(["eq", "ne", "gt", "lte"]), st.integers(-2, 2), min_size=1, max_size=2))
def test_filters(spark, rows, field, ops):
    import json

    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, p string").withColumn("payload", F.parse_json("p"))
    got = {r.i for r in payload.where(df, {field: ops}).select("i").collect()}
    assert got == {i for i, r in enumerate(rows) if python_match({field: ops}, r)}


def test_filter_limits():
    deep = 1
    for _ in range(20):
        deep = {"x": deep}
    refused("invalid_filter", payload.checked, deep)
    refused("invalid_filter", payload.checked, {"x" * 300: 1})
    refused("invalid_filter", payload.checked, {"x": {"in": list(range(300))}})
    assert tokens.words("Ünï-Code ÉA 42") == ["Ünï", "code", "Éa", "42"]


# vectors


def test_vectors(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 0.0]), ("d", None)], "id string, vector array<double>")
    assert [(r.id, r.score) for r in dense.search(p, [2.0, 0.0], k=9).collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert dense.search(p, [1.0, 0.0], k=0).count() == 0
    refused("invalid_limit", dense.search, p, [1.0], k=10_001)
    refused("22023", dense.search, p, [math.nan, 0.0])
    refused("0A000", vectors.distance, "<+>", F.lit(1), F.lit(1))
    refused("point_not_found", dense.stored_vector, p, "zz")
    with pytest.raises(Exception, match="expected 3 dimensions"):
        dense.search(p, [1.0, 0.0, 0.0]).collect()
    assert vectors.parse("[1, 2.5]", 2) == [1.0, 2.5]
    refused("22000", vectors.parse, "[1]", 2)
    refused("22P02", vectors.parse, "[1,")
    refused("invalid_weights", dense.multi_search, p, [[1.0, 0.0]], weights=[1.0, 2.0])
    refused("invalid_fusion", fusion.shares, p, "max", 1.0)
    flat = p.limit(1).select("id", F.lit(3.0).alias("score"))
    assert fusion.shares(flat, "weighted", 2.0).head().part == 1.0
    assert text.bm25(p.withColumn("t", F.lit("hello")), "t", "   ").count() == 0
    refused("invalid_query", text.terms, "x" * 9000)


def test_batch_equals_single(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900 + i, [1.0] * 8) for i in range(5)]
    p = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    q = spark.createDataFrame([(0, [1.0] * 8), (1, rows[3][1])], "qid bigint, vector array<double>")
    for metric in ("cosine", "l2", "dot"):
        got = dense.batch_search(p, q, k=4, metric=metric).collect()
        for i, v in ((0, [1.0] * 8), (1, rows[3][1])):
            want = [x.id for x in dense.search(p, v, k=4, metric=metric).collect()]
            assert [x.id for x in sorted(got, key=lambda x: x.rank) if x.qid == i] == want


def test_batch_ties_and_memory():
    """Equal vectors tie wherever they stand, and scores are made in tiles: 2500 queries on 10,000 points are 200 MB at once."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(2)
    base = r.normal(size=(1000, 64))
    m, ids, q = np.tile(base, (10, 1)), np.arange(10_000), np.tile(base[:500], (5, 1))
    for metric in ("cosine", "l2", "dot"):
        best = dense._Best(q, 4, metric)
        tracemalloc.start()
        for at in range(0, len(m), 2048):
            best.add(m[at : at + 2048], ids[at : at + 2048])
        best.settle()
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        i, s, found = best.rows
        assert len(i) == len(q) * 4
        if metric != "dot":
            assert (found.reshape(-1, 4) == (np.arange(len(q)) % 500)[:, None] + 1000 * np.arange(4)).all()
        assert (np.diff(found.reshape(-1, 4)) % 1000 == 0).all() and (s.reshape(-1, 4) == s.reshape(-1, 4)[:, :1]).all()


def test_batch_blocks(spark, monkeypatch):
    """Blocks by what is held, no points asked for, and text ids."""
    p = spark.createDataFrame([(str(i), [float(i % 3), 1.0]) for i in range(20)], "id string, vector array<double>")
    q = p.selectExpr("id AS qid", "vector")
    want = {tuple(r) for r in dense.batch_search(p, q, k=3).collect()}
    assert len(want) == 60 and dense.batch_search(p, q, k=0).count() == 0
    monkeypatch.setattr(dense, "BLOCK_FOUND", 30)
    assert {tuple(r) for r in dense.batch_search(p, q, k=3).collect()} == want


def test_encode_blocks(spark, monkeypatch):
    """Vectors over several small blocks are those of plain Python, with one file of numbered texts and one of terms."""
    r = random.Random(3)
    texts = {str(i): " ".join(r.choice(["Ab", "c", "\u00e9t\u00e9", f"w{r.randrange(40)}", "\U00010400x"]) for _ in range(r.randrange(30))) for i in range(60)} | {"none": None, "blank": " ,"}
    held = {i: tokens.words(t) for i, t in texts.items() if t and tokens.words(t)}
    n, average = len(held), sum(map(len, held.values())) / len(held)
    dims = {w: d for d, w in enumerate(sorted({w for t in held.values() for w in t}))}
    df = {w: sum(w in t for t in held.values()) for w in dims}
    want = {}
    for i, t in held.items():
        share = {dims[w]: text.idf(n, df[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in t}
        want[i] = [*zip(*sorted(share.items()), strict=True)]
    corpus = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    written = []
    monkeypatch.setattr(text, "stored", lambda df, keep=text.stored: written.append(df.columns) or keep(df))
    for tokens_held in (text.BLOCK_TOKENS, 50):
        monkeypatch.setattr(text, "BLOCK_TOKENS", tokens_held)
        monkeypatch.setattr(text, "BLOCK_TERMS", 7)
        got = {x.id: x.sparse for x in text.encode(corpus, "text").collect()}
        assert got.keys() == want.keys()
        for i, (at, weights) in want.items():
            assert got[i]["indices"] == list(at) and got[i]["values"] == pytest.approx(weights)
    assert [len(x) for x in written] == [8, 3] * 2  # texts as numbers, then the vocabulary: no cell has a row of its own
    assert text.encode(corpus.where("text is null"), "text").count() == 0


def test_text_queries_read_no_vectors(spark):
    """What reads texts alone joins nothing that would shuffle them."""
    from fathom.registry import queries

    for name in ("bm25", "bm25_filtered"):
        assert "embeddings.parquet" not in "".join(queries()[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_payload_is_parsed_once(spark):
    """A payload's parsing has one place in the plan, however many conditions name it."""
    df = spark.createDataFrame([(1, '{"a": {"b": 3}, "a.b": 1, "t": ["x"]}'), (2, '{"a": {"b": 3}, "t": 5}'), (3, '{"a": {"b": "x"}, "t": []}'), (4, None)], "id int, json string")
    parsed = df.select("id", F.parse_json("json").alias("payload"))
    rules = {"a.b": "number", "t": "array", "missing": "optional_bool"}
    for out, want in (
        (payload.violations(parsed, rules).select("id", "violation"), [(2, "t"), (3, "a.b"), (4, "a.b")]),
        (payload.where(parsed, {"a.b": {"gte": 1, "lt": 5}, "t": {"ne": 7}}).select("id"), [(1,), (2,)]),
        (payload.where(parsed, {"a": {"nested": {"b": 3}}}).select("id"), [(1,), (2,)]),
    ):
        assert sorted(map(tuple, out.collect())) == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    again = payload.violations(parsed.withColumn("violation", F.lit("old")), rules)
    assert again.columns == ["id", "payload", "violation"] and {r.violation for r in again.collect()} == {"t", "a.b"}


def test_event_payloads_read_props_once(spark):
    """The queries over events read their number once a row and parse once, whatever a filter names."""
    from fathom.registry import queries

    for name in ("filter_literal_key", "filter_path", "payload_schema"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("parseJson"), plan.count("$.k")) == (1, 1)


def test_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    c = index.centres(e, 16)
    indexed = index.assign(e, c).persist()
    assert indexed.count() == e.count()
    queries = e.where("cast(id as bigint) % 200 = 0").collect()
    shares = []
    for q in queries:
        exact = [r.id for r in dense.search(e, q.vector).collect()]
        shares.append(index.recall([r.id for r in index.search(indexed, c, q.vector, probes=12).collect()], exact))
    indexed.unpersist()
    assert sum(shares) / len(shares) >= 0.9


# series


def test_temporal(spark):
    schema = "tenant string, asset string, property string, time_ns bigint, value double"
    held = spark.createDataFrame([("t", "a", "p", 1, 1.0), ("t", "a", "p", 5, 2.0)], schema)
    new = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows, n = temporal.appended(held, new(("t", "a", "p", 1, 1.0), ("t", "a", "p", -3, float("inf")), ("u", "a", "p", 1, 9.0)))
    assert n == 2 and {(r.tenant, r.time_ns) for r in rows.collect()} == {("t", -3), ("u", 1)}
    refused("temporal_conflict", temporal.appended, held, new(("t", "a", "p", 1, 2.0)))
    refused("temporal_conflict", temporal.appended, held, new(("t", "a", "p", 9, 2.0), ("t", "a", "p", 9, 3.0)))
    refused("temporal_sample", temporal.appended, held, new(("t", "a", "p", 9, math.nan)))
    refused("temporal_sample", temporal.appended, held, new(("t", "a" * 5000, "p", 9, 1.0)))
    refused("temporal_range", temporal.history, held, "a", "p", 5, 1, 3)
    refused("temporal_limit", temporal.history, held, "a", "p", 1, 5, 4097)
    assert [r.time_ns for r in temporal.history(held, "a", "p", 1, 5, 10).collect()] == [1]
    assert temporal.latest(held, "none", "p").count() == 0
    assert [temporal.coverage(1, 5, *x) for x in ((6, 9), (1, 6), (2, 9), (3, 3))] == ["Skip", "All", "Partial", "Skip"]
    assert temporal.value_text(-math.inf) == "-Infinity"


# changes


def test_constraints(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, n int")
    c = Constraints(primary_key=("id",), unique={"u": ("name",)}, checks={"n": "n >= 0"}, not_null=("name",), lengths={"name": 3})
    row = lambda *r: spark.createDataFrame([r], t.schema)
    assert changes.insert(t, row(3, "c", None), c).count() == 3
    for bad, code in ((row(1, "c", 1), "23505"), (row(3, "a", 1), "23505"), (row(None, "c", 1), "23502"), (row(3, None, 1), "23502"), (row(3, "c", -1), "23514"), (row(3, "long", 1), "22001")):
        refused(code, changes.insert, t, bad, c)
    refused("21000", changes.on_conflict, t, row(1, "x", 1).union(row(1, "y", 1)), ["id"], {"name": "excluded.name"})
    assert changes.on_conflict(t, row(1, "x", 1).union(row(1, "y", 1)), ["id"]).count() == 2
    refused("42846", changes.alter_type, t, "name", "int")
    refused("2BP01", changes.drop_column, t, "id", c)
    refused("42701", changes.rename_column, t, "id", "name")
    refused("42703", changes.rename_column, t, "none", "x")


def test_foreign_keys(spark):
    parent = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, parent_id int")
    for action, want in (("cascade", [(11, 2), (12, None)]), ("set null", [(10, None), (11, 2), (12, None)]), ("set default", [(10, 0), (11, 2), (12, None)])):
        fk = ForeignKey("fk", ("parent_id",), "parent", ("id",), on_delete=action)
        out = changes.delete_rows({"parent": parent, "child": child}, {"child": [fk]}, "parent", "id = 1", {"child": {"parent_id": "0"}})
        assert sorted(map(tuple, out["child"].collect())) == want
    for action in ("restrict", "no action"):
        fk = ForeignKey("fk", ("parent_id",), "parent", ("id",), on_delete=action)
        refused("23503", changes.delete_rows, {"parent": parent, "child": child}, {"child": [fk]}, "parent", "id = 1")
    fk = ForeignKey("fk", ("parent_id",), "parent", ("id",), on_update="cascade")
    out = changes.update_rows({"parent": parent, "child": child}, {"child": [fk]}, "parent", {"id": "id + 100"}, "id = 1")
    assert sorted(map(tuple, out["child"].collect())) == [(10, 101), (11, 2), (12, None)]
    two = spark.createDataFrame([(1, None), (None, None), (5, 5)], "a int, b int")
    keys = spark.createDataFrame([(1, 1)], "a int, b int")
    simple, full = (ForeignKey("f", ("a", "b"), "p", ("a", "b"), match=m) for m in ("simple", "full"))
    assert changes.broken_references(two, keys, simple).count() == 1 and changes.broken_references(two, keys, full).count() == 2


def test_views(spark):
    rows = [(i, float(i % 7), "a" if i % 2 else "b", ("x" if i % 2 else "y") if i % 5 else None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, price double, label string, kind string, amount double")
    out = views.view(df, ["id"], "kind", ["price", "label"], using="decision_tree").collect()
    assert len(out) == 60 and all(r.prediction == ("x" if r.id % 2 else "y") and 0 <= r.confidence <= 1 for r in out)
    refused("ml_source", views.view, df, ["id"], "label", ["price"])
    refused("ml_method", views.view, df, ["id"], "kind", ["price"], using="svm")
    refused("ml_source", views.view, df, [], "kind", ["price"])


def test_views_fit_in_tasks_of_bounded_size(spark, monkeypatch):
    """A source in one partition is dealt out, so that no task of a fit reads all of it, and a rerun agrees."""
    seen, fit = [], views.Pipeline.fit

    def watched(self, df, *more):
        seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, df, *more)

    monkeypatch.setattr(views.Pipeline, "fit", watched)
    df = spark.range(2000).coalesce(1).selectExpr("id", "concat('k', id % 5) AS kind", "cast(id % 7 AS double) AS size", "if(id % 4 = 0, null, id % 7 + id % 5) AS y")
    whole = views.view(df, ["id"], "y", ["kind", "size"], task="regression").count()
    monkeypatch.setattr(views, "TASK_NUMBERS", 10_400)
    out = [sorted(map(tuple, views.view(df, ["id"], "y", ["kind", "size"], task="regression").collect())) for _ in range(2)]
    assert whole == len(out[0]) == 2000 and out[0] == out[1]
    assert seen[0] == [1500] and sum(seen[1]) == 1500 and max(seen[1]) < 400


# SQL surface


def test_sql_surface(spark):
    ok = relational.statement
    assert ok("SELECT a FROM t ORDER BY a DESC, b LIMIT 2").endswith("ORDER BY a DESC NULLS FIRST , b NULLS LAST LIMIT 2")
    assert "NULLS" not in ok("SELECT 'order by x' FROM t")
    for sql, code in {
        "SELECT 1 UNION SELECT 2": "0A000", "SELECT a[1] FROM t": "0A000", "SELECT ?": "42601", "SELECT 1; SELECT 2": "42601", "SELECT (1": "42601",
        "SELECT * FROM a, LATERAL b": "0A000", "SELECT sum(x) OVER () FROM t": "0A000", "": "42601", "DELETE FROM t": "0A000",
        "SELECT " + "(" * 40 + "1" + ")" * 40: "54001",
    }.items():
        refused(code, relational.statement, sql)
    got = relational.select(spark, "SELECT $1 AS a, 'it''s \\n' AS b, $2 AS c", [1, "x"]).head()
    assert tuple(got) == (1, "it's \\n", "x")
    with pytest.raises(Exception, match="OVERFLOW"):
        t = spark.createDataFrame([(9223372036854775807,), (1,)], "x bigint")
        relational.select(spark, "SELECT SUM(x) AS s FROM t", (), {"t": t}).collect()


def test_access(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, n int")
    assert access.tenant_scope(df, "a").count() == 1 and access.tenant_scope(df, None, mode="disabled").count() == 3
    refused("tenant_required", access.tenant_scope, df, None)
    refused("column_forbidden", access.Authority(columns=("n",)).require_columns, ["tenant_id"])
