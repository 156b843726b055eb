"""Running statements against a store: ``Engine.execute`` is the one entry point for every model."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.constants import DEFAULT_K, GRAPH_BATCH, SCROLL_LIMIT, UPSERT_POINTS
from fathom.errors import EngineError, require
from fathom.lang import sql
from fathom.lang.parser import QueryError, Statement, parse
from fathom.operators import changes, dense, graph, temporal, text, views
from fathom.functions.payload import where
from fathom.plans import pipeline as plan
from fathom.plans.store import Store, Transaction

POINTS = "id string, vector array<double>, vectors map<string,array<double>>, sparse struct<indices:array<bigint>,values:array<double>>, payload string"
EDGES = "edge_id string, src string, dst string, type string, props string"
SERIES = "tenant string, asset string, property string, time_ns bigint, value {}"


@dataclass
class Result:
    """What a statement gave: rows as a DataFrame, how many it changed, and what ran for how long."""

    rows: DataFrame | None = None
    affected: int | None = None
    trace: dict[str, float] = field(default_factory=dict)
    query_id: str = field(default_factory=lambda: f"q_{uuid.uuid4().hex[:14]}")
    truncation: str | None = None
    degraded: bool = False


class Engine:
    """A session on a store: a current collection, a tenant, and statements one at a time."""

    def __init__(self, spark: SparkSession, root: str, *, tenant: str = "default", role: str = "admin", strict: bool = True) -> None:
        self.spark, self.store, self.tenant, self.role, self.strict = spark, Store(spark, root), tenant, role, strict
        self.current: str | None = None

    # entry

    def execute(self, statement: str, parameters: Sequence = (), *, confirm: bool = False, idempotency_key: str | None = None) -> Result:
        started = time.perf_counter()
        s = parse(statement, tuple(parameters))
        parsed = time.perf_counter()
        tx = self.store.begin()
        if idempotency_key:
            if s.verb not in ("sql", "transaction", "relate"):
                raise QueryError("idempotency_unsupported", "a key goes with SQL or a transaction")
            if idempotency_key in tx.base.receipts:
                return Result(affected=tx.base.receipts[idempotency_key]["result"]["affected"])
        out = self.run(tx, s, parameters, confirm)
        if tx.staged or tx.datasets != tx.base.datasets:
            require(self.role != "read_only", "forbidden", "this session only reads")
            sql.check_deferred(tx)
            tx.commit((idempotency_key, {"affected": out.affected}) if idempotency_key else None)
        out.trace = {"parse": parsed - started, "execute": time.perf_counter() - parsed}
        return out

    def run(self, tx: Transaction, s: Statement, parameters: Sequence = (), confirm: bool = False) -> Result:
        method = getattr(self, f"_{s.verb}")
        if s.verb in ("sql", "transaction", "pipeline", "explain"):
            return method(tx, s, parameters)
        if s.verb in ("delete", "drop"):
            return method(tx, s, confirm)
        return method(tx, s)

    # collections

    def collection(self, tx: Transaction, s: Statement) -> str:
        name = s.args.get("collection") or self.current
        require(bool(name) and tx.has(f"points.{name}"), "collection_not_found", f"no collection {name}")
        return name

    def points(self, tx: Transaction, name: str) -> DataFrame:
        return tx.read(f"points.{name}").withColumn("payload", F.parse_json("payload"))

    def edges(self, tx: Transaction, name: str) -> DataFrame:
        return tx.read(f"edges.{name}").withColumn("props", F.parse_json("props"))

    def metric(self, tx: Transaction, name: str) -> str:
        return tx.meta(f"points.{name}")["metric"]

    def vector(self, tx: Transaction, name: str, given, using: str | None = None) -> list[float]:
        if not isinstance(given, list):
            return dense.stored_vector(self.points(tx, name), given, using)
        dim = tx.meta(f"points.{name}")["dim"]
        require(using is not None or len(given) == dim, "dimension_mismatch", f"{name} has {dim} dimensions, not {len(given)}")
        return given

    def _create(self, tx: Transaction, s: Statement) -> Result:
        name = s.collection
        require(not tx.has(f"points.{name}"), "collection_exists", f"collection {name} exists")
        meta = {"dim": s.dim, "metric": s.metric, "options": s.options}
        tx.put(f"points.{name}", self.spark.createDataFrame([], POINTS), "points", meta)
        tx.put(f"edges.{name}", self.spark.createDataFrame([], EDGES), "edges", {})
        for kind in ("double", "boolean"):
            tx.put(f"series_{kind}.{name}", self.spark.createDataFrame([], SERIES.format(kind)), "series", {})
        return Result(self._described(name, meta))

    def _drop(self, tx: Transaction, s: Statement, confirm: bool) -> Result:
        name = s.collection
        if not tx.has(f"points.{name}"):
            require(bool(s.args.get("if_exists")), "collection_not_found", f"no collection {name}")
            return Result(affected=0)
        n = tx.read(f"points.{name}").count()
        require(confirm, "confirmation_required", f"this would drop {name} and its {n} points")
        for part in ("points", "edges", "series_double", "series_boolean"):
            tx.drop(f"{part}.{name}")
        self.current = None if self.current == name else self.current
        return Result(affected=n)

    def _use(self, tx: Transaction, s: Statement) -> Result:
        self.current = self.collection(tx, s)
        return Result()

    def _show(self, tx: Transaction, s: Statement) -> Result:
        rows = [(n.removeprefix("points."), tx.meta(n)["dim"], tx.meta(n)["metric"]) for n in tx.names("points")]
        return Result(self.spark.createDataFrame(rows, "name string, dim int, metric string"))

    def _described(self, name: str, meta: dict) -> DataFrame:
        rows = [("name", name), ("vector_dim", str(meta["dim"])), ("metric", meta["metric"]), *((k, json.dumps(v)) for k, v in sorted(meta["options"].items()))]
        return self.spark.createDataFrame(rows, "field string, value string")

    def _describe(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        return Result(self._described(name, tx.meta(f"points.{name}")))

    # reads

    def _shown(self, rows: DataFrame, s: Statement, *more: str) -> DataFrame:
        payload = [F.to_json("payload").alias("payload")] if s.args.get("payload") and "payload" in rows.columns else []
        return rows.select("id", "score", *more, *payload)

    def _inside(self, tx: Transaction, name: str, s: Statement) -> DataFrame:
        p, c = self.points(tx, name), s.args.get("connected")
        if not c:
            return p
        return graph.admitted(p, self.edges(tx, name), c["anchors"], hops=c["hops"], direction=c["direction"], types=c["types"], payload_filter=s.args.get("filter"), budget=None)

    def _search(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        using = s.args.get("using")
        q = self.vector(tx, name, s.vector, using)
        found = dense.search(self._inside(tx, name, s), q, k=s.args.get("limit", DEFAULT_K), metric=self.metric(tx, name), using=using, payload_filter=s.args.get("filter"))
        return Result(self._shown(found, s), degraded=s.args.get("budget") == 0)

    def _hybrid(self, tx: Transaction, s: Statement) -> Result:
        name, k = self.collection(tx, s), s.args.get("limit", DEFAULT_K)
        p, q = self._inside(tx, name, s), None
        if s.vector is not None:
            q = self.vector(tx, name, s.vector)
        given = {"k": k, "metric": self.metric(tx, name), "payload_filter": s.args.get("filter"), "vector": q}
        if "text" in s.args:
            p = p.withColumn("_text", F.try_variant_get("payload", sql_path(s.field), "string"))
            return Result(self._shown(text.text_hybrid(p, "_text", s.text, **given), s))
        found = text.hybrid(p, sparse=s.sparse, mode=s.args.get("fusion", "rrf"), dense_weight=s.args.get("dense", 1.0), sparse_weight=s.args.get("sparse_weight", 1.0), depth=10_000 if s.args.get("connected") else None, **given)
        return Result(self._shown(found, s))

    def _multi(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        qs = [self.vector(tx, name, v) for v in s.vectors]
        found = dense.multi_search(self.points(tx, name), qs, k=s.args.get("limit", DEFAULT_K), metric=self.metric(tx, name), mode=s.args.get("fusion", "rrf"), weights=s.args.get("weights"), payload_filter=s.args.get("filter"))
        return Result(self._shown(found, s))

    def _recommend(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        found = dense.recommend(self.points(tx, name), s.like, s.unlike, k=s.args.get("limit", DEFAULT_K), metric=self.metric(tx, name), using=s.args.get("using"), payload_filter=s.args.get("filter"))
        return Result(self._shown(found, s))

    def _count(self, tx: Transaction, s: Statement) -> Result:
        return Result(where(self.points(tx, self.collection(tx, s)), s.args.get("filter")).agg(F.count("*").alias("count")))

    def _scroll(self, tx: Transaction, s: Statement) -> Result:
        rows = where(self.points(tx, self.collection(tx, s)), s.args.get("filter"))
        if "after" in s.args:
            rows = rows.where(F.col("id") > s.after)
        return Result(rows.orderBy("id").limit(s.args.get("limit", SCROLL_LIMIT)).select("id", F.to_json("payload").alias("payload")))

    def _get(self, tx: Transaction, s: Statement) -> Result:
        rows = self.points(tx, self.collection(tx, s)).where(F.col("id").isin(s.ids))
        return Result(rows.withColumn("payload", F.to_json("payload")))

    def _traverse(self, tx: Transaction, s: Statement, anchors: DataFrame | None = None) -> Result:
        name = self.collection(tx, s)
        options = {"direction": s.direction, "types": s.args.get("types"), "nodes": self.points(tx, name), "node_filter": s.args.get("filter"), "edge_filter": s.args.get("edge_filter")}
        if s.returning == "paths":
            if "limit" not in s.args:
                raise QueryError("limit_required", "paths need LIMIT")
            return Result(graph.paths(self.edges(tx, name), s.anchors, depth=s.depth, limit=s.limit, **options))
        walk = graph.traverse(self.edges(tx, name), s.anchors if anchors is None else anchors, depth=s.depth, returning=s.returning, **options)
        rows = walk.rows
        if s.args.get("payload") and s.returning == "nodes":
            rows = rows.join(self.points(tx, name).select("id", F.to_json("payload").alias("payload")), "id", "left")
        if "limit" in s.args:
            rows = rows.orderBy("depth", "edge_id" if s.returning == "edges" else "id").limit(s.limit)
        return Result(rows, truncation=walk.truncation)

    # changes of points and edges

    def _rows(self, points: list[dict], meta: dict) -> DataFrame:
        require(len(points) <= UPSERT_POINTS, "batch_too_large", f"at most {UPSERT_POINTS} points")
        out = {}
        for p in points:
            v = p.get("vector")
            require(v is None or len(v) == meta["dim"], "dimension_mismatch", f"point {p['id']} needs {meta['dim']} dimensions")
            require(set(p) <= {"id", "vector", "vectors", "sparse_vector", "payload"}, "unknown_field", f"unknown: {sorted(set(p))}")
            sparse = p.get("sparse_vector")
            named = {k: [float(x) for x in w] for k, w in (p.get("vectors") or {}).items()}
            cells = (list(map(int, sparse["indices"])), list(map(float, sparse["values"]))) if sparse else None
            out[p["id"]] = (p["id"], [float(x) for x in v] if v is not None else None, named, cells, json.dumps(p.get("payload") or {}))
        rows = self.spark.createDataFrame(list(out.values()), POINTS)
        if rules := meta["options"].get("payload_schema"):
            from fathom.functions.payload import violations

            broken = violations(rows.withColumn("payload", F.parse_json("payload")), rules).select("id", "violation").head()
            require(broken is None, "payload_schema", f"{broken and broken[0]}: {broken and broken[1]}")
        return rows

    def _upsert(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        rows = self._rows(s.points, tx.meta(f"points.{name}"))
        tx.put(f"points.{name}", changes.upsert_points(tx.read(f"points.{name}"), rows))
        return Result(affected=len({p["id"] for p in s.points}))

    def _delete(self, tx: Transaction, s: Statement, confirm: bool) -> Result:
        name = self.collection(tx, s)
        p = self.points(tx, name)
        hit = (p.where(F.col("id").isin(s.ids)) if "ids" in s.args else where(p, s.filter)).select("id")
        n = hit.count()
        require(confirm or "ids" in s.args, "confirmation_required", f"this would delete {n} points from {name}")
        tx.put(f"points.{name}", tx.read(f"points.{name}").join(hit, "id", "left_anti"))
        # edges of points that are gone are not visible
        e = tx.read(f"edges.{name}")
        tx.put(f"edges.{name}", e.join(hit, e["src"] == hit["id"], "left_anti").join(hit.withColumnRenamed("id", "_d"), F.col("dst") == F.col("_d"), "left_anti"))
        return Result(affected=n)

    def _update_point(self, tx: Transaction, s: Statement) -> Result:
        return self._merge(tx, f"points.{self.collection(tx, s)}", "id", "payload", s)

    def _update_edge(self, tx: Transaction, s: Statement) -> Result:
        return self._merge(tx, f"edges.{self.collection(tx, s)}", "edge_id", "props", s)

    def _merge(self, tx: Transaction, dataset: str, key: str, column: str, s: Statement) -> Result:
        df = tx.read(dataset)
        old = df.where(F.col(key) == s.id).select(column).head()
        require(old is not None, "not_found", f"no {s.id}")
        merged = s.new if s.args.get("replace") else {**json.loads(old[0] or "{}"), **s.new}
        tx.put(dataset, df.withColumn(column, F.when(F.col(key) == s.id, json.dumps(merged)).otherwise(F.col(column))))
        return Result(affected=1)

    def _relate(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        edge = s.args.get("key") or uuid.uuid4().hex
        row = self.spark.createDataFrame([(edge, s.src, s.dst, s.type, json.dumps(s.args.get("properties") or {}))], EDGES)
        nodes = None if s.args.get("deferred") else tx.read(f"points.{name}")
        tx.put(f"edges.{name}", graph.relate(tx.read(f"edges.{name}"), row, nodes))
        return Result(self.spark.createDataFrame([(edge,)], "edge_id string"), 1)

    def _unrelate(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        require(len(s.ids) <= GRAPH_BATCH, "batch_too_large", f"at most {GRAPH_BATCH} edges")
        e = tx.read(f"edges.{name}")
        n = e.where(F.col("edge_id").isin(s.ids)).count()
        tx.put(f"edges.{name}", graph.unrelate(e, s.ids))
        return Result(affected=n)

    # series

    def _append(self, tx: Transaction, s: Statement) -> Result:
        name = self.collection(tx, s)
        require(len({isinstance(r["value"], bool) for r in s.samples}) == 1, "temporal_type", "a batch has values of one type")
        kind = "boolean" if isinstance(s.samples[0]["value"], bool) else "double"
        other = tx.read(f"series_{'double' if kind == 'boolean' else 'boolean'}.{name}")
        cast = (lambda v: v) if kind == "boolean" else float
        rows = [(self.tenant, str(r["asset"]), str(r["property"]), int(r["time_ns"]), cast(r["value"])) for r in s.samples]
        new = self.spark.createDataFrame(rows, SERIES.format(kind))
        require(other.join(new, temporal.KEY, "left_semi").isEmpty(), "temporal_type", "the series has values of another type")
        own = tx.read(f"series_{kind}.{name}")
        fresh, n = temporal.appended(own, new)
        if n:
            tx.put(f"series_{kind}.{name}", own.unionByName(fresh))
        return Result(affected=n)

    def _kind_of(self, tx: Transaction, name: str, condition: Column) -> str:
        return "boolean" if not tx.read(f"series_boolean.{name}").where(condition).isEmpty() else "double"

    def _series(self, tx: Transaction, s: Statement, read) -> Result:
        name = self.collection(tx, s)
        own = (F.col("asset") == s.asset) & (F.col("property") == s.property)
        assets = self.points(tx, name) if s.args.get("filter") else None
        series = tx.read(f"series_{self._kind_of(tx, name, own)}.{name}")
        return Result(temporal.shown(read(series, {"tenant": self.tenant, "assets": assets, "payload_filter": s.args.get("filter")}), name))

    def _history(self, tx: Transaction, s: Statement) -> Result:
        return self._series(tx, s, lambda df, o: temporal.history(df, s.asset, s.property, s.start, s.end, s.limit, **o))

    def _latest(self, tx: Transaction, s: Statement) -> Result:
        return self._series(tx, s, lambda df, o: temporal.latest(df, s.asset, s.property, **o))

    # SQL, transactions, views

    def _sql(self, tx: Transaction, s: Statement, parameters: Sequence) -> Result:
        rows, n = sql.execute(tx, s.text, parameters, self.strict)
        return Result(rows, n)

    def _transaction(self, tx: Transaction, s: Statement, parameters: Sequence) -> Result:
        """One SQL change, one vector change and graph changes: all are published by one manifest or none is."""
        rows, n = sql.execute(tx, s.sql, parameters, self.strict)
        if s.expect is not None and n != s.expect:
            raise QueryError("sql_row_precondition_failed", f"{n} rows changed, not {s.expect}")
        self.run(tx, s.vector, parameters, True)
        for g in s.graph:
            self.run(tx, g, parameters)
        return Result(rows, n)

    def _ml(self, tx: Transaction, s: Statement) -> Result:
        require(tx.has(s.table) and tx.kind(s.table) == "table", "42P01", f"no table {s.table}")
        key = tx.meta(s.table)["constraints"]["primary_key"]
        version = tx.meta(s.view).get("refresh", 0) + 1 if tx.has(s.view) else 1
        found = views.view(tx.read(s.table), key, s.target, s.features, task=s.task, using=s.using, version=version)
        meta = sql.empty_meta() | {"refresh": version}
        meta["constraints"]["primary_key"] = list(key)
        tx.put(s.view, found, "table", meta)
        return Result(affected=None)

    # pipelines

    def _stages(self, tx: Transaction, s: Statement, parameters: Sequence) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        order = {"vector": 0, "relational": 1, "graph": 2, "temporal": 3}
        for kind, alias, part in sorted(s.stages, key=lambda x: order[x[0]]):
            if kind == "relational":
                rows, _ = sql.execute(tx, part.text, parameters, self.strict)
                require(rows is not None, "query.pipeline_stage", "a relational stage reads")
                out[alias] = rows
            elif kind == "vector":
                out[alias] = plan.with_ref(self.run(tx, part).rows, self.collection(tx, part))
            elif kind == "graph":
                name = self.collection(tx, part)
                if "source" in part.args:
                    rows = self._traverse(tx, part, self._ids(out, part.source, name).select("id")).rows
                else:
                    rows = self._traverse(tx, part).rows
                out[alias] = plan.with_ref(rows, name) if "id" in rows.columns else rows
            else:
                out[alias] = self._temporal(tx, part, out)
        return {alias: out[alias] for _, alias, _ in s.stages}

    def _ids(self, out: dict[str, DataFrame], source: str, namespace: str) -> DataFrame:
        """Ids of a stage's references in a namespace; a text id can stand for one."""
        alias, column = source.split(".", 1)
        require(alias in out, "query.pipeline_stage", f"no stage {alias}")
        rows = out[alias]
        if column == "record_ref" and column not in rows.columns:
            require("id" in rows.columns, "query.pipeline_stage", f"{alias} has no id")
            rows = out[alias] = plan.with_ref(rows, namespace)
        wrong = rows.where(F.col(column)["namespace"] != namespace)
        require(wrong.isEmpty(), "query.namespace", f"{source} refers to another collection than {namespace}")
        return rows.select(F.col(column)["id"].alias("id"))

    def _temporal(self, tx: Transaction, s: Statement, out: dict[str, DataFrame]) -> DataFrame:
        name = self.collection(tx, s)
        if "source" in s.args:
            assets = self._ids(out, s.source, name).select(F.col("id").alias("asset"))
        else:
            assets = self.spark.createDataFrame([(s.asset,)], "asset string")
        series = tx.read(f"series_{self._kind_of(tx, name, F.col('property') == s.property)}.{name}").where(F.col("tenant") == self.tenant)
        if s.args.get("filter"):
            passing = where(self.points(tx, name), s.filter).select(F.col("id").alias("asset"))
            series = series.join(passing, "asset", "left_semi")
        if s.verb == "history":
            return temporal.shown(temporal.history_of(series, assets, s.property, s.start, s.end, s.limit), name)
        last = temporal.latest_of_all(series.where(F.col("property") == s.property)).join(assets.distinct(), "asset", "left_semi")
        return temporal.shown(last, name)

    def _pipeline(self, tx: Transaction, s: Statement, parameters: Sequence) -> Result:
        joins = [plan.Join(*j) for j in s.joins]
        return Result(plan.run(plan.Pipeline(self._stages(tx, s, parameters), joins, s.returning, s.limit, s.order)))

    def _explain(self, tx: Transaction, s: Statement, parameters: Sequence) -> Result:
        """Stages, joins and bounds, without running any of them."""
        p = s.pipeline
        rows = [(i, kind, f"{alias}: {part.verb}", part.args.get("limit")) for i, (kind, alias, part) in enumerate(p.stages)]
        rows += [(len(rows) + i, "join", f"{k} {a} on {left} = {right}", None) for i, (k, a, left, right) in enumerate(p.joins)]
        if p.order:
            rows.append((len(rows), "order", " ".join(p.order), None))
        rows.append((len(rows), "limit", ", ".join(p.returning), p.limit))
        return Result(self.spark.createDataFrame(rows, "step int, stage string, detail string, bound int"))


def sql_path(field_name: str) -> str:
    """A payload field as a path: the literal key."""
    return "$['" + field_name.replace("\\", "\\\\").replace("'", "\\'") + "']"


__all__ = ["Engine", "EngineError", "Result"]
