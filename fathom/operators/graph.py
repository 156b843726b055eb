"""Property graph: breadth-first nodes and edges, simple paths, graph-constrained search, edge changes.

``edges`` has edge_id, src, dst, type and any property columns; ``nodes`` has id and whatever a filter reads. A hop is one
join with the edge table, dealt by its key; the frontier is written between hops, so plans stay short and lost executors
cost one hop. Only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.constants import CONNECTED_HOPS, GRAPH_ANCHORS, GRAPH_BATCH, GRAPH_DEPTH, GRAPH_TYPES, TRAVERSE_DEPTH
from fathom.errors import require
from fathom.functions.payload import where
from fathom.materialize import small, stored
from fathom.operators import dense, text

DIRECTIONS = ("out", "in", "any")


@dataclass
class Traversal:
    """Rows of a traversal and why it is not whole: None, "frontier", "visited" or "edges"."""

    rows: DataFrame
    truncation: str | None = None


@dataclass
class Budget:
    """Most rows of a frontier, of visited nodes and of traversed edges."""

    frontier: int = 1_000_000
    visited: int = 10_000_000
    edges: int = 100_000_000


def _checked(anchors: Sequence[str], types: Sequence[str] | None, depth: int, direction: str) -> None:
    require(0 < len(anchors) <= GRAPH_ANCHORS, "invalid_anchors", f"1 to {GRAPH_ANCHORS} anchors")
    require(types is None or len(types) <= GRAPH_TYPES, "invalid_types", f"at most {GRAPH_TYPES} edge types")
    require(0 <= depth <= GRAPH_DEPTH, "invalid_depth", f"depth is 0 to {GRAPH_DEPTH}")
    require(direction in DIRECTIONS, "invalid_direction", f"direction must be one of {DIRECTIONS}")


def directed(edges: DataFrame, direction: str, types: Sequence[str] | None = None, edge_filter: dict | Column | None = None) -> DataFrame:
    """Edges as (near, far, edge_id, src, dst, type): filtered by type, then by property; a loop is walked once."""
    rows = edges.where(F.col("type").isin(list(types))) if types else edges
    rows = rows.where(edge_filter) if isinstance(edge_filter, Column) else where(rows, edge_filter, "props")
    kept = ["edge_id", "src", "dst", "type"]
    out = rows.select(F.col("src").alias("near"), F.col("dst").alias("far"), *kept)
    back = rows.select(F.col("dst").alias("near"), F.col("src").alias("far"), *kept)
    return {"out": out, "in": back, "any": out.unionByName(back.where("src <> dst"))}[direction]


def _passing(nodes: DataFrame | None, node_filter: dict | Column | None) -> DataFrame | None:
    """Ids of the nodes a walk may reach; None where nothing restricts it."""
    if nodes is None:
        return None
    rows = nodes.where(node_filter) if isinstance(node_filter, Column) else where(nodes, node_filter)
    return rows.select("id")


def anchors_frame(edges: DataFrame, anchors: Sequence[str]) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(a,) for a in dict.fromkeys(anchors)], f"id {kind}")


def traverse(
    edges: DataFrame, anchors: Sequence[str] | DataFrame, *, depth: int = TRAVERSE_DEPTH, direction: str = "out", types: Sequence[str] | None = None,
    nodes: DataFrame | None = None, node_filter: dict | Column | None = None, edge_filter: dict | Column | None = None,
    returning: str = "nodes", budget: Budget | None = None,
) -> Traversal:
    """TRAVERSE: distinct nodes with their depth, or each traversed edge once with the depth it was first walked at.

    With ``nodes``, only ids among them that pass the filter are reached, returned and walked on from; anchors walk
    whether they pass or not and are returned only at depth 0. An edge to a node already visited counts as traversed
    if that node passes.
    """
    budget = budget or Budget()
    if isinstance(anchors, DataFrame):
        _checked(["-"], types, depth, direction)
        start = stored(anchors.select("id").where("id is not null").distinct())
    else:
        _checked(anchors, types, depth, direction)
        start = anchors_frame(edges, anchors)
    require(returning in ("nodes", "edges"), "invalid_return", "return nodes or edges here")
    walk, passing = directed(edges, direction, types, edge_filter), _passing(nodes, node_filter)
    if passing is not None:
        passing = stored(passing.distinct())
    if depth == 0:
        rows = start if passing is None else start.join(passing, "id", "left_semi")
        rows = rows.select("id", F.lit(0).alias("depth"))
        return Traversal(rows if returning == "nodes" else walk.limit(0).select("edge_id", "src", "dst", "type", F.lit(0).alias("depth")))
    frontier, visited, found, walked, why, seen, passed = start, start, [], [], None, 0, 0
    for hop in range(1, depth + 1):
        step = walk.join(small(frontier), F.col("near") == F.col("id"), "left_semi")
        if passing is not None:
            step = step.join(passing, step["far"] == passing["id"], "left_semi")
        if returning == "edges":
            step = stored(step)
            walked.append(step.select("edge_id", "src", "dst", "type", F.lit(hop).alias("depth")))
            passed += step.count()
        new = step.select(F.col("far").alias("id")).distinct().join(visited, "id", "left_anti")
        frontier = stored(new)
        size = frontier.count()
        if not size:
            break
        seen += size
        found.append(frontier.select("id", F.lit(hop).alias("depth")))
        visited = visited.unionByName(frontier)
        if size > budget.frontier or seen > budget.visited or passed > budget.edges:
            why = "frontier" if size > budget.frontier else "visited" if seen > budget.visited else "edges"
            break
    parts = walked if returning == "edges" else found
    if not parts:
        rows = start.select("id", F.lit(0).alias("depth")).limit(0) if returning == "nodes" else walk.limit(0).select("edge_id", "src", "dst", "type", F.lit(0).alias("depth"))
        return Traversal(rows, why)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    if returning == "edges":
        every = every.groupBy("edge_id", "src", "dst", "type").agg(F.min("depth").alias("depth"))
    return Traversal(every, why)


def paths(
    edges: DataFrame, anchors: Sequence[str], *, depth: int, limit: int, direction: str = "out", types: Sequence[str] | None = None,
    nodes: DataFrame | None = None, node_filter: dict | Column | None = None, edge_filter: dict | Column | None = None,
) -> DataFrame:
    """RETURN PATHS: (nodes, edges, depth) of simple paths, shortest first, then by node and edge ids. A limit is needed:
    the number of paths grows with the power of the depth, and parallel edges make paths of their own."""
    _checked(anchors, types, depth, direction)
    require(isinstance(limit, int) and limit > 0, "limit_required", "paths need a positive limit")
    walk, passing = directed(edges, direction, types, edge_filter).select("near", "far", "edge_id"), _passing(nodes, node_filter)
    if passing is not None:
        walk = walk.join(passing.distinct(), walk["far"] == passing["id"], "left_semi")
    start = anchors_frame(edges, anchors)
    kind = edges.schema["edge_id"].dataType.simpleString()
    grown = start.select(F.array("id").alias("nodes"), F.array().cast(f"array<{kind}>").alias("edges"), F.col("id").alias("at"))
    found, enough = [], 0
    for hop in range(1, depth + 1):
        step = grown.join(walk, grown["at"] == walk["near"]).where(~F.array_contains("nodes", F.col("far")))
        grown = stored(step.select(F.array_append("nodes", F.col("far")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.col("far").alias("at")))
        count = grown.count()
        if not count:
            break
        found.append(grown.select("nodes", "edges", F.lit(hop).alias("depth")))
        enough += count
        if enough >= limit:  # deeper paths come after these
            break
    if not found:
        return grown.select("nodes", "edges", F.lit(0).alias("depth")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.orderBy("depth", "nodes", "edges").limit(limit)


def connected_search(
    points: DataFrame, edges: DataFrame, anchors: Sequence[str], query: Sequence[float], *, hops: int = CONNECTED_HOPS, direction: str = "out",
    types: Sequence[str] | None = None, payload_filter: dict | None = None, budget: Budget | None = None, **options,
) -> DataFrame:
    """SEARCH ... CONNECTED TO: dense ranking inside the nodes a traversal admits. The filter restricts what the walk
    passes through, too; a traversal that is cut short is an error here."""
    return dense.search(admitted(points, edges, anchors, hops=hops, direction=direction, types=types, payload_filter=payload_filter, budget=budget), query, **options)


def connected_hybrid(points: DataFrame, edges: DataFrame, anchors: Sequence[str], *, hops: int = CONNECTED_HOPS, direction: str = "out", types: Sequence[str] | None = None, payload_filter: dict | None = None, budget: Budget | None = None, **options) -> DataFrame:
    """HYBRID ... CONNECTED TO: both branches rank every admitted point."""
    inside = admitted(points, edges, anchors, hops=hops, direction=direction, types=types, payload_filter=payload_filter, budget=budget)
    return text.hybrid(inside, depth=10_000, **options)


def admitted(points: DataFrame, edges: DataFrame, anchors: Sequence[str], *, hops: int, direction: str, types, payload_filter, budget) -> DataFrame:
    walk = traverse(edges, anchors, depth=hops, direction=direction, types=types, nodes=points, node_filter=payload_filter, budget=budget)
    require(walk.truncation is None, "graph_truncated", f"the traversal ran out of its {walk.truncation} budget")
    return points.join(small(walk.rows.select("id")), "id", "left_semi")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"))


def relate(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges with ``new`` ones: an edge_id that exists already is left as it is, so a repeated call changes nothing.
    With ``nodes``, both ends must exist."""
    require(new.count() <= GRAPH_BATCH, "batch_too_large", f"at most {GRAPH_BATCH} edges a batch")
    if nodes is not None:
        ends = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        require(ends.join(nodes.select("id"), "id", "left_anti").isEmpty(), "endpoint_not_found", "an edge names an unknown node")
    fresh = new.dropDuplicates(["edge_id"]).join(edges.select("edge_id"), "edge_id", "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


def unrelate(edges: DataFrame, ids: Sequence) -> DataFrame:
    return edges.where(~F.col("edge_id").isin(list(ids)))
