"""Payload filters over a VARIANT built from the events and documents, counts, pages of ids, points by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.payload import matches, once, violations, where
from fathom.operators import access, changes
from fathom.registry import query
from fathom.sources.tables import points, table

#: The payload of an event in both engines: {type, value, tags, inner: [{k, odd}], a.b}.
_SQL = """WITH p AS (SELECT event_id, event_type, value, (props->>'k')::BIGINT AS k FROM events)"""


def payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", once(F.get_json_object("props", "$.k").cast("bigint"), _payload).alias("payload"))


def _payload(k):
    inner = F.array(F.struct(k.alias("k"), (k % 2 == 1).alias("odd")), F.struct((k + 100).alias("k"), F.lit(False).alias("odd")))
    fields = F.struct(
        F.col("event_type").alias("type"), F.col("value").alias("value"), k.alias("k"), F.array("event_type", F.lit("all")).alias("tags"),
        inner.alias("inner"), F.concat(F.lit("Seen a "), F.upper("event_type"), F.lit(", number "), k.cast("string")).alias("note"),
        F.when(k % 3 == 0, k).alias("third"), F.lit(7).alias("a.b"), F.struct(F.lit(8).alias("b"), F.lit(9).alias("c")).alias("a"),
    )
    return F.parse_json(F.to_json(fields))


def register(name: str, given: dict, condition: str) -> None:
    @query(name, f"{_SQL} SELECT event_id FROM p WHERE {condition}")
    def run(spark, sf_dir):
        return where(payloads(spark, sf_dir), given).select("event_id")


register("filter_eq", {"type": "click", "k": 12}, "event_type = 'click' AND k = 12")
register("filter_ne", {"third": {"ne": 30}}, "k % 3 = 0 AND k <> 30")
register("filter_range", {"value": {"gt": 5.5, "lte": 20}, "k": {"gte": 10, "lt": 40}}, "value > 5.5 AND value <= 20 AND k >= 10 AND k < 40")
register("filter_range_on_text", {"type": {"gt": 0}}, "false")
register("filter_in", {"type": {"in": ["view", "error", "none"]}, "k": {"in": [1, 2, 3]}}, "event_type IN ('view', 'error') AND k IN (1, 2, 3)")
register("filter_text", {"note": {"text": "Number SEEN"}, "type": "view"}, "event_type = 'view'")
register("filter_text_all_terms", {"note": {"text": "click 42"}}, "event_type = 'click' AND k = 42")
register("filter_text_empty", {"note": {"text": " , "}}, "false")
register("filter_array_any", {"tags": "error"}, "event_type = 'error'")
register("filter_nested", {"inner": {"nested": {"filter": {"k": {"gt": 90}, "odd": True}}}}, "k > 90 AND k % 2 = 1")
register("filter_path", {"inner[].k": {"gte": 195}, "a.c": 9}, "k >= 95")
register("filter_literal_key", {"a.b": 7}, "true")
register("filter_strict_type", {"k": 12.0}, "false")
register("filter_unknown_op", {"k": {"near": 3}}, "false")
register("filter_missing", {"nothing": {"ne": 1}}, "false")


@query("filter_not_object", _SQL + " SELECT count(*) AS n FROM p")
def filter_not_object(spark, sf_dir):
    return payloads(spark, sf_dir).where(matches(F.col("payload"), [1])).agg(F.count("*").alias("n"))


@query("payload_schema", _SQL + " SELECT event_id, 'third' AS violation FROM p WHERE k % 3 <> 0")
def payload_schema(spark, sf_dir):
    rules = {"type": "string", "value": "number", "tags": "array", "third": "number", "missing": "optional_bool"}
    return violations(payloads(spark, sf_dir), rules).select("event_id", "violation")


@query("count_where", "SELECT count(*) AS count FROM embeddings WHERE label > 3 AND label <> 7")
def count_where(spark, sf_dir):
    return where(points(spark, sf_dir), {"label": {"gt": 3, "ne": 7}}).agg(F.count("*").alias("count"))


@query("scroll_page", "SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE vec_id::VARCHAR > '200' AND label = 4 ORDER BY id LIMIT 11")
def scroll_page(spark, sf_dir):
    """Ten points after the cursor and one more, which says whether there is a next page."""
    return where(points(spark, sf_dir), {"label": 4}).where(F.col("id") > "200").orderBy("id").limit(11).select("id", "label")


@query("get_points", "SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE vec_id IN (3, 77, 410)")
def get_points(spark, sf_dir):
    return points(spark, sf_dir).where(F.col("id").isin("3", "77", "410", "unknown")).select("id", "label")


@query("tenant_scope", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 = 1 GROUP BY label")
def tenant_scope(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("tenant_id", F.concat(F.lit("t"), (F.col("id").cast("bigint") % 3).cast("string")))
    return access.tenant_scope(p, "t1").groupBy("label").agg(F.count("*").alias("n"))


@query("row_authority", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def row_authority(spark, sf_dir):
    allowed = access.Authority(F.col("source") == "src1", ("doc_id", "lang"))
    return allowed.view(table(spark, sf_dir, "documents"))


@query("live_points", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0")
def live_points(spark, sf_dir):
    """A change log of two versions and tombstones: the last version of each id counts."""
    p = points(spark, sf_dir).select("id", F.lit(1).alias("version"), F.lit(False).alias("deleted"), "label")
    again = p.where(F.col("id").cast("bigint") % 5 == 0).withColumns({"version": F.lit(2), "label": F.col("label") + 100})
    gone = p.where(F.col("id").cast("bigint") % 7 == 0).withColumns({"version": F.lit(3), "deleted": F.lit(True)})
    return changes.live(p.unionByName(again).unionByName(gone))
