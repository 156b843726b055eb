"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a 30-bit hash of its id. Words are summed by source and hash bucket, the bucket in which a
source's budget runs out is found by a running sum over at most 1024 buckets, and only that bucket's documents are
summed again by the next 10 bits. Documents are then kept by comparing their hash with their source's threshold: no
sort of documents, no sample, and the same choice in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import WORD, stored, table

LEVELS, BITS = 3, 10
#: Source tables of more rows than this are joined by shuffle; below it, 100,000 short rows are broadcast.
BROADCAST_SOURCES = 100_000


def place(column: Column) -> Column:
    """30 bits of md5 of the id as text; a null id counts as the empty text."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), 2)


def word_count(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Add ``target`` to (key, source, source_size): shares by weight, none above ``cap`` times its source.

    Sources in code point order, null last, take the weights in turn. The common level is the largest of
    (total - caps of the sources that fill first) / (weights of the others), which is where resharing ends.
    """
    one = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ranked) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("bigint"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("caps", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(one))
        .withColumn("weights", F.sum("weight").over(one))
        .withColumn("level", (F.col("total") - F.col("caps")) / (F.col("weights") - F.col("used")))
    )
    level = level.withColumn("level", F.max("level").over(one))
    return level.withColumn(
        "target", F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.col("level"))
    ).select("key", "source", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame, cap: int = 3) -> DataFrame:
    """Add ``copies`` (whole copies of every document) and ``below`` (one more for hashes under it) to ``goals``."""
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    state = goals.withColumn("copies", whole.cast("bigint")).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")
    )
    state = state.withColumn("below", F.lit(0).cast("bigint")).withColumn("last", F.lit(0.0))
    rows = sized.select("key", "place", "size")
    small = state.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    for step in range(LEVELS):
        shift = BITS * (LEVELS - 1 - step)
        if step:
            rows = rows.join(hint(state.select("key", F.col("below").alias("prefix"))), "key").where(
                F.shiftright("place", shift + BITS) == F.col("prefix")
            ).drop("prefix")
        filled = rows.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossed = (
            filled.withColumn("upto", F.sum("words").over(order))
            .join(hint(state.select("key", "budget")), "key")
            .where(F.col("upto") > F.col("budget"))
            .groupBy("key")
            .agg(F.min(F.struct("bucket", "words", "upto")).alias("at"))
        )
        state = stored(
            state.join(crossed, "key", "left")
            .withColumn("below", F.coalesce(F.col("at.bucket"), F.lit(0)).cast("bigint"))
            .withColumn("budget", F.col("budget") - F.coalesce(F.col("at.upto") - F.col("at.words"), F.lit(0)))
            .withColumn("last", F.coalesce(F.col("at.words"), F.lit(0)).cast("double"))
            .drop("at")
        )
    # the last bucket is taken where that ends nearer to the target
    nearer = F.col("last") - F.col("budget") < F.col("budget")
    return state.withColumn("below", F.col("below") + F.when(nearer, 1).otherwise(0)).select(
        "key", "source_size", "target", "copies", "below"
    )


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, *carry, size, source_size, target, copies) of every document.

    Null text has size 0; null source is a source of its own, last in order; repeated ids stand or fall together,
    as equal ids have equal hashes; an empty table gives an empty result; other columns are not read. With no words
    at all every target is 0 and nothing is taken.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"),
            word_count(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("place"),
        )
    )
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    chosen = thresholds(sized, stored(targets(by_source, weights, cap)), cap)
    hint = F.broadcast if chosen.count() <= BROADCAST_SOURCES else (lambda df: df)
    # a source at its cap has no budget left; documents without words below its first word are not copied once more
    taken = F.least(F.lit(cap), F.col("copies") + F.when(F.col("place") < F.col("below"), 1).otherwise(0))
    told = ["size", "source_size", "target", taken.cast("bigint").alias("copies")]
    if carry:  # the choice depends on id and source alone, so rows are read again instead of being kept
        given = docs.select(
            F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"),
            word_count(F.col(text_col)).alias("size"), key.alias("key"), place(F.col(id_col)).alias("place"),
        )
        names = [F.col("row.id").alias(id_col), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)]]
        return given.join(hint(chosen), "key").select(*names, *told)
    return sized.join(hint(chosen), "key").select(F.col("id").alias(id_col), *told)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) AS place
  FROM documents),
src AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY k, source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1] AS weight FROM src),
c AS (SELECT *, coalesce(sum(source_size * 3) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS used,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w
      WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max((total - caps)::DOUBLE / (weights - used)::DOUBLE) OVER () AS level FROM c),
t AS (SELECT k, source_size, least((source_size * 3)::DOUBLE, weight * level) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS copies FROM t),
p AS (SELECT k, place, sum(size) AS words FROM sized GROUP BY k, place),
r AS (SELECT k, place, words, sum(words) OVER (PARTITION BY k ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM p),
b AS (SELECT g.k, min(place) AS place, arg_min(upto, place) AS upto, arg_min(words, place) AS words
      FROM g JOIN r USING (k) WHERE upto > target - copies * source_size GROUP BY g.k),
f AS (SELECT g.*, coalesce(b.place + CASE WHEN b.upto - (target - copies * source_size) < (target - copies * source_size) - (b.upto - b.words) THEN 1 ELSE 0 END, 0) AS below
      FROM g LEFT JOIN b USING (k))
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN place < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN f USING (k)
"""
