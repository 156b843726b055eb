"""Fusing ranked branches. A branch has at most its limit of rows, so a window over all of it is bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.constants import FLAT_BRANCH, RRF
from fathom.errors import require

MODES = ("rrf", "weighted")


def ranked(branch: DataFrame) -> DataFrame:
    """(id, score, rank) from rank 1."""
    return branch.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def shares(branch: DataFrame, mode: str, weight: float, constant: int = RRF) -> DataFrame:
    """(id, part, rank): what a branch gives each of its points."""
    require(mode in MODES, "invalid_fusion", f"fusion must be one of {MODES}")
    require(weight >= 0 and weight < float("inf"), "invalid_weights", "weights must be finite and not negative")
    rows = ranked(branch)
    if mode == "rrf":
        return rows.select("id", (F.lit(float(weight)) / (constant + F.col("rank"))).alias("part"), "rank")
    every = Window.partitionBy()
    low, high = F.min("score").over(every), F.max("score").over(every)
    unit = F.when(high == low, FLAT_BRANCH).otherwise((F.col("score") - low) / F.when(high != low, high - low))
    return rows.select("id", (unit * float(weight)).alias("part"), "rank")


def fuse_many(branches: Sequence[DataFrame], mode: str = "rrf", weights: Sequence[float] | None = None) -> DataFrame:
    """(id, score): the sum of the branches' shares."""
    weights = weights or [1.0] * len(branches)
    parts = [shares(b, mode, w).select("id", "part", F.lit(i).alias("branch")) for i, (b, w) in enumerate(zip(branches, weights, strict=True))]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # the sum's order is fixed, so that equal inputs give equal bits
    summed = F.aggregate(F.array_sort(F.collect_list(F.struct("branch", "part"))), F.lit(0.0), lambda s, x: s + x["part"])
    return every.groupBy("id").agg(summed.alias("score"))


def fuse(dense: DataFrame | None, sparse: DataFrame | None, *, mode: str = "rrf", dense_weight: float = 1.0, sparse_weight: float = 1.0, constant: int = RRF) -> DataFrame:
    """(id, score, dense_rank, sparse_rank) of two branches; order by score, dense rank, sparse rank, id."""
    require(dense is not None or sparse is not None, "invalid_hybrid", "a hybrid search needs a branch")
    none = F.lit(None).cast("int")
    sides = []
    if dense is not None:
        sides.append(shares(dense, mode, dense_weight, constant).select("id", "part", F.col("rank").alias("dense_rank"), none.alias("sparse_rank")))
    if sparse is not None:
        sides.append(shares(sparse, mode, sparse_weight, constant).select("id", "part", none.alias("dense_rank"), F.col("rank").alias("sparse_rank")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy("id").agg(F.sum("part").alias("score"), F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))


def best(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id").limit(k)
