"""An optional inverted-file index: points by the nearest of a few hundred centres, so a search reads only some cells.

Centres are fitted on a bounded sample; every point is indexed. Exact search stays the default; ``recall`` measures what
the index loses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.constants import DEFAULT_K
from fathom.operators import dense

#: Most points that centres are fitted on, by least hash of their ids.
SAMPLE = 50_000


def centres(points: DataFrame, cells: int, *, sample: int = SAMPLE, rounds: int = 15, seed: int = 42) -> np.ndarray:
    order = F.xxhash64("id")
    rows = points.where(F.col("vector").isNotNull()).select("id", "vector").orderBy(order, "id").limit(sample).collect()
    x = np.array([r.vector for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def assign(points: DataFrame, c: np.ndarray) -> DataFrame:
    """Add ``cell`` to every point that has a vector. Write it partitioned by cell, and a search prunes the others."""
    sent = points.sparkSession.sparkContext.broadcast(c)
    given = points.where(F.col("vector").isNotNull())
    names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = dense._matrix(batch.column(names.index("vector")), sent.value.shape[1])
                cell = pa.array((m @ sent.value.T).argmax(1), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*names, "cell"])

    return given.mapInArrow(run, given.withColumn("cell", F.lit(0)).schema)


def search(indexed: DataFrame, c: np.ndarray, query: Sequence[float], *, probes: int = 8, k: int = DEFAULT_K, **options) -> DataFrame:
    """The exact best k of the ``probes`` nearest cells."""
    q = np.array(dense.checked_query(query))
    near = np.argsort(-(c @ q), kind="stable")[:probes].tolist()
    return dense.search(indexed.where(F.col("cell").isin(near)), query, k=k, **options)


def recall(found: Sequence, exact: Sequence) -> float:
    return len(set(found) & set(exact)) / max(1, len(exact))
