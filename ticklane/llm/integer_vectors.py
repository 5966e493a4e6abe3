"""Vectors rounded down to integers, and exact sums of their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sums of components are kept as two halves, so that neither can overflow within a task
LOW_BITS = 26


def scaled_down(vector: Column, scale: int) -> Column:
    """floor(scale * component), with each component as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def is_scalable(vector: Column, scale: int, most: int) -> Column:
    """No component is null or non-finite, and none leaves ``most`` either way when scaled."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(most)))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def component_sums(df: DataFrame, group: str, vector: str, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each group its rows and exact component sums. Groups and components come to the driver: both must be few."""
    schema = "part int, rows long, high array<long>, low array<long>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = {}, {}, {}
        for batch in batches:
            groups, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)).astype("int64")
            for g in np.unique(groups):
                own = x[groups == g]
                rows[g] = rows.get(g, 0) + len(own)
                high[g] = high.get(g, 0) + (own >> LOW_BITS).sum(axis=0)
                low[g] = low.get(g, 0) + (own & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if rows:
            names = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype="int32")), pa.array([rows[g] for g in names], pa.int64()),
                                              lists(np.stack([high[g] for g in names])), lists(np.stack([low[g] for g in names]))],
                                             names=["part", "rows", "high", "low"])

    parts = df.select(F.col(group).cast("int").alias("part"), F.col(vector).alias("x")).mapInArrow(add, schema)
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
    each = parts.select("part", "rows", F.posexplode(F.arrays_zip("high", "low")).alias("at", "sums"))
    summed = each.groupBy("part", "at").agg(F.sum("rows").alias("rows"), exact("sums.high").alias("high"), exact("sums.low").alias("low"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in summed.collect():
        found.setdefault(row.part, (row.rows, [0] * dims))[1][row["at"]] = (int(row.high) << LOW_BITS) + int(row.low)
    return found
