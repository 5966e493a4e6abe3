"""Near-duplicate embeddings: random-hyperplane hashing, exact cosine verification, connected components.

Equal vectors are one class with a count. Each class gets a code of ``bits`` hyperplane signs in each of
several tables; classes that share a code in a table are compared exactly. Bits follow the logarithm of the
number of classes, and tables are as many as keep the chance to miss a pair at the threshold below
``miss``, so buckets stay small at any size. A pair that meets in several tables is counted in the first of
them only, which the codes carried with each vector decide, so no pair is ever shuffled: a bucket returns
numbers of links and a spanning forest. A bucket of more than ``block`` classes is dealt out as pairs of
blocks, so no task holds an unbounded group and no pair is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.components import connected_components
from ticklane.llm.shared import small, stored

BLOCK = 2048
MISS = 1e-4
PER_BUCKET = 16
CODE = "<u4"
PLACE = ["size", "table", "code", "low", "high"]


def plan(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits a table and number of tables."""
    bits = max(4, math.ceil(math.log2(max(classes, 1) / PER_BUCKET + 1)))
    same = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Rows:
    """Rows of one vector length as arrays."""

    def __init__(self, batch: pd.DataFrame, kind: str):
        self.place = batch[PLACE].to_numpy()
        self.own, self.vec, self.copies = (batch[name].to_numpy() for name in ("own", "vec", "copies"))
        unit = np.frombuffer(b"".join(batch["vector"]), dtype=kind).reshape(len(batch), -1).astype("float64")
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        self.unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.codes = batch["codes"].to_numpy()

    def append(self, other: _Rows) -> None:
        for name, mine in vars(self).items():
            setattr(self, name, np.concatenate([mine, getattr(other, name)]))

    def cut(self, start: int, stop: int) -> _Rows:
        part = object.__new__(_Rows)
        for name, mine in vars(self).items():
            setattr(part, name, mine[start:stop])
        return part

    def links(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Of the rows of one place: ids, numbers of links that no earlier table has, and roots of a forest of them."""
        _, table, _, low, high = self.place[0]
        if low == high:
            left, right = np.nonzero(np.triu(self.unit @ self.unit.T >= threshold, 1))
        else:
            one, two = np.nonzero(self.own == low)[0], np.nonzero(self.own == high)[0]
            left, right = np.nonzero(self.unit[one] @ self.unit[two].T >= threshold)
            left, right = one[left], two[right]
        if table and len(left):
            codes = np.frombuffer(b"".join(self.codes), dtype=CODE).reshape(len(self.vec), -1)
            new = np.ones(len(left), dtype=bool)
            for earlier in range(table):
                new &= codes[left, earlier] != codes[right, earlier]
            left, right = left[new], right[new]
        if not len(left):
            return None
        n = len(self.vec)
        links = np.bincount(left, self.copies[right], n) + np.bincount(right, self.copies[left], n)
        some = np.nonzero(links)[0]
        return self.vec[some], links[some].astype("int64"), self.vec[_forest(n, left, right)[some]]


def similar_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95,
                    miss: float = MISS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per input row: its id, ``n_links`` (other rows linked directly), ``component_id`` and ``kept``.

    Vectors of one length with a cosine of ``threshold`` or more are linked; vectors of other lengths are not
    compared. Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing and
    are components of their own. Equal rows are rows that link with each other. ``component_id`` is the smallest
    id reachable, itself included; null ids take part and stay null where they are alone. Other columns are
    left out; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    kind = "<f4" if dict(rows.dtypes)["vector"] == "array<float>" else "<f8"
    usable = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
                        & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = stored(rows.filter(usable).withColumn("key", F.xxhash64("vector")))
    classes = good.groupBy("key", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("vec", F.xxhash64("key", F.coalesce("least", F.lit(0)), F.size("vector")))
                     .withColumn("size", F.size("vector")))
    bits, tables = plan(classes.count(), threshold, miss)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype="int64")
        for batch in batches:
            raw, codes = [], []
            for vector in batch["vector"]:
                vector = np.asarray(vector).astype(kind)
                if len(vector) not in planes:
                    planes[len(vector)] = np.random.default_rng([seed, len(vector)]).standard_normal((tables * bits, len(vector)))
                raw.append(vector.tobytes())
                unit = vector.astype("float64") / float(np.abs(vector).max())
                codes.append(((planes[len(vector)] @ unit) > 0).reshape(tables, bits) @ weights)
            yield pd.DataFrame({"vec": batch["vec"], "copies": batch["copies"], "size": batch["size"], "vector": raw,
                                "codes": [c.astype(CODE).tobytes() for c in codes], "each": codes})

    signed = stored(classes.select("vec", "copies", "size", "vector").mapInPandas(
        sign, "vec long, copies long, size int, vector binary, codes binary, each array<long>"))
    buckets = signed.select("size", F.posexplode("each").alias("table", "code")).groupBy("size", "table", "code").count()
    blocks = small(stored(buckets.filter(F.col("count") > block)
                          .select("size", "table", "code", F.ceil(F.col("count") / block).alias("blocks"))))
    entries = (signed.select("vec", "copies", "size", "vector", "codes", F.posexplode("each").alias("table", "code"))
               .withColumn("codes", F.expr("substring(codes, 1, 4 * table)"))
               .join(blocks, ["size", "table", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
               .withColumn("own", F.pmod("vec", "blocks"))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .select("size", "table", "code", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       "own", "vec", "copies", "vector", "codes"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: _Rows | None = None
        for batch in batches:
            found = []
            sizes = batch["size"].to_numpy()
            edges = [0, *(np.nonzero(sizes[1:] != sizes[:-1])[0] + 1), len(batch)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                rows = _Rows(batch.iloc[start:stop], kind)
                if rest is not None and (rest.place[0] == rows.place[0]).all():
                    rest.append(rows)
                    rows = rest
                elif rest is not None and len(rest.vec) > 1:
                    found.append(rest.links(threshold))
                cuts = [0, *(np.nonzero((rows.place[1:] != rows.place[:-1]).any(axis=1))[0] + 1), len(rows.vec)]
                found += [rows.cut(i, j).links(threshold) for i, j in zip(cuts, cuts[1:-1]) if j - i > 1]
                rest = rows.cut(cuts[-2], cuts[-1])
            yield from gathered(found)
        if rest is not None and len(rest.vec) > 1:
            yield from gathered([rest.links(threshold)])

    def gathered(found: list) -> Iterator[pd.DataFrame]:
        found = [part for part in found if part is not None]
        if found:
            yield pd.DataFrame({name: np.concatenate([part[i] for part in found])
                                for i, name in enumerate(("vec", "links", "root"))})

    found = stored(entries.repartition(*PLACE).sortWithinPartitions(*PLACE)
                   .mapInPandas(compare, "vec long, links long, root long"))
    roots = connected_components(found.select("vec", "root"), "vec", "root").withColumnRenamed("node", "vec")
    named = classes.join(found.groupBy("vec").agg(F.sum("links").alias("links")), "vec", "left").join(roots, "vec", "left")
    named = stored(named.select("key", "vector", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "vec").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("key", "vector", "copies", "links", "component_id")
    linked = good.join(named, ["key", "vector"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_column), "n_links", "component_id",
                                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
