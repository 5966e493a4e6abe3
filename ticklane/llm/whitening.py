"""Whitening of embeddings with distributed block matrices.

The fit list (each distinct integer vector once) is numbered, centred and cut into row blocks of an MLlib BlockMatrix.
Its transpose times itself is the scatter matrix, of which only dims x dims numbers reach the driver; eigh there gives
the whitening matrix, and the block matrix times it projects the fit list. Rows take their projection by joining on
the vector, so copies cost a row each and nothing is centred or multiplied twice.

MLlib keeps the coordinates of the blocks on the driver (some 100 bytes for BLOCK_ROWS vectors).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.integer_vectors import component_sums, is_scalable, scaled_down
from ticklane.llm.shared import stored

COMPONENTS = 4
SCALE = 256
# integers up to here are exact as doubles
MOST = 1 << 53
BLOCK_ROWS = 4096
# doubles that one task multiplies at once
TASK_VALUES = 1 << 23
# eigenvalues below this share of all variance are rounding
NO_VARIANCE = 1e-12


def numbered(distinct: DataFrame, rows: int) -> DataFrame:
    """Rows of distinct ``x`` with ``index`` 0, 1, ...: by ranges of a hash, so that no task sorts them all."""
    ranges = max(1, min(math.ceil(rows / BLOCK_ROWS), 1 << 16))
    hashed = distinct.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(ranges)))
    sizes = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("x")
    return hashed.join(starts, "part").select("x", (F.col("start") + F.row_number().over(within) - 1).alias("index"))


def gram(matrix: BlockMatrix, columns: int, blocks: int, block_values: int) -> np.ndarray:
    """The transpose times the matrix, on the driver. The sum over row blocks is split, so tasks hold a few blocks."""
    splits = max(1, math.ceil(blocks * block_values / TASK_VALUES))
    model = matrix._java_matrix_wrapper._java_model
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", model, splits)
    result = BlockMatrix(product, columns, columns).toLocalMatrix().toArray()
    return (result + result.T) / 2


def fitted(distinct: DataFrame, dims: int, components: int) -> DataFrame:
    """Of each distinct vector ``x``: ``n``, ``deviation`` and, of each component, ``whitened`` and ``explained``; ``identity_error``.

    All in arrays by component; components without variance are left out.
    """
    n = distinct.count()
    rows = stored(numbered(distinct, n))
    sums = component_sums(rows.select(F.lit(0).alias("one"), "x"), "one", "x", dims)[0][1]
    extreme = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    means = F.lit([total / n for total in sums])
    centred = rows.select("index", array_to_vector(F.zip_with(F.transform("x", lambda x: x.cast("double")), means, lambda x, m: x - m)).alias("vector"))
    centred = MLUtils.convertVectorColumnsFromML(centred, "vector")
    blocks = math.ceil(n / BLOCK_ROWS)
    tasks = math.ceil(n * dims / TASK_VALUES)
    if centred.rdd.getNumPartitions() < tasks:
        centred = centred.repartition(tasks, "index")
    matrix = IndexedRowMatrix(centred, n, dims).toBlockMatrix(BLOCK_ROWS, dims)
    covariance = gram(matrix, dims, blocks, BLOCK_ROWS * dims) / n
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    chosen = [i for i in range(dims - 1, -1, -1) if values[i] > NO_VARIANCE * trace][:components]
    if not chosen:
        return rows.limit(0).select("x", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"),
                                    F.array(F.lit(0.0)).alias("explained"), F.lit(0.0).alias("identity_error"))
    spark = distinct.sparkSession
    weights = vectors[:, chosen] / np.sqrt(values[chosen])
    local = Matrices.dense(dims, len(chosen), weights.ravel(order="F").tolist())
    projected = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dims, len(chosen), dims, len(chosen)))
    error = float(np.abs(gram(projected, len(chosen), blocks, BLOCK_ROWS * len(chosen)) / n - np.eye(len(chosen))).max())
    whitened = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    whitened = whitened.select("index", vector_to_array("vector").alias("whitened"))
    return rows.join(whitened, "index").select(
        "x", F.lit(n).cast("long").alias("n"), deviation(n, sums, extreme, dims).alias("deviation"), "whitened",
        F.lit([float(values[i]) / trace for i in chosen]).alias("explained"), F.lit(error).alias("identity_error"))


def deviation(n: int, sums: list[int], extreme: int, dims: int):
    """Sum over components of (n * x - S)^2, exact; null where a long can't hold it."""
    if dims * (2 * n * extreme) ** 2 < 1 << 63:
        gaps = F.zip_with("x", F.lit(sums), lambda x, s: x * F.lit(n) - s)
        return F.aggregate(F.transform(gaps, lambda g: g * g), F.lit(0).cast("long"), lambda a, b: a + b)
    wide = "decimal(38,0)"
    totals = F.array(*[F.lit(str(total)).cast(wide) for total in sums])
    gaps = F.zip_with("x", totals, lambda x, s: (x.cast(wide) * F.lit(n).cast("decimal(19,0)")).cast(wide) - s)
    small = F.forall(gaps, lambda g: F.abs(g) < F.lit(1 << 32))
    squares = F.transform(gaps, lambda g: g.cast("decimal(11,0)") * g.cast("decimal(11,0)"))
    total = F.aggregate(squares, F.lit(0).cast(wide), lambda a, b: (a + b).cast(wide))
    return F.when(small, F.when(total < F.lit(str(1 << 63)).cast(wide), total).cast("long"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """One row per vector and component: its id, ``component`` (from 1 by falling variance), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error`` (largest entry by which the whitened covariance is not the identity).

    Vectors that are null or hold a null or non-finite component are left out, and so are those with a component beyond
    2**53 after scaling, which no integer in a double can hold. Vectors of different lengths are whitened apart, each
    length by its own fit list. Fewer components come back where fewer have variance: none for empty vectors, for a
    single vector or copies of it. ``deviation`` is null where it leaves a long. Equal rows and null ids are rows like others.
    Other columns are left out; an empty table gives no rows.
    """
    good = is_scalable(F.col(vector_column), scale, MOST)
    rows = stored(vectors.where(good).select(F.col(id_column).cast("long").alias("id"), scaled_down(F.col(vector_column), scale).alias("x")))
    results = []
    for dims in sorted(row[0] for row in rows.select(F.size("x")).distinct().collect()):
        own = rows.where((F.size("x") == dims) & (F.size("x") > 0))
        if dims:
            results.append(own.join(fitted(stored(own.select("x").distinct()), dims, components), "x"))
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not results:
        return vectors.sparkSession.createDataFrame([], f"{id_column} long, component int, n long, deviation long, "
                                                        "whitened double, explained double, identity_error double")
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    each = result.select(F.col("id").alias(id_column), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.withColumns({"component": (F.col("at") + 1).cast("int"), "explained": F.col("explained")[F.col("at")]}).select(id_column, *names)
