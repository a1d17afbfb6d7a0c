"""Whitening of embeddings through distributed block matrices.

Entries become whole numbers on a fixed grid, so that sums, and with them the centred rows, are exact until the last
division. The centred rows, numbered, are dealt into the blocks of an MLlib BlockMatrix X. X'X is the scatter: its
rows are multiplied in parts of the long side, whose products (width by width) are added up. Only that product, of
the width of a vector, comes to the driver, for eigh; X times the whitening matrix gives the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from filecensus.operators.scale import cut_lineage, numbered

COMPONENTS = 8
GRID, SHIFT = 1024, 100_000
# Entries of a block, and the least and the wished number of blocks on the long side.
BLOCK_ENTRIES = 4 * 1024 * 1024
BLOCK_ROWS, BLOCKS = 1024, 256


def _finite(vector: Column) -> Column:
    """Is a vector there, with all its entries finite numbers?"""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def on_grid(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of the usable rows; see `whiten`."""
    vector = F.col("embedding").cast("array<double>")
    usable = embeddings.select("vec_id", vector.alias("v")).filter(_finite(F.col("v")))
    return usable.select("vec_id", F.transform("v", lambda c: F.floor(c * GRID) + F.lit(SHIFT).cast("bigint")).alias("x"))


def block_matrix(rows: DataFrame, count: int, width: int) -> BlockMatrix:
    """The rows (place, vector) as distributed blocks, few enough for the driver to know their names."""
    high = max(1, min(max(BLOCK_ROWS, -(-count // BLOCKS)), BLOCK_ENTRIES // width))
    indexed = MLUtils.convertVectorColumnsFromML(
        rows.select("place", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, count, width).toBlockMatrix(high, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """X'X, multiplied in as many parts of the long side as there are blocks (at most BLOCKS)."""
    parts = max(1, min(BLOCKS, -(-matrix.numRows() // matrix.rowsPerBlock)))
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """place and vector (array<double>) of X times a small matrix."""
    width, components = whitening.shape
    spark_context = matrix.blocks.context
    small = Matrices.dense(width, components, whitening.ravel(order="F"))
    right = BlockMatrix(spark_context.parallelize([((0, 0), small)], 1), matrix.colsPerBlock, components)
    product = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("place"), vector_to_array("vector").alias("vector"))


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors over the roots of their eigenvalues, by falling eigenvalue, and the eigenvalues.

    Directions without variance (within rounding) are left out.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps]
    return vectors[:, order] / np.sqrt(values[order]), values[order]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    Rows whose vector is null or holds a null or an entry that is not finite are left out; all others are the fit
    list. An entry c counts as x = floor(1024 c) + 100000. deviation is the exact sum of squares of n x - S, an error
    if it is beyond a long. Vectors shorter than the longest are filled up with zeros; directions without variance
    have no component, so one vector alone, equal vectors, empty vectors and an empty table give no rows. Repeated
    and null vec_ids stay rows of their own; other columns are not looked at.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "vec_id {}, component int, n bigint, deviation bigint, whitened double, "
                                  "explained double, identity_error double".format(dict(embeddings.dtypes)["vec_id"]))
    rows = cut_lineage(numbered(on_grid(embeddings), ["vec_id"], "place"))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not count or not width:
        return empty
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(width) - F.size("x"))))
    sums = [row["s"] for row in rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"))
            .orderBy("pos").collect()]  # as many as a vector is wide
    shifts = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda x, s: x * F.lit(count) - s)
    rows = rows.select("vec_id", "place", shifts.alias("shift"))
    matrix = block_matrix(rows.select("place", F.transform("shift", lambda x: x / F.lit(count)).alias("vector")),
                          count, width)
    covariance = scatter(matrix) / count
    whitening, values = whitening_matrix(covariance, components)
    if not len(values):
        return empty
    spread = cut_lineage(projected(matrix, whitening))
    deviation = F.aggregate("shift", F.lit(0).cast("bigint"), lambda total, x: total + x * x)
    listed = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    return rows.select("vec_id", "place", deviation.alias("deviation")).join(spread, "place").select(
        "vec_id", "deviation", F.posexplode("vector").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(count).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(listed, F.col("at")).alias("explained"),
        F.lit(identity_error(spread, len(values))).alias("identity_error"))


def identity_error(spread: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the projected rows minus the identity."""
    columns = [F.get("vector", F.lit(i)) for i in range(components)]
    means = spread.agg(*[F.avg(c) for c in columns]).first()
    centred = [c - F.lit(m) for c, m in zip(columns, means, strict=True)]
    entries = [F.abs(F.avg(centred[i] * centred[j]) - F.lit(float(i == j)))
               for i in range(components) for j in range(i + 1)]
    return max(spread.agg(*entries).first())
