"""Whitening of embeddings with MLlib block matrices: principal components scaled to unit variance.

1. **Whole numbers.** Rows whose vector is null or holds null or non-finite entries are dropped; an entry c becomes
   x = floor(1024 c) + 100000. Counts, sums and deviations are sums of whole numbers, so they are exact in any order.
2. **Rows to blocks.** The remaining rows are stored with the number of their task and their place in it; the counts per
   task turn that into a gapless row index without a sort. Centred rows (n x - S) / n form an ``IndexedRowMatrix``,
   which is dealt into blocks of about two megabytes.
3. **Scatter.** The transposed block matrix times itself, its middle dimension dealt to many tasks: each sums the
   products of its blocks, and only d x d sums meet. d x d values (the dimension, not the data) go to the driver.
4. **Projection.** Eigenvectors over the root of their eigenvalues form a small block matrix, by which the row blocks are
   multiplied. The projections are stored, and their own covariance is measured the same way.

All steps but the unpacking of projected blocks run in the JVM. Repeated rows and equal ids are rows of their own; a null
id is kept. A vector shorter than the longest one holds nulls at its end and is dropped. Other columns are not read, so
their names may clash with anything. Directions without variance (an eigenvalue lost in the rounding of the largest) have
no component. An empty table, or one whose vectors are all dropped or all equal, gives an empty result. A deviation that
no long can hold is null; entries so large that n x itself passes a long end in Spark's overflow error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries of a block: two megabytes of doubles.
BLOCK_ENTRIES = 1 << 18
BLOCK_COLUMNS = 1024
#: Row numbers inside a task, as monotonically_increasing_id gives them.
PLACE_BITS = 33
#: Sums of squares below this have no rounding to fear when they are kept as longs.
LONG_SAFE = 9.0e18


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, x (array of longs) and index (0 to n - 1) of the rows that remain (stored)."""
    entries = F.col(column).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(entries, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    rows = vectors.where(F.col(column).isNotNull() & finite).select("vec_id", x.alias("x"))
    placed = kept_table(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    longest = placed.agg(F.max(F.size("x"))).first()[0] or 0
    fit = placed.where((F.size("x") == longest) & (F.size("x") > 0))
    if fit.isEmpty():
        return fit.select("vec_id", "x", F.col("place").alias("index"))
    # Dropped short vectors leave holes in the places, so rows are numbered among those that stay.
    if placed.where(F.size("x") < longest).limit(1).count():
        fit = kept_table(fit.withColumn("place", F.monotonically_increasing_id()), "vectors")
    task = F.shiftright("place", PLACE_BITS)
    counts = sorted(tuple(r) for r in fit.groupBy(task.alias("task")).count().collect())
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    starts = [(int(t), int(b)) for (t, _), b in zip(counts, before)]
    offsets = vectors.sparkSession.createDataFrame(starts, "task long, before long")
    inside = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return fit.withColumn("task", task).join(offsets, "task").select("vec_id", "x", (F.col("before") + inside).alias("index"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sum per dimension)."""
    found = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: r["at"])
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def off_mean(n: int, total: list[int]) -> Column:
    """n x - S, an array of longs."""
    return F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in total)), lambda v, s: v * F.lit(n).cast("long") - s)


def sum_of_squares(values: Column) -> Column:
    """Exact sum of squared longs; null where a long cannot hold it."""
    rough = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    exact = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v * v)
    return F.when(rough < LONG_SAFE, exact)


def block_matrix(rows: DataFrame, column: str, n: int, width: int) -> BlockMatrix:
    """The array ``column`` of ``rows`` (index, column) as blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(column).alias("vector")), "vector")
    columns = min(width, BLOCK_COLUMNS)
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transposed matrix times matrix; the products of row blocks are dealt to as many tasks as there are such blocks, a few for each core."""
    context = SparkSession.active().sparkContext
    splits = min(-(-n // matrix.rowsPerBlock), 4 * context.defaultParallelism)
    turned = matrix.transpose()
    # The Python method has no argument for the splits of the middle dimension; without them one task makes all products.
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """index and the array ``whitened`` of every row of ``matrix`` times ``weights`` (stored)."""
    context, size = SparkSession.active().sparkContext, matrix.colsPerBlock
    parts = [weights[low : low + size] for low in range(0, len(weights), size)]
    small = [((i, 0), DenseMatrix(p.shape[0], p.shape[1], p.T.ravel())) for i, p in enumerate(parts)]
    right = BlockMatrix(context.parallelize(small, 1), size, weights.shape[1], *weights.shape)
    product = matrix.multiply(right)
    rows_per_block = matrix.rowsPerBlock

    def unpack(blocks: Iterator) -> Iterator[tuple[int, list[float]]]:
        for (at, _), block in blocks:
            for place, values in enumerate(block.toArray().tolist()):
                yield at * rows_per_block + place, values

    rows = SparkSession.active().createDataFrame(product.blocks.mapPartitions(unpack), "index long, whitened array<double>", verifySchema=False)
    return kept_table(rows, "projected")


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns), at most ``most`` and only such with variance; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = values > len(values) * np.finfo(float).eps * max(values[0], 0)
    values, vectors = values[there][:most], vectors[:, there][:, :most]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.sign(largest)


def whiten(vectors: DataFrame, most: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every remaining row of
    ``vectors`` (vec_id, ``column`` and any others) and each of its first ``most`` components."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = whole_numbers(vectors, column)
    n, total = sums(rows)
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing
    width = len(total)
    off = off_mean(n, total)
    centred = rows.select("index", F.transform(off, lambda v: v.cast("double") / F.lit(float(n))).alias("centred"))
    matrix = block_matrix(centred, "centred", n, width)
    covariance = scatter(matrix, n) / n
    values, axes = eigen(covariance, most)
    if not len(values):
        return nothing
    found = projected(matrix, axes / np.sqrt(values))
    means = found.select(F.posexplode("whitened").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).collect()
    means = F.array(*(F.lit(r["m"]) for r in sorted(means, key=lambda r: r["at"])))
    around = found.select("index", F.zip_with("whitened", means, lambda v, m: v - m).alias("centred"))
    own = scatter(block_matrix(around, "centred", n, len(values)), n) / n
    error = float(np.abs(own - np.eye(len(values))).max())
    explained = F.array(*(F.lit(float(v)) for v in values / np.trace(covariance)))
    return (
        rows.select("vec_id", "index", sum_of_squares(off).alias("deviation"))
        .join(found, "index")
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
