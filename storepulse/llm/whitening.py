"""Whitening of embeddings with MLlib's BlockMatrix.

Rows get dense numbers and become blocks of a tall matrix, a bounded number of rows each. The scatter is the transpose times the matrix; its middle
dimension is split, so that partial products are made in many tasks and only their d x d sums meet. The driver takes eigenvectors of that d x d
matrix. To project, the tall matrix is folded into a square grid of blocks, which a block-diagonal matrix of whitening blocks multiplies: MLlib deals
a grid to as many partitions as it has blocks, but a single column of blocks only to their square root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.plans.lineage import cut

#: Rows of a block; above BLOCKS blocks these grow, up to BLOCK_BYTES, as MLlib keeps the blocks' numbers on the driver.
ROWS, BLOCKS, BLOCK_BYTES = 1024, 1 << 16, 64 << 20
#: Blocks that one task of the scatter multiplies.
SPLIT = 8


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums by dimension, and for each component its eigenvalue, unit eigenvector (a column) and share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def matrix(self) -> np.ndarray:
        """Projects a centred row on each component in units of its deviation; components without variance give zero columns."""
        return self.vectors / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 1e-300)), np.inf)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as long; a value beyond a long is an error."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def numbered(df: DataFrame, width: int) -> DataFrame:
    """df, a written table with `at` of monotonically_increasing_id, with `row`, a dense number from 0, and its block of `width` rows.

    Only the rows of each partition that made `at` are counted, a table of as many rows as there were tasks, which is broadcast."""
    parts = df.groupBy(F.shiftright("at", 33).alias("part")).agg(F.max(F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("n"))
    first = parts.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "first")
    row = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    return df.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(first), "part").drop("part").withColumn("row", row).drop("first").withColumn("block", F.floor(F.col("row") / width))


def _blocks(rows: DataFrame, mean: list[float], width: int):
    """(block, DenseMatrix) of rows (row, block, x): x less the mean; a row that is not there is zero."""
    d = len(mean)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            within = batch.column("row").to_numpy() - numbers * width
            x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(-1, d) - np.array(mean)
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()] if len(numbers) else []
            for lo, hi in zip(starts, [*starts[1:], len(numbers)], strict=True):
                if numbers[lo] != now:
                    if held is not None:
                        yield told(now, held)
                    now, held = numbers[lo], np.zeros((width, d), order="F")
                held[within[lo:hi]] = x[lo:hi]
        if held is not None:
            yield told(now, held)

    def told(block, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([held.tobytes(order="F")], pa.binary())], ["block", "data"])

    made = rows.select("row", "block", "x").repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block bigint, data binary")
    return made.rdd.map(lambda r: (r.block, DenseMatrix(width, d, np.frombuffer(r.data))))


def _scatter(rows: DataFrame, mean: list[float], width: int, blocks: int) -> np.ndarray:
    d = len(mean)
    tall = BlockMatrix(_blocks(rows, mean, width).map(lambda b: ((b[0], 0), b[1])), width, d, blocks * width, d)
    model = tall._java_matrix_wrapper
    split = max(1, ceil(blocks / SPLIT))
    turned = model.call("transpose")
    product = turned.multiply(model._java_model, split)
    return BlockMatrix(product, d, d).toLocalMatrix().toArray()


def _projected(rows: DataFrame, mean: list[float], matrix: np.ndarray, width: int, blocks: int) -> DataFrame:
    """row, z: the matrix product of each centred row."""
    spark, (d, k) = rows.sparkSession, matrix.shape
    side = max(1, ceil(sqrt(blocks)))
    folded = BlockMatrix(_blocks(rows, mean, width).map(lambda b: ((b[0] // side, b[0] % side), b[1])), width, d, ceil(blocks / side) * width, side * d)
    diagonal = spark.sparkContext.parallelize(range(side), min(side, 64)).map(lambda j: ((j, j), DenseMatrix(d, k, matrix.flatten(order="F"))))
    product = folded.multiply(BlockMatrix(diagonal, d, k, side * d, side * k))

    def unfolded(b):
        (i, j), block = b
        at = (i * side + j) * width
        return ((at + r, z) for r, z in enumerate(block.toArray().tolist()))

    return spark.createDataFrame(product.blocks.flatMap(unfolded), "row bigint, z array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold null, NaN or infinite entries are left out. Entries c count as x = floor(scale * c). The covariance is that of the
    distinct x, n of them, with divisor n, centred before it is multiplied; components are its unit eigenvectors by falling eigenvalue, `components`
    of them or as many as there are dimensions. deviation: the sum over dimensions of (n * x - S) squared, S the sums of the distinct x, as
    decimal(38,0), exactly. whitened: the centred x on the component over the root of its eigenvalue, null where the eigenvalue is no larger
    than rounding (then nothing can be whitened). explained: the eigenvalue's share of the trace, null if that is zero. identity_error: the largest
    absolute entry of the covariance of whitened over the distinct x less the identity, over components with variance, null without any.
    Vectors shorter than the longest count as filled with zeros. Equal vectors count once for the fit and are projected each; equal and null ids
    too. An empty table, or one of empty vectors only, gives no rows; other columns are left out. The d x d covariance is the driver's."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v")).filter(usable(F.col("v")))
    table = cut(kept.select("vec_id", whole_numbers(F.col("v"), scale).alias("x"), F.monotonically_increasing_id().alias("at")), "vectors")
    shape = table.agg(F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least"), F.count("*").alias("rows")).first()
    d, total = shape.d or 0, shape.rows
    kind = table.schema["vec_id"].dataType.simpleString()
    if not d:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if shape.least < d:
        table = table.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    width = max(ROWS, min(ceil(total / BLOCKS), BLOCK_BYTES // (8 * d)))
    blocks = ceil(total / width)
    table = numbered(table, width)
    once = cut(table.groupBy("x").agg(F.min("row").alias("row"), F.min_by("block", "row").alias("block")), "distinct")
    n = once.count()
    summed = once.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = [s for _, s in sorted((r.pos, r.s) for r in summed)]
    mean = [s / n for s in sums]

    covariance = _scatter(once, mean, width, blocks) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    trace = values.sum()
    k = min(components, d)
    values = np.where(values > trace * d * np.finfo(float).eps, values, 0.0)[:k]
    fit = Whitening(n, sums, values, np.ascontiguousarray(axes[:, :k]), values / trace if trace > 0 else np.full(k, np.nan))

    z = cut(_projected(table, mean, fit.matrix(), width, blocks), "whitened")
    error = _identity_error(z.join(once.select("row"), "row", "left_semi"), n, np.flatnonzero(fit.values))
    s = F.array(*(F.lit(v).cast("long") for v in sums))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast("long"), lambda t, p: t + p)
    exact = lambda c: c.cast("decimal(38,0)")
    fixed = F.lit(str(sum(v * v for v in sums))).cast("decimal(38,0)")
    # n^2 * sum(x^2) - 2n * sum(xS) + sum(S^2)
    spread = exact(exact(exact(dot(F.col("x"), F.col("x"))) * F.lit(str(n)).cast("decimal(19,0)")) - exact(dot(F.col("x"), s)) * 2)
    deviation = exact(exact(spread * F.lit(str(n)).cast("decimal(19,0)")) + fixed)
    own = table.select("row", "vec_id", deviation.alias("deviation"))
    told = F.array(*(F.struct(F.lit(i + 1).alias("component"), (F.col("z")[i] if v > 0 else F.lit(None).cast("double")).alias("whitened"), _number(e).alias("explained")) for i, (v, e) in enumerate(zip(fit.values, fit.explained, strict=True))))
    rows = own.join(z, "row").select("vec_id", "deviation", F.inline(told))
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", _number(error).alias("identity_error"))


def _number(value: float) -> Column:
    return F.lit(None if np.isnan(value) else float(value)).cast("double")


def _identity_error(z: DataFrame, n: int, used: np.ndarray) -> float:
    """Of the projected distinct rows, measured by one aggregation."""
    if not len(used):
        return float("nan")
    pairs = [(a, b) for a in used.tolist() for b in used.tolist() if a <= b]
    sums = z.agg(*(F.sum(F.col("z")[a]).alias(f"s{a}") for a in used.tolist()), *(F.sum(F.col("z")[a] * F.col("z")[b]).alias(f"p{a}_{b}") for a, b in pairs)).first()
    return max(abs(sums[f"p{a}_{b}"] / n - sums[f"s{a}"] / n * sums[f"s{b}"] / n - (a == b)) for a, b in pairs)
