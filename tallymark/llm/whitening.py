"""Embedding whitening: principal components of all vectors by distributed block matrices.

The centred rows are numbered and laid out as a ``BlockMatrix``. Its transpose times itself is the
scatter, a matrix of the size of one vector squared, whose eigenvectors are found on the driver;
the product of the blocks with these, over the roots of the eigenvalues, projects the rows.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import quoted
from tallymark.llm.bk_tree import heads
from tallymark.llm.common import sorted_groups, stored
from tallymark.llm.vectors import is_usable, of_one_length

COMPONENTS = 8
# An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# A block has so many rows, a partition so many blocks, and a slab so many partitions: what one
# task of a product holds in memory, and what one product covers, is bounded at any input.
BLOCK_ROWS, PARTITION_BLOCKS, SLAB_PARTITIONS = 2048, 4, 64
# Components of less than this share of the variance are noise of the arithmetic.
LEAST_SHARE = 1e-12
_ROW_BITS = 33


def whole_numbers(vector: str) -> Column:
    """Return the entries of a vector as whole numbers."""
    return F.transform(
        F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT
    )


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Return stored ``rows``, which have the ``at`` of their writing, with an ``index`` from 0."""
    spark = rows.sparkSession
    part = F.shiftrightunsigned("at", _ROW_BITS).alias("part")
    # One number for each task that wrote, of which there are as many as files.
    counts = sorted(map(tuple, rows.groupBy(part).count().collect()))
    starts, total = [], 0
    for number, count in counts:
        starts.append((number, total))
        total += count
    starts = spark.createDataFrame(starts, "part long, begin long")
    numbered = rows.withColumn("part", part).join(starts, "part")
    index = F.col("begin") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.select(index.alias("index"), "vec_id", "x"), total


def _packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Return the ``vector`` of ``block_rows`` rows at a time, by ``index``, as one block."""

    def packed(batches):
        for table in sorted_groups(batches, ("block",), block_rows):
            number = table["block"].to_numpy()
            begins = np.flatnonzero(heads(number)).tolist()
            for begin, end in zip(begins, [*begins[1:], len(number)], strict=True):
                some = table["vector"].combine_chunks()[begin:end]
                entries = some.flatten().to_numpy().reshape(end - begin, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number[begin]], pa.int64()),
                        pa.array([end - begin], pa.int32()),
                        pa.array([entries.tobytes(order="F")], pa.binary()),
                    ],
                    names=["block", "n", "entries"],
                )

    dealt = rows.withColumn("block", F.expr(f"index div {block_rows}")).repartition("block")
    dealt = dealt.sortWithinPartitions("block", "index").select("block", "vector")
    return dealt.mapInArrow(packed, "block long, n int, entries binary")


def _block_matrix(blocks: DataFrame, begin: int, end: int, block_rows: int, size: int) -> BlockMatrix:
    """Return the blocks that hold the rows from ``begin`` to ``end``, a multiple of their rows."""

    @F.udf(MatrixUDT())
    def matrix(n, entries):
        return DenseMatrix(n, size, np.frombuffer(entries))

    first, last = begin // block_rows, -(-end // block_rows)
    some = blocks.where((F.col("block") >= first) & (F.col("block") < last))
    # What a product is dealt to is the square root of this number.
    some = some.repartition((-(-(last - first) // PARTITION_BLOCKS)) ** 2)
    place = F.struct((F.col("block") - first).alias("row"), F.lit(0).cast("long").alias("column"))
    some = some.select(place.alias("place"), matrix("n", "entries").alias("matrix"))
    java = callMLlibFunc("createBlockMatrix", some, block_rows, size, end - begin, size)
    return BlockMatrix(java, block_rows, size)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """Return the product; partial sums over the middle are made in ``splits`` tasks."""
    java = left._java_matrix_wrapper.call(
        "multiply", right._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _slabs(total: int, block_rows: int) -> list[tuple[int, int]]:
    size = block_rows * PARTITION_BLOCKS * SLAB_PARTITIONS
    return [(begin, min(begin + size, total)) for begin in range(0, total, size)]


def _scatter(blocks: DataFrame, total: int, block_rows: int, size: int) -> np.ndarray:
    """Return the sum of the outer products of all rows' vectors."""
    scatter = np.zeros((size, size))
    for begin, end in _slabs(total, block_rows):
        some = _block_matrix(blocks, begin, end, block_rows, size)
        splits = -(-(end - begin) // (block_rows * PARTITION_BLOCKS))
        scatter += _product(some.transpose(), some, splits).toLocalMatrix().toArray()
    return scatter


def _projected(blocks: DataFrame, total: int, block_rows: int, matrix: np.ndarray) -> DataFrame:
    """Return ``index`` and ``whitened``, each row's vector times ``matrix``."""
    spark, (size, width) = blocks.sparkSession, matrix.shape
    local = [(0, size, matrix.astype(np.float64).tobytes(order="F"))]
    local = spark.createDataFrame(local, "block long, n int, entries binary")
    right = _block_matrix(local, 0, size, size, width)
    slabs = []
    for begin, end in _slabs(total, block_rows):
        product = _product(_block_matrix(blocks, begin, end, block_rows, size), right)
        java = product.toIndexedRowMatrix()._java_matrix_wrapper._java_model
        found = callMLlibFunc("getIndexedRows", java).toDF("index", "vector")
        index = (F.col("index") + begin).alias("index")
        slabs.append(found.select(index, vector_to_array("vector").alias("whitened")))
    return reduce(DataFrame.union, slabs)


def _identity_error(scores: DataFrame, width: int) -> float:
    """Return the largest absolute entry of the covariance of ``whitened`` less the identity."""
    each = [F.col("whitened")[at] for at in range(width)]
    means = list(scores.agg(*(F.avg(one).alias(f"m{at}") for at, one in enumerate(each))).first())
    apart = [one - mean for one, mean in zip(each, means, strict=True)]
    entries = [(a, b) for a in range(width) for b in range(a + 1)]
    sums = (F.avg(apart[a] * apart[b]).alias(f"c{at}") for at, (a, b) in enumerate(entries))
    got = scores.agg(*sums).first()
    return float(max(abs(one - (a == b)) for one, (a, b) in zip(got, entries, strict=True)))


def principal(scatter: np.ndarray, total: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Return up to ``most`` greatest eigenvalues, their unit vectors as columns, and the trace.

    The greatest entry of each vector by its absolute value is positive.
    """
    values, vectors = np.linalg.eigh(scatter / total)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(scatter)) / total
    order = order[values[order] > LEAST_SHARE * trace]
    values, vectors = values[order], vectors[:, order]
    at = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[at, np.arange(len(order))]), trace


def whiten(
    rows: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    most: int = COMPONENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Return ``vec_id``, ``n``, ``deviation``, ``explained``, ``whitened``, ``identity_error``.

    One row for each row of ``rows`` with a usable vector: ``n`` of them, all of which the
    components are fitted to. ``whitened`` holds the centred vector along up to ``most`` unit
    eigenvectors of the covariance, by falling eigenvalue, over the roots of the eigenvalues;
    ``explained`` their shares of the variance. ``deviation`` is the sum of the squares of
    n * x - sum(x) over the entries x, exact, as a decimal. ``identity_error`` is the largest
    absolute entry of the covariance of ``whitened`` less the identity.

    Vectors that are null or empty, or have null or infinite entries or NaN, are left out, and so
    are those that are not as long as most others are. Rows with a null key or a repeated one are
    returned like all others, ties too; other columns are not looked at, whatever their names.
    Components without variance are left out: if there is no other, as with one vector or equal
    ones, ``whitened`` is empty and ``identity_error`` is 0. An empty table gives no rows.
    """
    chosen = rows.where(is_usable(quoted(vector))).select(
        F.col(quoted(key)).cast("long").alias("vec_id"), whole_numbers(quoted(vector)).alias("x")
    )
    kept, size = of_one_length(chosen, "x", "vectors")
    kept = stored(kept.withColumn("at", F.monotonically_increasing_id()), "numbered-vectors")
    numbered, total = _numbered(kept)
    sums = kept.select(*(F.col("x")[at].alias(f"x{at}") for at in range(size)))
    sums = list(sums.agg(*(F.sum(name) for name in sums.columns)).first())
    whole = F.array(*(F.lit(one or 0).cast("long") for one in sums))
    terms = F.zip_with("x", whole, lambda x, s: (F.lit(total) * x - s).cast("decimal(19,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    deviation = F.aggregate(
        terms, zero, lambda done, term: (done + term * term).cast("decimal(38,0)")
    )
    values, vectors, trace = np.empty(0), np.empty((size, 0)), 1.0
    if total:
        mean = F.array(*(F.lit(one / total) for one in sums))
        centred = numbered.select("index", F.zip_with("x", mean, lambda x, m: x - m).alias("vector"))
        blocks = stored(_packed(centred, block_rows), "centred-blocks")
        scatter = _scatter(blocks, total, block_rows, size)
        values, vectors, trace = principal(scatter, total, most)
    error = 0.0
    found = numbered.withColumn("whitened", F.array().cast("array<double>"))
    if len(values):
        scores = stored(
            _projected(blocks, total, block_rows, vectors / np.sqrt(values)), "whitened"
        )
        error = _identity_error(scores, len(values))
        found = numbered.join(scores, "index")
    shares = F.array(*(F.lit(float(one) / trace) for one in values)).cast("array<double>")
    return found.select(
        "vec_id",
        F.lit(total).cast("long").alias("n"),
        deviation.alias("deviation"),
        shares.alias("explained"),
        "whitened",
        F.lit(error).alias("identity_error"),
    )
