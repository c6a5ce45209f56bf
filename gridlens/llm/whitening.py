"""Whitening of vectors by the covariance of the different ones, each weighted by its multiplicity or by one.

* Vectors become whole numbers x, and equal x become one row with its multiplicity. Everything below runs on these rows.
* Sums are whole numbers, so the mean S / n is exact: a centred component is (n * x - S) / n, one rounding of an exact number.
* Each task multiplies its centred rows, weighted, with themselves (a matrix as wide as the vectors); the tasks' matrices are added
  row by row on Spark, in the order of the partitions. Only the finished covariance, dimensions squared numbers, reaches the driver, where
  numpy finds its eigenvectors; so the width of the vectors must fit there, the number of rows does not matter.
* Each different x is projected once, and the rows take the result by the digest of their x. Both sides of that join are
  written, so Spark can split the rows of a very frequent vector.
* The identity error is measured on the projected rows: their covariance, centred before multiplying.

Rows whose vector is null, holds null or non-finite components, or has another length than most, are dropped. Rows with null key stay, repeated rows
stay. Components are the first ones by falling eigenvalue, fewer if the vectors are shorter; the largest entry of each eigenvector is positive. A
component without variance (an eigenvalue within rounding of zero, as with a single vector) has whitened null, and explained 0 or, if nothing
varies, null; the identity error covers the others. deviation is exact, and null where it exceeds a long. An empty table gives an empty table.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.whole_vectors import MOST, SCALE, unpacked, whole_vectors
from gridlens.session import stage

COMPONENTS = 4


def _extremes(rows: np.ndarray) -> int:
    return max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0


def weighted_sums(rows: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact sums of each column, each row as often as its weight."""
    if _extremes(rows) * int(weights.sum()) <= MOST:
        return [int(v) for v in weights @ rows]
    return [int(v) for v in weights.astype(object) @ rows.astype(object)]


def centred(rows: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """The rows less the mean, in doubles, and for each row the exact sum of (n * x - S) ** 2 (None beyond a long)."""
    reach = n * _extremes(rows) + max(map(abs, sums), default=0)
    if reach * reach * max(1, len(sums)) <= MOST:
        whole = n * rows - np.array(sums, np.int64)
        return whole / n, (whole * whole).sum(axis=1).tolist()
    whole = rows.astype(object) * n - np.array([int(s) for s in sums], object)
    squares = [sum(v * v for v in row) for row in whole.tolist()]
    # true division of integers rounds once
    shares = np.array([[v / n for v in row] for row in whole.tolist()]).reshape(rows.shape)
    return shares, [s if s <= MOST else None for s in squares]


def _per_task(rows: DataFrame, schema: str, work: Callable[[Iterable[tuple[np.ndarray, np.ndarray]]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """What work makes of the batches (vectors, weights) of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((unpacked(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
        yield from work(parts)

    return rows.select("x", "weight").mapInArrow(run, schema)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The sum of the weights and of each component; one row per task and component is added on Spark."""

    def work(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for vectors, weights in parts:
            n += int(weights.sum())
            more = weighted_sums(vectors, weights)
            sums = [a + b for a, b in zip(sums, more, strict=True)] if sums else more
        if n:
            yield pa.record_batch([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(v) for v in [n, *sums]])], names=["i", "total"])

    found = _per_task(rows, "i int, total string", work).groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_component = {r["i"]: int(r["total"]) for r in found.collect()}
    return by_component.get(-1, 0), [by_component[i] for i in range(len(by_component) - 1)]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    width = len(sums)

    def work(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((width, width))
        for vectors, weights in parts:
            shares = centred(vectors, n, sums)[0]
            product += (shares * weights[:, None]).T @ shares
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        values = [row.astype("<f8").tobytes() for row in product]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), pa.array(values)], names=["i", "part", "row"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.zeros(width)
        for row in table["row"].to_pylist():
            total += np.frombuffer(row, "<f8")
        return pa.table([table["i"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["i", "row"])

    parts = _per_task(rows, "i int, part int, row binary", work)
    found = {r["i"]: np.frombuffer(r["row"], "<f8") for r in parts.groupBy("i").applyInArrow(added, "i int, row binary").collect()}
    matrix = np.array([found[i] for i in range(width)]) / n
    return (matrix + matrix.T) / 2


def principal(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """The first eigenvalues (0 where they are within rounding of 0), their unit vectors as columns, and their shares of the trace."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:count].copy(), vectors[:, ::-1][:, :count]
    trace = float(np.trace(matrix))
    values[values <= len(matrix) * np.finfo(float).eps * max(values[0] if len(values) else 0, 0)] = 0
    sign = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0)) if vectors.size else 1
    return values, vectors * sign, [float(v) / trace if trace > 0 else None for v in values]


def _projected(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """digest, weight, deviation and z, the whitened components, for each different vector."""
    some = values > 0
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1)), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shares, deviations = centred(unpacked(batch.column(0)), n, sums)
            z = (shares @ vectors) * scale
            columns = [pa.array([v if ok else None for v, ok in zip(row, some, strict=True)] for row in z.tolist())]
            lists = columns[0].cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(deviations, pa.int64()), lists], names=["digest", "weight", "deviation", "z"])

    return rows.select("x", "digest", "weight").mapInArrow(run, "digest string, weight long, deviation long, z array<double>")


def identity_error(projected: DataFrame, components: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    if not components:
        return None
    z = {i: F.col("z")[i] for i in components}
    weight = F.col("weight").cast("double")
    means = projected.agg(*[(F.sum(weight * v) / F.sum(weight)).alias(f"m{i}") for i, v in z.items()]).first()
    entry = lambda i, j: F.sum(weight * (z[i] - F.lit(means[f"m{i}"])) * (z[j] - F.lit(means[f"m{j}"]))) / F.sum(weight)
    pairs = [(i, j) for i in components for j in components if i <= j]
    found = projected.agg(*[(entry(i, j) - F.lit(float(i == j))).alias(f"e{i}_{j}") for i, j in pairs]).first()
    return max(map(abs, found))


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", weight: Column | None = None, components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """A row for each remaining row of df and each component; weight is an expression on multiplicity, by default one."""
    rows = stage(whole_vectors(df, key, vector, scale).select("id", "x", F.sha2("x", 256).alias("digest")), "vectors")
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("multiplicity"))
    weight = (F.lit(1) if weight is None else weight).cast("long")
    distinct = stage(distinct.select("x", F.sha2("x", 256).alias("digest"), weight.alias("weight")), "distinct-vectors")
    n, sums = totals(distinct)
    if not n or not sums:
        values, vectors, shares = np.zeros(0), np.zeros((0, 0)), []
    else:
        values, vectors, shares = principal(covariance(distinct, n, sums), components)
    projected = stage(_projected(distinct, n, sums, values, vectors), "projected")
    error = identity_error(projected, np.flatnonzero(values > 0).tolist())
    each = projected.select(F.col("digest").alias("of"), "deviation", "z")
    joined = rows.select("id", "digest").join(each, F.col("digest") == F.col("of"))
    spread = joined.select(F.col("id").alias(key), "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>"), F.col("at"))
    return spread.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_multiplicity_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
