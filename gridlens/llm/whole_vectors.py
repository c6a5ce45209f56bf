"""Vectors turned into whole numbers, and their compact form as bytes.

A component c becomes floor(scale * c) of the double c; what lies outside a long becomes the nearest long.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.session import prepare, stage

SCALE = 256
#: Rows in a batch that goes to a Python task.
BATCH_ROWS = 4_000
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        floors = np.floor(values.astype(np.float64) * scale)
    inside = (floors >= -(2.0**63)) & (floors < 2.0**63)
    return np.where(inside, np.where(inside, floors, 0).astype(np.int64), np.where(floors > 0, MOST, LEAST))


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as its item size and its items, little-endian, in the smallest size that holds them: equal rows are equal bytes."""
    if not rows.size:
        return [b"\x01"] * len(rows)
    low, high = rows.min(axis=1), rows.max(axis=1)
    sizes = np.full(len(rows), 8)
    for size in (4, 2, 1):
        limit = 1 << (8 * size - 1)
        sizes[(low >= -limit) & (high < limit)] = size
    out: list[bytes] = [b""] * len(rows)
    for size in (1, 2, 4, 8):
        for at, row in zip(np.flatnonzero(sizes == size).tolist(), rows[sizes == size].astype(f"<i{size}"), strict=True):
            out[at] = bytes((size,)) + row.tobytes()
    return out


def unpacked(column: pa.Array) -> np.ndarray:
    """The rows of packed vectors of one width, as longs."""
    values = column.to_pylist()
    if not values:
        return np.zeros((0, 0), np.int64)
    out = np.empty((len(values), (len(values[0]) - 1) // values[0][0]), np.int64)
    sizes = np.array([v[0] for v in values])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(values[i][1:] for i in at.tolist()), f"<i{size}").reshape(len(at), -1)
    return out


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id (long) and x (packed), written, for every row whose vector has finite components only.

    Vectors of another length than most take no part; of two lengths equally frequent the greater one counts.
    """
    prepare(df.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    values = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), values.alias("v")).where(F.col("v").isNotNull() & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(widths)]
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                found = scaled(flat[starts[at][:, None] + np.arange(width)], scale)
                columns = [batch.column(0).take(pa.array(at)), pa.array(packed(found), pa.binary()), pa.array(np.full(len(at), width, np.int32))]
                yield pa.record_batch(columns, names=["id", "x", "width"])

    found = stage(rows.mapInArrow(run, "id long, x binary, width int"), "whole-vectors")
    common = found.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    return found.where(F.col("width") == (common["width"] if common else 0)).select("id", "x")
