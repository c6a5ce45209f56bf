"""Broadcast only after measuring."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_SIDE_BYTES = 64 * 1024 * 1024
FEW_ROWS = 10_000


def measured_bytes(df: DataFrame) -> int:
    """Rows times fixed width, plus the bytes of all text and, for nested columns, of their text form."""
    plain = [F.col(f"`{n}`") for n, kind in df.dtypes if kind in ("string", "binary")]
    nested = [F.to_json(F.struct(f"`{n}`")) for n, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in plain + nested]
    text = F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), text.alias("text")).first()
    return facts["rows"] * 16 * len(df.columns) + facts["text"]


def by_merge(df: DataFrame) -> DataFrame:
    """Mark a table that grows with the input, so that no join sends it through the driver. Spark judges stored tables by the size of their
    files, and columns of keys take many times that in memory."""
    return df.hint("merge")


def small_side(df: DataFrame, max_bytes: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Mark a table for broadcast when it measures at most max_bytes, else for a merge."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else by_merge(df)


def few_rows(df: DataFrame, limit: int) -> DataFrame:
    """Mark a ranking of at most limit rows for broadcast if the limit itself is small."""
    return F.broadcast(df) if limit <= FEW_ROWS else df
