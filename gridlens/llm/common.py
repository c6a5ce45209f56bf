"""Reading documents and handing texts to Python tasks in small batches."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlens.session import prepare

#: A word is a run of anything but these six characters.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in a batch that goes to a Python task, and bytes in a batch that comes back.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Long texts make a batch of the default 10,000 rows too large for a Python task."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def to_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of limited size; every variable-length value counts with its length."""
    columns: list[list] = [[] for _ in schema]
    size = 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
            size += 8 + (len(value) if isinstance(value, (bytes, str, list)) else 0)
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, size = [[] for _ in schema], 0
    if columns and columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
