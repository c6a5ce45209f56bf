"""Tables cut into zones by two columns at once, so that a filter on either one opens a small share of the files.

Each column is cut at quantiles into 2 ** bits ranges of about equal size. A zone takes the bits of both range numbers in turn (Z-order), so zones that are
near in number are near in both columns. Zones are folders; their files are sorted and carry Bloom filters of the first column. The bounds
are a table beside them, 2 ** (bits + 1) numbers: a reader turns a value or a range of either column into the zones that can hold it, which
the scan takes as a constant filter on folders. NULL lies in the first range.
"""

from bisect import bisect_right
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import schema as S

ZONE = "zone"


def _number(column: str, kind: str) -> Column:
    return F.unix_micros(column).cast("double") if kind == "timestamp" else F.col(column).cast("double")


def _as_number(value) -> float:
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp() * 1e6
    return float(value)


def interleaved(first: Column, second: Column, bits: int) -> Column:
    """The bits of two numbers in turn, those of the second above those of the first."""
    zone = F.lit(0)
    for bit in range(bits):
        low, high = (F.shiftright(n, bit).bitwiseAND(F.lit(1)) for n in (first, second))
        zone = zone + F.shiftleft(low, 2 * bit) + F.shiftleft(high, 2 * bit + 1)
    return zone.cast("int")


def zones_of(first: range, second: range, bits: int) -> list[int]:
    """The zones of all pairs of range numbers."""
    spread = lambda n: sum((n >> bit & 1) << 2 * bit for bit in range(bits))
    return sorted(spread(a) + 2 * spread(b) for a in first for b in second)


def write_zones(df: DataFrame, path: str, columns: tuple[str, str] = tuple(S.CELL_HOUR), bits: int = 4, accuracy: int = 10_000) -> None:
    """bits: 2 ** (2 * bits) zones; choose it so that a zone holds a few files of a good size."""
    kinds = dict(df.dtypes)
    shares = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    found = df.agg(*[F.percentile_approx(_number(c, kinds[c]), shares, accuracy).alias(c) for c in columns]).first()
    bounds = {c: [float(b) for b in found[c] or [0.0] * (2**bits - 1)] for c in columns}
    below = lambda c: F.filter(F.array(*map(F.lit, bounds[c])), lambda bound: bound <= _number(c, kinds[c]))
    at = [F.size(below(c)) for c in columns]
    zoned = df.withColumn(ZONE, interleaved(*at, bits))
    spread = zoned.repartitionByRange(ZONE, *columns).sortWithinPartitions(ZONE, *columns)
    bloom = f"parquet.bloom.filter.enabled#{columns[0]}"
    spread.write.mode("overwrite").partitionBy(ZONE).option(bloom, "true").parquet(f"{path}/rows")
    listed = [(i, c, bounds[c]) for i, c in enumerate(columns)]
    df.sparkSession.createDataFrame(listed, "nth int, name string, bounds array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def read_zones(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Rows of a table in zones; wanted holds for either column a value, or a pair of first and last value."""
    bounds = {r["name"]: list(r["bounds"]) for r in spark.read.parquet(f"{path}/bounds").orderBy("nth").collect()}
    unknown = set(wanted) - set(bounds)
    if unknown:
        raise ValueError(f"zones are by {list(bounds)}, not by {sorted(unknown)}")
    rows = spark.read.parquet(f"{path}/rows")
    ranges = []
    for name, cuts in bounds.items():
        if name not in wanted:
            ranges.append(range(len(cuts) + 1))
            continue
        first, last = wanted[name] if isinstance(wanted[name], tuple) else (wanted[name],) * 2
        ranges.append(range(bisect_right(cuts, _as_number(first)), bisect_right(cuts, _as_number(last)) + 1))
        rows = rows.where(F.col(name).between(F.lit(first), F.lit(last)) if first != last else F.col(name) == F.lit(first))
    if wanted:
        bits = (len(next(iter(bounds.values()))) + 1).bit_length() - 1
        rows = rows.where(F.col(ZONE).isin(zones_of(*ranges, bits)))
    return rows.drop(ZONE)
