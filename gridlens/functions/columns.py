"""Column expressions used by several operators. All are built-in, codegen-friendly expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens import schema as S


def negative_measure(columns: list[str]) -> Column:
    """True when any non-null measure is below zero; never NULL."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.col(name) < 0, F.lit(False))
    return found


def non_finite_measure(columns: list[str]) -> Column:
    """True when any measure is NaN or infinite; never NULL."""
    found = F.lit(False)
    for name in columns:
        value = F.col(name).cast("double")
        found = found | F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    return found


def missing_key(columns: list[str]) -> Column:
    missing = F.lit(False)
    for name in columns:
        missing = missing | F.col(name).isNull()
    return missing


def total_sms() -> Column:
    return F.col("sms_in") + F.col("sms_out")


def total_calls() -> Column:
    return F.col("call_in") + F.col("call_out")


def total_activity() -> Column:
    return total_sms() + total_calls() + F.col("internet_activity")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is above zero, else 0."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(F.lit(0.0))


def severity(alert_type: Column) -> Column:
    chain = None
    for name, level in S.SEVERITY.items():
        chain = F.when(alert_type == name, level) if chain is None else chain.when(alert_type == name, level)
    return chain.otherwise("MEDIUM")


def severity_rank(level: Column) -> Column:
    chain = None
    for name, rank in S.SEVERITY_RANK.items():
        chain = F.when(level == name, rank) if chain is None else chain.when(level == name, rank)
    return chain.otherwise(0)


def risk_level(score: Column) -> Column:
    return F.when(score >= S.RISK_HIGH, "HIGH").when(score >= S.RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def anomaly_direction(score: Column, baseline: Column) -> Column:
    return (
        F.when(baseline.isNull(), "NO_BASELINE")
        .when(score >= S.ANOMALY_CUT, "HIGH")
        .when(score <= -S.ANOMALY_CUT, "LOW")
        .otherwise("NORMAL")
    )


def number_text(value: Column, digits: int) -> Column:
    """A number as text, rounded half up on its decimal form, whatever the last places of the double are."""
    shown = F.round(value.try_cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(shown, value.cast("string"))


# --- fixed values: reason texts ---
def anomaly_reason(score: Column, baseline: Column, grid: Column, hour: Column) -> Column:
    # put together without a format, which Spark reads anew for every row
    moved = F.concat(
        F.lit("Activity is "),
        number_text(F.abs(score) * 100, 2),
        F.when(score > 0, "% above").otherwise("% below"),
        F.lit(" the historical median for grid "),
        F.coalesce(grid.cast("long").cast("string"), F.lit("null")),
        F.lit(" at hour "),
        F.coalesce(F.lpad(hour.cast("int").cast("string"), 2, "0"), F.lit("null")),
        F.lit(":00"),
    )
    return (
        F.when(baseline.isNull(), "No historical baseline available for this grid and hour")
        .when(baseline <= 0, "Historical baseline is zero or negative")
        .when(score != 0, moved)
        .otherwise("Activity matches the historical baseline")
    )


def value_slice(value: Column) -> Column:
    """A whole number that grows with the value, fine enough to spread one large group over many tasks.

    Neighbouring slices differ by about 0.8 % of the value. There are fewer than 200,000 slices over the
    whole double range, so a table of slice sizes is always small. Infinities have slices of their own, and NaN
    the last one, as in a sort.
    """
    finite = F.floor(F.signum(value) * F.log1p(F.abs(value)) * 128)
    number = value.cast("double")
    return (
        F.when(F.isnan(number), 1_000_001)
        .when(number == float("inf"), 1_000_000)
        .when(number == float("-inf"), -1_000_000)
        .otherwise(finite)
        .cast("long")
    )
