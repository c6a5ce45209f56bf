"""Rule alerts per daily file: high activity, activity drop, activity spike."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.joins import small_side
from gridlens.operators.order_stats import leave_one_out_median, quantiles
from gridlens.operators.windows import previous_hour_activity


def activity_floor(hourly: DataFrame, scope: str = "date", percentile: float = S.FLOOR_PERCENTILE) -> DataFrame:
    """Per daily file the activity below which ratios are not meaningful. One row per file, so the calendar
    bounds the result."""
    return quantiles(hourly, "total_activity", [percentile], [scope]).select(
        scope, F.col("quantile").alias("activity_floor")
    )


def within_day_baseline(hourly: DataFrame, scope: str = "date") -> DataFrame:
    """Median of a cell's other hours in the same file. The unique (cell, timestamp) key bounds such a bucket by
    the distinct timestamps of a day, so it needs no splitting. A baseline that equals the floor is not below it, so both are exact."""
    return leave_one_out_median(hourly, [scope, "grid_id"], max_group_rows=None, exact=True)


def rule_conditions(
    high: float = S.HIGH_MULTIPLIER, drop: float = S.DROP_FRACTION, spike: float = S.SPIKE_MULTIPLIER
) -> dict[str, Column]:
    """The rules in listing order; more than one may hold for a row."""
    current, floor = F.col("total_activity"), F.col("activity_floor")
    baseline, previous = F.col("baseline_activity"), F.col("prev_hour_activity")
    return {
        "HIGH_ACTIVITY": (baseline >= floor) & (current > baseline * high),
        "ACTIVITY_DROP": (baseline >= floor) & (current < baseline * drop),
        "ACTIVITY_SPIKE": (previous >= floor) & (current > previous * spike),
    }


def fired_rules(judged: DataFrame) -> DataFrame:
    """A row for each rule that fires, with alert_type and compared_activity; judged has the columns that the rules name."""
    rules = rule_conditions()
    names = F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules.items()]))
    fired = judged.where(reduce(or_, rules.values())).select("*", F.explode(names).alias("alert_type"))
    compared = F.when(F.col("alert_type") == "ACTIVITY_SPIKE", F.col("prev_hour_activity")).otherwise(F.col("baseline_activity"))
    return fired.withColumn("compared_activity", compared)


# --- fixed values: reason texts ---
def alert_reason(kind: Column, current: Column, compared: Column) -> Column:
    texts = {
        "HIGH_ACTIVITY": f"more than {S.HIGH_MULTIPLIER}x this grid's within-day baseline of",
        "ACTIVITY_DROP": f"below {S.DROP_FRACTION}x this grid's within-day baseline of",
        "ACTIVITY_SPIKE": f"more than {S.SPIKE_MULTIPLIER}x the immediately preceding hour's",
    }
    text = F.create_map(*[F.lit(part) for pair in texts.items() for part in pair])[kind]
    shown = C.number_text(current, 2), C.number_text(compared, 2)
    return F.concat(kind, F.lit(": current activity "), shown[0], F.lit(" is "), text, F.lit(" "), shown[1])


def network_alerts(hourly: DataFrame, scope: str = "date") -> DataFrame:
    """One row per fired rule. Floor, baseline and previous hour are taken within each daily file.

    Baseline and previous hour share one shuffle by file and cell. The floors are broadcast: one row per date is
    bounded by the calendar, one per any other scope is measured first.
    """
    rows = hourly.select(*dict.fromkeys(["grid_id", "timestamp", "hour", scope, "total_activity"]))
    prepared = within_day_baseline(previous_hour_activity(rows, scope), scope)
    floors = activity_floor(rows, scope)
    judged = prepared.join(F.broadcast(floors) if scope == "date" else small_side(floors), scope)
    kind, current, compared = F.col("alert_type"), F.col("total_activity"), F.col("compared_activity")
    return fired_rules(judged).select(
        "grid_id",
        "timestamp",
        "alert_type",
        F.round(current, 4).alias("current_activity"),
        F.round(compared, 4).alias("baseline_activity"),
        alert_reason(kind, current, compared).alias("reason"),
        F.col(scope).alias("source_file"),
    )


def with_severity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("severity", C.severity(F.trim("alert_type")))
