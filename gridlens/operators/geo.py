"""Geometry enrichment of the hourly summary and its checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators.joins import small_side


def enrich(hourly: DataFrame, lookup: DataFrame, strategy: str = "auto") -> DataFrame:
    """Left join on the cell. "auto" broadcasts the lookup after counting it; "merge" forces a sort-merge join."""
    if strategy == "merge":
        side = lookup.hint("merge")
    elif strategy == "auto":
        side = small_side(lookup)
    else:
        raise ValueError(f"unknown join strategy {strategy}")
    return hourly.join(side, "grid_id", "left")


def unmatched_grids(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    return hourly.select("grid_id").distinct().join(lookup.select("grid_id"), "grid_id", "left_anti")


def enrichment_coverage(hourly: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows before and after the join, cells, unmatched cells, coverage and repeated lookup keys.

    Everything follows from per-cell row counts, so the enriched table itself is not built.
    """
    cells = hourly.groupBy("grid_id").agg(F.count(F.lit(1)).alias("rows"))
    keys = lookup.groupBy("grid_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = cells.join(keys, "grid_id", "full_outer")
    present = F.col("rows").isNotNull()
    facts = joined.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("rows") * F.coalesce("copies", F.lit(1))), F.lit(0)).alias("rows_after"),
        F.count_if(present).alias("grids"),
        F.count_if(present & F.col("copies").isNull()).alias("unmatched_grids"),
        F.count_if(F.col("copies") > 1).alias("repeated_lookup_keys"),
    )
    matched = F.col("grids") - F.col("unmatched_grids")
    return facts.withColumns(
        {
            "coverage_percent": F.try_divide(matched * 100.0, F.col("grids")),
            "passed": (F.col("rows_before") == F.col("rows_after"))
            & (F.col("unmatched_grids") == 0)
            & (F.col("repeated_lookup_keys") == 0),
        }
    )


def centroids_in_box(lookup: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Cells, and how many have a centroid outside the box."""
    inside = F.col("centroid_lon").between(*lon) & F.col("centroid_lat").between(*lat)
    return lookup.agg(F.count(F.lit(1)).alias("cells"), F.count_if(~inside).alias("outside"))
