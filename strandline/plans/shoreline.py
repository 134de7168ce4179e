"""Positional error of a predicted coastline along transects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import spatial

# Transects at the river mouth; lower bounds of the regions, from the west.
RIVER_TRANSECTS = [17332, 17333, 17334, 17335, 17336]
BASELINE = 117
REGIONS = ((17443, "western coastline"), (17394, "northern cliff"), (17370, "central shoreline"),
           (17337, "town shoreline"), (None, "east shoreline and cliff"))


def without_river(transects: DataFrame, order: str = "transect_id", river: list[int] | None = None) -> DataFrame:
    return transects.where(~F.col(order).isin(RIVER_TRANSECTS if river is None else river))


def region_of(order: Column | str, regions=REGIONS) -> Column:
    """Region of a transect by its order number."""
    order = F.col(order) if isinstance(order, str) else order
    result = None
    for low, name in regions:
        if low is None:
            return F.lit(name) if result is None else result.otherwise(name)
        result = F.when(order >= low, name) if result is None else result.when(order >= low, name)
    return result


def coastline_error(
    transects: DataFrame, true_lines: DataFrame, predicted: DataFrame, cell: float, regions=REGIONS, river: list[int] | None = None
) -> DataFrame:
    """RMSE by region and overall (region NULL); transects (transect_id, x0, y0, x1, y1), lines as segments."""
    kept = without_river(transects, river=river)
    distances = spatial.paired_distances(kept, true_lines, predicted, cell)
    return spatial.rmse(distances.withColumn("region", region_of("transect_id", regions)), "region")
