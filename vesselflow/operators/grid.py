"""0.1-degree effort grids as sparse cell tables.

A grid is a DataFrame of ``(keys..., row, col, value)``; an absent cell is a
missing value.  Nothing here materialises the dense 800 x 470 raster: every
operator is a projection or an aggregation over the cells that hold data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.functions import normalised_difference


@dataclass(frozen=True)
class GridSpec:
    """G1: extent and resolution (CRS is always EPSG:4326, G9)."""
    xmin: float = C.GRID_XMIN
    xmax: float = C.GRID_XMAX
    ymin: float = C.GRID_YMIN
    ymax: float = C.GRID_YMAX
    res: float = C.GRID_RES
    crs: str = C.CRS

    @property
    def ncol(self) -> int:
        return int(round((self.xmax - self.xmin) / self.res))

    @property
    def nrow(self) -> int:
        return int(round((self.ymax - self.ymin) / self.res))


DEFAULT_GRID = GridSpec()


def _d(x: float) -> Column:
    return F.lit(float(x))


def in_extent(lon: Column, lat: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    return lon.between(_d(g.xmin), _d(g.xmax)) & lat.between(_d(g.ymin), _d(g.ymax))


def cell_col(lon: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    """Column index; the right edge belongs to the last column."""
    return F.least(F.floor((lon - _d(g.xmin)) / _d(g.res)), F.lit(g.ncol - 1)).cast("int")


def cell_row(lat: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    """Row index from the top; the bottom edge belongs to the last row."""
    return F.least(F.floor((_d(g.ymax) - lat) / _d(g.res)), F.lit(g.nrow - 1)).cast("int")


def assign_cells(points: DataFrame, lon: str = "longitude", lat: str = "latitude",
                 g: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Points outside the extent are dropped; others get ``row``, ``col``."""
    x, y = F.col(lon), F.col(lat)
    return (points.where(in_extent(x, y, g))
                  .withColumn("row", cell_row(y, g)).withColumn("col", cell_col(x, g)))


_AGGS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "mean": F.avg}


def rasterize(points: DataFrame, value: str, keys: list | tuple = (), fun: str = "sum",
              lon: str = "longitude", lat: str = "latitude", g: GridSpec = DEFAULT_GRID,
              out: str = "value") -> DataFrame:
    """One value per (keys, cell) from the points that fall in it."""
    cells = assign_cells(points, lon, lat, g)
    return cells.groupBy(*keys, "row", "col").agg(_AGGS[fun](value).alias(out))


def cell_x(col: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    return _d(g.xmin) + (col.cast("double") + _d(0.5)) * _d(g.res)


def cell_y(row: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    return _d(g.ymax) - (row.cast("double") + _d(0.5)) * _d(g.res)


def to_points(cells: DataFrame, g: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Cell centres ``x``, ``y`` next to the cell value."""
    return cells.withColumn("x", cell_x(F.col("col"), g)).withColumn("y", cell_y(F.col("row"), g))


def meridian_step_km(g: GridSpec = DEFAULT_GRID) -> float:
    """North-south size of one cell at the equator on the WGS84 ellipsoid."""
    a, e2 = C.WGS84_A_KM, C.WGS84_E2
    return a * (1 - e2) * (g.res * DEG2RAD)


DEG2RAD = math.pi / 180.0


def cell_area_km2(row: Column, g: GridSpec = DEFAULT_GRID) -> Column:
    """Cell area by latitude: parallel arc at the cell centre times one
    north-south step (the step is the same for every row)."""
    phi = cell_y(row, g) * _d(DEG2RAD)
    a, e2 = _d(C.WGS84_A_KM), _d(C.WGS84_E2)
    dx = a * F.cos(phi) / F.sqrt(_d(1.0) - e2 * F.sin(phi) * F.sin(phi)) * _d(g.res * DEG2RAD)
    return dx * _d(meridian_step_km(g))


def used_area(cells: DataFrame, keys: list | tuple, g: GridSpec = DEFAULT_GRID,
              value: str = "value", out: str = "area") -> DataFrame:
    """Used area of a grid = number of cells with data x median cell area,
    rounded to 0.1 km2.  Cells per group are bounded by the grid (<= ncol x nrow),
    so the exact median is held per group safely."""
    c = cells.where(F.col(value).isNotNull()).withColumn("_ca", cell_area_km2(F.col("row"), g))
    return c.groupBy(*keys).agg(
        F.round(F.count(F.lit(1)) * F.percentile(F.col("_ca"), F.lit(0.5)), 1).alias(out))


def normalised_change(before: DataFrame, after: DataFrame, value: str = "value",
                      keys: list | tuple = ()) -> DataFrame:
    """(after - before) / (after + before) per cell, a missing cell counting 0.
    Cells where both are 0/missing (0/0) are dropped, as are cells with no change."""
    on = [*keys, "row", "col"]
    b = before.select(*on, F.col(value).alias("before"))
    a = after.select(*on, F.col(value).alias("after"))
    j = a.join(b, on, "full_outer")
    j = j.withColumn("before", F.coalesce("before", _d(0))).withColumn("after", F.coalesce("after", _d(0)))
    j = j.withColumn("nfi", normalised_difference(F.col("after"), F.col("before")))
    return (j.where(F.col("nfi").isNotNull() & ~F.isnan("nfi"))
             .withColumn("is_gain", F.col("nfi") > 0).withColumn("is_loss", F.col("nfi") < 0))


def normalised_change_periods(cells: DataFrame, period: str = "period", before: str = "before",
                              after: str = "after", value: str = "value", keys: list | tuple = ()) -> DataFrame:
    """G7/J8 on one long cell table holding both periods: the two values of a cell
    are put side by side by a conditional sum -- one aggregation on the cell key,
    no join -- then compared as in ``normalised_change``."""
    p, v = F.col(period), F.col(value)
    j = cells.groupBy(*keys, "row", "col").agg(
        F.coalesce(F.sum(F.when(p == after, v)), _d(0)).alias("after"),
        F.coalesce(F.sum(F.when(p == before, v)), _d(0)).alias("before"))
    j = j.withColumn("nfi", normalised_difference(F.col("after"), F.col("before")))
    return (j.where(F.col("nfi").isNotNull() & ~F.isnan("nfi"))
             .withColumn("is_gain", F.col("nfi") > 0).withColumn("is_loss", F.col("nfi") < 0))


def change_direction(cells: DataFrame, value: str = "nfi", out: str = "type") -> DataFrame:
    """Increase (>= 0) / Decrease, exact zero is 'same' and dropped."""
    v = F.col(value)
    t = F.when(v == 0, C.SAME).when(v >= 0, C.INCREASE).otherwise(C.DECREASE)
    return cells.withColumn(out, t).where(F.col(out) != C.SAME)


def file_area(points: DataFrame, value: str = "effort", key: str = "file_name", date: str = "date",
              lon: str = "longitude", lat: str = "latitude", g: GridSpec = DEFAULT_GRID,
              with_file: bool = False, by: list | tuple = ()) -> DataFrame:
    """P24 + G3 + G6 + E1 in one pass: per ``key`` (one raster per file; per file and
    fleet with ``by``) the used area, repeated on one row per date present in the file.

    Cells are summed per (file, cell); the few dates of a file travel along as a
    set of structs (a missing date is kept), so the dates need no second pass over
    the points and no join.  Points outside the extent make a null cell, which
    counts towards the dates only: a file whose points all fall outside keeps its
    rows with a missing area."""
    x, y = F.col(lon), F.col(lat)
    inside = in_extent(x, y, g)
    c = (points.withColumn("row", F.when(inside, cell_row(y, g)))
               .withColumn("col", F.when(inside, cell_col(x, g))))
    cells = c.groupBy(*by, key, "row", "col").agg(
        F.sum(value).alias("_v"), F.collect_set(F.struct(F.col(date).alias("d"))).alias("_dates"))
    ok = F.col("row").isNotNull() & F.col("_v").isNotNull()
    per_file = cells.groupBy(*by, key).agg(
        F.round(F.count(F.when(ok, 1)) * F.percentile(F.when(ok, cell_area_km2(F.col("row"), g)), F.lit(0.5)),
                1).alias("area"),
        F.array_distinct(F.flatten(F.collect_set("_dates"))).alias("_dates"))
    out = per_file.select(*by, key, F.explode("_dates").alias("_d"), "area")
    return out.select(*by, *([key] if with_file else []), F.col("_d.d").alias(date), "area")
