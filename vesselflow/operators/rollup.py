"""Effort rollups: per-file hour counts, monthly hours, per-position effort.

Per-file grain (T1): the analysed code runs every rollup inside one half-month
file and adds the results; ``file_name`` is therefore a grouping key of the first
aggregation and is dropped only in the second.  Every aggregation is built so the
partial (map-side) step shrinks the data before it is shuffled: a vessel or file
holding a third of the rows is reduced to at most one row per distinct key on
each mapper first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.functions import n_distinct, safe_date
from vesselflow.operators import geo, membership


def hauling(pings: DataFrame, state: str = "vessel_state", value: str = C.HAULING) -> DataFrame:
    """P7."""
    return pings.where(F.col(state) == value)


def with_hour(pings: DataFrame, ts: str = "date") -> DataFrame:
    """F8: clock hour of the ping (session time zone UTC)."""
    return pings.withColumn("hour", F.hour(ts))


def relabel_zone(df: DataFrame, zone: str = "zone", eez_name: str = "eez_name",
                 home_eez: str = C.HOME_EEZ_NAME) -> DataFrame:
    """P16/T2 with the analysed code's three-valued logic:
    open area inside the home EEZ -> 'EEZ'; open area outside every EEZ -> 'High seas';
    open area inside another named zone stays; a protected-area name always stays;
    a missing zone -> 'High seas'."""
    z, n = F.col(zone), F.col(eez_name)
    new = (F.when(z.isNull(), C.HIGH_SEAS)
            .when(z != C.OPEN_AREA, z)
            .when(n.isNull(), C.HIGH_SEAS)
            .when(n == home_eez, C.EEZ_LABEL)
            .otherwise(z))
    return df.withColumn(zone, new)


def clip_and_label(points: DataFrame, layers: dict, lon="longitude", lat="latitude") -> DataFrame:
    """J2 then J1: keep points inside the ocean layer, attach the EEZ name (left)."""
    inside = geo.join_zones(points, layers["ocean"], "inner", lon, lat,
                            rename={"pid": "_ocean_pid", "name": "ocean_area"})
    return geo.join_zones(inside, layers["eez"], "left", lon, lat,
                          rename={"pid": "_eez_pid", "name": "eez_name"}).drop("_ocean_pid", "_eez_pid")


def monthly_vessel_hours(modelled: DataFrame, layers: dict, min_year: int,
                         with_file: bool = False) -> DataFrame:
    """Q4: hours of fishing per file, year, month, vessel and zone.

    Hours are distinct (day, hour) pairs per vessel and zone within a file (T20);
    a vessel in two zones in one hour counts in both.  Output grain is the file:
    the same (year, month, vessel, zone) appears once per half-month file."""
    p = with_hour(hauling(modelled)).select(
        "file_name", "year", "month", "day", "hour", "vessel_name", "zone", "longitude", "latitude")
    labelled = relabel_zone(clip_and_label(p, layers))
    # count of distinct (day, hour): one shuffle on the group keys, with the distinct
    # pairs already collapsed map-side; the struct keeps a missing hour countable.
    hours = (labelled.groupBy("file_name", "year", "month", "vessel_name", "zone")
                     .agg(F.count_distinct(F.struct("day", "hour")).alias("hrs"))
                     .where(F.col("year") > min_year))
    cols = ["year", "month", "vessel_name", "zone", "hrs"]
    return hours.select(*(["file_name"] + cols if with_file else cols))


def position_hours(pings: DataFrame, keys: list) -> DataFrame:
    """A6 + A2: distinct hour-position-vessel pings (T3), counted per ``keys`` +
    position + vessel.  Returns ``keys, longitude, latitude, vessel_name, h, max_day``."""
    p = with_hour(pings)
    return p.groupBy(*keys, "longitude", "latitude", "vessel_name").agg(
        F.count_distinct(F.struct("day", "hour")).alias("h"), F.max("day").alias("max_day"))


def file_dates(per_vessel: DataFrame) -> DataFrame:
    """Each row's date is its year and month with the *file's* last day; an
    impossible date (a file spanning two months, Feb 31) is missing (T4).  The
    file-wide max is a small per-file aggregate joined back, not a window, so a
    hot file is never one task."""
    fmax = per_vessel.groupBy("file_name").agg(F.max("max_day").alias("_fmax"))
    fmax = fmax.withColumnRenamed("file_name", "_file")
    j = per_vessel.join(fmax, per_vessel["file_name"].eqNullSafe(fmax["_file"])).drop("_file")      # a missing file name keeps its rows
    return j.withColumn("date", safe_date(F.col("year"), F.col("month"), F.col("_fmax"))).drop("_fmax")


def last_days(pings: DataFrame, keys: list) -> DataFrame:
    """The last day of the pings of each ``keys`` (a file, or a file and fleet) as ``_last``: a narrow pass
    reduced on the mappers, written once."""
    return membership.materialize(pings.groupBy(*keys).agg(F.max("day").alias("_last")))


def with_last_day(pings: DataFrame, days: DataFrame, keys: list) -> DataFrame:
    """Each ping with its file's ``_last`` day; pings whose keys are not in ``days`` go.  ``days`` is broadcast
    behind a check of its size, so the pings are not shuffled; a missing file name or fleet matches itself."""
    d = membership.bounded(days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_last"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & pings[k].eqNullSafe(d[f"_k{i}"])
    return pings.join(d, same).drop(*[f"_k{i}" for i in range(len(keys))])


def position_effort(per_vessel: DataFrame, keys: list) -> DataFrame:
    """A8 first level: per ``keys`` + position: hours and distinct vessels (NA counted)."""
    return per_vessel.groupBy(*keys, "longitude", "latitude").agg(
        F.sum("h").alias("hrs"), n_distinct("vessel_name").alias("vessels"))


def regroup_rounded(df: DataFrame, keys: list, hrs_scale: float = 1.0) -> DataFrame:
    """F10 + A8 second level + A9: positions rounded to 5 decimals, hours (optionally
    scaled) and vessel counts summed, effort = hours / vessels."""
    r = df.withColumn("longitude", F.round("longitude", 5)).withColumn("latitude", F.round("latitude", 5))
    hrs = F.sum(F.col("hrs") / F.lit(float(hrs_scale))) if hrs_scale != 1.0 else F.sum("hrs")
    g = r.groupBy(*keys, "longitude", "latitude").agg(hrs.alias("hrs"), F.sum("vessels").alias("vessels"))
    return g.withColumn("effort", F.try_divide(F.col("hrs"), F.col("vessels")))
