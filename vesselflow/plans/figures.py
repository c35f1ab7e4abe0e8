"""The analysis end to end (Q4-Q16): each function is one figure's or one result
table's plan, composed from the operators.  Inputs are domain DataFrames, so the
same plans run on the study's files or on the adapters' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.constants import Study
from vesselflow.functions import (detects, month_start, n_distinct, period_label, ratio, safe_date, split_first,
                                  strict_sum, trim_ws)
from vesselflow.operators import grid, membership, order, rollup
from vesselflow.operators import series as series_ops


# --- Q5: name lists ---------------------------------------------------------------------------

def permit_list(permits: DataFrame, normalise: bool = False) -> DataFrame:
    return membership.name_list(permits, normalise=normalise)


def vessel_list(hours: DataFrame) -> DataFrame:
    return membership.name_list(hours)


def active_fleet(hours: DataFrame, min_year: int | None = None, pattern: str = C.MPA_PATTERN) -> DataFrame:
    """Vessels ever seen fishing in the protected area (P8, P12 per T14, A13)."""
    h = hours.where(detects("zone", pattern))
    if min_year is not None:
        h = h.where(F.col("year") > min_year)
    return membership.name_list(h)


def name_lists(hours: DataFrame, permits: DataFrame, study: Study) -> DataFrame:
    """Q5: the three lists stacked as (list, vessel_name)."""
    return (permit_list(permits).withColumn("list", F.lit("permits"))
            .unionByName(vessel_list(hours).withColumn("list", F.lit("vessels")))
            .unionByName(active_fleet(hours, study.fleet_min_year).withColumn("list", F.lit("active"))))


# --- Q6: effort inside the protected area ------------------------------------------------------

def mpa_monthly_effort(hours: DataFrame, study: Study, unit_hours: float | None = None,
                       pattern: str = C.MPA_PATTERN) -> DataFrame:
    """Q6 (Fig 1A): vessel-months inside the area, then months: vessels (NA
    counted), hours / unit, effort = hours per vessel, month date, period."""
    unit = study.unit_hours_fig if unit_hours is None else unit_hours
    vm = (hours.where(detects("zone", pattern))
               .groupBy("year", "month", "vessel_name").agg(F.sum("hrs").alias("hrs")))
    m = vm.groupBy("year", "month").agg(
        n_distinct("vessel_name").alias("vessel"),
        F.sum(F.col("hrs") / F.lit(float(unit))).alias("hrs"))
    m = m.withColumn("effort", ratio(F.col("hrs"), F.col("vessel")))
    m = m.withColumn("date", month_start("year", "month"))
    return m.withColumn("period", period_label(F.col("date"), study.cut_date))


# --- Q7: catch per unit effort -----------------------------------------------------------------

def clean_landings(landings: DataFrame) -> DataFrame:
    """F1 + F3: the first-name part before '(' with surrounding whitespace removed."""
    first, _ = split_first(F.col("vessel_name"))
    return landings.select("date", trim_ws(first).alias("vessel_name"), "catch", "days_declared")


def monthly_cpue(landings: DataFrame, permits: DataFrame, active: DataFrame, study: Study,
                 from_date: str | None = None, ieee: bool = False) -> DataFrame:
    """Q7 (Fig 1B): permitted vessels' landings labelled by fleet, mean of
    catch/days in tonnes per year, month and fleet.  A zero-day declaration has
    no defined ratio (T10): by default it is left out of the mean and counted in
    ``zero_days``; ``ieee=True`` propagates Infinity/NaN instead.  A missing catch or
    number of days makes its month missing either way (T9)."""
    from vesselflow.functions import ieee_ratio
    x = clean_landings(landings)
    x = membership.keep_in(x, permits)
    x = membership.flag_in(x, active, out="revi")
    if from_date:
        x = x.where(F.col("date") >= F.to_date(F.lit(from_date)))
    x = x.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    r = ieee_ratio("catch", "days_declared") if ieee else ratio("catch", "days_declared")
    m = x.groupBy("year", "month", "revi").agg(
        F.when(F.count("catch") + F.count("days_declared") == 2 * F.count(F.lit(1)), F.avg(r / F.lit(1000.0))).alias("cpue"),
        F.sum(F.when(F.col("days_declared") == 0, 1).otherwise(0)).alias("zero_days"),
        F.count(F.lit(1)).alias("n_landings"))
    m = m.withColumn("date", month_start("year", "month"))
    return m.withColumn("period", period_label(F.col("date"), study.cut_date))


# --- file positions (P22) ---------------------------------------------------------------------

def file_positions(pings: DataFrame) -> DataFrame:
    """The sorted distinct file list with 1-based positions (O2), computed once
    (checkpointed) and shared by every slice taken from it."""
    return order.positions(pings, "file_name", "_pos")


def in_slice(pos, first: int, last: int | None):
    """Position within first..last; ``last`` None is an open end, so later files join the slice."""
    return (pos >= first) if last is None else pos.between(first, last)


def slice_rows(first: int, last: int | None) -> int | None:
    """Rows of a slice by construction, or None (counted before a broadcast) when its end is open."""
    return None if last is None else last - first + 1


def file_slice(pings: DataFrame, first: int, last: int | None, positions: DataFrame | None = None) -> DataFrame:
    """Names of the files at 1-based positions first..last of the sorted distinct
    file list."""
    ranked = positions if positions is not None else file_positions(pings)
    return ranked.where(in_slice(F.col("_pos"), first, last)).select("file_name")


def in_files(pings: DataFrame, files: DataFrame | None, max_files: int | None = None) -> DataFrame:
    if files is None:
        return pings
    return membership.keep_in(pings, files, col="file_name", known_rows=max_files)


# --- Q8-Q11: used area per half month -----------------------------------------------------------

def fleet_pings(modelled: DataFrame, fleet: DataFrame, exclude: DataFrame | None = None,
                files: DataFrame | None = None, max_files: int | None = None) -> DataFrame:
    p = rollup.hauling(modelled)
    p = in_files(p, files, max_files)
    p = membership.keep_in(p, fleet)
    if exclude is not None:
        p = membership.drop_in(p, exclude)
    return p


def half_month_effort(fleet_p: DataFrame, layers: dict, days: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """Q8/Q9 up to the grid: per file, hour-position dedup, file-wide date, hours and
    distinct vessels per position, clip to the ocean, EEZ attach (multiplies
    overlaps), 5-decimal regroup and effort per position.  ``by`` names further keys of a
    raster (the fleet); ``days`` holds the last day of each raster's pings (computed when absent).
    Returns ``by, file_name, date, longitude, latitude, hrs, vessels, effort``."""
    raster = [*by, "file_name"]
    days = rollup.last_days(fleet_p, raster) if days is None else days
    pv = rollup.position_hours(rollup.with_last_day(fleet_p, days, raster), [*raster, "year", "month", "_last"])
    pv = pv.withColumn("date", safe_date(F.col("year"), F.col("month"), F.col("_last")))     # impossible dates are missing (T4)
    return effort_of_positions(pv, layers, raster)


def effort_of_positions(per_vessel: DataFrame, layers: dict, raster: list) -> DataFrame:
    """Hours ``h`` per raster, date, position and vessel -> effort per raster, date and rounded position inside the ocean."""
    pe = rollup.position_effort(per_vessel, [*raster, "date"])
    clipped = rollup.clip_and_label(pe, layers).drop("ocean_area", "eez_name")
    return rollup.regroup_rounded(clipped, [*raster, "date"])


def half_month_area(fleet_p: DataFrame, layers: dict, g: grid.GridSpec = grid.DEFAULT_GRID,
                    with_file: bool = False) -> DataFrame:
    """Q8/Q9: effort per position summed per 0.1 cell, used area per file (count x
    median cell area), one row per date of the file."""
    return grid.file_area(half_month_effort(fleet_p, layers), g=g, with_file=with_file)


def both_fleets(permits: DataFrame, active: DataFrame) -> DataFrame:
    """(name, revi): the active vessels, and the permitted ones that are not active; no name is in both."""
    name = [F.col(active.columns[0]).alias("vessel_name")]
    yes = active.select(*name).distinct()
    no = membership.difference(permits.select(F.col(permits.columns[0]).alias("vessel_name")), yes)
    return membership.materialize(yes.withColumn("revi", F.lit(C.FLEET_YES)).unionByName(no.withColumn("revi", F.lit(C.FLEET_NO))))


def both_fleets_effort(modelled: DataFrame, layers: dict, permits: DataFrame, active: DataFrame, study: Study) -> DataFrame:
    """``half_month_effort`` of both fleets in one pass, with ``revi`` yes/no as a further key.

    A first narrow pass finds every file and, per fleet, the last day of its pings in it (one row per file and fleet);
    the slice of files of the non-active fleet is cut there.  The second pass reads the pings once and meets
    both small tables by broadcast."""
    names = membership.bounded(both_fleets(permits, active).withColumnRenamed("vessel_name", "_name"))
    same = modelled["vessel_name"].eqNullSafe(names["_name"])
    fishing = F.col("vessel_state") == C.HAULING
    seen = membership.materialize(
        modelled.join(names, same, "left").groupBy("file_name", "revi")
        .agg(F.max(F.when(fishing, F.col("day"))).alias("_last"), F.count(F.when(fishing, 1)).alias("_n")))
    days = seen.where("_n > 0 and revi is not null").select("revi", "file_name", "_last")
    if study.other_fleet_files:
        files = file_slice(seen, *study.other_fleet_files, positions=order.positions(seen, "file_name", "_pos", materialize=False))
        no = in_files(days.where(F.col("revi") == C.FLEET_NO), files, slice_rows(*study.other_fleet_files))
        days = membership.materialize(days.where(F.col("revi") == C.FLEET_YES).unionByName(no))
    pings = rollup.hauling(modelled).join(names, same).drop("_name")
    return half_month_effort(pings, layers, days, by=("revi",))


def area_results(modelled: DataFrame, layers: dict, permits: DataFrame, active: DataFrame,
                 study: Study, g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Q8 + Q9 + Q10: both fleets' half-month areas in one table, ``revi`` yes/no."""
    effort = both_fleets_effort(modelled, layers, permits, active, study)
    return grid.file_area(effort, g=g, by=("revi",)).select("date", "area", "revi")


def file_manifest(files: DataFrame, modelled: DataFrame, layers: dict, permits: DataFrame, active: DataFrame, study: Study,
                  g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """A row for every listed file and fleet, whatever became of the file: its pings, hauling pings and the fleet's of these, the used
    area (missing if there is none) and the reason.

    ``files`` (file_name) comes from the listing, so a file without a single row is there too (``empty``).  The other reasons name the
    first filter that left nothing: ``no hauling``, ``other fleet``, ``outside slice`` (of the files of the non-active fleet), ``no used
    cell`` (off the ocean or the grid); else ``used``."""
    names = membership.bounded(both_fleets(permits, active).withColumnRenamed("vessel_name", "_name"))
    fishing = F.col("vessel_state") == C.HAULING
    of = lambda fleet: F.count(F.when(fishing & (F.col("revi") == fleet), 1))
    seen = (modelled.join(names, modelled["vessel_name"].eqNullSafe(names["_name"]), "left").groupBy("file_name")
            .agg(F.count(F.lit(1)).alias("n_pings"), F.count(F.when(fishing, 1)).alias("n_hauling"), of(C.FLEET_YES).alias("_y"), of(C.FLEET_NO).alias("_n")))
    seen = membership.materialize(seen)
    pos = order.positions(seen, "file_name", "_pos", materialize=False)
    cut = in_slice(F.col("_pos"), *study.other_fleet_files) if study.other_fleet_files else F.lit(True)
    sliced = seen.join(pos.select(F.col("file_name").alias("_f"), cut.alias("_cut")), seen["file_name"].eqNullSafe(F.col("_f")), "left").drop("_f")
    fleets = F.array(F.struct(F.lit(C.FLEET_YES).alias("revi"), F.col("_y").alias("n_fleet"), F.lit(True).alias("_cut")),
                     F.struct(F.lit(C.FLEET_NO).alias("revi"), F.col("_n").alias("n_fleet"), F.coalesce("_cut", F.lit(True)).alias("_cut")))
    listed = files.select(F.col("file_name").alias("_file")).distinct()
    rows = (listed.join(sliced, F.col("_file").eqNullSafe(F.col("file_name")), "left").withColumn("_x", F.explode(fleets))
            .select(F.col("_file").alias("file_name"), "_x.revi", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pings", "n_hauling")],
                    F.coalesce("_x.n_fleet", F.lit(0)).alias("n_fleet"), "_x._cut"))
    areas = grid.file_area(both_fleets_effort(modelled, layers, permits, active, study), g=g, with_file=True, by=("revi",))
    areas = areas.groupBy(F.col("revi").alias("_r"), F.col("file_name").alias("_f")).agg(F.max("area").alias("area"))
    reason = (F.when(F.col("area").isNotNull(), "used").when(F.col("n_pings") == 0, "empty").when(F.col("n_hauling") == 0, "no hauling")
              .when(F.col("n_fleet") == 0, "other fleet").when(~F.col("_cut"), "outside slice").otherwise("no used cell"))
    return (rows.join(areas, (F.col("revi") == F.col("_r")) & F.col("file_name").eqNullSafe(F.col("_f")), "left")
            .select("file_name", "revi", "n_pings", "n_hauling", "n_fleet", "area", reason.alias("reason")))


def recode_fleet(df: DataFrame, col: str = "revi") -> DataFrame:
    """factor(levels = c('no','yes'), labels = c('No','Yes')); other values missing."""
    m = F.create_map(*[F.lit(x) for kv in C.FLEET_LABELS.items() for x in kv])
    return df.withColumn(col, F.try_element_at(m, F.col(col)))


_STUDY_DEFAULT = object()


def monthly_area(areas: DataFrame, study: Study, outlier=_STUDY_DEFAULT,
                 recode: bool = True) -> DataFrame:
    """Q11 (Fig 1C): area in 10^3 km2 per month and fleet.  One missing half-month
    makes the month missing (T9); missing months fail the outlier filter like in
    the analysed code.  ``outlier`` defaults to the study's limit; ``None`` keeps
    every month (the impact series, Q20/Q21)."""
    a = recode_fleet(areas) if recode else areas
    a = a.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    m = a.groupBy("year", "month", "revi").agg((strict_sum("area") / F.lit(1000.0)).alias("area"))
    lim = study.area_outlier if outlier is _STUDY_DEFAULT else outlier
    if lim is not None:
        m = m.where(F.col("area") < F.lit(float(lim)))
    m = m.withColumn("date", month_start("year", "month"))
    return m.withColumn("period", period_label(F.col("date"), study.cut_date))


# --- Q12-Q16: before/after grids and the normalised change ---------------------------------------

def _cells(pings: DataFrame, layers: dict, keys: list, keep=None, hrs_scale: float = 24.0,
           g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Shared body of the before/after grids: per file hour-position dedup, optional
    row filter ``keep`` on (keys, year) (T24), hours and distinct vessels per position
    and file, ocean clip + EEZ attach, 5-decimal regroup over all files with hours in
    days, effort per position, summed per cell.  Returns (keys, row, col, value)."""
    pv = rollup.position_hours(pings, [*keys, "file_name", "year", "month"])
    if keep is not None:
        pv = pv.where(keep)
    pe = rollup.position_effort(pv, [*keys, "file_name"])
    clipped = rollup.clip_and_label(pe, layers).drop("ocean_area", "eez_name")
    eff = rollup.regroup_rounded(clipped, list(keys), hrs_scale=hrs_scale)
    return grid.rasterize(eff, "effort", keys=list(keys), fun="sum", g=g)


def _year_window(years: tuple) -> Column:
    return (F.col("year") >= years[0]) & (F.col("year") < years[1])


def effort_cells(fleet_p: DataFrame, layers: dict, years: tuple | None = None,
                 hrs_scale: float = 24.0, g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Q12/Q13 body for one ping set: one grid, optional year window.  Returns (row, col, value)."""
    return _cells(fleet_p, layers, [], _year_window(years) if years else None, hrs_scale, g)


def grid_points(cells: DataFrame, label: str, g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """G4 + F11 + P21: centre points with value, log1p(value) and period label."""
    return (grid.to_points(cells, g)
            .select("x", "y", F.col("value").alias("layer"),
                    F.log1p("value").alias("log_layer"), F.lit(label).alias("time")))


def period_cells(modelled: DataFrame, layers: dict, fleet: DataFrame, study: Study,
                 exclude: DataFrame | None = None, hrs_scale: float = 24.0,
                 g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Q12-Q14 in one plan: every file of the before and after slices is tagged with
    its period by a small broadcast table (at most the two slice sizes), so the
    fleet's pings are read once; the year window applies to the before period only
    (T24); all later keys carry ``period``.  Returns (period, row, col, value)."""
    pos = file_positions(modelled)
    (b0, b1), (a0, a1) = study.before_files, study.after_files
    tags = (pos.select("file_name", F.explode(F.array(
                F.when(in_slice(F.col("_pos"), b0, b1), F.lit("before")),
                F.when(in_slice(F.col("_pos"), a0, a1), F.lit("after")))).alias("period"))
               .where(F.col("period").isNotNull()))
    rows = [slice_rows(b0, b1), slice_rows(a0, a1)]
    rows = None if None in rows else sum(rows)
    fp = fleet_pings(modelled, fleet, exclude)
    tagged = fp.join(membership.bounded(tags, known_rows=rows), "file_name")
    keep = (F.col("period") != "before") | _year_window(study.before_years) if study.before_years else None
    return _cells(tagged, layers, ["period"], keep, hrs_scale, g)


def before_after_cells(modelled: DataFrame, layers: dict, fleet: DataFrame, study: Study,
                       exclude: DataFrame | None = None, g: grid.GridSpec = grid.DEFAULT_GRID):
    """Q12/Q13 (active fleet) or Q14 (``exclude`` = active fleet, fleet = permits) as
    two (row, col, value) tables; the period filter reaches the tag table, so asking
    for one period does only that period's work."""
    cells = period_cells(modelled, layers, fleet, study, exclude, g=g)
    return tuple(cells.where(F.col("period") == p).drop("period") for p in ("before", "after"))


def nfi_points(before: DataFrame, after: DataFrame, g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Q15/Q16 (Fig 1D/E) from two grids: NFI per cell, gain/loss masks, direction, centres."""
    ch = grid.change_direction(grid.normalised_change(before, after))
    return grid.to_points(ch, g).select("x", "y", F.col("nfi").alias("layer"), "type", "is_gain", "is_loss")


def nfi_points_periods(cells: DataFrame, g: grid.GridSpec = grid.DEFAULT_GRID) -> DataFrame:
    """Q15/Q16 from one (period, row, col, value) table: a single aggregation, no join."""
    ch = grid.change_direction(grid.normalised_change_periods(cells))
    return grid.to_points(ch, g).select("x", "y", F.col("nfi").alias("layer"), "type", "is_gain", "is_loss")


# --- Q17-Q21: monthly series and the counterfactual ---------------------------------------------

def activity_series(hours: DataFrame, study: Study) -> DataFrame:
    """Q17 input: hours per vessel inside the area by month (hours, not days, T11),
    missing months filled with 0 (T23)."""
    m = mpa_monthly_effort(hours, study, unit_hours=study.unit_hours_model)
    s = m.select(F.lit("activity").alias("series_id"), "date", F.col("effort").alias("y"))
    return series_ops.month_spine(s, fill=0.0)


def observed_series(hours: DataFrame, landings: DataFrame, permits: DataFrame, active: DataFrame, areas: DataFrame,
                    study: Study) -> DataFrame:
    """The five impact series as observed: the activity's missing months are not filled."""
    m = mpa_monthly_effort(hours, study, unit_hours=study.unit_hours_model)
    return (m.select(F.lit("activity").alias("series_id"), "date", F.col("effort").alias("y"))
            .unionByName(cpue_series(landings, permits, active, study)).unionByName(area_series(areas, study)))


def cpue_series(landings: DataFrame, permits: DataFrame, active: DataFrame, study: Study) -> DataFrame:
    """Q18/Q19 input: CPUE per fleet from ``cpue_from``; no gap fill."""
    m = monthly_cpue(landings, permits, active, study, from_date=study.cpue_from)
    return m.select(F.concat(F.lit("cpue_"), F.lower("revi")).alias("series_id"), "date", F.col("cpue").alias("y"))


def area_series(areas: DataFrame, study: Study) -> DataFrame:
    """Q20/Q21 input: monthly area per fleet, without the figure's outlier filter."""
    m = monthly_area(areas, study, outlier=None, recode=False)
    return m.select(F.concat(F.lit("area_"), F.col("revi")).alias("series_id"), "date", F.col("area").alias("y"))


def impact(series: DataFrame, study: Study) -> DataFrame:
    """M2-M4 on any number of series: time index, periods, fit, effects."""
    s = series_ops.time_index(series)
    s = series_ops.flag_periods(s, (study.pre_start, study.pre_end), (study.post_start, study.post_end))
    return series_ops.linear_counterfactual(s)
