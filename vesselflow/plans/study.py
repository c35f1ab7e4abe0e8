"""The whole analysis on landed data, writing every result table.

Inputs are parquet folders (modelled pings, polygons, permits, landings); outputs
are parquet folders under ``out``.  Monthly hours and the fleet list are written
first and read back, so later stages start from a written table (lineage cut on
shared storage, not on an executor) and the expensive zone joins run once.

    from vesselflow.plans.study import StudyPaths, run_study
    run_study(spark, StudyPaths(pings=..., polygons=..., permits=..., landings=...), "s3://bucket/out")
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.constants import REFERENCE_STUDY, Study
from vesselflow.operators import geo, grid, intervals, rollup, series
from vesselflow.operators.models import bayesian_impact, bayesian_summary, gamma_trend
from vesselflow.plans import figures as FG
from vesselflow.plans import incremental
from vesselflow.sources import io, landing, publish


@dataclass(frozen=True)
class StudyPaths:
    pings: str          # modelled pings (preprocessed + vessel_state), parquet
    polygons: str       # zone layers: pid, layer (ocean/eez/mpa), name, ..., ring
    permits: str        # vessel_name
    landings: str       # date, vessel_name, catch, days_declared


def _p(out: str, name: str) -> str:
    return os.path.join(out, name)


def _write_read(spark: SparkSession, df: DataFrame, path: str, partition_by=None) -> DataFrame:
    io.write_table(df, path, partition_by, replace_all=True)      # no partition of an earlier run stays
    return spark.read.parquet(path)


def layers_from(polygons: DataFrame) -> dict:
    return {
        "ocean": geo.prepare_layer(polygons, "ocean", ["pid", "name"]),
        "eez": geo.prepare_layer(polygons, "eez", ["pid", "name"]),
        "mpa": geo.prepare_layer(polygons, "mpa", ["pid", "name", "decree", "state", "municipality", "region"]),
    }


def half_month_cells(eff: DataFrame) -> DataFrame:
    """S8 content of Q8/Q9: the per-file effort grid, one row per (fleet, file, cell)."""
    cells = grid.rasterize(eff, "effort", keys=["fleet", "file_name"], fun="sum")
    return cells.select("fleet", F.col("file_name").alias("period"), "row", "col", "value")


def publish_study(spark: SparkSession, paths: StudyPaths, out: str, study: Study = REFERENCE_STUDY, **options) -> dict:
    """:func:`run_study` into a new version of ``out``, switched to once every table is written; the tables' paths.
    ``publish.read_published(spark, out, "area_results")`` reads one whole run."""
    tables: dict = {}
    publish.publish(spark, out, lambda folder: tables.update(run_study(spark, paths, folder, study, **options)))
    return tables


def run_study(spark: SparkSession, paths: StudyPaths, out: str, study: Study = REFERENCE_STUDY,
              bayesian: bool = True, niter: int = C.MCMC_ITERATIONS, strict: bool = False, states: str | None = None) -> dict:
    """Run Q4-Q21 (+ M5, M7) and write: month_vessel_hrs, fleets, area_results,
    area_monthly, cpue_monthly, mpa_effort, grids_half_month, grids_before_after,
    nfi, series_completeness, series_gaps, impact_linear, impact_summary, impact_intervals, impact_bayesian, trends.
    ``strict`` makes a series whose length differs from ``study.expected_rows`` an error, as in the original.
    ``states`` (a folder of ``refresh_states`` with the same study) gives hours and half-month effort instead of the pings."""
    modelled = spark.read.parquet(paths.pings)
    layers = layers_from(spark.read.parquet(paths.polygons))
    permits = FG.permit_list(spark.read.parquet(paths.permits))
    landings = spark.read.parquet(paths.landings)

    hours = (incremental.hours(spark, states, with_file=True) if states
             else rollup.monthly_vessel_hours(modelled, layers, study.hours_min_year, with_file=True))
    hours = _write_read(spark, hours, _p(out, "month_vessel_hrs"), ["year"])
    fleet_all = FG.active_fleet(hours)                          # README / causal lists: no year filter
    fleet_grid = FG.active_fleet(hours, study.fleet_min_year)   # grid scripts (T14)
    fleets = (fleet_all.withColumn("list", F.lit("active"))
              .unionByName(fleet_grid.withColumn("list", F.lit("active_grid")))
              .unionByName(permits.withColumn("list", F.lit("permits"))))
    fleets = _write_read(spark, fleets, _p(out, "fleets"))
    active = fleets.where("list = 'active'").select("vessel_name")
    active_grid = fleets.where("list = 'active_grid'").select("vessel_name")

    # Q6, Q7
    io.write_table(FG.mpa_monthly_effort(hours, study), _p(out, "mpa_effort"))
    io.write_table(FG.monthly_cpue(landings, permits, active, study), _p(out, "cpue_monthly"))

    # Q8-Q11 (+ S8 per-file grids)
    # per-position effort of both fleets, written once; areas and per-file grids derive from it
    eff = (incremental.both_fleets_effort(spark, states, layers, permits, active_grid, study) if states
           else FG.both_fleets_effort(modelled, layers, permits, active_grid, study))
    eff = _write_read(spark, eff.withColumnRenamed("revi", "fleet"), _p(out, "effort_half_month"), ["fleet"])
    areas = grid.file_area(eff, by=("fleet",)).select("date", "area", F.col("fleet").alias("revi"))
    areas = _write_read(spark, areas, _p(out, "area_results"))
    io.write_grids(half_month_cells(eff), _p(out, "grids_half_month"), replace_all=True)
    io.write_table(FG.monthly_area(areas, study), _p(out, "area_monthly"))

    # Q12-Q16: one pass per fleet for both periods; NFI from the written grids, no join
    grids = [FG.period_cells(modelled, layers, lst, study, exclude=excl).withColumn("fleet", F.lit(fleet))
             for fleet, lst, excl in ((C.FLEET_YES, active_grid, None), (C.FLEET_NO, permits, active_grid))]
    io.write_grids(io.union_files(grids).select("fleet", "period", "row", "col", "value"),
                   _p(out, "grids_before_after"), replace_all=True)
    cells = spark.read.parquet(_p(out, "grids_before_after"))
    nfis = [FG.nfi_points_periods(cells.where(F.col("fleet") == f)).withColumn("fleet", F.lit(f))
            for f in (C.FLEET_YES, C.FLEET_NO)]
    io.write_table(io.union_files(nfis), _p(out, "nfi"))

    # Q17-Q21, M5, M6, M7
    s = (FG.activity_series(hours, study)
         .unionByName(FG.cpue_series(landings, permits, active, study))
         .unionByName(FG.area_series(areas, study)))
    s = _write_read(spark, s, _p(out, "series"))
    if study.expected_rows:
        counts = _write_read(spark, series.expected_counts(s, study.expected_rows), _p(out, "series_completeness"))
        if strict:
            series.require_expected(counts)
    observed = FG.observed_series(hours, landings, permits, active, areas, study)
    io.write_table(series.gap_runs(observed, study.pre_start, study.post_end), _p(out, "series_gaps"))
    fitted = _write_read(spark, intervals.prediction_intervals(FG.impact(s, study)), _p(out, "impact_linear"))
    io.write_table(series.impact_summary(fitted), _p(out, "impact_summary"))
    io.write_table(intervals.impact_intervals(fitted), _p(out, "impact_intervals"))
    if bayesian:
        indexed = series.flag_periods(series.time_index(s), (study.pre_start, study.pre_end),
                                      (study.post_start, study.post_end))
        io.write_table(bayesian_impact(indexed, niter=niter), _p(out, "impact_bayesian"))
        io.write_table(bayesian_summary(indexed, niter=niter), _p(out, "impact_bayesian_summary"))
    a = FG.mpa_monthly_effort(hours, study).select(F.lit("activity").alias("series_id"), "period", "date",
                                                  F.col("effort").alias("y"))
    io.write_table(gamma_trend(a, ["series_id", "period"]), _p(out, "trends"))
    return {name: _p(out, name) for name in (
        "month_vessel_hrs", "fleets", "mpa_effort", "cpue_monthly", "effort_half_month", "area_results",
        "grids_half_month",
        "area_monthly", "grids_before_after", "nfi", "series", "impact_linear", "impact_summary", "impact_intervals",
        "series_gaps", "trends")}


def refresh_states(spark: SparkSession, pings: str, polygons: str, out: str, study: Study = REFERENCE_STUDY) -> dict:
    """Bring the partial states in ``out`` to the landed ``pings``: only files that the landing ledger lists with new content are read."""
    return incremental.refresh(spark.read.parquet(pings), incremental.landed_versions(spark, pings),
                               layers_from(spark.read.parquet(polygons)), out, study)


def ingest_raw(spark: SparkSession, raw_dir: str, polygons: str, out: str, ports: str | None = None,
               model: str = "band", port_radius_km: float = 5.0) -> str:
    """Q1 + Q2 as one batch job: raw delimited files -> cleaned pings with per-file
    ids, protected-area attributes, port visits and fishing state, landed through
    the ledger (S9): files that were landed before and did not change are not read again."""
    from vesselflow.operators import clean
    from vesselflow.operators.mixture import classify_by_mixture
    from vesselflow.operators.models import classify_by_speed

    layers = layers_from(spark.read.parquet(polygons))
    ports_table = spark.read.parquet(ports) if ports else None

    def modelled(raw):
        p = geo.attach_mpa(clean.preprocess(raw, file_col="source_file"), layers["mpa"])
        if ports_table is not None:
            p = geo.flag_port_visits(p, ports_table, radius_km=port_radius_km)
        return classify_by_mixture(p) if model == "mixture" else classify_by_speed(p)

    landing.land(spark, raw_dir, out, modelled)
    return out
