"""The study runner on landed copies of the adapter tables gives the registered results."""

import os

from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY
from vesselflow.plans import catalog
from vesselflow.plans.study import StudyPaths, publish_study
from vesselflow.sources import adapters, fixtures, publish

from .conftest import SF001


def test_run_study_matches_queries(spark, scratch):
    land = os.path.join(scratch, "landed")
    i = catalog.Inputs(spark, SF001)
    i.modelled.write.parquet(os.path.join(land, "pings"))
    fixtures.zone_polygons(spark).write.parquet(os.path.join(land, "polygons"))
    adapters.permits(spark, SF001).write.parquet(os.path.join(land, "permits"))
    adapters.landings(spark, SF001).write.parquet(os.path.join(land, "landings"))
    paths = StudyPaths(*(os.path.join(land, n) for n in ("pings", "polygons", "permits", "landings")))
    out = publish_study(spark, paths, os.path.join(scratch, "out"), FIXTURE_STUDY, bayesian=True, niter=50)

    hrs = spark.read.parquet(out["month_vessel_hrs"]).drop("file_name")
    q4 = catalog.QUERIES["q04_monthly_vessel_hours"](spark, SF001)
    assert sorted(map(tuple, hrs.select(q4.columns).collect())) == sorted(map(tuple, q4.collect()))

    areas = spark.read.parquet(out["area_results"])
    q10 = catalog.QUERIES["q10_area_results"](spark, SF001)
    assert sorted(map(tuple, areas.select(q10.columns).collect()), key=str) == \
        sorted(map(tuple, q10.collect()), key=str)

    nfi = spark.read.parquet(out["nfi"])
    n15 = catalog.QUERIES["q15_nfi_active"](spark, SF001).count()
    n16 = catalog.QUERIES["q16_nfi_other"](spark, SF001).count()
    assert nfi.where(F.col("fleet") == "yes").count() == n15
    assert nfi.where(F.col("fleet") == "no").count() == n16

    grids = spark.read.parquet(out["grids_half_month"])
    assert grids.select("fleet").distinct().count() == 2
    folder = publish.current(spark, os.path.join(scratch, "out"))
    assert spark.read.parquet(os.path.join(folder, "impact_bayesian")).count() > 0

    for table, name in (("impact_intervals", "m06c_impact_intervals"), ("series_gaps", "w03b_gap_runs")):
        want = catalog.QUERIES[name](spark, SF001)
        got = spark.read.parquet(out[table]).select(want.columns)
        for c, kind in want.dtypes:
            got = got.withColumn(c, F.round(c, 6)) if kind == "double" else got
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counts = spark.read.parquet(os.path.join(folder, "series_completeness"))
    assert {r["check"] for r in counts.collect()} == {"cpue_pair", "area_yes", "area_no"}
