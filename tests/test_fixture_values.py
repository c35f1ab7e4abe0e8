"""Values recorded for the adapters at sf0.001 and sf0.01 (the only golden figures available)."""

import pytest
from pyspark.sql import functions as F

from vesselflow.operators import geo, grid, rollup
from vesselflow.plans import catalog
from vesselflow.plans import figures as FG
from vesselflow.sources import adapters

RECORDED = {
    "/root/testdata/sf0.001": dict(
        sizes=(6000, 165, 10), ocean=1078, eez=(176, 168), mpa=(22, 3),
        hours={"EEZ": 138, "High seas": 922, "open area": 211, "Revillagigedo": 33, "Golfo Norte": 3},
        months=25, fleets=(5, 5), hauling_ocean=1307, cells=775, zero_days=480),
    "/root/testdata/sf0.01": dict(
        sizes=(60000, 165, 100), ocean=27599, eez=(4084, 2943), mpa=(359, 10),
        hours={"EEZ": 1533, "High seas": 9856, "open area": 1358, "Revillagigedo": 161},
        months=71, fleets=(48, 52), hauling_ocean=12916, cells=11799, zero_days=4804),
}


@pytest.mark.parametrize("sf", sorted(RECORDED))
def test_recorded_values(spark, sf):
    want = RECORDED[sf]
    p = adapters.pings(spark, sf)
    r = p.agg(F.count(F.lit(1)), F.count_distinct("file_name"), F.count_distinct("vessel_name")).first()
    assert tuple(r) == want["sizes"]

    zones = {(r["layer"], r["name"]): r["n_positions"]
             for r in catalog.QUERIES["j01_zone_membership"](spark, sf).collect()}
    assert zones[("ocean", "Eastern Pacific")] == want["ocean"]
    assert (zones[("eez", "Mexican Pacific Exclusive Economic Zone")],
            zones[("eez", "Neighbour Exclusive Economic Zone")]) == want["eez"]
    assert (zones.get(("mpa", "Revillagigedo"), 0), zones.get(("mpa", "Golfo Norte"), 0)) == want["mpa"]

    h = catalog.QUERIES["q04_monthly_vessel_hours"](spark, sf)
    got = {r["zone"]: r["hrs"] for r in h.groupBy("zone").agg(F.sum("hrs").alias("hrs")).collect()}
    assert {k: v for k, v in got.items() if v} == want["hours"]

    i = catalog.Inputs(spark, sf)
    assert catalog.QUERIES["q06_mpa_effort"](spark, sf).count() == want["months"]
    vessels, active = FG.vessel_list(i.hours).count(), i.active.count()
    assert (active, vessels - active) == want["fleets"]
    ocean = geo.join_zones(rollup.hauling(i.modelled), i.layers["ocean"], "inner")
    assert ocean.count() == want["hauling_ocean"]
    assert grid.assign_cells(ocean).select("row", "col").distinct().count() == want["cells"]
    assert adapters.landings(spark, sf).where("days_declared = 0").count() == want["zero_days"]
