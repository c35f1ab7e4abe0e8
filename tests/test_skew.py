"""A hot key (one vessel in one file holding ~40% of all pings) against brute force.

The Spark plans must give the same rows as a plain pandas computation of the
same rules, whatever the skew; nothing is dropped or sampled."""

import pandas as pd
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.operators import rollup
from vesselflow.plans import catalog
from vesselflow.sources import adapters
from vesselflow.sources.fixtures import ZONE_POLYGONS

from .conftest import SF001


def _inside(ring, x, y):
    c, n = False, len(ring)
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            c = not c
    return c


def _names(layer, x, y):
    return [name for pid, lay, name, *_rest, ring in ZONE_POLYGONS if lay == layer and _inside(ring, x, y)]


def _skewed(spark):
    p = adapters.fishing_pings(spark, SF001)
    hot = (F.col("id") % 5) < 2                               # ~40% of the rows
    return (p.withColumn("vessel_name", F.when(hot, F.lit("V1")).otherwise(F.col("vessel_name")))
             .withColumn("file_name", F.when(hot, F.lit("1996_01_1")).otherwise(F.col("file_name"))))


def test_hours_under_skew_match_brute_force(spark):
    i = catalog.Inputs(spark, SF001)
    from vesselflow.operators import geo
    pings = geo.attach_mpa(_skewed(spark), i.layers["mpa"])
    got = rollup.monthly_vessel_hours(pings, i.layers, 1994, with_file=True).toPandas()

    pdf = _skewed(spark).toPandas()
    pdf = pdf[pdf.vessel_state == C.HAULING]
    rows = []
    for r in pdf.itertuples():
        oceans = _names("ocean", r.longitude, r.latitude)
        mpas = _names("mpa", r.longitude, r.latitude) or [C.OPEN_AREA]
        eezs = _names("eez", r.longitude, r.latitude) or [None]
        for _ in oceans:
            for zone in mpas:
                for eez in eezs:
                    if zone != C.OPEN_AREA:
                        z = zone
                    elif eez is None:
                        z = C.HIGH_SEAS
                    elif eez == C.HOME_EEZ_NAME:
                        z = C.EEZ_LABEL
                    else:
                        z = zone
                    rows.append((r.file_name, r.year, r.month, r.day, r.date.hour, r.vessel_name, z))
    want = (pd.DataFrame(rows, columns=["file_name", "year", "month", "day", "hour", "vessel_name", "zone"])
              .drop_duplicates()
              .groupby(["file_name", "year", "month", "vessel_name", "zone"]).size().rename("hrs").reset_index())
    key = ["file_name", "year", "month", "vessel_name", "zone"]
    a = got.sort_values(key).reset_index(drop=True)[key + ["hrs"]]
    b = want.sort_values(key).reset_index(drop=True)[key + ["hrs"]]
    assert len(a) == len(b)
    assert (a.astype(str).values == b.astype(str).values).all()
    raw = _skewed(spark).toPandas()
    hot_share = ((raw.vessel_name == "V1") & (raw.file_name == "1996_01_1")).mean()
    assert hot_share >= 0.3                                   # the hot key really holds a third of the pings


def test_area_under_skew_keeps_every_file(spark):
    from vesselflow.plans import figures as FG
    i = catalog.Inputs(spark, SF001)
    sk = _skewed(spark)
    names = sk.select("vessel_name").distinct()
    out = FG.half_month_area(FG.fleet_pings(sk, names), i.layers, with_file=True)
    files = {r["file_name"] for r in out.collect()}
    hauling_files = {r[0] for r in rollup.hauling(sk).select("file_name").distinct().collect()}
    assert "1996_01_1" in files and files <= hauling_files
    hot = out.where(F.col("file_name") == "1996_01_1").first()
    assert hot["area"] is not None and hot["area"] > 0
