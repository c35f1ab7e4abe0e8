"""Hand-made frames for the value rules of the analysis."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vesselflow import constants as C
from vesselflow import functions as VF
from vesselflow.operators import clean, geo, grid, membership, rollup, series


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_t2_zone_relabel(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, "open area", C.HOME_EEZ_NAME), (3, "open area", None),
         (4, "open area", "Other EEZ"), (5, "Revillagigedo", None), (6, "Revillagigedo", C.HOME_EEZ_NAME)],
        "k int, zone string, eez_name string")
    out = dict(rows(rollup.relabel_zone(df), "k", "zone"))
    assert out == {1: "High seas", 2: "EEZ", 3: "High seas", 4: "open area", 5: "Revillagigedo", 6: "Revillagigedo"}


def test_t8_n_distinct_counts_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert df.agg(VF.n_distinct("v").alias("n")).first()["n"] == 3


def test_t9_strict_sum(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 3.0)], "g int, a double")
    out = dict(rows(df.groupBy("g").agg(VF.strict_sum("a").alias("s")), "g", "s"))
    assert out == {1: None, 2: 5.0}


def test_t10_zero_days(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 0.0), (10.0, 2.0)], "c double, d double")
    got = [r[0] for r in df.select(VF.ratio("c", "d")).collect()]
    assert got == [None, None, 5.0]
    ieee = [r[0] for r in df.select(VF.ieee_ratio("c", "d")).collect()]
    assert ieee[0] == float("inf") and ieee[1] != ieee[1] and ieee[2] == 5.0


def test_t6_landing_names(spark):
    df = spark.createDataFrame([(" V1 (ALIAS",), ("\tV2\n",), ("V3",), (None,)], "vessel_name string")
    first, second = VF.split_first(F.col("vessel_name"))
    got = [(r[0], r[1]) for r in df.select(VF.trim_ws(first), second).collect()]
    assert got == [("V1", "ALIAS"), ("V2", ""), ("V3", ""), (None, "")]


def test_t7_membership_with_missing_names(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "vessel_name string")
    lst = spark.createDataFrame([("a",)], "vessel_name string")
    assert rows(membership.keep_in(df, lst), "vessel_name") == [("a",)]
    kept = [r[0] for r in membership.drop_in(df, lst).collect()]
    assert sorted(kept, key=str) == sorted(["b", None], key=str)
    flags = dict((r["vessel_name"], r["revi"]) for r in membership.flag_in(df, lst).collect())
    assert flags == {"a": "Yes", "b": "No", None: "No"}


def test_t4_file_date_invalid_is_missing(spark):
    pv = spark.createDataFrame([("f1", 2001, 1, 31), ("f1", 2001, 2, 3), ("f2", 2001, 3, 15)],
                               "file_name string, year int, month int, max_day int")
    out = {(r["file_name"], r["month"]): r["date"] for r in rollup.file_dates(pv).collect()}
    assert out[("f1", 1)] == dt.date(2001, 1, 31)
    assert out[("f1", 2)] is None               # Feb 31 does not exist
    assert out[("f2", 3)] == dt.date(2001, 3, 15)


def test_t12_period_cut(spark):
    df = spark.createDataFrame([(dt.date(2017, 10, 31),), (dt.date(2017, 11, 1),), (None,)], "d date")
    got = [r[0] for r in df.select(VF.period_label(F.col("d"), "2017-11-01")).collect()]
    assert got == ["Before", "After", None]


def test_t18_registration_text(spark):
    df = spark.createDataFrame([(54213.0, "54213", "ABC")], "a double, b string, c string")
    r = df.select(VF.id_text("a"), VF.id_text("b"), VF.id_text("c")).first()
    assert tuple(r) == ("54213", "54213", "ABC")


def test_p2_speed_repair(spark):
    df = spark.createDataFrame([("12,5",), ("3 kn",), ("",), ("abc",), (" 7 ",)], "raw_speed string")
    got = [r[0] for r in df.select(clean.repair_number("raw_speed")).collect()]
    assert got == [12.5, 3.0, None, None, 7.0]


def test_g2_extent_edges(spark):
    df = spark.createDataFrame([(-75.0, -12.0), (-155.0, 35.0), (-74.9, 0.0), (-100.05, 10.0)],
                               "longitude double, latitude double")
    out = rows(grid.assign_cells(df), "longitude", "row", "col")
    assert (-155.0, 0, 0) in out and (-75.0, 469, 799) in out
    assert all(r[0] != -74.9 for r in out)


def test_t15_nfi(spark):
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 1.0)], "row int, col int, value double")
    a = spark.createDataFrame([(0, 0, 3.0), (0, 2, 1.0), (0, 3, 4.0)], "row int, col int, value double")
    out = {(r["col"]): (r["nfi"], r["type"]) for r in grid.change_direction(grid.normalised_change(b, a)).collect()}
    assert out == {0: (0.5, "Increase"), 1: (-1.0, "Decrease"), 3: (1.0, "Increase")}   # col 2 unchanged dropped


def test_t17_used_area_is_count_times_median(spark):
    cells = spark.createDataFrame([("f", 0, 0, 1.0), ("f", 100, 0, 1.0), ("f", 200, 0, 1.0)],
                                  "file_name string, row int, col int, value double")
    areas = list(spark.range(1).select(*[grid.cell_area_km2(F.lit(x)) for x in (0, 100, 200)]).first())
    got = grid.used_area(cells, ["file_name"]).first()["area"]
    assert got == round(3 * sorted(areas)[1], 1)


def test_t23_month_spine_fill(spark):
    s = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0), ("a", dt.date(2000, 4, 1), 2.0)],
                              "series_id string, date date, y double")
    filled = rows(series.month_spine(s, fill=0.0), "date", "y")
    assert [y for _, y in filled] == [1.0, 0.0, 0.0, 2.0]
    kept = rows(series.month_spine(s, fill=None), "date", "y")
    assert [y for _, y in kept] == [1.0, None, None, 2.0]


def _layers(spark):
    polys = spark.createDataFrame([
        (1, "ocean", "Ocean", None, None, None, None, [(-120.0, 0.0), (-100.0, 0.0), (-100.0, 20.0), (-120.0, 20.0)]),
        (2, "eez", C.HOME_EEZ_NAME, None, None, None, None, [(-120.0, 0.0), (-110.0, 0.0), (-110.0, 20.0), (-120.0, 20.0)]),
        (3, "eez", "Overlap", None, None, None, None, [(-112.0, 0.0), (-108.0, 0.0), (-108.0, 20.0), (-112.0, 20.0)]),
    ], "pid long, layer string, name string, decree string, state string, municipality string, region string, "
       "ring array<struct<x:double,y:double>>")
    return {"ocean": geo.prepare_layer(polys, "ocean", ["pid", "name"]),
            "eez": geo.prepare_layer(polys, "eez", ["pid", "name"])}


PINGS = ("file_name string, year int, month int, day int, date timestamp, vessel_name string, zone string, "
         "longitude double, latitude double, vessel_state string")


def _ping(f, d, h, v, zone, lon, lat, state="hauling"):
    return (f, 2001, 1, d, dt.datetime(2001, 1, d, h), v, zone, lon, lat, state)


def test_t1_t20_t21_hours(spark):
    layers = _layers(spark)
    data = [
        _ping("f1", 1, 5, "A", "open area", -115.0, 10.0),
        _ping("f1", 1, 5, "A", "open area", -115.0, 10.0),      # duplicate hour: counted once
        _ping("f1", 1, 6, "A", "open area", -111.0, 10.0),      # inside both EEZ polygons (T21)
        _ping("f1", 1, 7, "A", "open area", -130.0, 10.0),      # outside the ocean: dropped
        _ping("f2", 16, 5, "A", "open area", -115.0, 10.0),     # second file of the month (T1)
        _ping("f1", 1, 8, "A", "open area", -101.0, 10.0, "steaming"),
    ]
    pings = spark.createDataFrame(data, PINGS)
    hrs = rollup.monthly_vessel_hours(pings, layers, 2000, with_file=True)
    got = rows(hrs, "file_name", "zone", "hrs")
    # f1: hours 5 and 6 in EEZ (6 twice: two EEZ rows collapse by distinct), hour 6 in 'open area' (overlap)
    assert got == [("f1", "EEZ", 2), ("f1", "open area", 1), ("f2", "EEZ", 1)]


def test_t3_dedup_and_t1_vessel_grain(spark):
    data = [("f1", 2001, 1, 1, dt.datetime(2001, 1, 1, 5), "A", "z", -115.0, 10.0, "hauling"),
            ("f1", 2001, 1, 1, dt.datetime(2001, 1, 1, 5), "A", "z", -115.0, 10.0, "hauling"),
            ("f2", 2001, 1, 20, dt.datetime(2001, 1, 20, 5), "A", "z", -115.0, 10.0, "hauling")]
    p = spark.createDataFrame(data, PINGS)
    pv = rollup.position_hours(p, ["file_name", "year", "month"])
    assert rows(pv, "file_name", "h") == [("f1", 1), ("f2", 1)]
    per_file = rollup.position_effort(pv, ["file_name"])
    total = per_file.agg(F.sum("vessels")).first()[0]
    assert total == 2       # a sum of per-file distinct counts, not a global distinct (T1)


def test_e1_p24_file_area_dates_and_missing_area(spark):
    pts = spark.createDataFrame([
        ("f1", dt.date(2001, 1, 31), -100.05, 10.05, 2.0),
        ("f1", None, -100.05, 10.05, 1.0),                 # impossible date of the same file: kept as a row
        ("f1", dt.date(2001, 1, 31), -100.05, 12.05, 1.0),
        ("f2", dt.date(2001, 2, 15), -170.0, 10.0, 1.0),   # outside the grid: no cell
    ], "file_name string, date date, longitude double, latitude double, effort double")
    out = {(r["file_name"], r["date"]): r["area"] for r in grid.file_area(pts, with_file=True).collect()}
    cells = spark.range(1).select(grid.cell_area_km2(F.lit(249)), grid.cell_area_km2(F.lit(229))).first()
    expected = round(2 * (cells[0] + cells[1]) / 2, 1)
    assert out == {("f1", dt.date(2001, 1, 31)): expected, ("f1", None): expected,
                   ("f2", dt.date(2001, 2, 15)): None}


def test_nfi_one_table_equals_two_grids(spark):
    b = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 1.0)], "row int, col int, value double")
    a = spark.createDataFrame([(0, 0, 3.0), (0, 2, 1.0), (0, 3, 4.0)], "row int, col int, value double")
    long = b.withColumn("period", F.lit("before")).unionByName(a.withColumn("period", F.lit("after")))
    two = sorted(tuple(r) for r in grid.normalised_change(b, a).select("row", "col", "nfi").collect())
    one = sorted(tuple(r) for r in grid.normalised_change_periods(long).select("row", "col", "nfi").collect())
    assert one == two
