"""More value rules: T5, T9, T11, T13, T14, T19, T24."""

import datetime as dt

from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY
from vesselflow.operators import membership, series
from vesselflow.plans import figures as FG


def test_t5_permit_names_kept_unsplit(spark):
    p = spark.createDataFrame([("V1 (ALIAS",), ("V1 (ALIAS",), ("V2",)], "vessel_name string")
    assert sorted(r[0] for r in membership.name_list(p).collect()) == ["V1 (ALIAS", "V2"]
    assert sorted(r[0] for r in membership.name_list(p, normalise=True).collect()) == ["V1", "V2"]


def test_t9_missing_half_month_makes_month_missing(spark):
    a = spark.createDataFrame([(dt.date(1996, 1, 15), 100.0, "yes"), (dt.date(1996, 1, 31), None, "yes"),
                               (dt.date(1996, 2, 15), 100.0, "yes"), (dt.date(1996, 2, 29), 300.0, "yes"),
                               (dt.date(1996, 3, 15), 900000.0, "no")],
                              "date date, area double, revi string")
    m = {(r["month"], r["revi"]): r["area"] for r in FG.monthly_area(a, FIXTURE_STUDY).collect()}
    assert m == {(2, "Yes"): 0.4}                      # Jan is missing (dropped), Mar is an outlier
    s = {r["date"].month: r["y"] for r in FG.area_series(a, FIXTURE_STUDY).collect()}
    assert s[1] is None and s[2] == 0.4 and s[3] == 900.0     # the model series keeps both


def test_t11_hours_vs_days(spark):
    h = spark.createDataFrame([(1996, 1, "A", "Revillagigedo", 48), (1996, 1, "B", "Revillagigedo", 24)],
                              "year int, month int, vessel_name string, zone string, hrs long")
    fig = FG.mpa_monthly_effort(h, FIXTURE_STUDY).first()
    model = FG.mpa_monthly_effort(h, FIXTURE_STUDY, unit_hours=FIXTURE_STUDY.unit_hours_model).first()
    assert (fig["vessel"], fig["hrs"], fig["effort"]) == (2, 3.0, 1.5)
    assert (model["hrs"], model["effort"]) == (72.0, 36.0)


def test_t13_fleet_recode(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("Yes",), (None,)], "revi string")
    assert [r[0] for r in FG.recode_fleet(df).collect()] == ["Yes", "No", None, None]


def test_t14_fleet_year_filter(spark):
    h = spark.createDataFrame([(2004, "A", "Revillagigedo"), (2010, "B", "Revillagigedo"), (2010, "C", "EEZ")],
                              "year int, vessel_name string, zone string")
    assert sorted(r[0] for r in FG.active_fleet(h).collect()) == ["A", "B"]
    assert sorted(r[0] for r in FG.active_fleet(h, min_year=2005).collect()) == ["B"]


def test_t19_time_index_per_series_after_filter(spark):
    s = spark.createDataFrame([("a", dt.date(2000, m, 1), 1.0) for m in (1, 2, 3)]
                              + [("b", dt.date(2000, m, 1), 1.0) for m in (2, 3)],
                              "series_id string, date date, y double")
    t = {(r["series_id"], r["date"].month): r["t"] for r in series.time_index(s).collect()}
    assert t == {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 2): 1, ("b", 3): 2}


def test_t24_year_window_only_before(spark):
    from vesselflow.plans import catalog
    from .conftest import SF001
    i = catalog.Inputs(spark, SF001)
    p = FG.fleet_pings(i.fishing, i.active)
    all_years = FG.effort_cells(p, i.layers, None).agg(F.sum("value")).first()[0]
    window = FG.effort_cells(p, i.layers, (1996, 1998)).agg(F.sum("value")).first()[0]
    assert 0 < window < all_years


def test_profile_exact_and_sketch(spark):
    from vesselflow.operators.profile import profile
    df = spark.range(0, 20000).select((F.col("id") % 1000).alias("a"),
                                      F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 7).alias("b"))
    exact = {r["column_name"]: (r["n_rows"], r["n_missing"], r["n_distinct"]) for r in profile(df).collect()}
    assert exact == {"a": (20000, 0, 1000), "b": (20000, 2000, 7)}
    approx = {r["column_name"]: r["n_distinct"] for r in profile(df, exact=False).collect()}
    assert abs(approx["a"] - 1000) <= 50 and approx["b"] == 7
