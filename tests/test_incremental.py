"""Refreshed states equal a full run after new, changed, touched and withdrawn files; only changed files are read."""

import os
import time

import pytest
from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY as S
from vesselflow.operators import membership, rollup
from vesselflow.plans import catalog, incremental
from vesselflow.plans import figures as FG
from vesselflow.plans.study import ingest_raw, refresh_states
from vesselflow.sources.fixtures import zone_polygons

from .conftest import SF001
from .test_io import _write
from .test_ledger import ROW


def _rows(df):
    return sorted(map(str, df.collect()))


def _versions(pings, version="1"):
    return pings.select("file_name").distinct().withColumn("version", F.lit(version))


@pytest.fixture()
def world(spark, scratch):
    i = catalog.Inputs(spark, SF001)
    return i, os.path.join(scratch, "states"), membership.materialize(i.modelled.where("year in (1999, 2000)"))


def _equal_a_full_run(spark, i, out, pings):
    full = rollup.monthly_vessel_hours(pings, i.layers, S.hours_min_year, with_file=True)
    got = incremental.hours(spark, out, with_file=True)
    assert _rows(got) == _rows(full.select(got.columns))
    active = membership.materialize(FG.active_fleet(full, S.fleet_min_year))
    want = FG.both_fleets_effort(pings, i.layers, i.permits, active, S)
    have = incremental.both_fleets_effort(spark, out, i.layers, i.permits, active, S)
    assert want.count() > 0
    assert _rows(catalog.r6(have.select(want.columns), "effort")) == _rows(catalog.r6(want, "effort"))


def test_new_changed_and_withdrawn_files(spark, world, monkeypatch):
    i, out, pings = world
    seen = []
    made = incremental.partials
    monkeypatch.setattr(incremental, "partials", lambda p, *a: seen.append({r[0] for r in p.select("file_name").distinct().collect()}) or made(p, *a))
    first = pings.where("month <= 10")
    n = first.select("file_name").distinct().count()
    assert incremental.refresh(first, _versions(first), i.layers, out, S) == {"refreshed": n, "withdrawn": 0}
    _equal_a_full_run(spark, i, out, first)

    late = pings.select("file_name").distinct().count() - n
    assert incremental.refresh(pings, _versions(pings), i.layers, out, S) == {"refreshed": late, "withdrawn": 0}
    assert {f.split("_")[1] for f in seen[-1]} == {"11", "12"}                  # January to October were not read again
    _equal_a_full_run(spark, i, out, pings)
    assert incremental.refresh(pings, _versions(pings), i.layers, out, S) == {"refreshed": 0, "withdrawn": 0} and len(seen) == 2

    # one file is replaced by a part of itself, one loses all its pings, one is listed no more
    names = [r[0] for r in pings.select("file_name").distinct().orderBy("file_name").limit(3).collect()]
    now = pings.where((F.col("file_name") != names[0]) | (F.col("day") % 2 == 0)).where(~F.col("file_name").isin(names[1:]))
    versions = _versions(pings).where(F.col("file_name") != names[2]).withColumn(
        "version", F.when(F.col("file_name").isin(names[:2]), "2").otherwise("1"))
    assert incremental.refresh(now, versions, i.layers, out, S) == {"refreshed": 2, "withdrawn": 1}
    assert seen[-1] == {names[0]}
    _equal_a_full_run(spark, i, out, now)
    assert incremental.vacuum(spark, out) == 0                                  # every run still holds files
    again = _versions(pings, "3").where(~F.col("file_name").isin(names[1:]))
    incremental.refresh(now, again, i.layers, out, S)
    assert incremental.vacuum(spark, out) > 0
    _equal_a_full_run(spark, i, out, now)


def test_a_refresh_that_died_changes_nothing(spark, world, monkeypatch):
    i, out, pings = world
    first = pings.where("month = 1")
    incremental.refresh(first, _versions(first), i.layers, out, S)
    before = _rows(incremental.hours(spark, out, with_file=True))
    made = incremental.partials
    def dies(*a):
        yielded = made(*a)
        yielded["positions"] = yielded["positions"].withColumn("h", F.raise_error(F.lit("lost")).cast("long"))
        return yielded
    monkeypatch.setattr(incremental, "partials", dies)
    with pytest.raises(Exception, match="lost"):
        incremental.refresh(pings, _versions(pings), i.layers, out, S)
    monkeypatch.undo()
    assert os.path.exists(os.path.join(out, "hours", "run=2"))                  # written, not committed
    assert _rows(incremental.hours(spark, out, with_file=True)) == before
    incremental.refresh(pings, _versions(pings), i.layers, out, S)
    _equal_a_full_run(spark, i, out, pings)


def test_no_files_and_missing_names(spark, world):
    i, out, pings = world
    none = pings.limit(0)
    assert incremental.refresh(none, _versions(none), i.layers, out, S) == {"refreshed": 0, "withdrawn": 0}
    assert incremental.hours(spark, out).count() == 0 and incremental.state(spark, out, "positions").count() == 0
    nameless = pings.where("month = 2").withColumn("file_name", F.lit(None).cast("string"))
    assert incremental.refresh(nameless, _versions(nameless), i.layers, out, S) == {"refreshed": 1, "withdrawn": 0}
    want = rollup.monthly_vessel_hours(nameless, i.layers, S.hours_min_year, with_file=True)
    got = incremental.hours(spark, out, with_file=True)
    assert got.count() > 0 and _rows(got) == _rows(want.select(got.columns))


def test_more_names_than_the_filter_takes(spark, world, monkeypatch):
    i, out, pings = world
    monkeypatch.setattr(incremental, "FILTER_NAMES", 2)
    incremental.refresh(pings.where("month = 3"), _versions(pings.where("month = 3")), i.layers, out, S)
    _equal_a_full_run(spark, i, out, pings.where("month = 3"))


def test_states_follow_the_landing_ledger(spark, scratch):
    polys, raw, out, states = (os.path.join(scratch, n) for n in ("polys", "raw", "out", "states"))
    zone_polygons(spark).write.parquet(polys)
    _write(raw, "A.csv", [ROW.format(name="A", date="01/01/2022", speed=2)])
    ingest_raw(spark, raw, polys, out)
    assert refresh_states(spark, out, polys, states) == {"refreshed": 1, "withdrawn": 0}
    os.utime(os.path.join(raw, "A.csv"), (time.time() + 10, time.time() + 10))
    _write(raw, "B.csv", [ROW.format(name="B", date="20/01/2022", speed=2)])
    ingest_raw(spark, raw, polys, out)
    assert refresh_states(spark, out, polys, states) == {"refreshed": 1, "withdrawn": 0}      # A was touched only
    assert sorted(r.file_name for r in incremental.state(spark, states, "files").collect()) == ["A", "B"]
    _write(raw, "A.csv", [ROW.format(name="MOVED", date="01/03/2022", speed=2)])
    os.utime(os.path.join(raw, "A.csv"), (time.time() + 20, time.time() + 20))
    ingest_raw(spark, raw, polys, out)
    assert refresh_states(spark, out, polys, states) == {"refreshed": 1, "withdrawn": 0}
    got = {(r.vessel_name, r.month) for r in incremental.state(spark, states, "positions").collect()}
    assert got == {("MOVED", 3), ("B", 1)}
