"""Batch, stream, replays, changed, touched and moved files all give the same table; rejected lines are kept; ids do not depend on the splits."""

import itertools
import os
import time

import pytest

from vesselflow.operators import clean, geo
from vesselflow.plans.study import ingest_raw
from vesselflow.sources import io, landing
from vesselflow.sources.fixtures import zone_polygons
from vesselflow.streaming.ingest import start_ingest

from .test_io import _write

ROW = "{name},1,MAZATLAN,EMPRESA,{date} 05:10,18.5,-112.0,{speed},90"
ATTRS = ["pid", "name", "decree", "state", "municipality", "region"]


def _first(raw):
    _write(os.path.join(raw, "2022"), "A.csv", [ROW.format(name=f"A{i}", date="01/01/2022", speed=2) for i in range(4)])


def _dateless(raw):
    _write(os.path.join(raw, "2022"), "D.csv", [ROW.format(name="D", date="31/02/2022", speed=2)])


def _second(raw):
    _write(os.path.join(raw, "2022"), "B.csv", [ROW.format(name=f"B{i}", date="20/01/2022", speed=9) for i in range(3)] + ["X,1,P,E,01/01/2022 05:10,north,-112.0,3,90"])


def _table(spark, out):
    cols = sorted(spark.read.parquet(out).columns)
    return sorted(map(tuple, spark.read.parquet(out).selectExpr(*[f"string({c})" for c in cols]).collect()))


@pytest.fixture()
def places(spark, scratch):
    polys = os.path.join(scratch, "polys")
    zone_polygons(spark).write.parquet(polys)
    mpa = geo.prepare_layer(zone_polygons(spark), "mpa", ATTRS)
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    batch = lambda: ingest_raw(spark, raw, polys, out)
    stream = lambda: start_ingest(spark, raw, out, mpa).awaitTermination(120)
    return raw, out, batch, stream


@pytest.mark.parametrize("order", list(itertools.product(("batch", "stream"), repeat=2)))
def test_batch_and_stream_in_any_order(spark, places, order):
    raw, out, batch, stream = places
    run = {"batch": batch, "stream": stream}
    _first(raw)
    run[order[0]]()
    assert spark.read.parquet(out).count() == 4
    _second(raw)
    run[order[1]]()
    assert spark.read.parquet(out).count() == 7
    before = _table(spark, out)
    run[order[0]]()                                                           # a replay changes nothing
    assert _table(spark, out) == before
    state = {r.file_name: (r.n_good, r.n_rejected, r.commit) for r in landing.ledger(spark, out).collect()}
    assert state == {"A": (4, 0, 1), "B": (3, 1, 2)}
    kept = spark.read.parquet(f"{out}/{landing.REJECTS}").collect()
    assert [(r.landed_file, "north" in r.line) for r in kept] == [("f_B", True)]
    assert sorted(r.id for r in spark.read.parquet(out).where("file_name = 'B'").collect()) == [1, 2, 3]


def test_changed_touched_and_moved_files(spark, places):
    raw, out, batch, stream = places
    _first(raw)
    _second(raw)
    batch()
    path = os.path.join(raw, "2022", "A.csv")
    os.utime(path, (time.time() + 10, time.time() + 10))                      # touched: committed, not read
    batch()
    assert {r.file_name: r.commit for r in landing.ledger(spark, out).collect()} == {"A": 2, "B": 1}
    _write(os.path.join(raw, "2022"), "A.csv", [ROW.format(name="MOVED", date="01/03/2022", speed=2)])
    os.utime(path, (time.time() + 20, time.time() + 20))
    batch()                                                                   # its January rows are retracted
    rows = spark.read.parquet(out).where("file_name = 'A'").collect()
    assert [(r.vessel_name, r.month) for r in rows] == [("MOVED", 3)] and spark.read.parquet(out).count() == 4
    before = _table(spark, out)
    stream()
    assert _table(spark, out) == before
    _dateless(raw)                                                            # a row without a date has a partition of its own
    batch()
    assert spark.read.parquet(out).where("file_name = 'D' and date is null").count() == 1 and spark.read.parquet(out).count() == 5


def test_a_run_that_died_before_its_commit_is_mended(spark, places, monkeypatch):
    raw, out, batch, _ = places
    _first(raw)
    monkeypatch.setattr(landing, "_retract", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        batch()
    monkeypatch.undo()
    batch()
    assert spark.read.parquet(out).count() == 4 and landing.ledger(spark, out).count() == 1


def test_a_streaming_sinks_folder_is_refused(spark, places):
    raw, out, batch, _ = places
    _first(raw)
    os.makedirs(os.path.join(out, "_spark_metadata"))
    with pytest.raises(ValueError, match="streaming file sink"):
        batch()


def test_ids_do_not_depend_on_the_splits(spark, scratch):
    folder = os.path.join(scratch, "raw")
    _write(folder, "A.csv", [ROW.format(name=f"A{i}", date="01/01/2022", speed=2) for i in range(400)])
    _write(folder, "B.csv", [ROW.format(name=f"B{i}", date="01/01/2022", speed=2) for i in range(90)])
    seen, splits = [], []
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for limit in ("64m", "9k", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            raw = io.read_raw_pings(spark, folder)
            splits.append(raw.select("source_file", "source_block").distinct().count())
            got = clean.preprocess(raw.drop("_corrupt_record"), file_col="source_file")
            seen.append(sorted((r.file_name, r.id, r.vessel_name) for r in got.select("file_name", "id", "vessel_name").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(set(splits)) > 1 and seen[0] == seen[1] == seen[2]
    assert [x[2] for x in seen[0] if x[0] == "A"] == [f"A{i}" for i in range(400)]


def test_reject_counts_add_up(spark, scratch):
    _second(os.path.join(scratch, "raw"))
    raw = io.read_raw_pings(spark, os.path.join(scratch, "raw"))
    good, bad = landing.split_rejects(raw)
    assert [(r.n_lines, r.n_good, r.n_rejected) for r in landing.reject_counts(raw).collect()] == [(4, 3, 1)]
    assert good.count() == 3 and bad.count() == 1
