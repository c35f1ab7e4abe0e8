"""Landing never loses pings: halves of a month, re-runs, restarts, later files, missing file names."""

import os
import tempfile

from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY, REFERENCE_STUDY
from vesselflow.operators import clean, rollup
from vesselflow.plans import figures as FG
from vesselflow.sources import io


def test_second_half_month_keeps_the_first(spark):
    out = os.path.join(tempfile.mkdtemp(), "pings")
    half = "select 2020 as year, 1 as month, '{f}' as file_name, {v} as v"
    for f, v in (("202001", 1), ("202002", 2), ("202002", 3)):       # the third replaces the second
        io.write_pings(spark.sql(half.format(f=f, v=v)), out)
    assert sorted((r.file_name, r.v) for r in spark.read.parquet(out).collect()) == [("202001", 1), ("202002", 3)]


def test_derived_tables_keep_no_stale_partition(spark):
    out = os.path.join(tempfile.mkdtemp(), "t")
    rows = spark.range(3).withColumn("year", F.col("id") + 2000)
    io.write_table(rows, out, ["year"], replace_all=True)
    io.write_table(rows.where("id = 0"), out, ["year"], replace_all=True)
    assert spark.read.parquet(out).count() == 1


def test_later_files_join_open_slices(spark):
    files = spark.createDataFrame([(f"{i:04d}",) for i in range(1, 501)], "file_name string")
    for study in (REFERENCE_STUDY, FIXTURE_STUDY):
        assert FG.file_slice(files, *study.other_fleet_files).count() == 499
        assert FG.file_slice(files, *study.after_files).count() == 500 - study.after_files[0] + 1


def test_missing_file_names_keep_their_rows(spark):
    df = spark.sql("select * from values ('a', 1), (null, 2), (null, 3) as t(file_name, v)")
    assert sorted(r.id for r in clean.row_ids(df.coalesce(1)).where("file_name is null").collect()) == [1, 2]
    pv = spark.sql("select * from values ('a', 2020, 1, 5), (null, 2020, 1, 7) as t(file_name, year, month, max_day)")
    assert rollup.file_dates(pv).count() == 2


def test_missing_landing_values_make_the_month_missing(spark):
    names = spark.sql("select 'V1' as vessel_name")
    land = spark.sql("""select * from values ('V1', date '2000-01-03', 2000d, 2d), ('V1', date '2000-02-03', null, 2d),
                        ('V1', date '2000-02-04', 2000d, 2d), ('V1', date '2000-03-04', 2000d, 0d) as t(vessel_name, date, catch, days_declared)""")
    plain = {r.month: r.cpue for r in FG.monthly_cpue(land, names, names, FIXTURE_STUDY).collect()}
    assert plain == {1: 1.0, 2: None, 3: None}
    ieee = {r.month: r.cpue for r in FG.monthly_cpue(land, names, names, FIXTURE_STUDY, ieee=True).collect()}
    assert ieee == {1: 1.0, 2: None, 3: float("inf")}


def test_default_stream_checkpoint_belongs_to_the_output():
    import inspect

    from vesselflow.streaming import ingest
    assert "_ingest_checkpoint" in inspect.getsource(ingest.start_ingest)
