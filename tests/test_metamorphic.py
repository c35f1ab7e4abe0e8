"""Metamorphic checks: layout changes nothing; the per-file grain is real."""

import datetime as dt

from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY
from vesselflow.operators import clean, order, rollup
from vesselflow.plans import catalog

from .conftest import SF001


def test_repartitioning_changes_nothing(spark):
    i = catalog.Inputs(spark, SF001)
    base = sorted(map(tuple, rollup.monthly_vessel_hours(i.modelled, i.layers, 1994).collect()))
    shuffled = i.modelled.repartition(7, F.rand(3)).orderBy(F.rand(5))
    again = sorted(map(tuple, rollup.monthly_vessel_hours(shuffled, i.layers, 1994).collect()))
    assert base == again


def test_splitting_a_file_changes_vessel_counts(spark):
    data = [("f1", 2001, 1, d, "A", -115.0, 10.0) for d in (1, 2)] + [("f1", 2001, 1, 3, "B", -115.0, 10.0)]
    p = spark.createDataFrame(
        [(f, y, m, d, dt.datetime(y, m, d, 1), v, lon, lat) for f, y, m, d, v, lon, lat in data],
        "file_name string, year int, month int, day int, date timestamp, vessel_name string, "
        "longitude double, latitude double")
    one = rollup.position_effort(rollup.position_hours(p, ["file_name"]), ["file_name"])
    split = p.withColumn("file_name", F.when(F.col("day") == 2, "f2").otherwise("f1"))
    two = rollup.position_effort(rollup.position_hours(split, ["file_name"]), ["file_name"])
    assert one.agg(F.sum("vessels")).first()[0] == 2
    assert two.agg(F.sum("vessels")).first()[0] == 3        # A is counted once per file (T1)
    assert one.agg(F.sum("hrs")).first()[0] == two.agg(F.sum("hrs")).first()[0]


def test_row_ids_dense_for_any_layout(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).cast("string").alias("file_name"), "id")
    df = df.repartition(9, F.rand(1))
    out = clean.row_ids(df.withColumnRenamed("id", "v"))
    got = out.groupBy("file_name").agg(F.min("id"), F.max("id"), F.count("id"), F.count_distinct("id")).collect()
    for r in got:
        assert r[1] == 1 and r[2] == r[3] == r[4]


def test_positions_are_a_total_order(spark):
    df = spark.range(0, 3000).select((F.col("id") % 997).cast("string").alias("k")).repartition(5)
    pos = order.positions(df, "k").collect()
    ranked = sorted(pos, key=lambda r: r["pos"])
    assert [r["pos"] for r in ranked] == list(range(1, 998))
    assert [r["k"] for r in ranked] == sorted(r["k"] for r in pos)
