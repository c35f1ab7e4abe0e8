"""Raw files: scan, clean, per-file ids, sinks and the incremental stream."""

import os

import pytest
from pyspark.sql import functions as F

from vesselflow.operators import clean
from vesselflow.sources import io
from vesselflow.sources.fixtures import zone_polygons
from vesselflow.operators import geo

HEADER = "Nombre,RNP,Puerto Base,Permisionario o Concesionario,Fecha,Latitud,Longitud,Velocidad,Rumbo\n"


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(HEADER + "".join(l + "\n" for l in lines))


def _files(root):
    _write(os.path.join(root, "2022", "01"), "01-15 ENE 2022.csv", [
        'BARCO UNO,54213,MAZATLAN,EMPRESA,01/01/2022 05:10,18.5,-112.0,"12,5",90',
        "BARCO UNO,54213,MAZATLAN,EMPRESA,01/01/2022 06:10,18.6,-112.1,3 kn,91",
        "BARCO DOS,7,ENSENADA,OTRA,02/01/2022 07:00,31.0,-113.5,,",
        "BARCO DOS,7,ENSENADA,OTRA,31/02/2022 07:00,31.0,-113.5,2,10",
    ])
    _write(os.path.join(root, "2022", "01"), "16-31 ENE 2022.csv", [
        "BARCO UNO,54213,MAZATLAN,EMPRESA,16/01/2022 05:10,10.0,-100.0,1.5,90",
    ])
    _write(os.path.join(root, "2022", "01"), "notes.txt", ["ignored"])


def test_raw_scan_and_preprocess(spark, scratch):
    _files(scratch)
    raw = io.read_raw_pings(spark, scratch)
    p = clean.preprocess(raw, file_col="source_file")
    got = {(r["file_name"], r["id"]): r for r in p.collect()}
    assert len(got) == 5
    assert sorted(i for f, i in got if f == "01-15 ENE 2022") == [1, 2, 3, 4]
    speeds = sorted((r["speed"] for r in got.values()), key=lambda x: (x is None, x))
    assert speeds[:4] == [1.5, 2.0, 3.0, 12.5] and speeds[4] is None
    bad_dates = [r for r in got.values() if r["date"] is None]
    assert len(bad_dates) == 1                      # 31/02 is not a date
    assert {r["RNP"] for r in got.values()} == {"54213", "7"}
    assert {r["year"] for r in got.values() if r["date"] is not None} == {2022}


def test_sinks_partition(spark, scratch):
    df = spark.createDataFrame([(2001, 1, "a"), (2001, 2, "b")], "year int, month int, v string")
    out = os.path.join(scratch, "pings")
    io.write_pings(df, out)
    assert sorted(os.listdir(os.path.join(out, "year=2001"))) == ["month=1", "month=2"]
    io.write_pings(df.where("month = 2").withColumn("v", F.lit("c")), out)    # dynamic overwrite
    back = {(r["month"], r["v"]) for r in io.read_years(spark, out, [2001]).collect()}
    assert back == {(1, "a"), (2, "c")}


def test_stream_ingest_available_now(spark, scratch):
    from vesselflow.streaming.ingest import start_ingest
    landing = os.path.join(scratch, "landing")
    _files(landing)
    mpa = geo.prepare_layer(zone_polygons(spark), "mpa", ["pid", "name", "decree", "state", "municipality", "region"])
    out = os.path.join(scratch, "clean")
    q = start_ingest(spark, landing, out, mpa, checkpoint=os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 5
    assert df.where("vessel_state = 'hauling'").count() == 3
    zones = {r["zone"] for r in df.collect()}
    assert "Revillagigedo" in zones and "open area" in zones


def test_year_scope_prunes_partitions(spark, scratch):
    df = spark.createDataFrame([(y, m, float(y)) for y in (2000, 2001, 2002) for m in (1, 2)],
                               "year int, month int, v double")
    out = os.path.join(scratch, "landed")
    io.write_pings(df, out)
    scoped = io.read_years(spark, out, [2001]).select("month", "v").where(F.col("v") > 0)
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2001" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,0.0)]" in plan
    assert scoped.count() == 2


def test_batch_ingest_job(spark, scratch):
    from vesselflow.plans.study import ingest_raw
    from vesselflow.sources.fixtures import ports
    raw = os.path.join(scratch, "raw")
    _files(raw)
    polys = os.path.join(scratch, "polys")
    zone_polygons(spark).write.parquet(polys)
    prt = os.path.join(scratch, "ports")
    ports(spark).write.parquet(prt)
    out = ingest_raw(spark, raw, polys, os.path.join(scratch, "modelled"), ports=prt)
    df = spark.read.parquet(out)
    assert df.count() == 5
    assert {"id", "zone", "location", "vessel_state", "file_name", "year", "month"} <= set(df.columns)
    assert sorted(r["id"] for r in df.where("file_name = '01-15 ENE 2022'").collect()) == [1, 2, 3, 4]


def test_latin1_and_header_case(spark, scratch):
    folder = os.path.join(scratch, "latin1")
    os.makedirs(folder)
    with open(os.path.join(folder, "f.csv"), "w", encoding="latin-1") as f:
        f.write(HEADER.replace("Puerto Base", "Puerto base"))
        f.write("PEÑASCO UNO,1,PUERTO PEÑASCO,DUEÑO,01/01/2022 05:10,18.5,-112.0,3,90\n")
    r = io.read_raw_pings(spark, folder, encoding="ISO-8859-1").first()
    assert r["Nombre"] == "PEÑASCO UNO" and r["Puerto Base"] == "PUERTO PEÑASCO"


def test_reordered_header_fails_the_scan(spark, scratch):
    folder = os.path.join(scratch, "reordered")
    os.makedirs(folder)
    with open(os.path.join(folder, "f.csv"), "w", encoding="utf-8") as f:
        f.write(HEADER.replace("Latitud,Longitud", "Longitud,Latitud"))
        f.write("BARCO UNO,1,MAZATLAN,EMPRESA,01/01/2022 05:10,-112.0,18.5,3,90\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_raw_pings(spark, folder).select("Latitud", "Longitud").collect()


def test_stream_restart_processes_only_new_files(spark, scratch):
    from vesselflow.streaming.ingest import start_ingest
    landing = os.path.join(scratch, "landing2")
    out = os.path.join(scratch, "clean2")
    ckpt = os.path.join(scratch, "ckpt2")
    _files(landing)
    mpa = geo.prepare_layer(zone_polygons(spark), "mpa", ["pid", "name", "decree", "state", "municipality", "region"])
    start_ingest(spark, landing, out, mpa, checkpoint=ckpt).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    _write(os.path.join(landing, "2022", "02"), "01-15 FEB 2022.csv",
           ["BARCO TRES,9,MAZATLAN,EMPRESA,02/02/2022 05:10,18.5,-112.0,2,90"])
    start_ingest(spark, landing, out, mpa, checkpoint=ckpt).awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 6                                   # the first five are not read again
    assert df.where("vessel_name = 'BARCO TRES'").count() == 1
