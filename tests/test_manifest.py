"""Every listed file has a row and a reason, an empty file and an emptied one as well."""

from pyspark.sql import functions as F

from vesselflow.constants import FIXTURE_STUDY as S
from vesselflow.plans import catalog
from vesselflow.plans import figures as FG

SF = "/root/testdata/sf0.001"


def test_files_that_end_without_area_keep_a_row(spark):
    i = catalog.Inputs(spark, SF)
    names = sorted(r.file_name for r in i.fishing.select("file_name").distinct().collect())
    still, steaming, alien, ashore = names[3], names[4], names[5], names[6]
    pings = (i.fishing.withColumn("vessel_state", F.when(F.col("file_name") == steaming, "steaming").otherwise(F.col("vessel_state")))
             .withColumn("vessel_name", F.when(F.col("file_name") == alien, "nobody").otherwise(F.col("vessel_name")))
             .withColumn("longitude", F.when(F.col("file_name") == ashore, 0.0).otherwise(F.col("longitude"))).where(F.col("file_name") != still))
    files = i.fishing.select("file_name").union(spark.sql("select 'never read'"))
    got = {(r.file_name, r.revi): r for r in FG.file_manifest(files, pings, i.layers, i.permits, i.active, S).collect()}
    assert len(got) == 2 * (len(names) + 1)
    for revi in ("yes", "no"):
        reasons = {n: got[n, revi].reason for n in ("never read", still, steaming, alien, ashore)}
        assert reasons == {"never read": "empty", still: "empty", steaming: "no hauling", alien: "other fleet", ashore: "no used cell"} or got[ashore, revi].n_fleet == 0
        assert all(got[n, revi].area is None for n in reasons)
    assert got[names[0], "no"].reason in ("outside slice", "other fleet") and any(r.reason == "used" and r.area > 0 for r in got.values())
