"""Partial states per landed file, so that a new half-month refreshes only itself (Q4, Q8-Q10).

Every rollup of the analysis starts at the grain of one raw file.  Two tables hold what a file contributes, and both are exact:

* ``hours`` -- hours per file, month, vessel and zone (the whole of Q4);
* ``positions`` -- hours and last day per file, month, vessel and position.  The fleets are not applied yet, since the list of
  active vessels changes with every landed file; the area plans start from these rows instead of the pings.
* ``files`` -- pings per file, which fixes the sorted file list of the slices.

A refresh compares the landed versions with the committed ones by an anti-join, computes the states of unseen and changed files only, writes them
into a folder of its own (``run=N``) and appends one commit row per file.  Readers take the rows of each file's last commit, so a refresh
that dies changes nothing for them, and its folder is written again by the next one.  One writer at a time is assumed.

Defined results: a file without pings is committed with no rows; a file that is listed no more is withdrawn; the same version again costs the
anti-join alone; a missing file name counts as a file with an empty name for the versions.  The states hold the zones and the first
year of hours they were made with: other polygons or another study need another folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.constants import Study
from vesselflow.functions import safe_date
from vesselflow.operators import grid, membership, order, rollup
from vesselflow.plans import figures as FG
from vesselflow.sources import landing

COMMITS = "_commits"
COMMIT_SCHEMA = "file_name string, version string, run long"
STATES = {
    "hours": "file_name string, year int, month int, vessel_name string, zone string, hrs long",
    "positions": "file_name string, year int, month int, longitude double, latitude double, vessel_name string, h long, max_day int",
    "files": "file_name string, n_pings long",
}
# File names that go into the scan's filter as values, where they prune partitions; more are joined.
FILTER_NAMES = 1000


def commits(spark: SparkSession, out: str) -> DataFrame:
    """(file_name, version, run): the last commit of every file; ``version`` is missing for a withdrawn one."""
    path = f"{out.rstrip('/')}/{COMMITS}"
    if not landing.exists(spark, path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    rows = spark.read.schema(COMMIT_SCHEMA).parquet(path)
    return rows.groupBy("file_name").agg(F.max_by("version", "run").alias("version"), F.max("run").alias("run"))


def landed_versions(spark: SparkSession, landed: str) -> DataFrame:
    """(file_name, version) from the landing ledger: what was read, not when, so a touched file keeps its version."""
    one = F.concat_ws(":", "path", F.col("lines").cast("string"), F.col("fingerprint").cast("string"))
    return landing.ledger(spark, landed).groupBy("file_name").agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list(one)))).alias("version"))


def _of_files(pings: DataFrame, names: DataFrame) -> DataFrame:
    listed = [r[0] for r in names.limit(FILTER_NAMES + 1).collect()]
    if len(listed) > FILTER_NAMES:
        return membership.keep_in(pings, names, col="file_name")
    if "landed_file" in pings.columns:                      # the partition of the landed table
        return pings.where(F.col("landed_file").isin([f"f_{n}" for n in listed]))
    return pings.where(F.coalesce("file_name", F.lit("")).isin(listed))


def partials(pings: DataFrame, layers: dict, min_year: int) -> dict:
    """The state tables of some files' modelled pings."""
    positions = rollup.position_hours(rollup.hauling(pings), ["file_name", "year", "month"])
    made = {"hours": rollup.monthly_vessel_hours(pings, layers, min_year, with_file=True), "positions": positions,
            "files": pings.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_pings"))}
    return {name: made[name].selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")])
            for name, schema in STATES.items()}


def refresh(pings: DataFrame, versions: DataFrame, layers: dict, out: str, study: Study) -> dict:
    """Bring the states in ``out`` to ``versions`` (file_name, version) of the modelled ``pings``; counts of refreshed and withdrawn files."""
    spark, out = pings.sparkSession, out.rstrip("/")
    known = membership.materialize(commits(spark, out))
    listed = membership.materialize(versions.select(F.coalesce("file_name", F.lit("")).alias("file_name"), "version"))
    stale = membership.materialize(listed.join(known, ["file_name", "version"], "left_anti"))
    withdrawn = known.where("version is not null").join(listed, "file_name", "left_anti").select("file_name")
    run = 1 + (known.agg(F.max("run")).first()[0] or 0)
    changed = membership.materialize(stale.unionByName(withdrawn.withColumn("version", F.lit(None).cast("string"))))
    n_stale, n_all = stale.count(), changed.count()
    if n_all == 0:
        return {"refreshed": 0, "withdrawn": 0}
    if n_stale:
        for name, rows in partials(_of_files(pings, stale.select("file_name")), layers, study.hours_min_year).items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/run={run}")
    changed.select("file_name", "version", F.lit(run).cast("long").alias("run")).coalesce(1).write.mode("append").parquet(f"{out}/{COMMITS}")
    return {"refreshed": n_stale, "withdrawn": n_all - n_stale}


def state(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of a state table, each file's from its last commit."""
    path = f"{out.rstrip('/')}/{name}"
    if not landing.exists(spark, path):
        return spark.createDataFrame([], STATES[name])
    live = membership.materialize(commits(spark, out).where("version is not null").select(F.col("file_name").alias("_f"), F.col("run").alias("_r")))
    rows = spark.read.schema(f"{STATES[name]}, run long").option("basePath", path).parquet(path)
    same = (F.coalesce("file_name", F.lit("")) == F.col("_f")) & (F.col("run") == F.col("_r"))
    return rows.join(membership.bounded(live), same, "left_semi").drop("run")


def vacuum(spark: SparkSession, out: str) -> int:
    """Delete the folders of runs that no file's last commit names; their number.  Not while a reader is at work."""
    live = {r[0] for r in commits(spark, out).where("version is not null").select("run").distinct().collect()}
    gone = 0
    for name in STATES:
        fs, folder = landing._fs(spark, f"{out.rstrip('/')}/{name}")
        for s in fs.listStatus(folder) if fs.exists(folder) else ():
            number = s.getPath().getName().removeprefix("run=")
            if number.isdigit() and int(number) not in live:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone


def hours(spark: SparkSession, out: str, with_file: bool = False) -> DataFrame:
    """Q4 from the states."""
    h = state(spark, out, "hours")
    return h if with_file else h.drop("file_name")


def both_fleets_effort(spark: SparkSession, out: str, layers: dict, permits: DataFrame, active: DataFrame, study: Study) -> DataFrame:
    """``figures.both_fleets_effort`` from the states: no ping is read."""
    names = membership.bounded(FG.both_fleets(permits, active).withColumnRenamed("vessel_name", "_name"))
    positions = state(spark, out, "positions")
    pv = positions.join(names, positions["vessel_name"].eqNullSafe(names["_name"])).drop("_name")
    days = pv.groupBy("revi", "file_name").agg(F.max("max_day").alias("_last"))
    if study.other_fleet_files:
        ranked = order.positions(state(spark, out, "files"), "file_name", "_pos", materialize=False)
        files = FG.file_slice(positions, *study.other_fleet_files, positions=ranked)
        no = FG.in_files(days.where(F.col("revi") == C.FLEET_NO), files, FG.slice_rows(*study.other_fleet_files))
        days = days.where(F.col("revi") == C.FLEET_YES).unionByName(no)
    raster = ["revi", "file_name"]
    pv = rollup.with_last_day(pv, membership.materialize(days), raster)
    return FG.effort_of_positions(pv.withColumn("date", safe_date(F.col("year"), F.col("month"), F.col("_last"))), layers, raster)


def area_results(spark: SparkSession, out: str, layers: dict, permits: DataFrame, active: DataFrame, study: Study) -> DataFrame:
    """Q10 from the states."""
    effort = both_fleets_effort(spark, out, layers, permits, active, study)
    return grid.file_area(effort, by=("revi",)).select("date", "area", "revi")
