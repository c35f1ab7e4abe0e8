"""Landing with a ledger: batch, stream, replay and replaced files all give the same table (S9, Q1), and rejected lines are kept.

The ledger is an append-only parquet folder inside the output (``_ledger``; readers skip names that begin with an
underscore).  A commit appends one row per landed file: name, path, length, modified time, fingerprint of its lines, counts of good and
rejected lines.  The latest commit of a path is its state.  A listing is compared with the states by an anti-join:

* unseen or changed files are landed; a file that was only touched (same fingerprint) is committed without being read again;
* all paths of one file name land together, since a name is a partition of the table (``landed_file``);
* a replaced file's rows in other months are retracted after its new rows are written.

Rows are written before the commit and every step can be repeated, so a run that dies midway is mended by the next one.  The stream
only discovers files; it lands them through the same function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import schemas
from vesselflow.operators.clean import file_name_from_path
from vesselflow.operators.membership import materialize
from vesselflow.sources import io

LEDGER, REJECTS = "_ledger", "_rejects"
SCHEMA = ("file_name string, path string, length long, modified timestamp, lines long, fingerprint decimal(38,0), "
          "n_good long, n_rejected long, commit long")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The state of every path that was ever landed: its latest commit."""
    path = f"{out.rstrip('/')}/{LEDGER}"
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "commit").alias("r"))
    return last.select("r.*")


def listing(spark: SparkSession, raw_dir: str, glob: str = "*.csv") -> DataFrame:
    """(file_name, path, length, modified) of every raw file, from the file listing: no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(raw_dir)
    return files.select(file_name_from_path(F.col("path")).alias("file_name"), "path", "length", F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, lines, fingerprint): the sum of the hashes of a file's lines, pre-aggregated in every split, so a file of any size is never one task."""
    if not paths:
        return spark.createDataFrame([], "path string, lines long, fingerprint decimal(38,0)")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.xxhash64("value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("fingerprint"))


def rejected() -> Column:
    """Whether the reader could not fit a line to the schema.  It judges only the columns that a plan reads, so an empty piece of
    every raw column is part of the test: a line is good or rejected whatever is selected later."""
    pieces = [F.substring(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), 1, 0) for c in schemas.RAW_PINGS.names]
    return F.length(F.concat(F.coalesce("_corrupt_record", F.lit("")), *pieces)) > 0


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of one scan.  A line is rejected when the reader could not fit it to the schema; it is kept with its
    file, the byte at which its split starts and its first field."""
    bad = rejected()
    return (raw.where(~bad).drop("_corrupt_record"),
            raw.where(bad).select("source_file", "source_block", F.col("Nombre").alias("first_field"), F.col("_corrupt_record").alias("line")))


def reject_counts(raw: DataFrame) -> DataFrame:
    """(source_file, n_lines, n_good, n_rejected, n_named) of every file with a line; good and rejected lines add up to the lines, n_named of them
    name a vessel."""
    bad = rejected()
    return raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(~bad, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_rejected"),
                                          F.count("Nombre").alias("n_named"))


def _retract(spark: SparkSession, out: str, kept: DataFrame, names: DataFrame) -> int:
    """Delete the partitions of the files ``names`` that ``kept`` (year, month, landed_file) does not list; their number."""
    found = io.landed_partitions(spark, out)
    if found is None:
        return 0
    found = found.join(names.select(F.concat(F.lit("f_"), "file_name").alias("landed_file")), "landed_file", "left_semi")
    # Rows without a date have a partition too: missing years and months are equal to each other here.
    same = found["landed_file"] == kept["landed_file"]
    for c in ("year", "month"):
        same = same & found[c].eqNullSafe(kept[c])
    stale = found.join(kept, same, "left_anti")
    gone = [r["folder"] for r in stale.select("folder").collect()]          # partitions of the files landed now
    for folder in gone:
        fs, p = _fs(spark, folder)
        fs.delete(p, True)
    return len(gone)


def land(spark: SparkSession, raw_dir: str, out: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*.csv",
         only: DataFrame | None = None, encoding: str = "UTF-8") -> dict:
    """Land the unseen and changed files of ``raw_dir`` in ``out`` (or those of them that ``only`` (path) names, with the other paths of their
    names).  ``transform`` turns good raw rows into pings with year, month and file_name."""
    if exists(spark, f"{out.rstrip('/')}/_spark_metadata"):
        raise ValueError(f"{out} was written by a streaming file sink; its readers would not see landed files")
    files, known = listing(spark, raw_dir, glob), materialize(ledger(spark, out))
    seen = known.select("path", "length", "modified")
    fresh = files.join(seen, ["path", "length", "modified"], "left_anti")
    if only is not None:
        fresh = fresh.join(only.select("path").distinct(), "path", "left_semi")
    fresh = materialize(fresh)
    prints = materialize(fingerprints(spark, [r["path"] for r in fresh.select("path").collect()]))
    fresh = fresh.withColumn("path_key", F.col("path")).join(prints.withColumnRenamed("path", "path_key"), "path_key", "left").drop("path_key")
    fresh = materialize(fresh.select("file_name", "path", "length", "modified", F.coalesce("lines", F.lit(0)).alias("lines"),
                                     F.coalesce("fingerprint", F.lit(0)).cast("decimal(38,0)").alias("fingerprint")))
    same = known.select("path", "length", "lines", "fingerprint", "n_good", "n_rejected")
    touched = materialize(fresh.join(same, ["path", "length", "lines", "fingerprint"]))
    changed = fresh.join(touched.select("path"), "path", "left_anti")
    names = materialize(changed.select("file_name").distinct())
    number = 1 + (known.agg(F.max("commit")).first()[0] or 0)
    together = materialize(files.join(names, "file_name", "left_semi"))
    paths = [r["path"] for r in together.select("path").collect()]
    counts = spark.createDataFrame([], "path string, n_good long, n_rejected long")
    retracted = 0
    if paths:
        raw = io.read_raw_pings(spark, paths, glob, encoding=encoding)
        good, bad = split_rejects(raw)
        io.write_pings(transform(good).drop("source_file", "source_block"), out)
        rejects = bad.withColumn("landed_file", F.concat(F.lit("f_"), file_name_from_path(F.col("source_file"))))
        io.write_table(rejects, f"{out.rstrip('/')}/{REJECTS}", ["landed_file"])
        counts = reject_counts(raw).select(F.col("source_file").alias("path"), "n_good", "n_rejected")
        months = transform(good).select("year", "month", F.concat(F.lit("f_"), F.coalesce("file_name", F.lit(""))).alias("landed_file")).distinct()
        retracted = _retract(spark, out, materialize(months), names)
    whole = together.join(fresh.select("path", "lines", "fingerprint"), "path", "left").join(
        known.select("path", F.col("lines").alias("l0"), F.col("fingerprint").alias("f0")), "path", "left").join(counts, "path", "left")
    whole = whole.select("file_name", "path", "length", "modified", F.coalesce("lines", "l0").alias("lines"), F.coalesce("fingerprint", "f0").alias("fingerprint"),
                         F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))
    entry = materialize(whole.unionByName(touched).withColumn("commit", F.lit(number).cast("long")))
    landed, n_touched = entry.count(), touched.count()
    if landed:
        entry.write.mode("append").parquet(f"{out.rstrip('/')}/{LEDGER}")
    return {"landed": landed - n_touched, "touched": n_touched, "retracted": retracted}
