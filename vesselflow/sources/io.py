"""Scans and sinks.

Raw half-month files are delimited text with a fixed schema; everything after
ingest is parquet.  Paths are directories; Spark lists them in parallel, so one
folder with hundreds of thousands of files is one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import schemas
from vesselflow.operators.clean import file_name_from_path


def read_raw_pings(spark: SparkSession, path: str | list, glob: str = "*.csv", recursive: bool = True,
                   with_corrupt: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """S1 + S2 + P6: every matching file under ``path`` with the fixed raw schema.
    Malformed lines are kept with their text in ``_corrupt_record`` (PERMISSIVE);
    ``source_file`` is the file path and ``source_block`` the split's first byte, from the scan metadata.  Each file's header is
    compared with the fixed schema (case does not matter): one in another order or with other names
    fails the scan, so that no value lands in the wrong column.  ``encoding`` covers files written as Latin-1."""
    schema = schemas.RAW_PINGS_WITH_CORRUPT if with_corrupt else schemas.RAW_PINGS
    r = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
         .option("encoding", encoding).option("enforceSchema", False)
         .option("recursiveFileLookup", recursive).option("pathGlobFilter", glob))
    if with_corrupt:
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    df = r.csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("source_block", F.col("_metadata.file_block_start"))


def read_table(spark: SparkSession, path: str, columns: list | None = None, where=None) -> DataFrame:
    """Parquet scan; selecting and filtering here lets the scan prune
    columns, row groups and partitions."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if where is not None:
        df = df.where(where)
    return df


def spread_small_scan(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a scan that yields fewer splits than the cluster has cores (a file with
    one huge row group) a round-robin spread, so the map-side work after it runs on
    every core.  Large inputs have many more splits than cores and pass unchanged;
    the split count is known at planning time (no job)."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:                      # remote session: no RDD view, leave the scan as it is
        return df
    return df.repartition(target) if n < target else df


def read_polygons(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Polygon layers stored as rows with a ring array (parquet or JSON lines)."""
    return spark.read.schema(schemas.POLYGONS).format(fmt).load(path)


def read_years(spark: SparkSession, path: str, years) -> DataFrame:
    """The landed pings of some years only (partition pruning on ``year``)."""
    return spark.read.parquet(path).where(F.col("year").isin(list(years)))


def write_table(df: DataFrame, path: str, partition_by: list | None = None, mode: str = "overwrite",
                replace_all: bool = False) -> None:
    """Parquet sink; with ``partition_by`` only the partitions present in
    ``df`` are replaced (dynamic partition overwrite), or with ``replace_all`` the whole table."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "static" if replace_all else "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_pings(pings: DataFrame, path: str) -> None:
    """Preprocessed pings partitioned by year, month and raw file, so landing a file replaces that
    file's rows and leaves the other half of its month alone.  ``file_name`` stays a column; its copy
    ``landed_file`` (prefixed, so that it is never read as a number) names the partition."""
    if "file_name" not in pings.columns:
        write_table(pings.sortWithinPartitions("year", "month"), path, ["year", "month"])
        return
    keyed = pings.withColumn("landed_file", F.concat(F.lit("f_"), F.coalesce("file_name", F.lit(""))))
    write_table(keyed.sortWithinPartitions("year", "month", "landed_file"), path, ["year", "month", "landed_file"])


def landed_partitions(spark: SparkSession, path: str) -> DataFrame | None:
    """(year, month, landed_file, folder) of the partitions that hold files; None if there is no table yet.  The file
    listing alone is read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")
    named = F.regexp_extract("path", r"/landed_file=([^/]+)/", 1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    files = files.where(F.col("path").rlike(r"/year=[^/]+/month=[^/]+/landed_file=[^/]+/"))
    return files.select(F.expr("try_cast(regexp_extract(path, '/year=([^/]+)/', 1) as int)").alias("year"),
                        F.expr("try_cast(regexp_extract(path, '/month=([^/]+)/', 1) as int)").alias("month"),
                        F.try_url_decode(F.regexp_replace(named, r"\+", "%2B")).alias("landed_file"), folder.alias("folder")).distinct()


def write_grids(cells: DataFrame, path: str, replace_all: bool = False) -> None:
    """Per-period cell tables named by fleet and period, overwriting only those (or all)."""
    write_table(cells, path, ["fleet", "period"], replace_all=replace_all)


def union_files(frames: list) -> DataFrame:
    """Row-bind per-file or per-fleet results by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def source_name(df: DataFrame, path_col: str = "source_file", out: str = "file_name") -> DataFrame:
    """P6 from a path column."""
    return df.withColumn(out, file_name_from_path(F.col(path_col)))
