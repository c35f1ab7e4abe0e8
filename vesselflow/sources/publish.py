"""Publication of a whole run at once (S7, S8): versioned folders and one pointer that is switched last.

A run writes all its tables below ``<out>/_versions/<version>``.  Only when every table is there does the pointer
``<out>/_current`` name that version, by one rename that replaces the old pointer.  Readers resolve the pointer, so they see
the tables of one run, never half of two; a run that dies leaves the pointer, and its folder is not read by anyone.

Defined results: an output without a pointer is an error for readers; a pointer to a version whose folder is gone is an
error that names it; two runs at once publish two versions, and the pointer names the one that ended last; nothing deletes
an earlier version, for readers may still be on it (``stale`` lists what may go).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER, VERSIONS = "_current", "_versions"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def new_version() -> str:
    """A name that sorts by time and that no other run has."""
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:8]


def _switch(spark: SparkSession, out: str, version: str) -> None:
    jvm = spark._jvm
    tmp, to = _path(spark, f"{out}/{POINTER}.{version}"), _path(spark, f"{out}/{POINTER}")
    stream = _fs(spark, out).create(tmp, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.makeQualified(_fs(spark, out).getUri(), to).toUri(), conf).rename(tmp, to, options)


def publish(spark: SparkSession, out: str, write: Callable[[str], object]) -> str:
    """Run ``write(folder)`` on a new version's folder and switch to it if it returns; the version's name."""
    version = new_version()
    write(f"{out}/{VERSIONS}/{version}")
    _switch(spark, out, version)
    return version


def current(spark: SparkSession, out: str) -> str:
    """The folder that the pointer names."""
    fs, pointer = _fs(spark, out), _path(spark, f"{out}/{POINTER}")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published in {out}")
    stream = fs.open(pointer)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    folder = f"{out}/{VERSIONS}/{version}"
    if not fs.exists(_path(spark, folder)):
        raise FileNotFoundError(f"{out} names version {version}, whose folder is gone")
    return folder


def read_published(spark: SparkSession, out: str, *names: str) -> list[DataFrame]:
    """Tables of the published run, all of one version."""
    folder = current(spark, out)
    return [spark.read.parquet(f"{folder}/{name}") for name in names]


def stale(spark: SparkSession, out: str) -> list[str]:
    """Version folders that the pointer does not name and that are older than the one it names."""
    now = current(spark, out).rsplit("/", 1)[1]
    found = [s.getPath().getName() for s in _fs(spark, out).listStatus(_path(spark, f"{out}/{VERSIONS}"))]
    return sorted(f"{out}/{VERSIONS}/{v}" for v in found if v < now)
