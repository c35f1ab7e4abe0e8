"""SparkSession construction and the few session settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library assumes: UTC calendar arithmetic, ANSI
# semantics (undefined values come from explicit try_* calls, never silently),
# and adaptive execution so joins/aggregations re-plan on runtime sizes.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Starting points for a large cluster (not forced; pass as ``extra`` or via spark-submit).
# Many shuffle partitions that AQE coalesces to ~256 MB keep every reduce task
# within executor memory at 100 TB; skewed partitions above 5x the median are split.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vesselflow", extra: dict | None = None) -> SparkSession:
    """Local/test session builder.  On a cluster, pass ``master=None`` and let
    spark-submit supply master, memory and ``spark.checkpoint.dir``."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in CORE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's value always wins.  Only when it is unset (local runs,
    tests) a fresh scratch folder is created and registered."""
    try:
        sc = spark.sparkContext
    except Exception:                      # remote (Connect) session: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    path = tempfile.mkdtemp(prefix="vesselflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vesselflow`` importable in the Python workers that run grouped-map
    functions (once per application).  A zip of the package's sources is added with
    ``addPyFile``, which Spark distributes to every executor; on a cluster where the
    package is installed on the executors (or passed with ``--py-files``) this is a
    harmless duplicate."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:                      # remote session: the server side provides the package
        return
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="vesselflow-pkg-"), "vesselflow.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
