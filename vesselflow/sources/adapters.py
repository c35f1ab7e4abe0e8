"""Domain tables derived from the driver's test tables (lineitem, supplier, events).

The test tables carry no vessel data, so each domain table is a fixed function of
them; the same rules exist as SQL text in ``vesselflow.plans.oracle`` for the
DuckDB cross-check.  Everything is a projection of a parquet scan: only the used
columns are read and the work grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.operators import geo
from vesselflow.operators.models import classify_by_speed
from vesselflow.sources import fixtures


def _d(x: float):
    return F.lit(float(x))


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Pruned scan of a test table, spread over the cores when the file is one row group."""
    from vesselflow.sources.io import spread_small_scan
    return spread_small_scan(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessed-ping shape without zones: one ping per lineitem row.

    ``id`` repeats across (orderkey, linenumber) collisions on purpose (ids are per file)."""
    li = _read(spark, sf_dir, "lineitem",
               "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    year, month, day = F.year("l_shipdate"), F.month("l_shipdate"), F.dayofmonth("l_shipdate")
    hour = ((pk * 7 + ln) % 24).cast("int")
    lon = (F.when(sk % 2 == 0, _d(-155) + ((pk * 131 + sk * 17) % 8000).cast("double") / _d(100))
            .otherwise(_d(-107) + ((pk * 131 + sk * 17) % 3200).cast("double") / _d(100)))
    lat = _d(-12) + ((pk * 89 + sk * 29) % 4700).cast("double") / _d(100)
    file_name = F.concat(year.cast("string"), F.lit("_"), F.lpad(month.cast("string"), 2, "0"), F.lit("_"),
                         F.when(day <= 15, "1").otherwise("2"))
    return li.select(
        (F.col("l_orderkey") * 8 + ln).alias("id"),
        year.alias("year"), month.alias("month"), day.alias("day"),
        F.make_timestamp(year, month, day, hour, F.lit(0), F.lit(0)).alias("date"),
        F.concat(F.lit("V"), sk.cast("string")).alias("vessel_name"),
        (F.lit(10000) + sk).cast("string").alias("RNP"),
        lon.alias("longitude"), lat.alias("latitude"),
        (F.col("l_quantity") / _d(5)).alias("speed"),
        ((pk * 13) % 360).cast("double").alias("direction"),
        file_name.alias("file_name"),
    )


_LAYERS: dict = {}


def zone_layers(spark: SparkSession) -> dict:
    """The three stand-in polygon layers prepared for point joins (built and
    measured once per session: they are constants)."""
    try:
        key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    except Exception:                      # remote session: no stable handle, rebuild each time
        return _build_layers(spark)
    if key not in _LAYERS:
        _LAYERS[key] = _build_layers(spark)
    return _LAYERS[key]


def _build_layers(spark: SparkSession) -> dict:
    polys = fixtures.zone_polygons(spark)
    return {
        "ocean": geo.prepare_layer(polys, "ocean", attrs=["pid", "name"]),
        "eez": geo.prepare_layer(polys, "eez", attrs=["pid", "name"]),
        "mpa": geo.prepare_layer(polys, "mpa", attrs=["pid", "name", "decree", "state", "municipality", "region"]),
    }


def modelled_pings(spark: SparkSession, sf_dir: str, layers: dict | None = None) -> DataFrame:
    """Pings with protected-area attributes (J3) and the speed-band fishing state."""
    layers = layers or zone_layers(spark)
    p = geo.attach_mpa(pings(spark, sf_dir), layers["mpa"])
    return classify_by_speed(p)


def fishing_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with the fishing state but without protected-area columns: the
    projection the area and grid plans read (a stored modelled table would give it
    by column pruning; here it skips recomputing a zone join nobody reads)."""
    return classify_by_speed(pings(spark, sf_dir))


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing declarations: names with a leading blank and sometimes an alias part,
    zero declared days on purpose."""
    li = _read(spark, sf_dir, "lineitem",
               "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    name = F.concat(F.lit(" V"), F.col("l_suppkey").cast("string"),
                    F.when(F.col("l_linenumber") % 3 == 0, F.lit(" (ALIAS")).otherwise(F.lit("")))
    return li.select(name.alias("vessel_name"), F.col("l_shipdate").cast("date").alias("date"),
                     F.col("l_extendedprice").alias("catch"),
                     (F.col("l_quantity").cast("int") % 11).cast("double").alias("days_declared"))


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select("s_suppkey")
    return s.where(F.col("s_suppkey") % 5 != 0).select(
        F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("vessel_name"))


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-file shape (Spanish headers, text date, text speed with a decimal comma),
    rendered from the same pings so the ingest path has real input."""
    p = pings(spark, sf_dir)
    return p.select(
        F.col("vessel_name").alias("Nombre"),
        F.col("RNP").cast("double").alias("RNP"),
        F.lit("PUERTO").alias("Puerto Base"),
        F.concat(F.lit("OWNER "), F.col("RNP")).alias("Permisionario o Concesionario"),
        F.date_format("date", C.RAW_TIMESTAMP_FORMAT).alias("Fecha"),
        F.col("latitude").alias("Latitud"), F.col("longitude").alias("Longitud"),
        F.regexp_replace(F.col("speed").cast("string"), r"\.", ",").alias("Velocidad"),
        F.col("direction").cast("string").alias("Rumbo"),
        F.col("file_name").alias("source_file"),
    )
