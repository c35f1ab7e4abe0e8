"""Fixed schemas of the domain tables (never inferred)."""

from pyspark.sql import types as T

RAW_PINGS = T.StructType([
    T.StructField("Nombre", T.StringType()),
    T.StructField("RNP", T.StringType()),
    T.StructField("Puerto Base", T.StringType()),
    T.StructField("Permisionario o Concesionario", T.StringType()),
    T.StructField("Fecha", T.StringType()),
    T.StructField("Latitud", T.DoubleType()),
    T.StructField("Longitud", T.DoubleType()),
    T.StructField("Velocidad", T.StringType()),
    T.StructField("Rumbo", T.StringType()),
])

RAW_PINGS_WITH_CORRUPT = T.StructType(RAW_PINGS.fields + [T.StructField("_corrupt_record", T.StringType())])

PINGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("vessel_name", T.StringType()),
    T.StructField("RNP", T.StringType()),
    T.StructField("port_base", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("direction", T.DoubleType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("mpa_decree", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("municipality", T.StringType()),
    T.StructField("region", T.StringType()),
])

MONTH_VESSEL_HRS = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("vessel_name", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("hrs", T.LongType()),
])

AREAS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("area", T.DoubleType()),
    T.StructField("revi", T.StringType()),
])

LANDINGS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("vessel_name", T.StringType()),
    T.StructField("catch", T.DoubleType()),
    T.StructField("days_declared", T.DoubleType()),
])

PERMITS = T.StructType([T.StructField("vessel_name", T.StringType())])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

POLYGONS = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("layer", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("decree", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("municipality", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("ring", T.ArrayType(POINT)),
])

PORTS = T.StructType([
    T.StructField("port", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])

GRID_CELLS = T.StructType([
    T.StructField("fleet", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

SERIES = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("t", T.IntegerType()),
    T.StructField("y", T.DoubleType()),
])
