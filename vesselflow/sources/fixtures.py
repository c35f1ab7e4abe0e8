"""Zone polygons and ports used with the driver's test tables.

The study's own layers (an ocean mask, exclusive economic zones, protected
areas) are external files; these stand-ins have the same roles and columns.
Coordinates are (lon, lat) vertices of closed rings (closing edge implied).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vesselflow import schemas

# --- fixed values: stand-in zone layers -----------------------------------------------------
# (pid, layer, name, decree, state, municipality, region, ring)
ZONE_POLYGONS = [
    (1, "ocean", "Eastern Pacific", None, None, None, None,
     [(-150, -10), (-80, -10), (-80, 5), (-95, 15), (-105, 20), (-115, 32), (-150, 32)]),
    (2, "eez", "Mexican Pacific Exclusive Economic Zone", None, None, None, None,
     [(-120, 12), (-92, 12), (-95, 16), (-106, 23), (-117, 32), (-122, 28)]),
    (3, "mpa", "Revillagigedo", "PN", "Colima", "Manzanillo", "Pacifico Centro",
     [(-118, 17), (-109, 16.5), (-108, 20.5), (-113, 23), (-117.5, 22)]),
    (4, "mpa", "Golfo Norte", "RB", "Sonora", "Puerto Penasco", "Golfo de California",
     [(-114.5, 30.5), (-112.5, 30.5), (-112.5, 31.5), (-114.5, 31.5)]),
    (5, "eez", "Neighbour Exclusive Economic Zone", None, None, None, None,
     [(-95, -6), (-82, -6), (-82, 4), (-92, 5)]),
]

# (port, longitude, latitude)
PORTS = [
    ("Mazatlan", -106.42, 23.20),
    ("Manzanillo", -104.32, 19.05),
    ("Ensenada", -116.62, 31.85),
    ("Puerto Madero", -92.40, 14.70),
]


def zone_polygons(spark: SparkSession) -> DataFrame:
    rows = [(pid, layer, name, decree, state, mun, reg, [(float(x), float(y)) for x, y in ring])
            for pid, layer, name, decree, state, mun, reg, ring in ZONE_POLYGONS]
    return spark.createDataFrame(rows, schemas.POLYGONS)


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, schemas.PORTS)
