"""Point-in-polygon joins (J1-J4, J9) as native DataFrame plans.

Polygons arrive as rows ``(pid, layer, name, attrs..., ring array<struct<x,y>>)``;
several rows with one ``pid`` are several rings (holes, islands) of one shape.

Plan:
1. rings -> edges ``(x1, y1, x2, y2)`` by ``posexplode`` (closing edge implied);
2. every edge is listed under each latitude band it spans, and the edges of one
   polygon and band are collected into one array row;
3. a point carries its band, joins the band rows by equality, and the crossing
   parity of the ray towards +x is computed by ``aggregate`` over the band's edge
   array inside the join condition.

4. cells: the same bands cut by meridians into square cells.  A cell that no edge touches lies wholly inside or
   outside a polygon, so its points are answered by an equality join on (band, column); only the
   points of border cells evaluate the parity, over the band's edges that are not wholly left of the cell.
   Cells outside a polygon have no row.  Used when the cell table fits the broadcast limit, else the bands are.

The polygon side is a dimension table whose size does not grow with the pings; its
size is measured before it is broadcast, so the join is map-side and shuffles no
ping.  Above the limit the same join runs as a salted shuffle join so one hot band
cannot land in a single task.  The parity is exact for any polygon: a point inside
has at least one edge crossing its latitude, so the band holds every edge that
matters.  Tests are planar on degrees; a point exactly on a boundary follows the
one-sided crossing rule (left/bottom edges in, right/top edges out).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BAND_DEG = 1.0
DEG2RAD = math.pi / 180.0
EARTH_RADIUS_KM = 6371.0
BROADCAST_LIMIT_BYTES = 64 << 20
SHUFFLE_SALTS = 64
_EDGE_BYTES = 48          # struct of four doubles + array overhead, per edge reference
_ROW_BYTES = 96           # per (pid, band) row besides its edges


def polygon_edges(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """One row per polygon edge; all non-ring columns are kept."""
    keep = [c for c in polygons.columns if c != ring]
    n = F.size("_ring")
    exploded = polygons.select(*keep, F.col(ring).alias("_ring"),
                               F.posexplode(ring).alias("_pos", "_v"))
    nxt = F.element_at("_ring", ((F.col("_pos") + 1) % n) + 1)
    return exploded.select(*keep,
                           F.col("_v.x").alias("x1"), F.col("_v.y").alias("y1"),
                           nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def band_of(lat: Column, band_deg: float) -> Column:
    return F.floor(lat / F.lit(float(band_deg))).cast("int")


@dataclass
class ZoneLayer:
    """A polygon layer prepared for point joins: band rows plus their measured size."""
    bands: DataFrame
    attrs: list
    band_deg: float
    n_rows: int
    n_edge_refs: int
    cells: DataFrame | None = None          # (_band, _col, _inside, _edges, attrs) of inside and border cells
    n_cells: int = 0
    n_cell_edges: int = 0

    @property
    def cell_bytes(self) -> int:
        return self.n_cells * _ROW_BYTES + self.n_cell_edges * _EDGE_BYTES

    @property
    def est_bytes(self) -> int:
        return self.n_rows * _ROW_BYTES + self.n_edge_refs * _EDGE_BYTES


def prepare_layer(polygons: DataFrame, layer: str | None = None, attrs: list | None = None,
                  band_deg: float | None = DEFAULT_BAND_DEG, layer_col: str = "layer",
                  max_edges_per_band: int = 64, min_band_deg: float = 0.01, cells: bool = True) -> ZoneLayer:
    """Edges of one layer grouped by latitude band.  ``attrs`` are polygon columns
    carried to matched points (default: every column but the ring).

    When a (polygon, band) row holds more than ``max_edges_per_band`` edges on
    average (detailed coastlines), the bands are narrowed and the table rebuilt,
    so the per-point parity loop stays short; ``band_deg=None`` starts from 1 degree."""
    if layer is not None:
        polygons = polygons.where(F.col(layer_col) == layer)
    attrs = attrs or [c for c in polygons.columns if c not in ("ring",)]
    if "pid" not in attrs:
        attrs = ["pid"] + attrs
    edges = polygon_edges(polygons.select(*attrs, "ring")).where(F.col("y1") != F.col("y2"))
    band = float(band_deg or DEFAULT_BAND_DEG)
    while True:
        lo = band_of(F.least("y1", "y2"), band)
        hi = band_of(F.greatest("y1", "y2"), band)
        bands = (edges.withColumn("_band", F.explode(F.sequence(lo, hi)))   # horizontal edges never cross
                      .groupBy("pid", "_band")
                      .agg(*[F.first(a).alias(a) for a in attrs if a != "pid"],
                           F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges")))
        stats = bands.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_edges")).alias("e")).first()
        n, e = int(stats["n"] or 0), int(stats["e"] or 0)
        if n == 0 or e / n <= max_edges_per_band or band / 4 < min_band_deg:
            layer = ZoneLayer(bands, attrs, band, n, e)
            return with_cells(layer, polygon_edges(polygons.select(*attrs, "ring"))) if cells else layer
        band = band / 4


def with_cells(layer: ZoneLayer, edges: DataFrame) -> ZoneLayer:
    """``layer`` with its raster of inside and border cells.  ``edges`` holds all edges, horizontal ones as well (a
    cell that only such an edge crosses is a border cell).  Edges are widened by a millionth of a cell, so rounding
    in a clipped edge never leaves a touched cell unmarked."""
    d = float(layer.band_deg)
    eps = d * 1e-6
    # An edge's cells, band by band: the columns between its crossings of the band's two parallels.
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    parts = edges.withColumn("_band", F.explode(F.sequence(band_of(lo - eps, d), band_of(hi + eps, d))))

    def at(parallel: Column) -> Column:
        y = F.greatest(lo, F.least(hi, parallel))
        x = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
        return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x))

    south, north = at(F.col("_band") * d - eps), at((F.col("_band") + 1) * d + eps)
    flat = F.col("y1") == F.col("y2")
    west = F.when(flat, F.least("x1", "x2")).otherwise(F.least(south, north))
    east = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(south, north))
    border = parts.select("pid", "_band", F.explode(F.sequence(band_of(west - eps, d), band_of(east + eps, d))).alias("_col")).distinct()
    # Other cells of a band lie between its outermost border cells and are decided by their centre.
    bands = layer.bands.groupBy("pid", "_band").agg(F.flatten(F.collect_list("_edges")).alias("_edges"), *[
        F.first(a).alias(a) for a in layer.attrs if a != "pid"])
    span = border.groupBy("pid", "_band").agg(F.min("_col").alias("_from"), F.max("_col").alias("_to"), F.collect_set("_col").alias("_border"))
    rows = span.join(bands, ["pid", "_band"], "left").withColumn("_col", F.explode(F.sequence("_from", "_to")))
    rows = rows.withColumn("_inside", ~F.array_contains("_border", F.col("_col")))
    found = F.coalesce(F.col("_edges"), F.array().cast(layer.bands.schema["_edges"].dataType))
    centre = crossing_parity(found, (F.col("_col") + 0.5) * d, (F.col("_band") + 0.5) * d)
    right = F.filter(found, lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("_col") * d - eps)
    rows = rows.where(~F.col("_inside") | (centre == 1)).select(
        "_band", "_col", "_inside", F.when(~F.col("_inside"), right).alias("_edges"), *layer.attrs)
    # A band that horizontal edges alone reach has no crossing, hence nothing inside.
    rows = rows.where(F.col("_inside") | (F.size("_edges") > 0))
    from vesselflow.operators.membership import materialize
    rows = materialize(rows)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.coalesce("_edges", F.array().cast(layer.bands.schema["_edges"].dataType)))).alias("e")).first()
    return replace(layer, cells=rows, n_cells=int(n["n"] or 0), n_cell_edges=int(n["e"] or 0))


def cell_classes(points: DataFrame, layer: ZoneLayer, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """(class, points): how many points fall into cells that are ``inside`` a polygon, on a ``border`` (the only ones that
    evaluate a parity) or ``outside`` all.  A cell with both an inside and a border polygon counts as border."""
    kind = layer.cells.groupBy("_band", "_col").agg(F.bool_and("_inside").alias("_in"))
    at = points.select(band_of(F.col(lat), layer.band_deg).alias("_band"), band_of(F.col(lon), layer.band_deg).alias("_col"))
    at = at.groupBy("_band", "_col").agg(F.count(F.lit(1)).alias("_n"))
    name = F.when(F.col("_in"), "inside").when(~F.col("_in"), "border").otherwise("outside")
    return at.join(kind, ["_band", "_col"], "left").groupBy(name.alias("class")).agg(F.sum("_n").alias("points"))


def crossing_parity(edges: Column, lon: Column, lat: Column) -> Column:
    """1 when the ray from (lon, lat) towards +x crosses an odd number of edges."""
    def step(acc, e):
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        x_cross = F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return acc + F.when(straddles & (lon < x_cross), 1).otherwise(0)
    return F.aggregate(edges, F.lit(0), step) % 2


def join_zones(points: DataFrame, layer: ZoneLayer, how: str = "left",
               lon: str = "longitude", lat: str = "latitude",
               rename: dict | None = None, strategy: str = "auto",
               broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Attach the polygons of ``layer`` that contain each point.

    ``how='left'`` keeps unmatched points with missing attributes; ``'inner'``
    clips to the layer; ``'semi'``/``'anti'`` keep points in / outside the layer.
    A point in k overlapping polygons yields k rows for left/inner (T21).
    ``rename`` maps polygon attribute names to output names (default: ``pid`` and
    ``name`` prefixed by nothing, others unchanged).
    """
    rename = rename or {}
    if strategy == "auto" and layer.cells is not None and layer.cell_bytes <= broadcast_limit:
        strategy = "cells"
    b = layer.cells.withColumnRenamed("_band", "_cband") if strategy == "cells" else layer.bands
    outs = [F.col(a).alias(rename.get(a, a)) for a in layer.attrs]
    if how in ("left", "inner"):
        b = b.select(*[c for c in b.columns if c.startswith("_")], *outs)
    else:
        b = b.select(*[c for c in b.columns if c.startswith("_")])
    if strategy == "auto":
        strategy = "broadcast" if layer.est_bytes <= broadcast_limit else "shuffle"
    pband = band_of(F.col(lat), layer.band_deg)
    pts = points.withColumn("_pband", pband)
    if strategy == "cells":
        pts = pts.withColumn("_pcol", band_of(F.col(lon), layer.band_deg))
        cond = ((pts["_pband"] == b["_cband"]) & (pts["_pcol"] == b["_col"])
                & (b["_inside"] | (crossing_parity(b["_edges"], pts[lon], pts[lat]) == 1)))
        joined = pts.join(F.broadcast(b), cond, _how(how)).drop("_pcol", "_cband", "_col", "_inside")
    elif strategy == "broadcast":
        cond = (pts["_pband"] == b["_band"]) & (crossing_parity(b["_edges"], pts[lon], pts[lat]) == 1)
        joined = pts.join(F.broadcast(b), cond, _how(how))
    else:
        # Salted shuffle join: a hot band is spread over SHUFFLE_SALTS tasks; every
        # band row is replicated once per salt so each point still meets all edges.
        # The salt is deterministic, so a re-run task routes every row the same way.
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(SHUFFLE_SALTS))
        pts = pts.withColumn("_salt", salt.cast("int"))
        bs = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SHUFFLE_SALTS - 1))))
        cond = ((pts["_pband"] == bs["_band"]) & (pts["_salt"] == bs["_salt"])
                & (crossing_parity(bs["_edges"], pts[lon], pts[lat]) == 1))
        joined = pts.join(bs, cond, _how(how)).drop(bs["_salt"]).drop(pts["_salt"])
    return joined.drop("_pband", "_band", "_edges")


def _how(how: str) -> str:
    return {"left": "left", "inner": "inner", "semi": "left_semi", "anti": "left_anti"}[how]


def attach_mpa(points: DataFrame, mpa: ZoneLayer, lon="longitude", lat="latitude",
               default_zone: str = "open area") -> DataFrame:
    """Protected-area attributes; ``zone`` is the area name or ``default_zone``."""
    joined = join_zones(points, mpa, "left", lon, lat,
                        rename={"pid": "_mpa_pid", "name": "zone", "decree": "mpa_decree"})
    drop = [c for c in ("_mpa_pid", "layer") if c in joined.columns]
    return joined.withColumn("zone", F.coalesce(F.col("zone"), F.lit(default_zone))).drop(*drop)


def flag_port_visits(points: DataFrame, ports: DataFrame, radius_km: float = 5.0,
                     lon="longitude", lat="latitude", port_lon="longitude", port_lat="latitude",
                     out: str = "location", inside: str = "port_visit", outside: str = "at_sea",
                     broadcast_limit: int = BROADCAST_LIMIT_BYTES, strategy: str = "auto") -> DataFrame:
    """``port_visit`` when a port lies within ``radius_km`` (haversine), else ``at_sea``.

    Ports are listed under every cell their radius reaches (:func:`port_cells`) and collected
    into one array per cell; each point joins its single cell row by equality and
    tests ``exists(distance <= radius)`` natively -- one map-side pass, one output
    row per point, and only the ports around the point's cell are measured.  The
    ports table is a dimension; its size is checked first, and above the limit the
    same join runs salted by shuffle (a cell row per salt, so a hot cell is spread
    over SHUFFLE_SALTS tasks and each point still meets one row).
    """
    p = port_cells(ports, radius_km, port_lon, port_lat)
    if strategy == "auto":
        n = p.agg(F.sum(F.size("_ports"))).first()[0] or 0
        strategy = "broadcast" if n * _EDGE_BYTES <= broadcast_limit else "shuffle"
    band, col = port_cell_of(F.col(lon), F.col(lat), radius_km)
    pts = points.withColumn("_pband", band).withColumn("_pcol", col)
    if strategy == "broadcast":
        j = pts.join(F.broadcast(p), (pts["_pband"] == p["_band"]) & (pts["_pcol"] == p["_col"]), "left")
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(SHUFFLE_SALTS)).cast("int")
        pts = pts.withColumn("_salt", salt)
        ps = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SHUFFLE_SALTS - 1))))
        j = pts.join(ps, (pts["_pband"] == ps["_band"]) & (pts["_pcol"] == ps["_col"]) & (pts["_salt"] == ps["_salt"]), "left") \
               .drop(ps["_salt"]).drop(pts["_salt"])
    near = F.exists("_ports", lambda q: haversine_km(F.col(lon), F.col(lat), q["plon"], q["plat"]) <= radius_km)
    return (j.withColumn(out, F.when(F.coalesce(near, F.lit(False)), inside).otherwise(outside))
             .drop("_pband", "_pcol", "_band", "_col", "_ports"))


def _port_band(radius_km: float) -> tuple[float, float]:
    """The radius in degrees of latitude and the height of a band, at least twice that."""
    deg = radius_km / 110.0 + 1e-6
    return deg, max(0.1, 2 * deg)


def _port_columns(band: Column, band_deg: float) -> Column:
    """Columns of a band: cells about as wide as high on the ground at the band's edge nearest a pole, one at a pole itself."""
    edge = F.greatest(F.abs(band * band_deg), F.abs((band + 1) * band_deg))
    return F.greatest(F.lit(1), F.floor(F.cos(F.least(edge, F.lit(90.0)) * F.lit(DEG2RAD)) * (360.0 / band_deg)).cast("int"))


def _port_column(lon: Column, columns: Column) -> Column:
    """The column of a longitude, counted on past the date line; ``pmod`` by ``columns`` names the cell."""
    return F.floor((lon + 180.0) * columns / 360.0)


def port_cell_of(lon: Column, lat: Column, radius_km: float) -> tuple[Column, Column]:
    """(band, column) of a position; missing coordinates have no cell."""
    _, band_deg = _port_band(radius_km)
    band = band_of(lat, band_deg)
    columns = _port_columns(band, band_deg)
    return band, F.pmod(_port_column(lon, columns), columns).cast("int")


def port_cells(ports: DataFrame, radius_km: float = 5.0, port_lon="longitude", port_lat="latitude") -> DataFrame:
    """(_band, _col, _ports): the ports whose circle can reach a cell.

    A circle of angular radius d around latitude p spans ``asin(sin d / cos p)`` degrees of longitude on either side, and all
    of them when it holds a pole; columns are taken modulo their number, so a circle across the date line lies in the cells of
    both sides.  A port without coordinates reaches nothing."""
    deg, band_deg = _port_band(radius_km)
    p = ports.select(F.col(port_lon).alias("plon"), F.col(port_lat).alias("plat")).where("plon is not null and plat is not null")
    polar = F.abs("plat") + deg >= 89.9
    reach = F.when(polar, 180.0).otherwise(
        F.asin(F.least(F.lit(1.0), F.sin(F.lit(deg * DEG2RAD)) / F.cos(F.col("plat") * F.lit(DEG2RAD)))) / F.lit(DEG2RAD) + 1e-6)
    p = p.withColumn("_reach", reach).withColumn("_band", F.explode(F.sequence(
        band_of(F.col("plat") - deg, band_deg), band_of(F.col("plat") + deg, band_deg))))
    p = p.withColumn("_n", _port_columns(F.col("_band"), band_deg))
    lo = _port_column(F.col("plon") - F.col("_reach"), F.col("_n"))
    hi = F.least(_port_column(F.col("plon") + F.col("_reach"), F.col("_n")), lo + F.col("_n") - 1)
    p = p.withColumn("_col", F.explode(F.sequence(lo, hi))).withColumn("_col", F.pmod("_col", "_n").cast("int"))
    return p.groupBy("_band", "_col").agg(F.collect_list(F.struct("plon", "plat")).alias("_ports"))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, r_km: float = EARTH_RADIUS_KM) -> Column:
    k = F.lit(DEG2RAD)
    p1, p2 = lat1 * k, lat2 * k
    dlat = p2 - p1
    dlon = (lon2 - lon1) * k
    a = F.sin(dlat / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dlon / 2) ** 2
    return F.lit(2 * r_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bounding_box(df: DataFrame, lon="longitude", lat="latitude") -> DataFrame:
    """A10: one-row extent of the positions."""
    return df.agg(F.min(lon).alias("xmin"), F.max(lon).alias("xmax"),
                  F.min(lat).alias("ymin"), F.max(lat).alias("ymax"))


def within_box_of(points: DataFrame, frame: DataFrame, lon="longitude", lat="latitude") -> DataFrame:
    """Keep points inside the extent of ``frame``; the extent is a scalar
    subquery (computed once, no join)."""
    bb = bounding_box(frame, lon, lat)
    xmin, xmax = bb.select("xmin").scalar(), bb.select("xmax").scalar()
    ymin, ymax = bb.select("ymin").scalar(), bb.select("ymax").scalar()
    return points.where(F.col(lon).between(xmin, xmax) & F.col(lat).between(ymin, ymax))


def valid_position(lon="longitude", lat="latitude") -> Column:
    """A usable point: both coordinates present and on the globe."""
    return (F.col(lon).isNotNull() & F.col(lat).isNotNull()
            & F.col(lon).between(-180.0, 180.0) & F.col(lat).between(-90.0, 90.0))
