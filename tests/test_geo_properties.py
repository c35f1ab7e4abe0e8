"""Property checks of the polygon join against a brute-force crossing count."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vesselflow.operators import geo


def _brute(ring, x, y):
    inside = False
    n = len(ring)
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


star = st.lists(st.floats(min_value=0.5, max_value=20.0, allow_nan=False), min_size=3, max_size=24)
pts = st.lists(st.tuples(st.floats(-25, 25, allow_nan=False), st.floats(-25, 25, allow_nan=False)),
               min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(radii=star, points=pts, band=st.sampled_from([0.25, 1.0, 3.0]))
def test_matches_brute_force(spark, radii, points, band):
    n = len(radii)
    ring = [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]
    polys = spark.createDataFrame(
        [(1, "x", "poly", None, None, None, None, [(float(a), float(b)) for a, b in ring])],
        "pid long, layer string, name string, decree string, state string, municipality string, region string, "
        "ring array<struct<x:double,y:double>>")
    layer = geo.prepare_layer(polys, None, ["pid", "name"], band_deg=band)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)],
                               "k int, longitude double, latitude double")
    got = sorted(r["k"] for r in geo.join_zones(df, layer, "semi").collect())
    want = [i for i, (x, y) in enumerate(points) if _brute(ring, x, y)]
    assert got == want
    assert len(got) <= len(points)
    assert got == sorted(r["k"] for r in geo.join_zones(df, layer, "semi", strategy="broadcast").collect())
    anti = sorted(r["k"] for r in geo.join_zones(df, layer, "anti").collect())
    assert sorted(got + anti) == list(range(len(points)))


def test_cells_answer_most_points_without_parity(spark):
    """Holes, islands, horizontal edges inside a cell, a sliver thinner than a cell, points on corners: equal to the band join; few points on borders."""
    rings = [(1, [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.5), (-20.0, 20.5)]), (1, [(-5.3, -5.0), (-5.3, 5.25), (5.0, 5.25), (5.0, -5.0)]),
             (2, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]), (3, [(-24.0, 10.6), (24.0, 10.6), (24.0, 10.7), (-24.0, 10.7)]), (4, [(0.0, 0.0), (3.0, 3.0), (6.0, 0.0)])]
    polys = spark.createDataFrame([(p, "x", f"z{p}", None, None, None, None, r) for p, r in rings],
                                  "pid long, layer string, name string, decree string, state string, municipality string, region string, "
                                  "ring array<struct<x:double,y:double>>")
    layer = geo.prepare_layer(polys, None, ["pid", "name"])
    df = spark.range(40000).selectExpr("id as k", "(id % 200) * 0.25 - 25 as longitude", "floor(id / 200) * 0.25 - 25 as latitude")
    df = df.union(df.selectExpr("k + 40000", "longitude + 0.113", "latitude + 0.107")).union(spark.sql("select 99999L, null, 1d"))
    for how in ("inner", "left", "semi", "anti"):
        cells, bands = (geo.join_zones(df, layer, how, strategy=x) for x in ("auto", "broadcast"))
        assert cells.columns == bands.columns
        assert cells.exceptAll(bands).isEmpty() and bands.exceptAll(cells).isEmpty()
    seen = {r["class"]: r["points"] for r in geo.cell_classes(df, layer).collect()}
    assert sum(seen.values()) == 80001 and seen["border"] < 0.2 * 80001 and seen["inside"] > 0.4 * 80001
