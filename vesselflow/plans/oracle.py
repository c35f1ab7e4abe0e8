"""Plain-SQL statements of the registered queries, for an independent engine.

Each statement runs on the driver's test tables (``lineitem``, ``supplier``)
as views and repeats the adapters of ``vesselflow.sources.adapters`` and the
plans of ``vesselflow.plans`` in ANSI SQL: zones by an edge join with a
crossing count per (point, polygon), hour counts by ``distinct``, grids by
``floor``.  Decimal literals are written as doubles (``1e0`` form) because
plain ``0.1`` is typed decimal.  Results are rounded the same way on both sides.
"""

from __future__ import annotations

from vesselflow import constants as C
from vesselflow.constants import FIXTURE_STUDY as S
from vesselflow.operators import grid as G
from vesselflow.sources.fixtures import ZONE_POLYGONS


def d(x: float) -> str:
    """A double literal that no engine reads as decimal."""
    r = repr(float(x))
    return r if "e" in r or "inf" in r or "nan" in r else r + "e0"


def q(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def _edges_values() -> str:
    rows = []
    for pid, layer, name, decree, state, mun, reg, ring in ZONE_POLYGONS:
        n = len(ring)
        for i in range(n):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
            rows.append(f"({pid}, {q(layer)}, {q(name)}, {q(decree)}, {q(state)}, {q(mun)}, {q(reg)}, "
                        f"{d(x1)}, {d(y1)}, {d(x2)}, {d(y2)})")
    return ("select * from (values " + ", ".join(rows) +
            ") as t(pid, layer, name, decree, state, municipality, region, x1, y1, x2, y2)")


CROSS = ("((e.y1 > p.latitude) <> (e.y2 > p.latitude)) and "
         "p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1")


def pip(src: str, layer: str, attrs: str = "e.name") -> str:
    """Distinct positions of ``src`` inside polygons of ``layer`` (odd crossings)."""
    return (f"select p.longitude, p.latitude, e.pid, {attrs} "
            f"from (select distinct longitude, latitude from {src}) p join edges e "
            f"on e.layer = '{layer}' and {CROSS} "
            f"group by p.longitude, p.latitude, e.pid, {attrs} having count(*) % 2 = 1")


PINGS = f"""select l_orderkey * 8 + l_linenumber as id,
  cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
  cast(day(l_shipdate) as integer) as day,
  make_timestamp(year(l_shipdate), month(l_shipdate), day(l_shipdate),
                 cast((l_partkey * 7 + l_linenumber) % 24 as integer), 0, 0) as date,
  concat('V', cast(l_suppkey as varchar)) as vessel_name,
  cast(10000 + l_suppkey as varchar) as RNP,
  case when l_suppkey % 2 = 0
       then cast(-155 as double) + cast((l_partkey * 131 + l_suppkey * 17) % 8000 as double) / cast(100 as double)
       else cast(-107 as double) + cast((l_partkey * 131 + l_suppkey * 17) % 3200 as double) / cast(100 as double)
  end as longitude,
  cast(-12 as double) + cast((l_partkey * 89 + l_suppkey * 29) % 4700 as double) / cast(100 as double) as latitude,
  l_quantity / cast(5 as double) as speed,
  cast((l_partkey * 13) % 360 as double) as direction,
  concat(cast(year(l_shipdate) as varchar), '_', lpad(cast(month(l_shipdate) as varchar), 2, '0'), '_',
         case when day(l_shipdate) <= 15 then '1' else '2' end) as file_name
from lineitem"""

MODELLED = f"""select p.*, coalesce(m.name, '{C.OPEN_AREA}') as zone, m.decree as mpa_decree, m.state,
  m.municipality, m.region,
  case when p.speed is null then 'unknown' when p.speed <= {d(4.0)} then '{C.HAULING}' else 'steaming' end
    as vessel_state
from pings p left join mpa_hit m on p.longitude = m.longitude and p.latitude = m.latitude"""

ZONE_LABEL = (f"case when zone is null then '{C.HIGH_SEAS}' when zone <> '{C.OPEN_AREA}' then zone "
              f"when eez_name is null then '{C.HIGH_SEAS}' when eez_name = {q(C.HOME_EEZ_NAME)} then "
              f"'{C.EEZ_LABEL}' else zone end")


def _clip(src: str, name: str) -> dict:
    """CTEs: ``name`` = rows of ``src`` inside the ocean, with ``eez_name`` (left)."""
    return {
        f"{name}_ocean": (pip(src, "ocean"), [src, "edges"]),
        f"{name}_eez": (pip(src, "eez"), [src, "edges"]),
        name: (f"select s.*, z.name as eez_name from {src} s "
               f"join {name}_ocean o on s.longitude = o.longitude and s.latitude = o.latitude "
               f"left join {name}_eez z on s.longitude = z.longitude and s.latitude = z.latitude",
               [src, f"{name}_ocean", f"{name}_eez"]),
    }


CELL_COL = f"least(floor((longitude - {d(G.DEFAULT_GRID.xmin)}) / {d(G.DEFAULT_GRID.res)}), {G.DEFAULT_GRID.ncol - 1})"
CELL_ROW = f"least(floor(({d(G.DEFAULT_GRID.ymax)} - latitude) / {d(G.DEFAULT_GRID.res)}), {G.DEFAULT_GRID.nrow - 1})"
IN_EXTENT = (f"longitude between {d(G.DEFAULT_GRID.xmin)} and {d(G.DEFAULT_GRID.xmax)} and "
             f"latitude between {d(G.DEFAULT_GRID.ymin)} and {d(G.DEFAULT_GRID.ymax)}")
CELL_Y = f"({d(G.DEFAULT_GRID.ymax)} - (cast(row as double) + {d(0.5)}) * {d(G.DEFAULT_GRID.res)})"
CELL_X = f"({d(G.DEFAULT_GRID.xmin)} + (cast(col as double) + {d(0.5)}) * {d(G.DEFAULT_GRID.res)})"
_PHI = f"({CELL_Y} * {d(G.DEG2RAD)})"
CELL_AREA = (f"{d(C.WGS84_A_KM)} * cos({_PHI}) / sqrt({d(1.0)} - {d(C.WGS84_E2)} * sin({_PHI}) * sin({_PHI}))"
             f" * {d(G.DEFAULT_GRID.res * G.DEG2RAD)} * {d(G.meridian_step_km())}")
SAFE_DATE = ("case when {day} between 1 and day(last_day(make_date({y}, {m}, 1))) "
             "then make_date({y}, {m}, {day}) end")
N_DISTINCT = "(count(distinct {c}) + max(case when {c} is null then 1 else 0 end))"


def _fleet_area(prefix: str, fleet_where: str) -> dict:
    """CTEs for Q8/Q9: ``{prefix}_area(file_name, date, area)``."""
    p = prefix
    ctes = {
        f"{p}_f": (f"select * from modelled where vessel_state = '{C.HAULING}' and {fleet_where}",
                   ["modelled", "active", "permits", "files_ranked"]),
        f"{p}_pv": (f"select file_name, year, month, longitude, latitude, vessel_name, count(*) as h, "
                    f"max(day) as max_day from (select distinct file_name, year, month, day, hour(date) as hour, "
                    f"longitude, latitude, vessel_name from {p}_f) t "
                    f"group by file_name, year, month, longitude, latitude, vessel_name", [f"{p}_f"]),
        f"{p}_fmax": (f"select file_name, max(max_day) as fmax from {p}_pv group by file_name", [f"{p}_pv"]),
        f"{p}_pvd": (f"select v.*, {SAFE_DATE.format(day='f.fmax', y='v.year', m='v.month')} as date "
                     f"from {p}_pv v join {p}_fmax f on v.file_name = f.file_name", [f"{p}_pv", f"{p}_fmax"]),
        f"{p}_pe": (f"select file_name, date, longitude, latitude, sum(h) as hrs, "
                    f"{N_DISTINCT.format(c='vessel_name')} as vessels from {p}_pvd "
                    f"group by file_name, date, longitude, latitude", [f"{p}_pvd"]),
    }
    ctes.update(_clip(f"{p}_pe", f"{p}_pc"))
    ctes.update({
        f"{p}_eff": (f"select file_name, date, longitude, latitude, hrs, vessels, hrs / vessels as effort from "
                     f"(select file_name, date, round(longitude, 5) as longitude, round(latitude, 5) as latitude, "
                     f"sum(hrs) as hrs, sum(vessels) as vessels from {p}_pc group by file_name, date, "
                     f"round(longitude, 5), round(latitude, 5)) t", [f"{p}_pc"]),
        f"{p}_cells": (f"select file_name, {CELL_ROW} as row, {CELL_COL} as col, sum(effort) as value "
                       f"from {p}_eff where {IN_EXTENT} group by file_name, {CELL_ROW}, {CELL_COL}", [f"{p}_eff"]),
        f"{p}_farea": (f"select file_name, round(count(*) * quantile_cont({CELL_AREA}, 0.5), 1) as area "
                       f"from {p}_cells where value is not null group by file_name", [f"{p}_cells"]),
        f"{p}_area": (f"select d.file_name, d.date, a.area from (select distinct file_name, date from {p}_eff) d "
                      f"left join {p}_farea a on d.file_name = a.file_name", [f"{p}_eff", f"{p}_farea"]),
    })
    return ctes


def _grid_cells(prefix: str, fleet_where: str, years: tuple | None) -> dict:
    """CTEs for Q12-Q14: ``{prefix}_cells(row, col, value)``."""
    p = prefix
    yr = f"where year >= {years[0]} and year < {years[1]}" if years else ""
    ctes = {
        f"{p}_f": (f"select * from modelled where vessel_state = '{C.HAULING}' and {fleet_where}",
                   ["modelled", "active", "permits", "files_ranked"]),
        f"{p}_pv": (f"select file_name, year, month, longitude, latitude, vessel_name, count(*) as h "
                    f"from (select distinct file_name, year, month, day, hour(date) as hour, longitude, latitude, "
                    f"vessel_name from {p}_f) t group by file_name, year, month, longitude, latitude, vessel_name",
                    [f"{p}_f"]),
        f"{p}_pe": (f"select file_name, longitude, latitude, sum(h) as hrs, {N_DISTINCT.format(c='vessel_name')} "
                    f"as vessels from {p}_pv {yr} group by file_name, longitude, latitude", [f"{p}_pv"]),
    }
    ctes.update(_clip(f"{p}_pe", f"{p}_pc"))
    ctes.update({
        f"{p}_eff": (f"select longitude, latitude, hrs / vessels as effort from "
                     f"(select round(longitude, 5) as longitude, round(latitude, 5) as latitude, "
                     f"sum(hrs / {d(24.0)}) as hrs, sum(vessels) as vessels from {p}_pc "
                     f"group by round(longitude, 5), round(latitude, 5)) t", [f"{p}_pc"]),
        f"{p}_cells": (f"select {CELL_ROW} as row, {CELL_COL} as col, sum(effort) as value from {p}_eff "
                       f"where {IN_EXTENT} group by {CELL_ROW}, {CELL_COL}", [f"{p}_eff"]),
    })
    return ctes


ACTIVE_WHERE = "vessel_name in (select vessel_name from active)"
OTHER_WHERE = ("vessel_name in (select vessel_name from permits) and "
               "vessel_name not in (select vessel_name from active)")


def _slice(rng: tuple) -> str:
    end = f" and pos <= {rng[1]}" if rng[1] else ""
    return f"file_name in (select file_name from files_ranked where pos >= {rng[0]}{end})"


CTES: dict = {
    "edges": (_edges_values(), []),
    "pings": (PINGS, []),
    "mpa_hit": (pip("pings", "mpa", "e.name, e.decree, e.state, e.municipality, e.region"), ["pings", "edges"]),
    "modelled": (MODELLED, ["pings", "mpa_hit"]),
    "h0": (f"select file_name, year, month, day, cast(hour(date) as integer) as hour, vessel_name, zone, "
           f"longitude, latitude from modelled where vessel_state = '{C.HAULING}'", ["modelled"]),
    "h_lab": (f"select file_name, year, month, day, hour, vessel_name, {ZONE_LABEL} as zone from h1", ["h1"]),
    "hours_f": (f"select file_name, year, month, vessel_name, zone, count(*) as hrs from "
                f"(select distinct * from h_lab) t group by file_name, year, month, vessel_name, zone "
                f"having year > {S.hours_min_year}", ["h_lab"]),
    "permits": ("select concat('V', cast(s_suppkey as varchar)) as vessel_name from supplier "
                "where s_suppkey % 5 <> 0", []),
    "active": ("select distinct vessel_name from hours_f where regexp_matches(zone, '" + C.MPA_PATTERN + "')"
               + (f" and year > {S.fleet_min_year}" if S.fleet_min_year is not None else ""), ["hours_f"]),
    "landings": ("select concat(' V', cast(l_suppkey as varchar), "
                 "case when l_linenumber % 3 = 0 then ' (ALIAS' else '' end) as vessel_name, "
                 "cast(l_shipdate as date) as date, l_extendedprice as catch, "
                 "cast(cast(l_quantity as integer) % 11 as double) as days_declared from lineitem", []),
    "files_ranked": ("select file_name, row_number() over (order by file_name) as pos from "
                     "(select distinct file_name from modelled) t", ["modelled"]),
}
CTES.update(_clip("h0", "h1"))
CTES.update(_fleet_area("ay", ACTIVE_WHERE))
CTES.update(_fleet_area("an", OTHER_WHERE + (" and " + _slice(S.other_fleet_files) if S.other_fleet_files else "")))
CTES["areas"] = (f"select date, area, '{C.FLEET_YES}' as revi from ay_area union all "
                 f"select date, area, '{C.FLEET_NO}' as revi from an_area", ["ay_area", "an_area"])
CTES.update(_grid_cells("gby", ACTIVE_WHERE + " and " + _slice(S.before_files), S.before_years))
CTES.update(_grid_cells("gay", ACTIVE_WHERE + " and " + _slice(S.after_files), None))
CTES.update(_grid_cells("gbn", OTHER_WHERE + " and " + _slice(S.before_files), S.before_years))
CTES.update(_grid_cells("gan", OTHER_WHERE + " and " + _slice(S.after_files), None))


def with_ctes(body: str, *needs: str) -> str:
    """``with`` clause holding ``needs`` and everything they depend on, in order."""
    order: list = []

    def visit(n):
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in needs:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({CTES[n][0]})" for n in order) + "\n" + body
