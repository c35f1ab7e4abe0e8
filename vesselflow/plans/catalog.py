"""Registered queries over the driver's test tables, and their SQL statements.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the domain tables with the
adapters and runs one plan; ``SQL[name]`` is the same result in plain SQL over
the raw test tables.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.constants import FIXTURE_STUDY as S
from vesselflow.plans import figures as FG
from vesselflow.plans import oracle as O
from vesselflow.operators import intervals
from vesselflow.operators import membership, rollup
from vesselflow.session import ensure_checkpoint_dir
from vesselflow.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


class Inputs:
    """Domain tables of one test-data directory, built lazily and shared by the
    plans of one query; derived name lists are checkpointed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._c: dict = {}

    def _get(self, k, f):
        if k not in self._c:
            self._c[k] = f()
        return self._c[k]

    @property
    def layers(self):
        return self._get("layers", lambda: adapters.zone_layers(self.spark))

    @property
    def modelled(self):
        return self._get("modelled", lambda: adapters.modelled_pings(self.spark, self.sf_dir, self.layers))

    @property
    def fishing(self):
        """Modelled pings without the zone columns (for plans that never read them)."""
        return self._get("fishing", lambda: adapters.fishing_pings(self.spark, self.sf_dir))

    @property
    def hours(self):
        return self._get("hours", lambda: rollup.monthly_vessel_hours(self.modelled, self.layers, S.hours_min_year))

    @property
    def permits(self):
        return self._get("permits", lambda: FG.permit_list(adapters.permits(self.spark, self.sf_dir)))

    @property
    def active(self):
        return self._get("active", lambda: membership.materialize(FG.active_fleet(self.hours, S.fleet_min_year)))

    @property
    def landings(self):
        return self._get("landings", lambda: adapters.landings(self.spark, self.sf_dir))

    def areas(self):
        return self._get("areas", lambda: FG.area_results(self.fishing, self.layers, self.permits, self.active, S))

    def period_cells(self, fleet: str):
        def build():
            if fleet == "yes":
                return FG.period_cells(self.fishing, self.layers, self.active, S)
            return FG.period_cells(self.fishing, self.layers, self.permits, S, exclude=self.active)
        return self._get(("cells", fleet), build)

    def cells(self, fleet: str):
        c = self.period_cells(fleet)
        return tuple(c.where(F.col("period") == p).drop("period") for p in ("before", "after"))


# --- Q4-Q16 ---------------------------------------------------------------------------------

@register("q04_monthly_vessel_hours", O.with_ctes(
    "select year, month, vessel_name, zone, cast(hrs as bigint) as hrs from hours_f", "hours_f"))
def q04(spark, sf_dir):
    return Inputs(spark, sf_dir).hours


@register("q05_name_lists", O.with_ctes(
    "select 'permits' as list, vessel_name from (select distinct vessel_name from permits) t "
    "union all select 'vessels' as list, vessel_name from (select distinct vessel_name from hours_f) u "
    "union all select 'active' as list, vessel_name from active", "permits", "hours_f", "active"))
def q05(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return FG.name_lists(i.hours, adapters.permits(spark, sf_dir), S).select("list", "vessel_name")


_Q6_SQL = """select year, month, cast(vessel as bigint) as vessel, round(hrs, 6) as hrs,
  round(hrs / vessel, 6) as effort, make_date(year, month, 1) as date,
  case when make_date(year, month, 1) < date '{cut}' then 'Before' else 'After' end as period
from (select year, month, {nd} as vessel, sum(hrs / {unit}) as hrs
      from (select year, month, vessel_name, sum(hrs) as hrs from hours_f
            where regexp_matches(zone, '{pat}') group by year, month, vessel_name) t
      group by year, month) m"""


@register("q06_mpa_effort", O.with_ctes(_Q6_SQL.format(
    cut=S.cut_date, nd=O.N_DISTINCT.format(c="vessel_name"), unit=O.d(24.0), pat=C.MPA_PATTERN), "hours_f"))
def q06(spark, sf_dir):
    return r6(FG.mpa_monthly_effort(Inputs(spark, sf_dir).hours, S), "hrs", "effort")


_Q7_SQL = """select year, month, revi, {r_open}avg(case when days_declared <> 0 then catch / days_declared end
    / {k}){r_close} as cpue,
  cast(sum(case when days_declared = 0 then 1 else 0 end) as bigint) as zero_days,
  count(*) as n_landings, make_date(year, month, 1) as date,
  case when make_date(year, month, 1) < date '{cut}' then 'Before' else 'After' end as period
from (select cast(year(date) as integer) as year, cast(month(date) as integer) as month, catch, days_declared,
             case when vessel_name in (select vessel_name from active) then 'Yes' else 'No' end as revi
      from (select date, regexp_replace(split_part(vessel_name, '(', 1), '^\\s+|\\s+$', '', 'g') as vessel_name,
                   catch, days_declared from landings) l
      where vessel_name in (select vessel_name from permits) {since}) x
group by year, month, revi"""


def _q7_sql(since: str | None) -> str:
    return O.with_ctes(_Q7_SQL.format(k=O.d(1000.0), cut=S.cut_date, r_open="round(", r_close=", 6)",
                                      since=f"and date >= date '{since}'" if since else ""),
                       "landings", "permits", "active")


@register("q07_cpue", _q7_sql(None))
def q07(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return r6(FG.monthly_cpue(i.landings, i.permits, i.active, S), "cpue")


def _q7_ieee_sql() -> str:
    """The reference's own mean: a zero-day landing makes its month infinite (or not a number), a missing value makes it missing."""
    body = """select year(l.date)::integer as year, month(l.date)::integer as month, case when a.vessel_name is null then 'No' else 'Yes' end as revi,
  case when count(catch) < count(*) or count(days_declared) < count(*) then null
       when bool_or(days_declared = 0 and catch = 0) then 'NaN'::double
       when bool_or(days_declared = 0) then 'Infinity'::double
       else round(avg(catch / nullif(days_declared, 0) / 1000.0::double), 6) end as cpue, count(*) as n_landings
from (select date, trim(split_part(vessel_name, '(', 1), chr(9) || chr(10) || chr(13) || ' ') as vessel_name, catch, days_declared from landings) l
join (select distinct vessel_name from permits) p on l.vessel_name = p.vessel_name
left join (select distinct vessel_name from active) a on l.vessel_name = a.vessel_name group by 1, 2, 3"""
    return O.with_ctes(body, "landings", "permits", "active")


@register("q07b_cpue_ieee", _q7_ieee_sql())
def q07b(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return r6(FG.monthly_cpue(i.landings, i.permits, i.active, S, ieee=True), "cpue").select("year", "month", "revi", "cpue", "n_landings")


@register("q08_area_active_fleet", O.with_ctes("select file_name, date, area from ay_area", "ay_area"))
def q08(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return FG.half_month_area(FG.fleet_pings(i.fishing, i.active), i.layers, with_file=True)


def _manifest_sql() -> str:
    sl = S.other_fleet_files
    cut = f"pos >= {sl[0]}" + (f" and pos <= {sl[1]}" if sl[1] is not None else "") if sl else "true"
    hauling = "speed <= 4.0e0"
    return O.with_ctes(f"""select c.file_name, c.revi, n_pings, n_hauling, n_fleet, area,
       case when area is not null then 'used' when n_pings = 0 then 'empty' when n_hauling = 0 then 'no hauling' when n_fleet = 0 then 'other fleet'
            when c.revi = '{C.FLEET_NO}' and not ({cut}) then 'outside slice' else 'no used cell' end as reason
from (select file_name, count(*) as n_pings, count(case when {hauling} then 1 end) as n_hauling,
             count(case when {hauling} and {O.ACTIVE_WHERE} then 1 end) as n_fleet, '{C.FLEET_YES}' as revi from pings group by file_name
      union all
      select file_name, count(*), count(case when {hauling} then 1 end),
             count(case when {hauling} and {O.OTHER_WHERE} then 1 end), '{C.FLEET_NO}' from pings group by file_name) c
left join files_ranked r on r.file_name = c.file_name
left join (select file_name, '{C.FLEET_YES}' as revi, max(area) as area from ay_area group by file_name
           union all select file_name, '{C.FLEET_NO}', max(area) from an_area group by file_name) a on a.file_name = c.file_name and a.revi = c.revi""",
                       "ay_area", "an_area", "files_ranked", "pings", "active", "permits")


@register("e01_file_manifest", _manifest_sql())
def e01(spark, sf_dir):
    """Every listed file and fleet has a row, with a missing area and the reason where nothing was used."""
    i = Inputs(spark, sf_dir)
    return FG.file_manifest(i.fishing.select("file_name"), i.fishing, i.layers, i.permits, i.active, S)


@register("q09_area_other_fleet", O.with_ctes("select file_name, date, area from an_area", "an_area"))
def q09(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    files = FG.file_slice(i.fishing, *S.other_fleet_files)
    n_files = FG.slice_rows(*S.other_fleet_files)
    return FG.half_month_area(FG.fleet_pings(i.fishing, i.permits, exclude=i.active, files=files,
                                             max_files=n_files),
                              i.layers, with_file=True)


@register("q10_area_results", O.with_ctes("select date, area, revi from areas", "areas"))
def q10(spark, sf_dir):
    return Inputs(spark, sf_dir).areas()


_Q11_SQL = """select year, month, revi, round(area, 6) as area, make_date(year, month, 1) as date,
  case when make_date(year, month, 1) < date '{cut}' then 'Before' else 'After' end as period
from (select cast(year(date) as integer) as year, cast(month(date) as integer) as month, revi,
             case when count(area) = count(*) then sum(area) end / {k} as area
      from (select date, area, case revi when 'no' then 'No' when 'yes' then 'Yes' end as revi from areas) a
      group by year(date), month(date), revi) m
where area < {lim}"""


@register("q11_area_monthly", O.with_ctes(_Q11_SQL.format(cut=S.cut_date, k=O.d(1000.0), lim=O.d(S.area_outlier)),
                                          "areas"))
def q11(spark, sf_dir):
    return r6(FG.monthly_area(Inputs(spark, sf_dir).areas(), S), "area")


def _grid_sql(prefix: str, label: str) -> str:
    return (f"select round({O.CELL_X}, 6) as x, round({O.CELL_Y}, 6) as y, round(value, 6) as layer, "
            f"round(ln(1 + value), 6) as log_layer, '{label}' as time from {prefix}_cells")


def _grid(cells: DataFrame, label: str) -> DataFrame:
    return r6(FG.grid_points(cells, label), "x", "y", "layer", "log_layer")


@register("q12_grid_before_active", O.with_ctes(_grid_sql("gby", "before"), "gby_cells"))
def q12(spark, sf_dir):
    return _grid(Inputs(spark, sf_dir).cells("yes")[0], "before")


@register("q13_grid_after_active", O.with_ctes(_grid_sql("gay", "after"), "gay_cells"))
def q13(spark, sf_dir):
    return _grid(Inputs(spark, sf_dir).cells("yes")[1], "after")


@register("q14_grid_before_after_other", O.with_ctes(
    _grid_sql("gbn", "before") + " union all " + _grid_sql("gan", "after"), "gbn_cells", "gan_cells"))
def q14(spark, sf_dir):
    b, a = Inputs(spark, sf_dir).cells("no")
    return _grid(b, "before").unionByName(_grid(a, "after"))


def _nfi_sql(b: str, a: str) -> str:
    return f"""select round({O.CELL_X}, 6) as x, round({O.CELL_Y}, 6) as y, round(nfi, 6) as layer,
  case when nfi >= 0 then 'Increase' else 'Decrease' end as type, nfi > 0 as is_gain, nfi < 0 as is_loss
from (select row, col, (aft - bef) / nullif(aft + bef, 0) as nfi
      from (select coalesce(a.row, b.row) as row, coalesce(a.col, b.col) as col,
                   coalesce(a.value, {O.d(0)}) as aft, coalesce(b.value, {O.d(0)}) as bef
            from {a}_cells a full outer join {b}_cells b on a.row = b.row and a.col = b.col) j) n
where nfi is not null and not isnan(nfi) and nfi <> 0"""


@register("q15_nfi_active", O.with_ctes(_nfi_sql("gby", "gay"), "gby_cells", "gay_cells"))
def q15(spark, sf_dir):
    return r6(FG.nfi_points_periods(Inputs(spark, sf_dir).period_cells("yes")), "x", "y", "layer")


@register("q16_nfi_other", O.with_ctes(_nfi_sql("gbn", "gan"), "gbn_cells", "gan_cells"))
def q16(spark, sf_dir):
    return r6(FG.nfi_points_periods(Inputs(spark, sf_dir).period_cells("no")), "x", "y", "layer")


# --- Q17-Q21 + M6 ---------------------------------------------------------------------------

IMPACT_COLS = ["series_id", "date", "t", "y", "in_pre", "in_post", "pred", "lower", "upper", "effect", "cum_effect"]


def _impact_df(series: DataFrame) -> DataFrame:
    return r6(FG.impact(series, S).select(*IMPACT_COLS), "y", "pred", "lower", "upper", "effect", "cum_effect")


def _impact_sql(src: str, needs: tuple) -> str:
    body = f"""select s.series_id, s.date, s.t, round(s.y, 6) as y, s.in_pre, s.in_post,
  round(f.a + f.b * s.t, 6) as pred,
  round(f.a + f.b * s.t - {O.d(1.96)} * r.sd, 6) as lower, round(f.a + f.b * s.t + {O.d(1.96)} * r.sd, 6) as upper,
  round(case when s.in_post then s.y - (f.a + f.b * s.t) end, 6) as effect,
  round(case when s.in_post then sum(case when s.in_post then s.y - (f.a + f.b * s.t) end)
        over (partition by s.series_id order by s.t rows between unbounded preceding and current row) end, 6)
    as cum_effect
from (select series_id, date, y, t, date between date '{S.pre_start}' and date '{S.pre_end}' as in_pre,
             date between date '{S.post_start}' and date '{S.post_end}' as in_post
      from (select series_id, date, y, cast(row_number() over (partition by series_id order by date) as integer) as t
            from {src}) x) s
left join (select series_id, regr_slope(y, t) as b, regr_intercept(y, t) as a
           from (select series_id, date, y, row_number() over (partition by series_id order by date) as t
                 from {src}) x where date between date '{S.pre_start}' and date '{S.pre_end}' group by series_id) f
  on s.series_id = f.series_id
left join (select x.series_id, stddev_samp(x.y - (g.a + g.b * x.t)) as sd
           from (select series_id, date, y, row_number() over (partition by series_id order by date) as t
                 from {src}) x
           join (select series_id, regr_slope(y, t) as b, regr_intercept(y, t) as a
                 from (select series_id, date, y, row_number() over (partition by series_id order by date) as t
                       from {src}) z where date between date '{S.pre_start}' and date '{S.pre_end}'
                 group by series_id) g on x.series_id = g.series_id
           where x.date between date '{S.pre_start}' and date '{S.pre_end}' group by x.series_id) r
  on s.series_id = r.series_id"""
    return O.with_ctes(body, *needs)


_ACT_CTE = ("s_act_m", f"""select make_date(year, month, 1) as date, hrs / vessel as y from
  (select year, month, {O.N_DISTINCT.format(c='vessel_name')} as vessel, sum(hrs / {O.d(1.0)}) as hrs
   from (select year, month, vessel_name, sum(hrs) as hrs from hours_f
         where regexp_matches(zone, '{C.MPA_PATTERN}') group by year, month, vessel_name) t
   group by year, month) m""", ["hours_f"])
O.CTES[_ACT_CTE[0]] = (_ACT_CTE[1], _ACT_CTE[2])
O.CTES["s_act"] = ("""select 'activity' as series_id, cast(g.date as date) as date, coalesce(m.y, 0e0) as y
  from (select unnest(generate_series(min(date), max(date), interval 1 month)) as date from s_act_m) g
  left join s_act_m m on cast(g.date as date) = m.date""", ["s_act_m"])
O.CTES["s_cpue"] = (_Q7_SQL.format(k=O.d(1000.0), cut=S.cut_date, r_open="", r_close="",
                                   since=f"and date >= date '{S.cpue_from}'"),
                    ["landings", "permits", "active"])
O.CTES["s_area"] = (f"""select year, month, revi, make_date(year, month, 1) as date,
  case when count(area) = count(*) then sum(area) end / {O.d(1000.0)} as area
  from (select cast(year(date) as integer) as year, cast(month(date) as integer) as month, revi, area from areas) a
  group by year, month, revi""", ["areas"])
for _fleet, _lab in (("Yes", "yes"), ("No", "no")):
    O.CTES[f"s_cpue_{_lab}"] = (f"select 'cpue_{_lab}' as series_id, date, cpue as y from s_cpue "
                                f"where revi = '{_fleet}'", ["s_cpue"])
    O.CTES[f"s_area_{_lab}"] = (f"select 'area_{_lab}' as series_id, date, area as y from s_area "
                                f"where revi = '{_lab}'", ["s_area"])


@register("q17_impact_activity", _impact_sql("s_act", ("s_act",)))
def q17(spark, sf_dir):
    return _impact_df(FG.activity_series(Inputs(spark, sf_dir).hours, S))


def _cpue(spark, sf_dir, fleet):
    i = Inputs(spark, sf_dir)
    s = FG.cpue_series(i.landings, i.permits, i.active, S)
    return _impact_df(s.where(F.col("series_id") == f"cpue_{fleet}"))


@register("q18_impact_cpue_active", _impact_sql("s_cpue_yes", ("s_cpue_yes",)))
def q18(spark, sf_dir):
    return _cpue(spark, sf_dir, "yes")


@register("q19_impact_cpue_other", _impact_sql("s_cpue_no", ("s_cpue_no",)))
def q19(spark, sf_dir):
    return _cpue(spark, sf_dir, "no")


def _area(spark, sf_dir, fleet):
    s = FG.area_series(Inputs(spark, sf_dir).areas(), S)
    return _impact_df(s.where(F.col("series_id") == f"area_{fleet}"))


@register("q20_impact_area_active", _impact_sql("s_area_yes", ("s_area_yes",)))
def q20(spark, sf_dir):
    return _area(spark, sf_dir, "yes")


@register("q21_impact_area_other", _impact_sql("s_area_no", ("s_area_no",)))
def q21(spark, sf_dir):
    return _area(spark, sf_dir, "no")


# --- Q1-Q3: ingest, modelling, fishing positions ----------------------------------------------------

from vesselflow.operators import clean, geo  # noqa: E402
from vesselflow.sources import fixtures  # noqa: E402

PRE_COLS = ["year", "month", "day", "date_text", "vessel_name", "RNP", "port_base", "owner", "latitude",
            "longitude", "speed", "direction", "n_unparsed", "file_name", "location", "zone", "mpa_decree",
            "state", "municipality", "region"]


def preprocessed(spark, sf_dir, layers=None, with_ids=False):
    layers = layers or adapters.zone_layers(spark)
    p = clean.preprocess(adapters.raw_pings(spark, sf_dir), file_col="source_file", with_ids=with_ids)
    p = geo.attach_mpa(p, layers["mpa"])
    return geo.flag_port_visits(p, fixtures.ports(spark), radius_km=PORT_RADIUS_KM)


PORT_RADIUS_KM = 5.0
_NUM_RE = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)"
_PORTS_VALUES = ", ".join(f"({O.q(n)}, {O.d(x)}, {O.d(y)})" for n, x, y in fixtures.PORTS)


def _hav(lon, lat, plon, plat):
    k = O.d(geo.DEG2RAD)
    a = (f"pow(sin(({plat} * {k} - {lat} * {k}) / 2e0), 2) + cos({lat} * {k}) * cos({plat} * {k}) * "
         f"pow(sin((({plon} - {lon}) * {k}) / 2e0), 2)")
    return f"{O.d(2 * geo.EARTH_RADIUS_KM)} * asin(sqrt(least(1e0, {a})))"


O.CTES["raw"] = (f"""select vessel_name as Nombre, cast(RNP as double) as RNP, 'PUERTO' as port_txt,
  concat('OWNER ', RNP) as owner_txt, strftime(date, '%d/%m/%Y %H:%M') as Fecha, latitude as Latitud,
  longitude as Longitud, replace(cast(speed as varchar), '.', ',') as Velocidad,
  cast(direction as varchar) as Rumbo, file_name as source_file from pings""", ["pings"])
O.CTES["pre0"] = (f"""select Nombre as vessel_name,
  case when regexp_matches(cast(RNP as varchar), '^-?[0-9]+\\.0+$')
       then regexp_replace(cast(RNP as varchar), '\\.0+$', '') else cast(RNP as varchar) end as RNP,
  port_txt as port_base, owner_txt as owner, Latitud as latitude, Longitud as longitude,
  try_cast(nullif(regexp_extract(replace(trim(Velocidad), ',', '.'), '{_NUM_RE}', 0), '') as double) as speed,
  try_cast(nullif(regexp_extract(replace(trim(Rumbo), ',', '.'), '{_NUM_RE}', 0), '') as double) as direction,
  Velocidad, Rumbo, try_strptime(Fecha, '%d/%m/%Y %H:%M') as date, source_file as file_name from raw""", ["raw"])
O.CTES["pre_mpa"] = (O.pip("pre0", "mpa", "e.name, e.decree, e.state, e.municipality, e.region"),
                     ["pre0", "edges"])
O.CTES["ports"] = (f"select * from (values {_PORTS_VALUES}) as t(port, plon, plat)", [])
O.CTES["pre_port"] = (f"""select distinct p.longitude, p.latitude from (select distinct longitude, latitude from pre0) p
  join ports q on {_hav('p.longitude', 'p.latitude', 'q.plon', 'q.plat')} <= {O.d(PORT_RADIUS_KM)}""",
                      ["pre0", "ports"])
O.CTES["pre"] = (f"""select cast(year(date) as integer) as year, cast(month(date) as integer) as month,
  cast(day(date) as integer) as day, strftime(date, '%Y-%m-%d %H:%M:%S') as date_text, vessel_name, RNP,
  port_base, owner, p.latitude, p.longitude, speed, direction,
  (case when speed is null and trim(Velocidad) <> '' then 1 else 0 end
   + case when direction is null and trim(Rumbo) <> '' then 1 else 0 end) as n_unparsed, file_name,
  case when q.longitude is not null then 'port_visit' else 'at_sea' end as location,
  coalesce(m.name, 'open area') as zone, m.decree as mpa_decree, m.state, m.municipality, m.region
  from pre0 p left join pre_mpa m on p.longitude = m.longitude and p.latitude = m.latitude
  left join pre_port q on p.longitude = q.longitude and p.latitude = q.latitude""",
                 ["pre0", "pre_mpa", "pre_port"])


@register("q01_preprocess_raw_pings", O.with_ctes("select * from pre", "pre"))
def q01(spark, sf_dir):
    p = preprocessed(spark, sf_dir)
    return p.withColumn("date_text", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).select(*PRE_COLS)


@register("q02_modelled_pings", O.with_ctes(
    "select file_name, vessel_name, RNP, strftime(date, '%Y-%m-%d %H:%M:%S') as date_text, longitude, latitude, "
    "speed, zone, vessel_state from modelled", "modelled"))
def q02(spark, sf_dir):
    m = Inputs(spark, sf_dir).modelled
    return m.select("file_name", "vessel_name", "RNP", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date_text"),
                    "longitude", "latitude", "speed", "zone", "vessel_state")


@register("q03_fishing_positions", O.with_ctes(
    "select vessel_name, file_name, longitude, latitude from modelled where vessel_state = 'hauling' "
    "and longitude between (select min(longitude) from modelled) and (select max(longitude) from modelled) "
    "and latitude between (select min(latitude) from modelled) and (select max(latitude) from modelled)",
    "modelled"))
def q03(spark, sf_dir):
    m = Inputs(spark, sf_dir).modelled
    pts = rollup.hauling(m).select("vessel_name", "file_name", "longitude", "latitude")
    return geo.within_box_of(pts, m)


# --- single operators ---------------------------------------------------------------------------

from vesselflow.operators import grid as grid_ops  # noqa: E402
from vesselflow.operators import series as series_ops  # noqa: E402
from vesselflow.operators import profile as profile_ops  # noqa: E402


@register("j01_zone_membership", O.with_ctes(
    "select layer, name, count(*) as n_positions from (select distinct p.longitude, p.latitude, e.layer, e.name "
    "from (select distinct longitude, latitude from pings) p join edges e on " + O.CROSS +
    " group by p.longitude, p.latitude, e.layer, e.name, e.pid having count(*) % 2 = 1) t group by layer, name",
    "pings", "edges"))
def j01(spark, sf_dir):
    """Distinct positions inside each polygon of every layer."""
    i = Inputs(spark, sf_dir)
    pos = adapters.pings(spark, sf_dir).select("longitude", "latitude").distinct()
    parts = []
    for layer, zl in i.layers.items():
        hit = geo.join_zones(pos, zl, "inner", rename={"pid": "_pid"}).select("name", "_pid")
        parts.append(hit.groupBy("name").agg(F.count(F.lit(1)).alias("n_positions"))
                        .withColumn("layer", F.lit(layer)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("layer", "name", "n_positions")


@register("m06_impact_summary", O.with_ctes(
    "select series_id, count(*) as n_post, round(avg(y), 6) as actual_avg, round(avg(pred), 6) as pred_avg, "
    "round(avg(effect), 6) as effect_avg, round(sum(y), 6) as actual_sum, round(sum(pred), 6) as pred_sum, "
    "round(sum(effect), 6) as effect_sum, round(sum(effect) / nullif(sum(pred), 0), 6) as rel_effect "
    "from (" + "\nunion all\n".join(
        "select series_id, y, a + b * t as pred, y - (a + b * t) as effect, in_post from ("
        "select s.*, f.a, f.b from (select series_id, date, y, row_number() over (partition by series_id order by date) as t, "
        f"date between date '{S.post_start}' and date '{S.post_end}' as in_post from {src}) s join "
        "(select series_id, regr_slope(y, t) as b, regr_intercept(y, t) as a from (select series_id, date, y, "
        f"row_number() over (partition by series_id order by date) as t from {src}) z where date between date "
        f"'{S.pre_start}' and date '{S.pre_end}' group by series_id) f on s.series_id = f.series_id) u"
        for src in ("s_act", "s_cpue_yes", "s_cpue_no", "s_area_yes", "s_area_no"))
    + ") v where in_post group by series_id",
    "s_act", "s_cpue_yes", "s_cpue_no", "s_area_yes", "s_area_no"))
def m06(spark, sf_dir):
    """M6 over all five series fitted in one plan (one group per series)."""
    i = Inputs(spark, sf_dir)
    s = (FG.activity_series(i.hours, S)
         .unionByName(FG.cpue_series(i.landings, i.permits, i.active, S))
         .unionByName(FG.area_series(i.areas(), S)))
    summ = series_ops.impact_summary(FG.impact(s, S))
    return r6(summ, "actual_avg", "pred_avg", "effect_avg", "actual_sum", "pred_sum", "effect_sum", "rel_effect")


_PROFILE_COLS = ["vessel_name", "RNP", "longitude", "latitude", "speed", "file_name", "zone", "vessel_state"]


@register("s11_profile", O.with_ctes(" union all ".join(
    f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_missing, "
    f"count(distinct {c}) as n_distinct from modelled" for c in _PROFILE_COLS), "modelled"))
def s11(spark, sf_dir):
    """Rows, missing and distinct values per column (one pass)."""
    return profile_ops.profile(Inputs(spark, sf_dir).modelled, _PROFILE_COLS)


@register("a10_extent", O.with_ctes(
    "select min(longitude) as xmin, max(longitude) as xmax, min(latitude) as ymin, max(latitude) as ymax "
    "from modelled where vessel_state = 'hauling'", "modelled"))
def a10(spark, sf_dir):
    """A10: extent of the fishing positions."""
    return geo.bounding_box(rollup.hauling(Inputs(spark, sf_dir).fishing))


@register("w01_file_dates", O.with_ctes(
    "select file_name, year, month, " + O.SAFE_DATE.format(day="fmax", y="year", m="month") + " as date "
    "from (select distinct file_name, year, month from pings) p join "
    "(select file_name as f, max(day) as fmax from pings group by file_name) m on p.file_name = m.f", "pings"))
def w01(spark, sf_dir):
    """Every (file, year, month) with the file's last day as its date (T4)."""
    p = adapters.pings(spark, sf_dir)
    pv = p.groupBy("file_name", "year", "month").agg(F.max("day").alias("max_day"))
    return rollup.file_dates(pv).select("file_name", "year", "month", "date")


@register("p22_file_positions", O.with_ctes(
    f"select file_name, cast(pos as integer) as pos from files_ranked where pos >= {S.before_files[0]}", "files_ranked"))
def p22(spark, sf_dir):
    """Positions of the sorted distinct file list (before + after slices)."""
    from vesselflow.operators.order import positions
    ranked = positions(Inputs(spark, sf_dir).fishing, "file_name")
    return ranked.where(F.col("pos") >= S.before_files[0])


@register("g03_ping_density", O.with_ctes(
    f"select cast({O.CELL_ROW} as integer) as row, cast({O.CELL_COL} as integer) as col, count(*) as n_pings "
    f"from modelled where vessel_state = 'hauling' and {O.IN_EXTENT} group by {O.CELL_ROW}, {O.CELL_COL}",
    "modelled"))
def g03(spark, sf_dir):
    """G2/G3 with ``fun = count``: hauling pings per 0.1-degree cell."""
    h = rollup.hauling(Inputs(spark, sf_dir).modelled)
    return grid_ops.rasterize(h, "longitude", fun="count", out="n_pings")


@register("g05_cell_area", O.with_ctes(
    f"select cast(row as integer) as row, round({O.CELL_AREA}, 6) as cell_area_km2 from "
    f"(select distinct {O.CELL_ROW} as row from modelled where {O.IN_EXTENT}) t", "modelled"))
def g05(spark, sf_dir):
    """Area of the cells of every grid row that holds a ping."""
    cells = grid_ops.assign_cells(Inputs(spark, sf_dir).fishing).select("row").distinct()
    return r6(cells.withColumn("cell_area_km2", grid_ops.cell_area_km2(F.col("row"))), "cell_area_km2")


@register("f01_landing_names", O.with_ctes(
    "select regexp_replace(split_part(vessel_name, '(', 1), '^\\s+|\\s+$', '', 'g') as first_name, "
    "case when strpos(vessel_name, '(') > 0 then substr(vessel_name, strpos(vessel_name, '(') + 1) else '' end "
    "as second_name, count(*) as n from landings group by all", "landings"))
def f01(spark, sf_dir):
    """landing names split at the first '(' into two fixed parts, first part trimmed."""
    from vesselflow.functions import split_first, trim_ws
    l = adapters.landings(spark, sf_dir)
    first, second = split_first(F.col("vessel_name"))
    return l.groupBy(trim_ws(first).alias("first_name"), second.alias("second_name")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("p23_valid_positions", O.with_ctes(
    "select count(*) as n_rows, cast(sum(case when longitude is not null and latitude is not null and "
    "longitude between -180e0 and 180e0 and latitude between -90e0 and 90e0 then 1 else 0 end) as bigint) as n_valid "
    "from pings", "pings"))
def p23(spark, sf_dir):
    p = adapters.pings(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.when(geo.valid_position(), 1).otherwise(0)).alias("n_valid"))


@register("s10_year_scope", O.with_ctes(
    "select year, month, count(*) as n_pings from pings where year in (1996, 1997) group by year, month", "pings"))
def s10(spark, sf_dir):
    """The pings of some years only (a partition filter on landed data)."""
    p = adapters.pings(spark, sf_dir).where(F.col("year").isin(1996, 1997))
    return p.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_pings"))


@register("w04_season_index", O.with_ctes(
    "select series_id, date, cast(t as integer) as t, cast(((t - 1) // 2) % 30 as integer) as season "
    "from (select series_id, date, row_number() over (partition by series_id order by date) as t from s_act) x",
    "s_act"))
def w04(spark, sf_dir):
    """Time index and the 30 x 2 season index of the activity series."""
    s = series_ops.time_index(FG.activity_series(Inputs(spark, sf_dir).hours, S))
    return s.select("series_id", "date", "t", series_ops.season_index().alias("season"))


# --- model fits (rows-only checks) -------------------------------------------------------------------

MCMC_ITER_QUERY = C.MCMC_ITERATIONS


@register("m05_bayesian_impact")
def m05(spark, sf_dir):
    """M5: structural time-series counterfactual for the five series at once."""
    from vesselflow.operators.models import bayesian_impact
    i = Inputs(spark, sf_dir)
    s = (FG.activity_series(i.hours, S)
         .unionByName(FG.cpue_series(i.landings, i.permits, i.active, S))
         .unionByName(FG.area_series(i.areas(), S)))
    s = series_ops.flag_periods(series_ops.time_index(s), (S.pre_start, S.pre_end), (S.post_start, S.post_end))
    return bayesian_impact(s, niter=MCMC_ITER_QUERY)


@register("m06b_bayesian_summary")
def m06b(spark, sf_dir):
    """M6 over M5: Bayesian impact summary (intervals from draws) for the five series."""
    from vesselflow.operators.models import bayesian_summary
    i = Inputs(spark, sf_dir)
    s = (FG.activity_series(i.hours, S)
         .unionByName(FG.cpue_series(i.landings, i.permits, i.active, S))
         .unionByName(FG.area_series(i.areas(), S)))
    s = series_ops.flag_periods(series_ops.time_index(s), (S.pre_start, S.pre_end), (S.post_start, S.post_end))
    return bayesian_summary(s, niter=MCMC_ITER_QUERY)


@register("m07_gamma_trend")
def m07(spark, sf_dir):
    """M7: Gamma/log smoothed trends of Fig 1A (per period) and Fig 1B (per fleet and period)."""
    from vesselflow.operators.models import gamma_trend
    i = Inputs(spark, sf_dir)
    a = FG.mpa_monthly_effort(i.hours, S).select(F.lit("activity").alias("series_id"), "period", "date",
                                                 F.col("effort").alias("y"))
    c = FG.monthly_cpue(i.landings, i.permits, i.active, S).select(
        F.concat(F.lit("cpue_"), F.col("revi")).alias("series_id"), "period", "date", F.col("cpue").alias("y"))
    return gamma_trend(a.unionByName(c), ["series_id", "period"])


def _refreshed_states(spark, sf_dir, i: Inputs) -> str:
    """States after two refreshes: files of January to April and an older text of May and June first, then every file as it is, so
    that the second refresh computes May and later only."""
    from vesselflow.plans import incremental
    out = f"{ensure_checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    number = F.when(F.col("month") <= 4, "1")
    early = i.modelled.where("month <= 4 or (month <= 6 and day % 7 <> 3)")
    old = early.select("file_name", "month").distinct().select("file_name", F.coalesce(number, F.lit("0")).alias("version"))
    incremental.refresh(early, old, i.layers, out, S)
    incremental.refresh(i.modelled, i.modelled.select("file_name").distinct().withColumn("version", F.lit("1")), i.layers, out, S)
    return out


@register("q04b_incremental_hours", O.with_ctes(
    "select file_name, year, month, vessel_name, zone, cast(hrs as bigint) as hrs from hours_f", "hours_f"))
def q04b(spark, sf_dir):
    """Q4 per file from partial states that were refreshed twice."""
    from vesselflow.plans import incremental
    return incremental.hours(spark, _refreshed_states(spark, sf_dir, Inputs(spark, sf_dir)), with_file=True)


@register("q10b_incremental_areas", O.with_ctes("select date, area, revi from areas", "areas"))
def q10b(spark, sf_dir):
    """Q10 from partial states that were refreshed twice; the active fleet comes from the states as well."""
    from vesselflow.plans import incremental
    i = Inputs(spark, sf_dir)
    out = _refreshed_states(spark, sf_dir, i)
    active = membership.materialize(FG.active_fleet(incremental.hours(spark, out), S.fleet_min_year))
    return incremental.area_results(spark, out, i.layers, i.permits, active, S)


# A fixed number of iterations on both sides, so that rounding cannot move the place where they stop.
MIXTURE_STEPS = 25


def _mixture_sql(body: str) -> str:
    """The fit as a recursive statement over the speed histogram, one row an iteration."""
    from vesselflow.operators.mixture import MAX_EXPONENT, MIN_VARIANCE
    odds = ("(ln(w2) - ln(v2) / 2e0 - (x - m2) * (x - m2) / (2e0 * v2)) - "
            "(ln(w1) - ln(v1) / 2e0 - (x - m1) * (x - m1) / (2e0 * v1))")
    floor = O.d(MIN_VARIANCE)
    return (f"with recursive pings as ({O.PINGS}), h as (select speed as x, cast(count(*) as double) as n from pings where speed is not null group by speed), "
            "s as (select sum(n * x) / sum(n) as m, sum(n * x * x) / sum(n) as q from h), "
            f"s2 as (select m, greatest(q - m * m, {floor}) as v from s), "
            "em(i, w1, m1, v1, w2, m2, v2) as (select 0, cast(0.5 as double), m - sqrt(v), v, cast(0.5 as double), m + sqrt(v), v from s2 union all "
            f"select i + 1, n1 / n, m1 + d1 / n1, greatest(q1 / n1 - d1 / n1 * (d1 / n1), {floor}), "
            f"n2 / n, m2 + d2 / n2, greatest(q2 / n2 - d2 / n2 * (d2 / n2), {floor}) from ("
            "select i, m1, m2, sum(n) as n, sum(n * r) as n1, sum(n * r * (x - m1)) as d1, sum(n * r * (x - m1) * (x - m1)) as q1, "
            "sum(n * (1e0 - r)) as n2, sum(n * (1e0 - r) * (x - m2)) as d2, sum(n * (1e0 - r) * (x - m2) * (x - m2)) as q2 from ("
            f"select em.*, h.*, 1e0 / (1e0 + exp(least({O.d(MAX_EXPONENT)}, {odds}))) as r from em, h where i < {MIXTURE_STEPS}) g group by i, m1, m2) t), "
            f"f as (select * from em where i = {MIXTURE_STEPS}) " + body.replace("{odds}", odds))


def _mixture_fit(spark, sf_dir):
    from vesselflow.operators import mixture
    return mixture.fit(mixture.speed_histogram(adapters.pings(spark, sf_dir)), iterations=MIXTURE_STEPS, tolerance=float("-inf"))


@register("m01b_mixture_states", _mixture_sql(
    f"select file_name, case when x is null then 'unknown' when {{odds}} <= 0 then '{C.HAULING}' else 'steaming' end as vessel_state, "
    "count(*) as n_pings from (select file_name, speed as x from pings) p, f group by 1, 2"))
def m01b(spark, sf_dir):
    """Fishing state from a two-component Gaussian mixture on speed; rows per state and file."""
    from vesselflow.operators.mixture import mixture_state
    p = adapters.pings(spark, sf_dir).withColumn("vessel_state", mixture_state(F.col("speed"), _mixture_fit(spark, sf_dir)))
    return p.groupBy("file_name", "vessel_state").agg(F.count(F.lit(1)).alias("n_pings"))


@register("m01c_mixture_components", _mixture_sql(
    f"select '{C.HAULING}' as component, round(w1, 6) as weight, round(m1, 6) as mean, round(sqrt(v1), 6) as sd from f "
    "union all select 'steaming', round(w2, 6), round(m2, 6), round(sqrt(v2), 6) from f"))
def m01c(spark, sf_dir):
    """Weight, mean and deviation of the two components."""
    from vesselflow.operators.mixture import components
    return r6(components(_mixture_fit(spark, sf_dir), spark), "weight", "mean", "sd")


@register("w03_series_completeness", O.with_ctes(
    "select series_id, count(*) as n_rows from (select series_id from s_act union all select series_id from "
    "s_cpue_yes union all select series_id from s_cpue_no union all select series_id from s_area_yes union all "
    "select series_id from s_area_no) t group by series_id",
    "s_act", "s_cpue_yes", "s_cpue_no", "s_area_yes", "s_area_no"))
def w03(spark, sf_dir):
    """Rows per impact series (the analysed code fixes these counts by hand)."""
    i = Inputs(spark, sf_dir)
    s = (FG.activity_series(i.hours, S)
         .unionByName(FG.cpue_series(i.landings, i.permits, i.active, S))
         .unionByName(FG.area_series(i.areas(), S)))
    return series_ops.completeness(s)


_SERIES = ("s_act", "s_cpue_yes", "s_cpue_no", "s_area_yes", "s_area_no")
_PERIODS = " union all ".join(
    "select series_id, date, y, row_number() over (partition by series_id order by date) as t, "
    f"date between date '{S.pre_start}' and date '{S.pre_end}' as in_pre, "
    f"date between date '{S.post_start}' and date '{S.post_end}' as in_post from {src}" for src in _SERIES)
# Student's t by bisection of the angle; the coefficients of the finite series come from a recursive product.
O.CTES["iv_u"] = (_PERIODS, list(_SERIES))
O.CTES["iv_line"] = ("select series_id, regr_slope(y, t) as b, regr_intercept(y, t) as a, count(y) as n_pre, avg(t) as m, "
                     "sum(t * t) - sum(t) * sum(t) / count(*) as sxx from iv_u where in_pre and y is not null group by series_id", ["iv_u"])
O.CTES["iv_fit"] = ("select l.*, sqrt(s.sse / (n_pre - 2)) as sd from iv_line l join (select u.series_id, "
                    "sum(pow(u.y - (l.a + l.b * u.t), 2)) as sse from iv_u u join iv_line l using (series_id) "
                    "where in_pre and y is not null group by u.series_id) s using (series_id)", ["iv_u", "iv_line"])
O.CTES["iv_coef"] = ("""select df, list(c order by k) as cs from (
  with recursive r as (
    select distinct n_pre - 2 as df, 0 as k, 1e0 as c from iv_fit
    union all
    select df, k + 1, c * case when df % 2 = 0 then (2e0 * k + 1) / (2e0 * k + 2) else (2e0 * k + 2) / (2e0 * k + 3) end
    from r where k + 1 < df // 2)
  select * from r where k < df // 2) x group by df""", ["iv_fit"])


def _within_sql(angle: str) -> str:
    powers = f"list_sum(list_transform(range(len(cs)), lambda i: cs[i + 1] * pow(cos({angle}), 2 * i + df % 2)))"
    return f"(case when df % 2 = 0 then sin({angle}) * {powers} else 2 / pi() * ({angle} + sin({angle}) * {powers}) end)"


O.CTES["iv_crit"] = (f"""select df, tan((lo + hi) / 2) * sqrt(df) as t_crit from (
  with recursive r as (
    select df, cs, 0e0 as lo, pi() / 2 as hi, 0 as i from iv_coef
    union all
    select df, cs, case when {_within_sql('((lo + hi) / 2)')} < 0.95 then (lo + hi) / 2 else lo end,
      case when {_within_sql('((lo + hi) / 2)')} < 0.95 then hi else (lo + hi) / 2 end, i + 1 from r where i < 60)
  select * from r where i = 60) x""", ["iv_coef"])


def _impact_series(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return FG.impact(FG.activity_series(i.hours, S).unionByName(FG.cpue_series(i.landings, i.permits, i.active, S))
                     .unionByName(FG.area_series(i.areas(), S)), S)


@register("m04_prediction_intervals", O.with_ctes(
    "select u.series_id, u.date, round(a + b * t, 6) as pred, "
    "round(a + b * t - t_crit * sd * sqrt(1 + 1e0 / n_pre + pow(t - m, 2) / sxx), 6) as pi_lower, "
    "round(a + b * t + t_crit * sd * sqrt(1 + 1e0 / n_pre + pow(t - m, 2) / sxx), 6) as pi_upper "
    "from iv_u u join iv_fit f using (series_id) join iv_crit c on c.df = f.n_pre - 2", "iv_u", "iv_fit", "iv_crit"))
def m04(spark, sf_dir):
    """M4: exact 95% prediction interval of every month of the five series (Student's t, error of the line included)."""
    p = intervals.prediction_intervals(_impact_series(spark, sf_dir))
    return r6(p.select("series_id", "date", "pred", "pi_lower", "pi_upper"), "pred", "pi_lower", "pi_upper")


_IV = ("resid_sd", "t_crit", "pred_avg", "pred_avg_lower", "pred_avg_upper", "effect_avg", "effect_se", "effect_avg_lower",
       "effect_avg_upper", "effect_sum", "effect_sum_lower", "effect_sum_upper", "rel_effect", "rel_lower", "rel_upper", "tail_p")


@register("m06c_impact_intervals", O.with_ctes(
    "select series_id, n_pre, n_post, " + ", ".join(f"round({c}, 6) as {c}" for c in _IV) + f""" from (
  select *, effect_avg / nullif(pred_avg, 0) as rel_effect, least(effect_avg_lower / nullif(pred_avg, 0), effect_avg_upper / nullif(pred_avg, 0)) as rel_lower,
    greatest(effect_avg_lower / nullif(pred_avg, 0), effect_avg_upper / nullif(pred_avg, 0)) as rel_upper,
    n_post * effect_avg as effect_sum, n_post * effect_avg_lower as effect_sum_lower, n_post * effect_avg_upper as effect_sum_upper,
    (1 - {_within_sql('angle')}) / 2 as tail_p
  from (select *, effect_avg - half as effect_avg_lower, effect_avg + half as effect_avg_upper, pred_avg - half as pred_avg_lower,
          pred_avg + half as pred_avg_upper, atan(abs(effect_avg / effect_se) / sqrt(df)) as angle
    from (select *, t_crit * effect_se as half from (
      select f.series_id, f.n_pre, p.n_post, f.sd as resid_sd, c.t_crit, p.pred_avg, p.effect_avg, c.df, k.cs,
        f.sd * sqrt(1e0 / p.n_post + 1e0 / f.n_pre + pow(p.tp - f.m, 2) / f.sxx) as effect_se
      from iv_fit f join iv_crit c on c.df = f.n_pre - 2 join iv_coef k on k.df = c.df
      join (select series_id, count(*) as n_post, avg(t) as tp, avg(a + b * t) as pred_avg, avg(y - (a + b * t)) as effect_avg
            from iv_u join iv_line using (series_id) where in_post and y is not null group by series_id) p on p.series_id = f.series_id)))) z""",
    "iv_u", "iv_line", "iv_fit", "iv_coef", "iv_crit"))
def m06c(spark, sf_dir):
    """M6: average, total and relative effect with exact 95% intervals and the tail probability, five series in one plan."""
    return r6(intervals.impact_intervals(_impact_series(spark, sf_dir)), *_IV)


_OBSERVED = "select 'activity' as series_id, date, y from s_act_m" + "".join(f" union all select series_id, date, y from {x}" for x in _SERIES[1:])


def _observed(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return FG.observed_series(i.hours, i.landings, i.permits, i.active, i.areas(), S)


@register("w03b_gap_runs", O.with_ctes(f"""select series_id, cast(min(month) as date) as first_month, cast(max(month) as date) as last_month,
  count(*) as n_months, present
from (select *, sum(case when present is distinct from before then 1 else 0 end) over (partition by series_id order by month) as run
  from (select *, lag(present) over (partition by series_id order by month) as before
    from (select c.series_id, c.month, coalesce(n, 0) > 0 as present
      from (select series_id, unnest(generate_series(timestamp '{S.pre_start}', timestamp '{S.post_end}', interval 1 month)) as month
            from (select distinct series_id from ({_OBSERVED}) d) e) c
      left join (select series_id, date_trunc('month', date) as month, count(y) as n from ({_OBSERVED}) o group by 1, 2) f
        on c.series_id = f.series_id and c.month = f.month) a) b) r
group by series_id, present, run""", "s_act_m", *_SERIES[1:]))
def w03b(spark, sf_dir):
    """Runs of present and missing months of the five series as observed, against the study's calendar."""
    return series_ops.gap_runs(_observed(spark, sf_dir), S.pre_start, S.post_end)


@register("w03c_expected_rows", O.with_ctes(" union all ".join([
    f"select 'cpue_pair' as \"check\", count(*) as n_rows, cast({S.expected_rows['cpue_pair']} as bigint) as n_expected, "
    f"count(*) = {S.expected_rows['cpue_pair']} as complete from (select * from s_cpue_yes union all select * from s_cpue_no) c",
    f"select series_id, count(*), cast({S.expected_rows['area_series']} as bigint), count(*) = {S.expected_rows['area_series']} "
    "from (select * from s_area_yes union all select * from s_area_no) a group by series_id"]), *_SERIES[1:]))
def w03c(spark, sf_dir):
    """The fixed lengths of the series (both CPUE fleets together, each area series) against their rows."""
    i = Inputs(spark, sf_dir)
    s = FG.cpue_series(i.landings, i.permits, i.active, S).unionByName(FG.area_series(i.areas(), S))
    return series_ops.expected_counts(s, S.expected_rows)


# --- more single operators -----------------------------------------------------------------------

def _raw_clean(spark, sf_dir, with_ids=False):
    return clean.preprocess(adapters.raw_pings(spark, sf_dir), file_col="source_file", with_ids=with_ids)


@register("p02_numeric_repair", O.with_ctes(
    "select count(*) as n_rows, count(speed) as n_speed, count(direction) as n_direction, "
    "cast(sum(n_unparsed) as bigint) as n_unparsed, round(sum(speed), 6) as speed_sum, "
    "round(sum(direction), 6) as direction_sum from pre", "pre"))
def p02(spark, sf_dir):
    """Speed and direction text repaired to doubles, with unparsed counts."""
    p = _raw_clean(spark, sf_dir)
    return r6(p.agg(F.count(F.lit(1)).alias("n_rows"), F.count("speed").alias("n_speed"),
                    F.count("direction").alias("n_direction"), F.sum("n_unparsed").alias("n_unparsed"),
                    F.sum("speed").alias("speed_sum"), F.sum("direction").alias("direction_sum")),
              "speed_sum", "direction_sum")


@register("p03_registration_text", O.with_ctes(
    "select RNP, count(*) as n from pre group by RNP", "pre"))
def p03(spark, sf_dir):
    """Registration ids read as doubles rendered as integer text."""
    return _raw_clean(spark, sf_dir).groupBy("RNP").agg(F.count(F.lit(1)).alias("n"))


@register("p04_timestamp_parts", O.with_ctes(
    "select year, month, day, count(*) as n, count(date_text) as n_parsed from pre group by year, month, day",
    "pre"))
def p04(spark, sf_dir):
    """Text timestamps parsed with the raw format; parts per day."""
    p = _raw_clean(spark, sf_dir)
    return p.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"), F.count("date").alias("n_parsed"))


@register("p05_row_ids", O.with_ctes(
    "select file_name, count(*) as n, cast(1 as bigint) as min_id, count(*) as max_id, "
    "count(*) as n_distinct_ids from (select source_file as file_name from raw) r group by file_name", "raw"))
def p05(spark, sf_dir):
    """P5: per-file ids are exactly 1..n (dense, unique) whatever the input splits."""
    p = _raw_clean(spark, sf_dir, with_ids=True)
    return p.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"),
                                      F.max("id").alias("max_id"), F.count_distinct("id").alias("n_distinct_ids"))


@register("p06_file_names", O.with_ctes(
    "select source_file as file_name, count(*) as n from raw group by source_file", "raw"))
def p06(spark, sf_dir):
    """Provenance column of the row-bound files."""
    return _raw_clean(spark, sf_dir).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


@register("u02_other_fleet", O.with_ctes(
    "select distinct vessel_name from permits where vessel_name not in (select vessel_name from active)",
    "permits", "active"))
def u02(spark, sf_dir):
    """Permitted vessels never active in the protected area."""
    i = Inputs(spark, sf_dir)
    return membership.difference(i.permits, i.active)


@register("p16_zone_relabel", O.with_ctes(
    "select zone as zone_in, eez_name, " + O.ZONE_LABEL + " as zone_out, count(*) as n from h1 "
    "group by zone, eez_name, " + O.ZONE_LABEL, "h1"))
def p16(spark, sf_dir):
    """Hauling pings in the ocean by protected-area zone, EEZ name and relabelled zone."""
    i = Inputs(spark, sf_dir)
    p = rollup.hauling(i.modelled).select("zone", "longitude", "latitude")
    c = rollup.clip_and_label(p, i.layers).withColumnRenamed("zone", "zone_in")
    c = rollup.relabel_zone(c.withColumn("zone", F.col("zone_in"))).withColumnRenamed("zone", "zone_out")
    return c.groupBy("zone_in", "eez_name", "zone_out").agg(F.count(F.lit(1)).alias("n"))


@register("j04_port_visits", O.with_ctes(
    "select location, count(*) as n from pre group by location", "pre"))
def j04(spark, sf_dir):
    """Pings within the port radius vs at sea."""
    return preprocessed(spark, sf_dir).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


@register("o03_preview", O.with_ctes(
    "select year, month, vessel_name, zone, cast(hrs as bigint) as hrs from hours_f "
    "order by hrs desc, year, month, vessel_name, zone limit 10", "hours_f"))
def o03(spark, sf_dir):
    """O3: the ten largest monthly vessel-hour rows (a total order, then a limit)."""
    h = Inputs(spark, sf_dir).hours
    return profile_ops.preview(h, 10, [F.col("hrs").desc(), "year", "month", "vessel_name", "zone"])


@register("f08_hour_of_day", O.with_ctes(
    "select hour, count(*) as n_pings from h0 group by hour", "h0"))
def f08(spark, sf_dir):
    """F8: hauling pings by clock hour (UTC)."""
    h = rollup.with_hour(rollup.hauling(Inputs(spark, sf_dir).modelled))
    return h.groupBy("hour").agg(F.count(F.lit(1)).alias("n_pings"))


@register("m01_speed_states", O.with_ctes(
    "select vessel_state, count(*) as n_pings, round(avg(speed), 6) as mean_speed from modelled "
    "group by vessel_state", "modelled"))
def m01(spark, sf_dir):
    """Speed-band fishing state per ping."""
    m = Inputs(spark, sf_dir).modelled
    return r6(m.groupBy("vessel_state").agg(F.count(F.lit(1)).alias("n_pings"), F.avg("speed").alias("mean_speed")),
              "mean_speed")


@register("f08_event_clock_hours",
          "select cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(hour(ts) as integer) "
          "as hour, count(*) as n from events group by year(ts), month(ts), hour(ts)")
def f08e(spark, sf_dir):
    """F8 on a real clock: year, month and hour of event timestamps (session time zone UTC)."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("ts")
    return (e.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), F.hour("ts").alias("hour"))
             .agg(F.count(F.lit(1)).alias("n")))
