"""Fixed values and study parameters.

Everything a result depends on is a parameter of the operators; this module only
holds the values the analysis uses by default, written out in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values (must equal the analysed study's for the same results) -------------
HAULING = "hauling"                      # the only vessel_state that counts as fishing
OPEN_AREA = "open area"                  # zone label of a ping outside every MPA
EEZ_LABEL = "EEZ"                        # relabel of open area inside the home EEZ
HIGH_SEAS = "High seas"                  # relabel of a ping outside every EEZ
HOME_EEZ_NAME = "Mexican Pacific Exclusive Economic Zone"
MPA_PATTERN = "Revillagigedo"            # regex that picks the protected area
PERIOD_BEFORE = "Before"
PERIOD_AFTER = "After"
FLEET_YES = "yes"                        # canonical (lower-case) storage of the fleet flag
FLEET_NO = "no"
FLEET_LABELS = {"no": "No", "yes": "Yes"}   # factor(levels = c("no","yes"), labels = c("No","Yes"))
INCREASE, DECREASE, SAME = "Increase", "Decrease", "same"
PORT_VISIT, AT_SEA = "port_visit", "at_sea"
CRS = "EPSG:4326"                        # every coordinate is WGS84 lon/lat, planar tests on degrees

# grid: extent lon -155..-75, lat -12..35 at 0.1 degree -> 800 x 470 cells
GRID_XMIN, GRID_XMAX, GRID_YMIN, GRID_YMAX = -155.0, -75.0, -12.0, 35.0
GRID_RES = 0.1
GRID_NCOL, GRID_NROW = 800, 470

# WGS84 ellipsoid (km) for cell areas
WGS84_A_KM = 6378.137
WGS84_E2 = 0.00669437999014

# structural time-series model settings of the impact analysis
MCMC_ITERATIONS = 1000
N_SEASONS = 30
SEASON_DURATION = 2

# raw file layout: Spanish headers -> English names
RAW_RENAMES = {
    "Nombre": "vessel_name",
    "RNP": "RNP",
    "Puerto Base": "port_base",
    "Permisionario o Concesionario": "owner",
    "Fecha": "raw_date",
    "Latitud": "latitude",
    "Longitud": "longitude",
    "Velocidad": "raw_speed",
    "Rumbo": "raw_direction",
}
RAW_TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm"


@dataclass(frozen=True)
class Study:
    """Calendar and filter parameters of one analysis.

    ``REFERENCE_STUDY`` holds the published values (data 2008-2022, closure
    November 2017).  ``FIXTURE_STUDY`` maps the same roles onto the driver's
    test tables, whose pings span 1995-01 .. 2001-11.
    """
    cut_date: str                 # figures: date < cut -> Before (2017-11-01 itself is After)
    pre_start: str                # impact model pre period (inclusive)
    pre_end: str
    post_start: str
    post_end: str
    hours_min_year: int           # monthly hours keep year > this
    fleet_min_year: int | None    # grid scripts build the active fleet from year > this (None: no filter)
    cpue_from: str                # impact CPUE series start (date >=)
    area_outlier: float           # Fig 1C keeps area (10^3 km2) < this
    before_files: tuple[int, int] # 1-based inclusive positions in the sorted file list
    after_files: tuple[int, int | None]
    before_years: tuple[int, int] # before grid keeps lo <= year < hi
    other_fleet_files: tuple[int, int | None] | None = None   # area of the non-active fleet skips file 1; None = open end
    unit_hours_fig: float = 24.0  # Fig 1A reports days (hours / 24) ...
    unit_hours_model: float = 1.0 # ... the impact model uses hours
    expected_rows: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Study":
        return replace(self, **kw)


REFERENCE_STUDY = Study(
    cut_date="2017-11-01", pre_start="2008-01-01", pre_end="2017-11-01",
    post_start="2017-12-01", post_end="2021-12-31",
    hours_min_year=2000, fleet_min_year=2005, cpue_from="2008-01-01", area_outlier=800.0,
    before_files=(177, 322), after_files=(323, None), before_years=(2009, 2018),
    other_fleet_files=(2, None), expected_rows={"cpue_pair": 336, "area_series": 164},
)

FIXTURE_STUDY = Study(
    cut_date="1999-11-01", pre_start="1995-01-01", pre_end="1999-11-01",
    post_start="1999-12-01", post_end="2001-11-30",
    hours_min_year=1994, fleet_min_year=None, cpue_from="1995-01-01", area_outlier=800.0,
    before_files=(1, 116), after_files=(117, None), before_years=(1995, 2000),
    other_fleet_files=(2, None), expected_rows={"cpue_pair": 166, "area_series": 83},
)
