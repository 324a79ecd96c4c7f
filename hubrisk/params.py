"""Parameters of the analysis (the reference's constants, made explicit)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's for identical results.
# WMO weather-code groups used by the daily weather rollup.
WMO_THUNDERSTORM = (95, 96, 99)
WMO_FOG = (45, 48)
WMO_FREEZING_RAIN = (66, 67)
WMO_HEAVY_RAIN = (63, 65)
WMO_HEAVY_SNOW = (73, 75)
WMO_SEVERE = (45, 48, 63, 65, 66, 67, 73, 75, 95, 96, 99)

# Season labels of the recommendation outputs (month -> label).
SEASONS = {
    "Spring (Mar-May)": (3, 4, 5),
    "Summer (Jun-Aug)": (6, 7, 8),
    "Fall (Sep-Nov)": (9, 10, 11),
    "Winter (Dec-Feb)": (12, 1, 2),
}
# Short season labels of the distribution figure.
SHORT_SEASONS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}

# Composite risk-score weights (sum to 1.00).
RISK_WEIGHTS = {
    "joint_weather_delay_prob": 0.15,
    "conditional_delay_prob": 0.15,
    "thunderstorm_co_occurrence": 0.08,
    "severe_weather_co_occurrence": 0.05,
    "precip_correlation": 0.05,
    "joint_delay_15_prob": 0.07,
    "combined_weather_risk": 0.05,
    "ifr_co_occurrence": 0.05,
    "duty_violation_risk": 0.10,
    "missed_connection_prob": 0.15,
    "fatigue_exposure": 0.10,
}
# Features normalised for the composite score (order of the normalised columns).
SCORE_FEATURES = (
    "joint_weather_delay_prob",
    "joint_delay_15_prob",
    "conditional_delay_prob",
    "precip_correlation",
    "thunderstorm_co_occurrence",
    "severe_weather_co_occurrence",
    "ifr_co_occurrence",
    "missed_connection_prob",
    "duty_violation_risk",
    "fatigue_exposure",
    "combined_weather_risk",
)
# Features whose weights are re-derived from classifier importance.
REWEIGHT_FEATURES = (
    "joint_weather_delay_prob",
    "conditional_delay_prob",
    "thunderstorm_co_occurrence",
    "severe_weather_co_occurrence",
    "precip_correlation",
    "joint_delay_15_prob",
    "combined_weather_risk",
)
# Avoid-list reasons, checked in this order (column, threshold, text).
AVOID_REASONS = (
    ("joint_weather_delay_prob", 0.05, "correlated weather delays"),
    ("missed_connection_prob", 0.5, "tight turnaround / missed connection risk"),
    ("duty_violation_risk", 0.8, "duty time violation risk"),
    ("fatigue_exposure", 0.0, "fatigue / WOCL exposure"),
    ("thunderstorm_co_occurrence", 0.05, "thunderstorm co-occurrence"),
)
AVOID_DEFAULT_REASON = "elevated composite risk"

# The classifier's named (non-weather) feature columns.
MODEL_FEATURES = (
    "joint_weather_delay_prob", "joint_delay_15_prob", "conditional_delay_prob",
    "precip_correlation", "wind_correlation",
    "thunderstorm_co_occurrence", "severe_weather_co_occurrence",
    "distance_ab", "latitude_diff", "longitude_diff",
    "same_region", "tornado_alley_pair", "hurricane_pair", "winter_storm_pair",
    "month_sin", "month_cos",
    "combined_weather_risk", "max_weather_risk",
    "weather_delay_rate_a", "weather_delay_rate_b",
    "weather_delay_mean_a", "weather_delay_mean_b",
    "delay_rate_15_a", "delay_rate_15_b",
    "cancellation_rate_a", "cancellation_rate_b",
    "connection_minutes", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "inbound_arr_time", "outbound_dep_time",
)
WEATHER_FEATURE_PREFIXES = ("wx_a_", "wx_b_", "wx_hub_")


# Climate regions of the airports, and storm corridors by name of their flag column.
CLIMATE_REGIONS = {
    "Northeast": ("BOS", "JFK", "LGA", "EWR", "PHL", "DCA", "IAD", "BWI", "BDL", "PVD", "SYR", "ROC", "BUF", "ALB", "PIT"),
    "Southeast": ("ATL", "CLT", "MIA", "FLL", "MCO", "TPA", "JAX", "RDU", "GSO", "CHS", "SAV", "PBI", "RSW", "SRQ", "MSY", "BNA",
                  "MEM", "SDF"),
    "Midwest": ("ORD", "MDW", "DTW", "MSP", "STL", "MCI", "IND", "CMH", "CLE", "MKE", "CVG", "DSM", "OMA", "ICT"),
    "South_Central": ("DFW", "IAH", "HOU", "AUS", "SAT", "OKC", "TUL", "LIT", "SHV", "ELP"),
    "Mountain": ("DEN", "SLC", "PHX", "ABQ", "TUS", "BOI", "COS", "BIL"),
    "Pacific": ("LAX", "SFO", "SEA", "SAN", "PDX", "SJC", "OAK", "SMF", "ONT", "SNA", "BUR"),
    "Alaska_Hawaii": ("ANC", "HNL", "OGG", "LIH", "KOA"),
}
STORM_CORRIDORS = {
    "in_tornado": ("OKC", "TUL", "ICT", "OMA", "DSM", "MCI", "DFW", "AUS", "SAT", "LIT", "MEM", "SHV"),
    "in_gulf": ("MSY", "HOU", "IAH", "TPA", "MIA", "FLL", "MCO", "JAX", "PBI", "RSW", "SRQ", "MOB"),
    "in_winter": ("BOS", "JFK", "LGA", "EWR", "PHL", "DCA", "IAD", "BWI", "BDL", "PVD", "SYR", "ROC", "BUF", "ALB", "PIT"),
}


@dataclass(frozen=True)
class Params:
    """All tunables of the analysis; defaults are the reference's values."""

    hub: str = "DFW"
    delay_threshold: float = 15.0          # minutes
    cost_per_minute: float = 75.0          # USD
    min_turnaround: int = 60               # minutes, sequence builder / greedy matching
    duty_limit_hours: float = 14.0
    wocl_start_hour: float = 2.0
    wocl_end_hour: float = 6.0
    top_k: tuple[int, ...] = (50, 100, 200, 500)
    top_airports: int | None = None        # pair only the N busiest spokes; None: all
    min_month_dates: int = 5               # pair-months with fewer flight dates are skipped
    min_corr_days: int = 5                 # correlation needs MORE than this many common days
    cascade_gap_min: int = 45
    cascade_gap_max: int = 480
    cascade_cost_threshold: float = 10000.0
    avoid_threshold: float = 65.0
    swap_threshold: float = 30.0
    critical_threshold: float = 80.0
    train_years: tuple[int, ...] = (2019, 2021, 2022, 2023)
    test_year: int = 2024
    validation_last_month: int = 6
    excluded_years: tuple[int, ...] = (2020,)
    # defaults used when an airport is absent from the schedule profile
    default_arr_hhmm: float = 1200.0
    default_dep_hhmm: float = 1400.0
    default_airtime: float = 120.0
    default_p90: float = 30.0
    # physical layout knobs (no effect on results)
    time_bin_minutes: int = 60             # width of the time-of-day bins of the range joins
    pairs_per_key: int | None = 4_000_000  # counted pairs of a (date, bin) above which it is salted; None: never
    salt_buckets: int = 1                  # >1 salts all keys of the same-day range joins alike instead
    seasons: dict = field(default_factory=lambda: dict(SEASONS))
