"""Scalar Column expressions. All JVM-side, no UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "hhmm_to_minutes", "minutes_to_hhmm", "haversine_miles", "cyclic_sin", "cyclic_cos",
    "pair_lo", "pair_hi", "metar_ceiling", "live_ceiling", "is_ifr", "is_lifr", "is_vfr",
    "is_mvfr", "live_category", "wx_flags", "parse_visibility", "icao_to_iata",
    "spoke_airport", "direction", "season_of", "severity_band", "region_pattern",
    "ratio", "flag", "format_local_time",
]

EARTH_RADIUS_MILES = 3959.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(cond: Column) -> Column:
    """Boolean with NULL read as false (pandas comparison semantics)."""
    return F.coalesce(cond, F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def number(c) -> Column:
    """Text or number -> finite double; bad text, NaN and infinities are NULL."""
    x = _c(c).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN sorts above infinity


def hhmm_to_minutes(t) -> Column:
    """HHMM clock number -> minutes after midnight (integer truncation of t first)."""
    ti = _c(t).cast("int")
    return (F.floor(ti / 100) * 60 + ti % 100).cast("int")


def minutes_to_hhmm(m) -> Column:
    """Minutes -> 'HH:MM' (hours wrap at 24)."""
    mi = F.floor(_c(m))
    return F.format_string("%02d:%02d", (F.floor(mi / 60) % 24).cast("int"), (mi % 60).cast("int"))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return 2 * F.lit(EARTH_RADIUS_MILES) * F.asin(F.sqrt(a))


def cyclic_sin(x, period: float) -> Column:
    return F.sin(2 * math.pi * _c(x) / period)


def cyclic_cos(x, period: float) -> Column:
    return F.cos(2 * math.pi * _c(x) / period)


def pair_lo(a, b) -> Column:
    return F.least(_c(a), _c(b))


def pair_hi(a, b) -> Column:
    return F.greatest(_c(a), _c(b))


def spoke_airport(hub: str) -> Column:
    """The non-hub end of a hub flight."""
    return F.when(F.col("Origin") == hub, F.col("Dest")).otherwise(F.col("Origin"))


def direction(hub: str) -> Column:
    return F.when(F.col("Dest") == hub, F.lit("inbound")).otherwise(F.lit("outbound"))


def metar_ceiling(n_layers: int = 4, present: tuple[int, ...] | None = None) -> Column:
    """Ceiling = height of the FIRST layer (1..4) covered BKN/OVC with a known height, else 99999."""
    layers = present or tuple(range(1, n_layers + 1))
    branches = [
        F.when(F.trim(F.col(f"skyc{i}")).isin("BKN", "OVC") & F.col(f"skyl{i}").isNotNull(),
               F.col(f"skyl{i}").cast("double"))
        for i in layers
    ]
    return F.coalesce(*branches, F.lit(99999.0))


def live_ceiling(clouds) -> Column:
    """Live variant: LOWEST base among BKN/OVC layers with a truthy base, else 99999."""
    bases = F.transform(
        F.filter(_c(clouds), lambda c: c["cover"].isin("BKN", "OVC") & c["base"].isNotNull() & (c["base"] != 0)),
        lambda c: c["base"].cast("double"))
    return F.coalesce(F.array_min(bases), F.lit(99999.0))


def is_ifr(ceiling, vsby) -> Column:
    return flag((_c(ceiling) < 1000) | (_c(vsby) < 3))


def is_lifr(ceiling, vsby) -> Column:
    return flag((_c(ceiling) < 500) | (_c(vsby) < 1))


def is_vfr(ceiling, vsby) -> Column:
    return flag((_c(ceiling) >= 3000) & (_c(vsby) >= 5))


def is_mvfr(ceiling, vsby) -> Column:
    return ~is_ifr(ceiling, vsby) & ~is_vfr(ceiling, vsby)


def live_category(ceiling, vis) -> Column:
    c, v = _c(ceiling), _c(vis)
    return (F.when((c < 500) | (v < 1), "LIFR").when((c < 1000) | (v < 3), "IFR")
            .when((c < 3000) | (v < 5), "MVFR").otherwise("VFR"))


def wx_flags(wxcodes) -> dict[str, Column]:
    """Phenomena flags from a METAR present-weather string (NULL -> false)."""
    w = F.coalesce(_c(wxcodes), F.lit(""))
    return {
        "has_thunderstorm": w.contains("TS"),
        "has_fog": w.contains("FG") | w.contains("BR"),
        "has_snow": w.contains("SN"),
        "has_freezing": w.contains("FZ"),
        "has_rain": w.contains("RA") | w.contains("DZ"),
    }


def parse_visibility(v) -> Column:
    """'10+' -> 10; unparsable or NULL -> 10."""
    return F.coalesce(F.regexp_replace(_c(v).cast("string"), r"\+", "").try_cast("double"), F.lit(10.0))


def icao_to_iata(icao) -> Column:
    return F.when(_c(icao).startswith("K"), F.substring(_c(icao), 2, 100)).otherwise(_c(icao))


def season_of(month, seasons: dict) -> Column:
    expr = None
    for label, months in seasons.items():
        cond = _c(month).isin(*months)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def severity_band(risk, critical: float = 80.0, high: float = 65.0) -> Column:
    return F.when(_c(risk) >= critical, "CRIT").when(_c(risk) >= high, "HIGH").otherwise("MOD")


def region_pattern(region_a, region_b) -> Column:
    ra = F.coalesce(_c(region_a), F.lit("Unknown"))
    rb = F.coalesce(_c(region_b), F.lit("Unknown"))
    return F.when(ra == rb, F.concat(F.lit("Same region ("), ra, F.lit(")"))).otherwise(
        F.concat(F.lit("Cross-region ("), ra, F.lit(" / "), rb, F.lit(")")))


def format_local_time(ts, micros: bool = True, sep: str = " ") -> Column:
    """Clock-time text of a TIMESTAMP_NTZ ('yyyy-MM-dd HH:mm:ss.SSSSSS', or 'yyyy-MM-ddTHH:mm'
    with micros=False, sep='T'), built from its fields: no session-time-zone conversion, so a
    clock time inside a daylight-saving gap keeps its value."""
    c = _c(ts)
    if not micros:
        return F.format_string(f"%04d-%02d-%02d{sep}%02d:%02d", F.year(c), F.month(c), F.dayofmonth(c),
                               F.hour(c), F.minute(c))
    sec = F.extract(F.lit("SECOND"), c)
    whole = F.floor(sec)
    frac = F.round((sec - whole) * 1000000).cast("int")
    return F.format_string(f"%04d-%02d-%02d{sep}%02d:%02d:%02d.%06d", F.year(c), F.month(c), F.dayofmonth(c),
                           F.hour(c), F.minute(c), whole.cast("int"), frac)
