"""Column functions of the pixel, geodesy, drift and vessel algebra; all stay in Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model: band limits in dB, scalings, geodesy, weights.
DB_LOW, DB_HIGH, DB_SHIFT, DB_SPAN = -50.0, 5.0, 45.0, 45.0
DIFF_SHIFT, DIFF_SPAN, STD_SPAN = 10.0, 25.0, 0.15
EARTH_KM = 6371.0
LEEWAY, DEFLECTION = 0.032, -15.0
WEIGHTS, REACH_KM = (0.60, 0.25, 0.15), 25.0


def clip(x: Column, low: float, high: float) -> Column:
    """Limits x; null and NaN stay what they are."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip_db(x: Column) -> Column:
    return clip(x.cast("double"), DB_LOW, DB_HIGH)


def normalise(db: Column) -> Column:
    return clip((db + DB_SHIFT) / DB_SPAN, 0.0, 1.0)


def difference(vv: Column, vh: Column) -> Column:
    return clip((vv - vh + DIFF_SHIFT) / DIFF_SPAN, 0.0, 1.0)


def texture(std: Column) -> Column:
    return clip(std / STD_SPAN, 0.0, 1.0)


def pixel_to_geo(row: Column, col: Column, gt: str) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel by the struct column gt (ox, rx, kx, oy, ky, ry)."""
    g = lambda f: F.col(f"{gt}.{f}")
    return g("ox") + col * g("rx") + row * g("kx"), g("oy") + col * g("ky") + row * g("ry")


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(north, east), the fuller series, for areas."""
    p = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * p) + 1.17 * F.cos(4 * p), 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p)


def metres_per_degree_short(lat: Column) -> tuple[Column, Column]:
    """(north, east), the reduced series, for drift steps; not interchangeable with the fuller one."""
    p = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * p), 111412.84 * F.cos(p)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """A place as a point of the unit sphere; its chords order places as their distances do, without a sine each."""
    x, y = F.radians(lon), F.radians(lat)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def chord_km(squared: Column) -> Column:
    """Great-circle distance of two points of the unit sphere by their squared distance (null: null; rounding may put antipodes beyond 2)."""
    return EARTH_KM * 2 * F.nanvl(F.asin(F.sqrt(squared) / 2), F.lit(math.pi / 2))


def drift_velocity(current_u: float, current_v: float, wind_u: float, wind_v: float, leeway: float = LEEWAY, deflection: float = DEFLECTION) -> tuple[float, float]:
    """Net velocity: current plus leeway times the wind turned by the deflection (clockwise if negative)."""
    t = math.radians(deflection)
    return current_u + leeway * (wind_u * math.cos(t) - wind_v * math.sin(t)), current_v + leeway * (wind_u * math.sin(t) + wind_v * math.cos(t))


def type_score(kind: Column) -> Column:
    k = F.lower(kind)
    has = lambda *w: F.greatest(*(k.contains(x) for x in w)) if len(w) > 1 else k.contains(w[0])
    return F.when(has("tanker", "oil"), 1.0).when(has("cargo", "container"), 0.75).when(has("fishing"), 0.5).otherwise(0.3)


def speed_score(knots: Column) -> Column:
    return F.when(knots.between(5.0, 18.0), 1.0).otherwise(0.5)


def distance_score(km: Column, reach: float = REACH_KM) -> Column:
    return F.greatest(F.lit(0.0), 1 - km / reach)


def attribution_score(distance: Column, kind: Column, speed: Column) -> Column:
    return (distance * WEIGHTS[0] + kind * WEIGHTS[1] + speed * WEIGHTS[2]) * 100.0


def rounded(c: Column, places: int) -> Column:
    """A number that is not negative, rounded as SQL does: round() makes a decimal of each first."""
    return F.floor(c * float(10**places) + 0.5) / float(10**places)


def base_name(path: Column) -> Column:
    """The file name without folders and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


BAND_EXPRESSION = r"^[\sb12+\-*/().0-9]+$"


def band_math(expression: str = "b1 - b2") -> Column:
    """A user's arithmetic over b1 and b2; anything else is refused."""
    import re

    if not re.match(BAND_EXPRESSION, expression):
        raise ValueError(f"not arithmetic over b1 and b2: {expression}")
    return F.expr(expression).cast("double")
