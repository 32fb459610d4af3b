"""Scalar functions as Columns: geography, finance, physics, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def annuity(n: Column, r: Column) -> Column:
    """r / (1 - (1 + r)^-n), or 1 / n without interest."""
    return F.when(r == 0, F.try_divide(F.lit(1.0), n)).otherwise(r / (1 - 1 / F.pow(1 + r, n)))


def to_mw(value: Column, unit: Column) -> tuple[Column, Column]:
    """Values and units per kW or GW as per MW."""
    v = F.when(F.contains(unit, F.lit("/kW")), value * 1e3).when(F.contains(unit, F.lit("/GW")), value / 1e3).otherwise(value)
    return v, F.replace(F.replace(unit, F.lit("/kW"), F.lit("/MW")), F.lit("/GW"), F.lit("/MW"))


def degree_factor(temp: Column, low: float, high: float, down: float, up: float) -> Column:
    """Extra demand outside a deadband; a temperature equal to a bound keeps its raw value."""
    return F.when(temp < low, (low - temp) * down).when(temp > high, (temp - high) * up).when((temp > low) & (temp < high), F.lit(0.0)).otherwise(temp)


def availability(traffic: Column, top: float, mean: float, traffic_mean: Column, traffic_min: Column) -> Column:
    return top - (top - mean) * (traffic - traffic_min) / (traffic_mean - traffic_min)


def cop_quadratic(delta: Column, c0: float, c1: float, c2: float) -> Column:
    return c0 + c1 * delta + c2 * delta * delta


def log_mean(a: Column, b: Column) -> Column:
    """Logarithmic mean of two temperatures (K); the value itself where they are equal."""
    return F.when(a == b, a).otherwise((a - b) / F.log(a / b))


def cop_lorenz(sink_in: Column, sink_out: Column, source_in: Column, source_out: Column, efficiency: float = 0.5) -> Column:
    """Lorenz COP between logarithmic mean temperatures (K) times a constant efficiency."""
    hot, cold = log_mean(sink_out, sink_in), log_mean(source_in, source_out)
    return F.when(hot > cold, efficiency * hot / (hot - cold))


def forward_temperature(ambient: Column, top: float, low: float, cold: float = 0.0, warm: float = 10.0) -> Column:
    """Heating curve: ``top`` below the cold bound, ``low`` above the warm one, linear between."""
    return F.when(ambient <= cold, F.lit(top)).when(ambient >= warm, F.lit(low)).otherwise(top + (low - top) * (ambient - cold) / (warm - cold))


def sigmoid_temperature(air: Column, low: float, high: float, steep: float, middle: float) -> Column:
    """River water temperature from a smoothed air temperature."""
    return low + (high - low) / (1 + F.exp(steep * (middle - air)))


def resistance(r_ref: Column, temp: Column, ref: float = 20.0, alpha: float = 0.00403) -> Column:
    return r_ref * (1 + alpha * (temp - ref))


def pipe_capacity(diameter: Column) -> Column:
    """MW of a gas pipe from its diameter (mm), piecewise linear through fixed points."""
    pts = [(0.0, 0.0), (500.0, 1500.0), (600.0, 5000.0), (900.0, 11250.0), (1200.0, 21700.0)]  # fixed values
    out = F.when(diameter.isNull(), F.lit(None).cast("double"))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        if x1 < 1200.0:
            out = out.when(diameter < x1, y0 + (diameter - x0) * (y1 - y0) / (x1 - x0))
    (x0, y0), (x1, y1) = pts[-2:]
    return out.otherwise(y0 + (diameter - x0) * (y1 - y0) / (x1 - x0))


def rename_tech(name: Column, prefixes: list[str], contains: list[str], contains_to: dict[str, str], exact: dict[str, str]) -> Column:
    """Group names for display, rule after rule, each on what the one before left: prefixes
    dropped, a word contained becomes the name, a word contained becomes another name, exact names."""
    out = name
    for p in prefixes:
        out = F.when(F.startswith(out, F.lit(p)), F.substring(out, len(p) + 1, 10_000)).otherwise(out)
    for k, v in [*((x, x) for x in contains), *contains_to.items()]:
        out = F.when(F.contains(out, F.lit(k)), F.lit(v)).otherwise(out)
    for k, v in exact.items():
        out = F.when(out == k, F.lit(v)).otherwise(out)
    return out


#: Two-letter codes of countries by name.
COUNTRY_CODES = {
    "Albania": "AL", "Austria": "AT", "Belgium": "BE", "Bosnia and Herzegovina": "BA", "Bulgaria": "BG", "Croatia": "HR", "Cyprus": "CY", "Czechia": "CZ", "Denmark": "DK", "Estonia": "EE",
    "Finland": "FI", "France": "FR", "Germany": "DE", "Greece": "GR", "Hungary": "HU", "Ireland": "IE", "Italy": "IT", "Kosovo": "XK", "Latvia": "LV", "Lithuania": "LT", "Luxembourg": "LU",
    "Malta": "MT", "Moldova": "MD", "Montenegro": "ME", "Netherlands": "NL", "North Macedonia": "MK", "Norway": "NO", "Poland": "PL", "Portugal": "PT", "Romania": "RO", "Serbia": "RS",
    "Slovakia": "SK", "Slovenia": "SI", "Spain": "ES", "Sweden": "SE", "Switzerland": "CH", "Ukraine": "UA", "United Kingdom": "GB",
}
#: Other spellings and codes.
COUNTRY_ALIASES = {"EL": "GR", "UK": "GB", "KV": "XK", "KOSOVO*": "XK", "CZECH REPUBLIC": "CZ", "MACEDONIA": "MK", "REPUBLIC OF MOLDOVA": "MD", "BOSNIA & HERZEGOVINA": "BA", "GREAT BRITAIN": "GB"}


def country(name: Column) -> Column:
    """The two-letter code of a country's name or code; NULL if unknown."""
    table = {k.upper(): v for k, v in COUNTRY_CODES.items()} | {v: v for v in COUNTRY_CODES.values()} | COUNTRY_ALIASES
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(F.trim(name)))


def storage_levels(inflow: Column, first: Column, factor: float) -> Column:
    """Levels before each step of an array of net inflows, and after the last: the level keeps
    ``factor`` of itself over a step and gains the inflow."""
    start = F.array(first.cast("double"))
    return F.aggregate(inflow, start, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) * factor + x)))
