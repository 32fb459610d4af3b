"""The scenario option language and year-dependent parameters (driver side)."""

from __future__ import annotations

import re
from bisect import bisect_right


def parse_options(text: str) -> dict:
    """Options such as ``Co2L0.5-3h-solar+c0.5-EQ0.7c-lv1.25-CF+a+b+v`` to settings.

    Unknown parts are kept under ``other`` in their order.
    """
    out: dict = {"adjust": [], "config": [], "other": []}
    for part in filter(None, text.split("-")):
        if m := re.fullmatch(r"(\d+)(h|seg|sn)", part, re.I):
            out["resolution"] = {"h": ("mean", int(m[1])), "seg": ("segments", int(m[1])), "sn": ("nth", int(m[1]))}[m[2].lower()]
        elif m := re.fullmatch(r"Co2L(\d*\.?\d*)", part):
            out["co2_limit"] = float(m[1]) if m[1] else True
        elif m := re.fullmatch(r"EQ(\d*\.?\d+)(c?)", part):
            out["self_sufficiency"] = (float(m[1]), "country" if m[2] else "node")
        elif m := re.fullmatch(r"l([vc])(\d*\.?\d+|opt)", part):
            out["line_limit"] = ({"v": "volume", "c": "cost"}[m[1]], m[2] if m[2] == "opt" else float(m[2]))
        elif m := re.fullmatch(r"cb(\d*\.?\d+)(ex|be)(\d*\.?\d*)", part):
            out["carbon_budget"] = (float(m[1]), {"ex": "exponential", "be": "beta"}[m[2]], float(m[3] or 0))
        elif part.startswith("CF+"):
            *path, value = part[3:].split("+")
            out["config"].append((path, _scalar(value)))
        elif m := re.fullmatch(r"([A-Za-z ]+)\+([cmpe])(\d*\.?\d+)", part):
            attr = {"c": "capital_cost", "m": "marginal_cost", "p": "p_nom_max", "e": "e_nom_max"}[m[2]]
            out["adjust"].append((m[1], attr, float(m[3])))
        else:
            out["other"].append(part)
    return out


def _scalar(x: str):
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    try:
        return float(x) if "." in x else int(x)
    except ValueError:
        return x


def at_year(item, year: int):
    """A constant, or the value of a year table: clamped outside, linear between."""
    if not isinstance(item, dict):
        return item
    years = sorted(map(int, item))
    values = {int(k): v for k, v in item.items()}
    i = bisect_right(years, year)
    if i == 0:
        return values[years[0]]
    if i == len(years) or years[i - 1] == year:
        return values[years[i - 1]]
    a, b = years[i - 1], years[i]
    return values[a] + (values[b] - values[a]) * (year - a) / (b - a)


def carbon_path(kind: str, budget: float, start: float, years: list[int], rate: float = 0.0) -> dict[int, float]:
    """Yearly emission limits that spend a budget: exponential decay from the start level
    with an initial relative change, or a beta-shaped (quadratic) fall."""
    first = years[0]
    if kind == "exponential":
        import math

        m = (1 + math.sqrt(1 + rate * budget / start)) * start / budget
        return {y: start * (1 + (m + rate) * (y - first)) * math.exp(-m * (y - first)) for y in years}
    last = first + 3 * budget / start  # a quadratic fall from the start level to zero spends a third of start * time
    return {y: max(0.0, start * (1 - (y - first) / (last - first)) ** 2) if y < last else 0.0 for y in years}
