"""Coefficient tables of network constraints: (constraint, row_key, var, coef, sense, rhs).

Solving is left to an external solver; an adapter reads these rows.  A variable is
``Component-attribute:name``, with ``@snapshot`` where it varies in time.  Every table has a
row for each variable of each constraint; a right-hand side is repeated on its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Carriers whose potential is shared with existing plants.
LAND_CARRIERS = ("solar", "solar rooftop", "solar-hsat", "onwind", "offwind-ac", "offwind-dc", "offwind-float")


def _rows(df: DataFrame, name: str | Column, key: Column, var: Column, coef: Column, sense: str | Column, rhs: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(name).alias("constraint"), key.cast("string").alias("row_key"), var.cast("string").alias("var"), coef.cast("double").alias("coef"), lit(sense).alias("sense"), rhs.cast("double").alias("rhs"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _var(kind: str, name: str = "name", time: str | None = None) -> Column:
    parts = [F.lit(f"{kind}:"), F.col(name)] + ([F.lit("@"), F.col(time).cast("string")] if time else [])
    return F.concat(*parts)


def country_carrier_limits(gens: DataFrame, limits: DataFrame) -> DataFrame:
    """min <= sum of p_nom by (country, carrier) <= max, less what exists already."""
    have = gens.where(~F.col("p_nom_extendable")).groupBy("country", "carrier").agg(F.sum("p_nom").alias("have"))
    g = gens.where("p_nom_extendable").join(limits, ["country", "carrier"]).join(have, ["country", "carrier"], "left")
    key, have_ = F.concat_ws(" ", "country", "carrier"), F.coalesce("have", F.lit(0.0))
    low = _rows(g.where("min IS NOT NULL"), "limit_min", key, F.col("name"), F.lit(1.0), ">=", F.greatest(F.col("min") - have_, F.lit(0.0)))
    return low.unionByName(_rows(g.where("max IS NOT NULL"), "limit_max", key, F.col("name"), F.lit(1.0), "<=", F.greatest(F.col("max") - have_, F.lit(0.0))))


def land_use(gens: DataFrame, horizon: str, carriers: tuple[str, ...] = LAND_CARRIERS) -> DataFrame:
    """``gens`` with p_nom_max less the existing plants of the same place and carrier: an existing
    plant's name up to the carrier names the place, and the new plant there is called
    "place carrier-horizon".  A p_nom_min above that raises it; 0 at least."""
    old = gens.where(~F.col("p_nom_extendable") & F.col("carrier").isin(*carriers))
    place = F.expr("regexp_replace(name, concat(' ', carrier, '.*$'), '')")
    used = old.groupBy(F.concat(place, F.lit(" "), F.col("carrier"), F.lit(f"-{horizon}")).alias("_to")).agg(F.sum("p_nom").alias("_used"))
    j = gens.join(used, gens["name"] == used["_to"], "left")
    left = F.col("p_nom_max") - F.coalesce("_used", F.lit(0.0))
    best = F.greatest(F.when(F.col("p_nom_min") > left, F.col("p_nom_min")).otherwise(left), F.lit(0.0))
    return j.select(*[best.alias(c) if c == "p_nom_max" else gens[c] for c in gens.columns])


def land_use_perfect(gens: DataFrame) -> DataFrame:
    """New capacity by carrier, bus and build year under the least p_nom_max of the group;
    groups without a finite one are left out."""
    g = gens.where("p_nom_extendable")
    top = g.groupBy("carrier", "bus", "build_year").agg(F.min("p_nom_max").alias("top")).where(F.col("top").isNotNull() & (F.col("top") < float("inf")))
    j = g.join(top, ["carrier", "bus", "build_year"])
    name = F.concat(F.lit("nom_max_"), "carrier", F.lit("_"), F.col("build_year").cast("string"))
    return _rows(j, name, F.col("bus"), _var("Generator-p_nom"), F.lit(1.0), "<=", F.col("top"))


def solar_potential(gens: DataFrame, factor: float) -> DataFrame:
    """Fixed and tracking solar share a bus's potential, a tracking MW using ``factor`` of it."""
    room = gens.where("carrier = 'solar' AND p_nom_extendable").groupBy("bus").agg(F.sum("p_nom_max").alias("room"))
    used = gens.where("carrier = 'solar-hsat'").groupBy("bus").agg((F.sum("p_nom") * factor).alias("used"))
    rhs = room.join(used, "bus").select("bus", F.greatest(F.col("room") - F.col("used"), F.lit(0.0)).alias("rhs"))
    g = gens.where("carrier IN ('solar', 'solar-hsat') AND p_nom_extendable").join(rhs, "bus")
    return _rows(g, "solar_potential", F.col("bus"), _var("Generator-p_nom"), F.when(F.col("carrier") == "solar-hsat", factor).otherwise(1.0), "<=", F.col("rhs"))


def sequestration_limit(snapshots: DataFrame, limits: dict[int, float]) -> DataFrame:
    """Stored CO2 of each period: limit (Mt a year, clamped and interpolated by year) times the
    period's years, as a global constraint with a negative constant."""
    from ..plans.options import at_year

    years = snapshots.groupBy("period").agg((F.sum("w_generators") / 8760).alias("nyears"))
    got = {int(r["period"]): float(at_year(limits, int(r["period"]))) for r in years.select("period").distinct().collect()}  # a row for each investment period
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in got.items() for x in kv]), F.col("period").cast("int")) if got else F.lit(None).cast("double")
    return _rows(years, "co2_sequestration_limit", F.col("period"), F.lit("co2 sequestered"), F.lit(1.0), ">=", -limit * F.col("nyears") * 1e6)


def _final_levels(stores: DataFrame, buses: DataFrame, carriers: list[str]) -> DataFrame:
    b = buses.where(F.col("carrier").isin(*carriers)).select(F.col("name").alias("bus"))
    return stores.where(~F.col("e_cyclic")).join(b, "bus", "left_semi")


def carbon_constraint(stores: DataFrame, buses: DataFrame, snapshots: DataFrame, limits: DataFrame, carriers: list[str]) -> DataFrame:
    """(name, period, constant): the level at a period's last snapshot less that at the end of
    the period before stays under the constant."""
    last = snapshots.groupBy("period").agg(F.max("snapshot").alias("last"))
    last = last.withColumn("before", F.lag("last").over(W.orderBy("period")))  # a row for each investment period
    s = _final_levels(stores, buses, carriers).select(F.col("name").alias("store"))
    j = limits.join(last, "period").crossJoin(s)  # few limits, all stores of the carriers
    end = _rows(j, F.col("name"), F.col("store"), _var("Store-e", "store", "last"), F.lit(1.0), "<=", F.col("constant"))
    return end.unionByName(_rows(j.where("before IS NOT NULL"), F.col("name"), F.col("store"), _var("Store-e", "store", "before"), F.lit(-1.0), "<=", F.col("constant")))


def carbon_budget(stores: DataFrame, buses: DataFrame, snapshots: DataFrame, periods: DataFrame, limits: DataFrame, carriers: list[str]) -> DataFrame:
    """The last level of a period times its years stays under the budget."""
    last = snapshots.groupBy("period").agg(F.max("snapshot").alias("last")).join(periods.select("period", "years"), "period")
    s = _final_levels(stores, buses, carriers).select(F.col("name").alias("store"))
    j = limits.join(last, "period").crossJoin(s)
    return _rows(j, F.col("name"), F.col("store"), _var("Store-e", "store", "last"), F.col("years"), "<=", F.col("constant"))


def co2_atmosphere(stores: DataFrame, buses: DataFrame, snapshots: DataFrame, limits: DataFrame, carriers: list[str]) -> DataFrame:
    """The level at the last snapshot stays under the constant."""
    last = snapshots.agg(F.max("snapshot").alias("last"))
    s = _final_levels(stores, buses, carriers).select(F.col("name").alias("store"))
    j = limits.crossJoin(F.broadcast(last)).crossJoin(s)  # one row; few limits
    return _rows(j, F.col("name"), F.col("store"), _var("Store-e", "store", "last"), F.lit(1.0), "<=", F.col("constant"))


def max_growth(carriers: DataFrame, periods: DataFrame, factor: float) -> DataFrame:
    """(carrier, growth in GW a year, relative) -> the limits of a period, in MW."""
    years = periods.agg(F.max("years").alias("_y"))
    return carriers.crossJoin(F.broadcast(years)).select("carrier", (F.col("growth") * F.col("_y") * factor * 1e3).alias("max_growth"), F.col("relative").alias("max_relative_growth"))


def boiler_retrofit(links: DataFrame, heat: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Existing gas boilers and the H2 boilers that replace them follow the heat profile of
    their bus: p(gas) + p(H2) = p_nom * load / the period's greatest load.  The two are one place's:
    names agree but for the carrier."""
    place = F.expr("replace(name, carrier, '')")
    gas = links.where(F.contains("carrier", F.lit("gas boiler")) & ~F.col("p_nom_extendable")).select("name", place.alias("place"), "bus1", "p_nom")
    h2 = links.where(F.contains("carrier", F.lit("retrofitted H2 boiler"))).select(F.col("name").alias("h2"), place.alias("place"))
    h = heat.join(snapshots.select("snapshot", "period"), "snapshot")
    shape = h.withColumn("profile", F.coalesce(F.try_divide("p", F.max("p").over(W.partitionBy("bus", "period"))), F.lit(0.0))).select(F.col("bus").alias("bus1"), "snapshot", "profile")
    j = gas.join(h2, "place").crossJoin(snapshots.select("snapshot")).join(shape, ["bus1", "snapshot"], "left")
    rhs, key = F.col("p_nom") * F.coalesce("profile", F.lit(0.0)), F.concat("name", F.lit("@"), F.col("snapshot").cast("string"))
    return _rows(j, "gas_retrofit", key, _var("Link-p", "name", "snapshot"), F.lit(1.0), "=", rhs).unionByName(_rows(j, "gas_retrofit", key, _var("Link-p", "h2", "snapshot"), F.lit(1.0), "=", rhs))


def emissions(gens: DataFrame, carriers: DataFrame, weights: DataFrame, cap: float) -> DataFrame:
    """Weighted emissions of all dispatch under a cap: a coefficient per generator and snapshot."""
    g = gens.join(carriers.where("co2_emissions <> 0").select("carrier", "co2_emissions"), "carrier").crossJoin(weights)  # every emitter has every snapshot
    return _rows(g, "co2", F.lit("co2"), F.concat_ws("@", "name", F.col("snapshot").cast("string")), F.col("co2_emissions") / F.col("efficiency") * F.col("w_generators"), "<=", F.lit(cap))


def _ratio(links: DataFrame, name: str, one: str, other: str, what: str, sign: float = -1.0, rhs: float = 0.0) -> DataFrame:
    """x(one) - efficiency(other) * x(other) = 0 for extendable links whose names differ in that word only."""
    l = links.where("p_nom_extendable")
    a = l.where(F.contains("name", F.lit(one)) & F.col("name").rlike(what)).select(F.col("name").alias("a"), F.expr(f"replace(name, '{one}', '')").alias("place"))
    b = l.where(F.contains("name", F.lit(other)) & F.col("name").rlike(what)).select(F.col("name").alias("b"), F.expr(f"replace(name, '{other}', '')").alias("place"), "efficiency")
    j = a.join(b, "place", "full_outer")
    alone = F.concat(F.lit(f"{name}: no partner for "), F.coalesce("a", "b"))
    j = j.withColumns({"a": F.coalesce("a", F.raise_error(alone).cast("string")), "b": F.coalesce("b", F.raise_error(alone).cast("string"))})
    return _rows(j, name, F.col("place"), _var("Link-p_nom", "a"), F.lit(1.0), "=", F.lit(rhs)).unionByName(_rows(j, name, F.col("place"), _var("Link-p_nom", "b"), sign * F.col("efficiency"), "=", F.lit(rhs)))


def battery_balance(links: DataFrame) -> DataFrame:
    """Charger capacity = discharger capacity * its efficiency; an error where one has no partner."""
    return _ratio(links, "Link-charger_ratio", " charger", " discharger", "battery")


def tes_charger_ratio(links: DataFrame) -> DataFrame:
    """The same for heat storage in tanks, pits and aquifers."""
    return _ratio(links, "TES_charger_ratio", " charger", " discharger", "water tanks|water pits|aquifer thermal energy storage")


def tes_energy_to_power(links: DataFrame, stores: DataFrame) -> DataFrame:
    """e_nom of a heat store = ratio * p_nom of its charger; an error where names do not match."""
    c = links.where(F.col("p_nom_extendable") & F.col("name").rlike("water tanks charger|water pits charger")).select(F.col("name").alias("charger"), F.expr("replace(name, ' charger', '')").alias("name"), "energy_to_power")
    s = stores.where(F.col("e_nom_extendable") & F.col("name").rlike("water tanks|water pits")).select("name", F.col("name").alias("store"))
    j = c.join(s, "name", "left").withColumn("store", F.coalesce("store", F.raise_error(F.concat(F.lit("no heat store for "), "charger")).cast("string")))
    return _rows(j, "TES_energy_to_power_ratio", F.col("name"), _var("Store-e_nom", "store"), F.lit(1.0), "=", F.lit(0.0)).unionByName(_rows(j, "TES_energy_to_power_ratio", F.col("name"), _var("Link-p_nom", "charger"), -F.col("energy_to_power"), "=", F.lit(0.0)))


def bidirectional_sync(links: DataFrame) -> DataFrame:
    """The reversed part of a lossy link has the capacity of the forward one."""
    back = links.where("reversed AND p_nom_extendable").select(F.col("name").alias("back"), F.expr("replace(name, '-reversed', '')").alias("name"))
    j = back.join(links.select("name"), "name", "left_semi")
    return _rows(j, "Link-bidirectional_sync", F.col("name"), _var("Link-p_nom", "back"), F.lit(1.0), "=", F.lit(0.0)).unionByName(_rows(j, "Link-bidirectional_sync", F.col("name"), _var("Link-p_nom"), F.lit(-1.0), "=", F.lit(0.0)))


def chp(links: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Feasible region of combined heat and power, electric and heat links of one name: fixed
    capacity ratio, the fuel line of extendable and of fixed plants, and back-pressure (with
    a right-hand side of 0)."""
    named = F.contains("name", F.lit("urban central")) & F.contains("name", F.lit("CHP"))
    e = links.where(named & F.contains("name", F.lit("electric"))).select(F.col("name").alias("e"), F.expr("replace(name, 'electric', '')").alias("place"), F.col("p_nom_extendable").alias("ext"), F.col("p_nom").alias("cap"), F.col("efficiency").alias("ee"), "p_nom_ratio", "c_b")
    h = links.where(named & F.contains("name", F.lit("heat"))).select(F.col("name").alias("h"), F.expr("replace(name, 'heat', '')").alias("place"), F.col("efficiency").alias("eh"))
    j = e.join(h, "place")
    t = j.crossJoin(snapshots.select("snapshot"))
    key, at = F.col("e"), F.concat("e", F.lit("@"), F.col("snapshot").cast("string"))
    zero, one = F.lit(0.0), F.lit(1.0)
    pe, ph = _var("Link-p", "e", "snapshot"), _var("Link-p", "h", "snapshot")
    ratio, ext, fix, back = "chplink-fix_p_nom_ratio", "chplink-top_iso_fuel_line_ext", "chplink-top_iso_fuel_line_fix", "chplink-backpressure"
    te, tf = t.where("ext"), t.where("NOT ext")
    return _union(
        _rows(j.where("ext"), ratio, key, _var("Link-p_nom", "e"), F.col("p_nom_ratio") * F.col("ee"), "=", zero), _rows(j.where("ext"), ratio, key, _var("Link-p_nom", "h"), -F.col("eh"), "=", zero),
        _rows(te, ext, at, pe, one, "<=", zero), _rows(te, ext, at, ph, one, "<=", zero), _rows(te, ext, at, _var("Link-p_nom", "e"), F.lit(-1.0), "<=", zero),
        _rows(tf, fix, at, pe, one, "<=", F.col("cap")), _rows(tf, fix, at, ph, one, "<=", F.col("cap")),
        _rows(t, back, at, ph, F.col("eh") * F.col("c_b"), "<=", zero), _rows(t, back, at, pe, -F.col("ee"), "<=", zero),
    )


def pipe_retrofit(links: DataFrame, h2_per_ch4: float) -> DataFrame:
    """Gas capacity kept plus that turned over to hydrogen equals today's, by corridor (the name
    without its carrier)."""
    l = links.where("p_nom_extendable AND NOT reversed").withColumn("corridor", F.expr("trim(replace(name, carrier, ''))"))
    gas = l.where("carrier = 'gas pipeline'").select("corridor", F.col("name").alias("gas"), "p_nom")
    j = gas.join(l.where("carrier = 'H2 pipeline retrofitted'").select("corridor", F.col("name").alias("h2")), "corridor")
    return _rows(j, "Link-pipe_retrofit", F.col("corridor"), _var("Link-p_nom", "gas"), F.lit(1.0), "=", F.col("p_nom")).unionByName(_rows(j, "Link-pipe_retrofit", F.col("corridor"), _var("Link-p_nom", "h2"), F.lit(1.0 / h2_per_ch4), "=", F.col("p_nom")))


def geothermal_charging(links: DataFrame, units: DataFrame) -> DataFrame:
    """A geothermal reservoir's capacity is under that of the well at its bus."""
    well = links.where("carrier = 'geothermal heat'").select(F.col("name").alias("well"), F.col("bus1").alias("bus"))
    j = units.where("carrier = 'geothermal heat'").select("name", "bus").join(well, "bus")
    name = "upper_bound_charging_capacity_of_geothermal_reservoir"
    return _rows(j, name, F.col("bus"), _var("StorageUnit-p_nom"), F.lit(1.0), "<=", F.lit(0.0)).unionByName(_rows(j, name, F.col("bus"), _var("Link-p_nom", "well"), F.lit(-1.0), "<=", F.lit(0.0)))


def self_sufficiency(gens: DataFrame, loads: DataFrame, units: DataFrame, snapshots: DataFrame, by: str, level: float, scaling: float = 0.1) -> DataFrame:
    """Local generation less spilled inflow covers a share of the load less the inflow, by
    country or node (column ``by``): gens (name), loads (snapshot, p), units (name, snapshot, inflow)."""
    w = snapshots.select("snapshot", "w_generators", "w_stores")
    need = loads.join(w, "snapshot").groupBy(by).agg(F.sum(F.col("p") * F.col("w_generators")).alias("load"))
    flow = units.join(w, "snapshot").groupBy(by).agg(F.sum(F.col("inflow") * F.col("w_stores")).alias("inflow"))
    rhs = need.join(flow, by, "left").select(by, (scaling * (level * F.col("load") - F.coalesce("inflow", F.lit(0.0)))).alias("rhs"))
    g = gens.select("name", by).join(rhs, by).crossJoin(w)
    u = units.select("name", by, "snapshot").join(rhs, by).join(w, "snapshot")
    return _rows(g, "equity_min", F.col(by), _var("Generator-p", "name", "snapshot"), F.col("w_generators") * scaling, ">=", F.col("rhs")).unionByName(_rows(u, "equity_min", F.col(by), _var("StorageUnit-spill", "name", "snapshot"), -F.col("w_stores") * scaling, ">=", F.col("rhs")))


def minimum_capacity(gens: DataFrame, least: dict[str, float]) -> DataFrame:
    """New capacity of a carrier is at least its business-as-usual minimum."""
    m = gens.sparkSession.createDataFrame([(k, float(v)) for k, v in least.items()], "carrier string, least double")
    return _rows(gens.where("p_nom_extendable").join(m, "carrier"), "bau_mincaps", F.col("carrier"), _var("Generator-p_nom"), F.lit(1.0), ">=", F.col("least"))


def reserve_margin(gens: DataFrame, loads: DataFrame, margin: float, conventional: list[str]) -> DataFrame:
    """Conventional capacity covers the peak of the summed load and a margin."""
    peak = loads.groupBy("snapshot").agg(F.sum("p").alias("p")).agg(F.max("p").alias("peak"))
    g = gens.where(F.col("carrier").isin(*conventional) & F.col("p_nom_extendable"))
    have = gens.where(F.col("carrier").isin(*conventional) & ~F.col("p_nom_extendable")).agg(F.coalesce(F.sum("p_nom"), F.lit(0.0)).alias("have"))
    j = g.crossJoin(F.broadcast(have)).crossJoin(F.broadcast(peak))  # single rows
    return _rows(j, "safe_mintotalcap", F.lit("peak"), _var("Generator-p_nom"), F.lit(1.0), ">=", (1 + margin) * F.col("peak") - F.col("have"))


def operational_reserve(gens: DataFrame, available: DataFrame, loads: DataFrame, eps_load: float, eps_vres: float, contingency: float) -> DataFrame:
    """Reserves of a snapshot cover a share of the load, a share of the variable renewables'
    potential and a contingency; dispatch and reserve stay under the available capacity."""
    demand = loads.groupBy("snapshot").agg(F.sum("p").alias("demand"))
    a = available.select("name", "snapshot", "p_max_pu").join(gens.select("name", "p_nom_extendable", "p_nom"), "name")
    fixed = a.where(~F.col("p_nom_extendable")).groupBy("snapshot").agg(F.sum(F.col("p_max_pu") * F.col("p_nom")).alias("potential"))
    rhs = demand.join(fixed, "snapshot", "left").select("snapshot", (eps_load * F.col("demand") + eps_vres * F.coalesce("potential", F.lit(0.0)) + contingency).alias("rhs"))
    every = gens.select("name", "p_nom_extendable", "p_nom").crossJoin(rhs)
    ext = a.where("p_nom_extendable").join(rhs, "snapshot")
    dense = every.join(available.select("name", "snapshot", "p_max_pu"), ["name", "snapshot"], "left").withColumn("pu", F.coalesce("p_max_pu", F.lit(1.0)))
    top = F.when(F.col("p_nom_extendable"), F.lit(0.0)).otherwise(F.col("pu") * F.col("p_nom"))
    at, key, up = F.col("snapshot"), F.concat("name", F.lit("@"), F.col("snapshot").cast("string")), "Generator-p-reserve-upper"
    return _union(
        _rows(every, "reserve_margin", at, _var("Generator-r", "name", "snapshot"), F.lit(1.0), ">=", F.col("rhs")),
        _rows(ext, "reserve_margin", at, _var("Generator-p_nom"), -eps_vres * F.col("p_max_pu"), ">=", F.col("rhs")),
        _rows(dense, up, key, _var("Generator-p", "name", "snapshot"), F.lit(1.0), "<=", top), _rows(dense, up, key, _var("Generator-r", "name", "snapshot"), F.lit(1.0), "<=", top),
        _rows(dense.where("p_nom_extendable"), up, key, _var("Generator-p_nom"), -F.col("pu"), "<=", top),
    )


def import_limit(gens: DataFrame, links: DataFrame, snapshots: DataFrame, limit: float, sense: str = "<=") -> DataFrame:
    """Weighted imports (TWh a year) by generators and, in fuel, by links; carriers that hold "import"."""
    nyears = snapshots.agg((F.sum("w_generators") / 8760).alias("nyears"))
    w = snapshots.select("snapshot", "w_generators").crossJoin(F.broadcast(nyears))  # a single row
    g = gens.where(F.contains("carrier", F.lit("import"))).select("name").crossJoin(w)
    l = links.where(F.contains("carrier", F.lit("import"))).select("name", "efficiency").crossJoin(w)
    rhs = F.col("nyears") * limit * 1e6
    return _rows(g, "import_limit", F.lit("import"), _var("Generator-p", "name", "snapshot"), F.col("w_generators"), sense, rhs).unionByName(_rows(l, "import_limit", F.lit("import"), _var("Link-p", "name", "snapshot"), F.col("efficiency") * F.col("w_generators"), sense, rhs))


def clip_small(series: DataFrame, value: str, threshold: float) -> DataFrame:
    """Entries up to the threshold become 0 before a solve."""
    return series.withColumn(value, F.when(F.abs(value) <= threshold, F.lit(0.0)).otherwise(F.col(value)))
