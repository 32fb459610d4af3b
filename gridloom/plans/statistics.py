"""Statistics of a solved network, from two long tables.

``assets``: component, name, carrier, location, capacity, installed, capital_cost,
marginal_cost, build_year, lifetime.  ``flows``: component, name, carrier, port, bus,
bus_carrier, location, country, snapshot, period, w, p; p is what a component gives to the
bus of its port, so loads and charging count negative, and the ports of a branch that have
no bus have no row.  w weighs a snapshot as its component is weighed: generators by
w_generators, storage by w_stores, all else by w_objective.  Pivots come last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.frames import exact_sum

BRANCHES = ("Line", "Link")
STORAGE = ("Store", "StorageUnit")


def flows(static: dict[str, DataFrame], series: dict[str, DataFrame], buses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row for a component, used port and snapshot.  ``static``: tables with name, carrier and
    bus, or bus0, bus1, ...; ``series``: name, snapshot and p, or p0, p1, ...  A line has p0 alone
    (p1 = -p0); a load's p is taken."""
    parts = []
    for comp, s in static.items():
        t = series[comp]
        if comp in BRANCHES:
            n = sum(c.startswith("bus") for c in s.columns)
            flow = {i: -F.col(f"p{i}") if f"p{i}" in t.columns else F.col("p0") for i in range(n)}
            ports = F.array(*[F.struct(F.lit(i).alias("port"), F.col(f"bus{i}").alias("bus"), flow[i].alias("p")) for i in range(n)])
            d = t.join(s.select("name", "carrier", *[f"bus{i}" for i in range(n)]), "name").select("name", "carrier", "snapshot", F.explode(ports).alias("x"))
            d = d.where("x.bus <> ''").select("name", "carrier", "snapshot", "x.port", "x.bus", "x.p")
        else:
            sign = F.lit(-1.0) if comp == "Load" else F.lit(1.0)
            d = t.join(s.select("name", "carrier", "bus"), "name").select("name", "carrier", "snapshot", F.lit(0).alias("port"), "bus", (sign * F.col("p")).alias("p"))
        weight = "w_generators" if comp == "Generator" else "w_stores" if comp in STORAGE else "w_objective"
        w = snapshots.select("snapshot", "period", F.col(weight).alias("w"))
        parts.append(d.join(w, "snapshot").select(F.lit(comp).alias("component"), "name", "carrier", "port", "bus", "snapshot", "period", "w", F.col("p").cast("double").alias("p")))
    b = buses.select(F.col("name").alias("bus"), F.col("carrier").alias("bus_carrier"), "location", "country")
    return reduce(DataFrame.unionByName, parts).join(b, "bus")


def assets(static: dict[str, DataFrame], buses: DataFrame) -> DataFrame:
    """One row for a component; a branch is where its first bus is that is not the common "EU"."""
    parts = []
    at = buses.select(F.col("name").alias("_b"), F.col("location").alias("_l"))
    for comp, s in static.items():
        if comp == "Load":
            continue
        cap = {"Store": "e_nom_opt", "Line": "s_nom_opt"}.get(comp, "p_nom_opt")
        ends = sorted(c for c in s.columns if c.startswith("bus"))
        d = s
        for e in ends:
            d = d.join(at, d[e] == at["_b"], "left").withColumnRenamed("_l", f"_{e}").drop("_b")
        place = F.coalesce(*[F.when(F.col(f"_{e}") != "EU", F.col(f"_{e}")) for e in ends], F.lit("EU"))
        installed = F.col("p_nom") if "p_nom" in s.columns else F.col(cap)
        marginal = F.col("marginal_cost") if "marginal_cost" in s.columns else F.lit(0.0)
        parts.append(d.select(F.lit(comp).alias("component"), "name", "carrier", place.alias("location"), F.col(cap).alias("capacity"), installed.alias("installed"), "capital_cost", marginal.alias("marginal_cost"), "build_year", "lifetime"))
    return reduce(DataFrame.unionByName, parts)


def energy_balance(f: DataFrame, by: list[str]) -> DataFrame:
    """Supply (positive) and consumption (negative) over all ports."""
    return f.groupBy("component", *by).agg(F.sum(F.col("p") * F.col("w")).alias("energy"))


def supply(f: DataFrame, by: list[str]) -> DataFrame:
    return f.groupBy("component", *by).agg(F.sum(F.greatest("p", F.lit(0.0)) * F.col("w")).alias("supply"))


def withdrawal(f: DataFrame, by: list[str]) -> DataFrame:
    return f.groupBy("component", *by).agg(F.sum(-F.least("p", F.lit(0.0)) * F.col("w")).alias("withdrawal"))


def _dispatch(f: DataFrame) -> DataFrame:
    """What costs are paid for: generation, store output, discharge, a link's input."""
    use = F.when(F.col("component") == "Link", -F.col("p")).when(F.col("component") == "StorageUnit", F.greatest("p", F.lit(0.0))).otherwise(F.col("p"))
    return f.where("port = 0 AND component NOT IN ('Load', 'Line')").withColumn("use", use)


def capex(a: DataFrame, by: list[str]) -> DataFrame:
    return a.groupBy("component", *by).agg(F.sum(F.col("capacity") * F.col("capital_cost")).alias("capex"))


def opex(a: DataFrame, f: DataFrame, by: list[str]) -> DataFrame:
    d = _dispatch(f).groupBy("component", "name").agg(F.sum(F.col("use") * F.col("w")).alias("use"))
    j = d.join(a, ["component", "name"])
    return j.groupBy("component", *by).agg(F.sum(F.col("use") * F.col("marginal_cost")).alias("opex"))


def costs(a: DataFrame, f: DataFrame, by: list[str]) -> DataFrame:
    """Capital and marginal costs with a ``cost`` level."""
    x = capex(a, by).select(F.lit("capital").alias("cost"), "component", *by, F.col("capex").alias("value"))
    return x.unionByName(opex(a, f, by).select(F.lit("marginal").alias("cost"), "component", *by, F.col("opex").alias("value")))


def capacities(a: DataFrame, by: list[str], value: str = "capacity") -> DataFrame:
    return a.groupBy("component", *by).agg(F.sum(value).alias(value))


def capacity_factors(a: DataFrame, f: DataFrame, by: list[str]) -> DataFrame:
    """Time-averaged operation over capacity, of one-port components but stores and of lines (by
    their absolute flow); NULL without capacity."""
    kinds = F.col("component").isin("Generator", "StorageUnit", "Line")
    p = F.when(F.col("component") == "Line", F.abs("p")).otherwise(F.col("p"))
    mean = f.where(kinds & (F.col("port") == 0)).groupBy("component", "name").agg((F.sum(p * F.col("w")) / F.sum("w")).alias("mean"))
    j = a.where(kinds).join(mean, ["component", "name"], "left")
    return j.groupBy("component", *by).agg(F.try_divide(F.sum("mean"), F.sum("capacity")).alias("capacity_factor"))


def curtailment(f: DataFrame, a: DataFrame, available: DataFrame, snapshots: DataFrame, bus_carriers: list[str]) -> DataFrame:
    """Percent by carrier: (available - dispatched) over capacity times the duration."""
    g = f.where((F.col("component") == "Generator") & F.col("bus_carrier").isin(*bus_carriers)).join(available, ["name", "snapshot"])
    own = a.where("component = 'Generator'").select("name", "capacity")
    lost = g.join(own, "name").groupBy("carrier").agg(F.sum((F.col("p_max_pu") * F.col("capacity") - F.col("p")) * F.col("w")).alias("lost"))
    at = g.select("name").distinct()
    cap = a.where("component = 'Generator'").join(at, "name", "left_semi").groupBy("carrier").agg(F.sum("capacity").alias("cap"))
    hours = snapshots.agg(F.sum("w_generators").alias("hours"))
    j = lost.join(cap, "carrier").crossJoin(F.broadcast(hours))  # a single row
    return j.select("carrier", (F.try_divide("lost", F.col("cap") * F.col("hours")) * 100).alias("curtailment"))


def prices(series: DataFrame, buses: DataFrame) -> DataFrame:
    """Mean over snapshots for each bus, then over the buses of a carrier."""
    j = series.join(buses.select(F.col("name").alias("bus"), "carrier"), "bus")
    return j.groupBy("carrier", "bus").agg(F.avg("price").alias("price")).groupBy("carrier").agg(F.avg("price").alias("price"))


def weighted_prices(f: DataFrame, series: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Load-weighted price by bus carrier; a bus without a price counts with 1, a carrier without
    load has no row."""
    load = f.groupBy("bus_carrier", "bus", "snapshot").agg(F.sum(-F.least("p", F.lit(0.0))).alias("load"))
    j = load.join(series.select("bus", "snapshot", "price"), ["bus", "snapshot"], "left").join(snapshots.select("snapshot", F.col("w_generators").alias("wg")), "snapshot")
    g = j.groupBy(F.col("bus_carrier").alias("carrier")).agg(F.sum("load").alias("all"), F.sum(F.col("load") * F.coalesce("price", F.lit(1.0)) * F.col("wg")).alias("a"), F.sum(F.col("load") * F.col("wg")).alias("b"))
    return g.where(F.col("all") > 0).select("carrier", (F.col("a") / F.col("b")).alias("price"))


def market_values(f: DataFrame, series: DataFrame, bus_carrier: str = "AC") -> DataFrame:
    """Revenue over supply by carrier at buses of a carrier, sorted; carriers without supply have no row."""
    j = f.where(F.col("bus_carrier") == bus_carrier).join(series.select("bus", "snapshot", "price"), ["bus", "snapshot"])
    s = F.greatest("p", F.lit(0.0)) * F.col("w")
    g = j.groupBy("carrier").agg(F.try_divide(F.sum(s * F.col("price")), F.sum(s)).alias("market_value"))
    return g.where("market_value IS NOT NULL").orderBy("market_value")


def price_metrics(series: DataFrame, buses: DataFrame, carrier: str = "AC", zero: float = 0.1) -> DataFrame:
    """metric, value: the share of hours at prices under ``zero`` (above renewables' marginal cost),
    mean and sample deviation over buses and snapshots of a carrier."""
    at = buses.where(F.col("carrier") == carrier).select(F.col("name").alias("bus"))
    p = F.col("price")
    row = series.join(at, "bus", "left_semi").agg(F.avg((p < zero).cast("double")).alias("electricity_price_zero_hours"), F.avg(p).alias("electricity_price_mean"), F.stddev_samp(p).alias("electricity_price_std"))
    return row.unpivot([], list(row.columns), "metric", "value")


def metrics(a: DataFrame, f: DataFrame, lengths: DataFrame, series: DataFrame, buses: DataFrame, constraints: DataFrame) -> DataFrame:
    """metric, value: line volumes, total costs, price statistics, duals of named global constraints."""
    cap = a.join(lengths, ["component", "name"])
    vol = F.col("capacity") * F.col("length")
    dc, ac = F.coalesce(F.sum(F.when((F.col("component") == "Link") & (F.col("carrier") == "DC"), vol)), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("component") == "Line", vol)), F.lit(0.0))
    v = cap.agg(dc.alias("line_volume_DC"), ac.alias("line_volume_AC")).withColumn("line_volume", F.col("line_volume_DC") + F.col("line_volume_AC"))
    total = costs(a, f, []).agg(F.sum("value").alias("value")).select(F.lit("total costs").alias("metric"), "value")
    named = {("lv_limit", "constant"): "line_volume_limit", ("lv_limit", "mu"): "line_volume_shadow", ("CO2Limit", "mu"): "co2_shadow", ("co2_sequestration_limit", "mu"): "co2_storage_shadow"}
    parts = [v.unpivot([], v.columns, "metric", "value"), total, price_metrics(series, buses)]
    parts += [constraints.where(F.col("name") == n).select(F.lit(label).alias("metric"), F.col(c).alias("value")) for (n, c), label in named.items()]
    return reduce(DataFrame.unionByName, parts)


def bars(a: DataFrame, f: DataFrame, available: DataFrame, series: DataFrame) -> DataFrame:
    """The nine bar statistics: statistic, component, carrier, value; capacities in GW, energies in
    TWh (withdrawal negative), both without lines and load shedding."""
    key = ["carrier"]
    shed = ~((F.col("component") == "Generator") & (F.col("carrier") == "Load")) & (F.col("component") != "Line")
    own = a.where("component = 'Generator'").select("name", "capacity")
    lost = f.where("component = 'Generator'").join(available, ["name", "snapshot"]).join(own, "name").groupBy("component", "carrier").agg(F.sum((F.col("p_max_pu") * F.col("capacity") - F.col("p")) * F.col("w")).alias("value"))
    s = F.greatest("p", F.lit(0.0)) * F.col("w")
    value = f.join(series.select("bus", "snapshot", "price"), ["bus", "snapshot"]).groupBy("component", "carrier").agg(F.try_divide(F.sum(s * F.col("price")), F.sum(s)).alias("value"))
    tables = {
        "capacity_factor": capacity_factors(a, f, key).where("capacity_factor IS NOT NULL").withColumnRenamed("capacity_factor", "value"),
        "installed_capacity": capacities(a.where(shed), key, "installed").withColumn("value", F.col("installed") / 1e3), "optimal_capacity": capacities(a.where(shed), key).withColumn("value", F.col("capacity") / 1e3),
        "capital_expenditure": capex(a, key).withColumnRenamed("capex", "value"), "operational_expenditure": opex(a, f, key).withColumnRenamed("opex", "value"), "curtailment": lost,
        "supply": supply(f.where("component <> 'Line'"), key).withColumn("value", F.col("supply") / 1e6), "withdrawal": withdrawal(f.where("component <> 'Line'"), key).withColumn("value", F.col("withdrawal") / -1e6),
        "market_value": value,
    }
    return reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("statistic"), "component", "carrier", F.col("value").cast("double").alias("value")) for k, t in tables.items()])


def bus_balance(f: DataFrame, bus: str, least: float = 1e-2) -> DataFrame:
    """snapshot, carrier, p at one bus; carriers whose absolute sum is not over ``least`` are left out."""
    d = f.where(F.col("bus") == bus).groupBy("snapshot", "carrier").agg(F.sum("p").alias("p"))
    big = d.groupBy("carrier").agg(F.sum(F.abs("p")).alias("s")).where(F.col("s") > least).select("carrier")
    return d.join(big, "carrier", "left_semi")


def _ordered_variance(x: str, by: str) -> Column:
    """The sample variance of a group of few rows, by Welford's steps in the order of ``by``."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a: Column, r: Column) -> Column:
        m = a["m"] + (r[x] - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), m.alias("m"), (a["s"] + (r[x] - a["m"]) * (r[x] - m)).alias("s"))

    rows = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(by, x))))
    return F.aggregate(rows, start, step, lambda a: F.when(a["n"] > 1, a["s"] / (a["n"] - 1)))


def balance_series(f: DataFrame, bus_carriers: list[str], max_threshold: float, mean_threshold: float) -> DataFrame:
    """snapshot, carrier, rank, positive, negative (GW) of a group of bus carriers: carriers small in
    both greatest and mean absolute value become "other"; ranks rise with the variance of the
    carrier over its greatest value.  Carriers of one shape differ there by rounding alone, so sums run in
    the order of ports and names (without names they are exact) and variances in that of snapshots: a
    rerun ranks alike, and as SQL that reads row by row."""
    at = f.where(F.col("bus_carrier").isin(*bus_carriers))
    if "name" in f.columns:
        own = W.partitionBy("snapshot", "carrier").orderBy("component", "port", F.length("name"), "name")
        # Running sums: one addition after the other, however long a group.
        at = at.select("snapshot", "carrier", F.sum("p").over(own.rowsBetween(W.unboundedPreceding, 0)).alias("p"), F.row_number().over(own).alias("i"))
        d = at.groupBy("snapshot", "carrier").agg((F.max_by("p", "i") / 1e3).alias("p"))
    else:
        d = at.groupBy("snapshot", "carrier").agg((exact_sum(F.col("p")).cast("double") / 1e3).alias("p"))
    n = d.select("snapshot").distinct().agg(F.count("*").alias("n"))
    size = d.groupBy("carrier").agg(F.max(F.abs("p")).alias("top"), F.sum(F.abs("p")).alias("s")).crossJoin(F.broadcast(n))  # a single row
    small = size.where((F.col("top") < max_threshold) & (F.col("s") / F.col("n") < mean_threshold)).select("carrier", F.lit("other").alias("to"))
    d = d.join(small, "carrier", "left").groupBy("snapshot", F.coalesce("to", "carrier").alias("carrier")).agg(exact_sum(F.col("p")).cast("double").alias("p"))
    var = d.groupBy("carrier").agg(F.max("p").alias("top"), _ordered_variance("p", "snapshot").alias("v")).select("carrier", F.try_divide("v", F.col("top") * F.col("top")).alias("v"))
    rank = var.withColumn("rank", F.row_number().over(W.orderBy(F.col("v").asc_nulls_last(), "carrier")))  # a row for each carrier
    j = d.join(rank.select("carrier", "rank"), "carrier")
    return j.select("snapshot", "carrier", "rank", F.greatest("p", F.lit(0.0)).alias("positive"), F.least("p", F.lit(0.0)).alias("negative"))


def balance_map(f: DataFrame, bus_carrier: str, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(bus, carrier, energy of what is at buses of a carrier, branches between such buses left out;
    branch, bus0, bus1, flow: its net energy from port 0)."""
    d = f.where(F.col("bus_carrier") == bus_carrier)
    ends = d.where("component IN ('Line', 'Link')").groupBy("component", "name").agg(F.countDistinct("port").alias("n"), F.min(F.when(F.col("port") == 0, F.col("bus"))).alias("bus0"), F.min(F.when(F.col("port") == 1, F.col("bus"))).alias("bus1"))
    inner = ends.where("bus0 IS NOT NULL AND bus1 IS NOT NULL")
    at = d.join(inner.select("component", "name"), ["component", "name"], "left_anti").groupBy("bus", "carrier").agg(F.sum(F.col("p") * F.col("w")).alias("energy")).where(F.abs("energy") > least)
    flow = d.where("port = 0").join(inner, ["component", "name"]).groupBy("component", "name", "bus0", "bus1").agg(F.sum(-F.col("p") * F.col("w")).alias("flow"))
    return at, flow


def _columns_by(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.groupBy("carrier").agg(F.sum(value).alias("value")).select(F.lit(name).alias("part"), "carrier", "value")


def aggregate_p_nom(static: dict[str, DataFrame], load: DataFrame) -> DataFrame:
    """part, carrier, value: optimal capacities of generators, storage units and links, and mean loads."""
    parts = [_columns_by(static[c], c, F.col("p_nom_opt")) for c in ("Generator", "StorageUnit", "Link")]
    sums = load.groupBy("carrier", "snapshot").agg(F.sum("p").alias("p")).groupBy("carrier").agg(F.avg("p").alias("value"))
    return reduce(DataFrame.unionByName, parts).unionByName(sums.select(F.lit("Load").alias("part"), "carrier", "value"))


def aggregate_p(f: DataFrame) -> DataFrame:
    """part, carrier, value: unweighted dispatch of one-port components, loads negative."""
    d = f.where(~F.col("component").isin(*BRANCHES))
    return d.groupBy(F.col("component").alias("part"), "carrier").agg(F.sum("p").alias("value"))


def aggregate_e_nom(units: DataFrame, stores: DataFrame) -> DataFrame:
    return _columns_by(units, "StorageUnit", F.col("p_nom_opt") * F.col("max_hours")).unionByName(_columns_by(stores, "Store", F.col("e_nom_opt")))


def aggregate_p_curtailed(gens: DataFrame, gens_t: DataFrame, units: DataFrame, units_t: DataFrame) -> DataFrame:
    g = gens_t.join(gens.select("name", "carrier", "p_nom_opt"), "name")
    u = units_t.join(units.select("name", "carrier"), "name")
    return _columns_by(g, "Generator", F.col("p_max_pu") * F.col("p_nom_opt") - F.col("p")).unionByName(_columns_by(u, "StorageUnit", F.col("inflow") - F.col("p")))


def aggregate_costs(a: DataFrame, f: DataFrame, existing_only: bool = False) -> DataFrame:
    """component, cost, carrier, value: capital costs of capacities, unweighted marginal costs of
    summed dispatch (of storage units, only of those with a positive sum)."""
    cap = a.groupBy("component", "carrier").agg(F.sum(F.col("installed" if existing_only else "capacity") * F.col("capital_cost")).alias("value")).withColumn("cost", F.lit("capital"))
    p = F.when(F.col("component") == "Link", -F.col("p")).otherwise(F.col("p"))
    d = f.where("port = 0 AND component IN ('Link', 'Generator', 'StorageUnit', 'Store')").groupBy("component", "name").agg(F.sum(p).alias("p")).where("component <> 'StorageUnit' OR p > 0")
    m = d.join(a, ["component", "name"]).groupBy("component", "carrier").agg(F.sum(F.col("p") * F.col("marginal_cost")).alias("value")).withColumn("cost", F.lit("marginal"))
    return cap.unionByName(m)


# ------------------------------------------------------- perfect foresight
def alive(a: DataFrame, periods: DataFrame) -> DataFrame:
    """Assets of every investment period that they are active in: built by then, not yet expired."""
    return a.join(periods, (F.col("build_year") <= F.col("period")) & (F.col("period") < F.col("build_year") + F.col("lifetime")))


def period_costs(a: DataFrame, f: DataFrame, periods: DataFrame) -> DataFrame:
    """period, component, cost, carrier, value: capital costs of active assets and marginal costs of
    weighted dispatch, by the period's discount (objective weight over years).  Dispatch counts
    with w_generators but for storage units (discharge, w_stores); generator and store output is
    rounded to two digits; a "co2 stored" store at a marginal cost of -100 or less pays -20.
    ``f`` has w_generators and w_stores."""
    d = F.col("objective") / F.col("years")
    cap = alive(a, periods).groupBy("period", "component", "carrier").agg(F.sum(F.col("capacity") * F.col("capital_cost") * d).alias("value")).withColumn("cost", F.lit("capital"))
    use = (
        F.when(F.col("component") == "Link", -F.col("p") * F.col("w_generators")).when(F.col("component") == "StorageUnit", F.greatest("p", F.lit(0.0)) * F.col("w_stores"))
        .otherwise(F.round("p", 2) * F.col("w_generators"))
    )
    s = f.where("port = 0 AND component NOT IN ('Load', 'Line')").groupBy("period", "component", "name").agg(F.sum(use).alias("use"))
    price = F.when((F.col("component") == "Store") & (F.col("carrier") == "co2 stored") & (F.col("marginal_cost") <= -100), F.lit(-20.0)).otherwise(F.col("marginal_cost"))
    mar = s.join(a.select("component", "name", "carrier", "marginal_cost"), ["component", "name"]).join(periods, "period").groupBy("period", "component", "carrier").agg(F.sum(F.col("use") * price * d).alias("value")).withColumn("cost", F.lit("marginal"))
    return cap.unionByName(mar)


def period_capacities(a: DataFrame, periods: DataFrame) -> DataFrame:
    """Active capacity of every period; load shedding left out."""
    return alive(a, periods).where("carrier <> 'load'").groupBy("period", "component", "carrier").agg(F.sum("capacity").alias("capacity"))


def period_energy(f: DataFrame) -> DataFrame:
    """Energy by period, component and carrier, over all ports, at w_generators."""
    return f.groupBy("period", "component", "carrier").agg(F.sum(F.col("p") * F.col("w_generators")).alias("energy"))


def period_supply_energy(f: DataFrame) -> DataFrame:
    """Energy by bus carrier, component, carrier (with the port for branches) and period: generators at
    w_generators, other one-port components at w_stores, branches at w_objective."""
    w = F.when(F.col("component") == "Generator", F.col("w_generators")).when(F.col("component").isin(*BRANCHES), F.col("w_objective")).otherwise(F.col("w_stores"))
    name = F.when(F.col("component").isin(*BRANCHES), F.concat("carrier", F.col("port").cast("string"))).otherwise(F.col("carrier"))
    return f.groupBy("period", "bus_carrier", "component", name.alias("carrier")).agg(F.sum(F.col("p") * w).alias("energy"))


def max_supply(f: DataFrame) -> DataFrame:
    """Greatest dispatch by bus carrier, component and carrier: for one-port components the greatest
    p, loads negated after it; for a branch the greatest input of port 0, negative, and the greatest
    input of other ports taken with the sign of the port's parity, summed over components."""
    port = F.col("port")
    even = port % 2 == 0
    raw = F.when(F.col("component").isin(*BRANCHES), F.when(even, -F.col("p")).otherwise(F.col("p"))).when(F.col("component") == "Load", -F.col("p")).otherwise(F.col("p"))
    top = f.groupBy("bus_carrier", "component", "name", "carrier", "port").agg(F.max(raw).alias("top"))
    sign = F.when(F.col("component").isin(*BRANCHES), F.when(even, F.lit(-1.0)).otherwise(F.lit(1.0))).when(F.col("component") == "Load", F.lit(-1.0)).otherwise(F.lit(1.0))
    name = F.when(F.col("component").isin(*BRANCHES), F.concat("carrier", port.cast("string"))).otherwise(F.col("carrier"))
    return top.groupBy("bus_carrier", "component", name.alias("carrier")).agg(F.sum(F.col("top") * sign).alias("supply"))


def plain_curtailment(gens: DataFrame, gens_t: DataFrame) -> DataFrame:
    """Percent of available generation that is not used, unweighted, to three digits."""
    j = gens_t.join(gens.select("name", "carrier", "p_nom_opt"), "name")
    avail = F.sum(F.col("p_max_pu") * F.col("p_nom_opt"))
    return j.groupBy("carrier").agg(F.round(F.try_divide(avail - F.sum("p"), avail) * 100, 3).alias("curtailment"))


def plain_market_values(f: DataFrame, series: DataFrame, bus_carrier: str = "AC") -> DataFrame:
    """Unweighted revenue over dispatch: of generators by carrier, of links by carrier over port 0 and,
    where a carrier has port 1 there, over port 1."""
    d = f.where((F.col("bus_carrier") == bus_carrier) & ((F.col("component") == "Generator") | ((F.col("component") == "Link") & F.col("port").isin(0, 1)))).join(series.select("bus", "snapshot", "price"), ["bus", "snapshot"])
    g = d.groupBy("component", "carrier", "port").agg(F.try_divide(F.sum(F.col("p") * F.col("price")), F.sum("p")).alias("value"))
    return g.groupBy("component", "carrier").agg(F.max_by("value", "port").alias("market_value"))


def price_deviation(series: DataFrame, buses: DataFrame, carrier: str = "AC", zero: float = 0.1) -> DataFrame:
    """metric, value: share of zero hours, mean of the buses' means, deviation of their deviations."""
    at = buses.where(F.col("carrier") == carrier).select(F.col("name").alias("bus"))
    p = F.col("price")
    b = series.join(at, "bus", "left_semi").groupBy("bus").agg(F.sum((p < zero).cast("double")).alias("z"), F.count(p).alias("n"), F.avg(p).alias("m"), F.stddev_samp(p).alias("s"))
    row = b.agg((F.sum("z") / F.sum("n")).alias("zero_hours"), F.avg("m").alias("mean"), F.stddev_samp("s").alias("standard_deviation"))
    return row.unpivot([], list(row.columns), "metric", "value")


def discounted(costs_by_year: DataFrame, rates: list[float], first: int) -> DataFrame:
    """(keys.., year, cost) -> year, rate, cost / (1 + rate)^(year - first)."""
    r = costs_by_year.withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    return r.withColumn("cost", F.col("cost") / F.pow(1 + F.col("rate"), F.col("year") - first))


def drop_small(df: DataFrame, by: list[str], value: str, threshold: float, columns: list[str]) -> DataFrame:
    """Labels whose greatest value over the columns (signed) reaches the threshold; long form."""
    d = df.groupBy(*by, *columns).agg(F.sum(value).alias(value))
    keep = d.groupBy(*by).agg(F.max(value).alias("_m")).where(F.col("_m") >= threshold).select(*by)
    return d.join(keep, by, "left_semi")
