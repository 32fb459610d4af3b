"""Costs, energy totals, industry and heat: table-driven compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import annuity
from .frames import normed


def prepare_costs(long: DataFrame, defaults: dict[str, float], years: float = 1.0) -> DataFrame:
    """(technology, parameter, value) to one row per technology, defaults filled in, with
    capital_cost = (annuity(lifetime, discount rate) + FOM / 100) * investment * years and
    marginal_cost = VOM + fuel / efficiency."""
    wide = long.groupBy("technology").pivot("parameter", sorted(defaults)).agg(F.sum("value"))
    w = wide.select("technology", *[F.coalesce(F.col(f"`{p}`"), F.lit(float(v))).alias(p) for p, v in sorted(defaults.items())])
    capital = (annuity(F.col("lifetime"), F.col("discount rate")) + F.col("FOM") / 100) * F.col("investment") * years
    return w.select("*", capital.alias("capital_cost"), (F.col("VOM") + F.try_divide("fuel", "efficiency")).alias("marginal_cost"))


def storage_costs(costs: DataFrame, parts: dict[str, tuple[str, str, str | None, float]]) -> DataFrame:
    """Composite storage by (energy part, link, second link or None, hours): link + hours *
    energy part + second link; such a row costs nothing else."""
    spec = costs.sparkSession.createDataFrame([(k, *v) for k, v in parts.items()], "technology string, store string, link1 string, link2 string, max_hours double")
    cost = lambda key: costs.select(F.col("technology").alias(key), F.col("capital_cost").alias(f"c_{key}"))
    j = spec.join(cost("store"), "store").join(cost("link1"), "link1").join(cost("link2"), "link2", "left")
    total = F.col("c_link1") + F.col("max_hours") * F.col("c_store") + F.when(F.col("link2").isNull(), F.lit(0.0)).otherwise(F.col("c_link2"))
    return j.select("technology", total.alias("capital_cost"), F.lit(0.0).alias("marginal_cost"), F.lit(0.0).alias("CO2 intensity"), F.lit(0.0).alias("standing_losses"))


def blend_ratios(today: DataFrame, future: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """a (1 - f) + b f; where one side is missing, the other stands alone."""
    t = today.select(*keys, F.col("value").alias("a")).join(future.select(*keys, F.col("value").alias("b")), keys, "full_outer")
    return t.select(*keys, F.coalesce(F.col("a") * (1 - fraction) + F.col("b") * fraction, "b", "a").alias("value"))


def rescale(df: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """Values scaled so that each key's sum meets the reference; keys without one keep theirs."""
    d = df.withColumn("_t", F.sum(value).over(W.partitionBy(key)))
    j = d.join(reference.select(key, F.col(value).alias("_ref")), key, "left")
    return j.withColumn(value, F.coalesce(F.col(value) * F.try_divide("_ref", "_t"), F.col(value))).drop("_ref", "_t")


def split_dissolved(df: DataFrame, shares: DataFrame, key: str, value: str) -> DataFrame:
    """A dissolved state's values go to its successors (old, new, share); others stay."""
    s = shares.select(F.col("old").alias("_old"), F.col("new").alias("_new"), F.col("share").alias("_share"))
    j = df.join(s, df[key] == s["_old"], "left")
    out = j.select(*[F.coalesce("_new", key).alias(c) if c == key else (F.col(value) * F.coalesce("_share", F.lit(1.0))).alias(c) if c == value else F.col(c) for c in df.columns])
    return out.groupBy(*[c for c in df.columns if c != value]).agg(F.sum(value).alias(value))


def emissions_from_fuel(energy: DataFrame, keys: list[str], factors: DataFrame) -> DataFrame:
    """(keys, fuel, value) with (fuel, factor) -> co2: energy times the fuel's factor, summed;
    fuels without a factor emit nothing."""
    j = energy.join(factors.select("fuel", "factor"), "fuel", "left")
    return j.groupBy(*keys).agg(F.sum(F.coalesce(F.col("value") * F.col("factor"), F.lit(0.0))).alias("co2"))


def fallback(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """The first estimate that is neither NULL nor 0."""
    return df.withColumn(out, F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in cols]))


def heating_distribution(totals: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Installed heating by country and technology spread over nodes by population, split
    into urban and rural by the node's urban fraction; long form."""
    n = nodes.select(key, "node", normed(F.col("population"), key).alias("share"), "urban_fraction")
    j = totals.join(n, key)
    parts = F.array(F.struct(F.lit("urban").alias("area"), F.col("urban_fraction").alias("f")), F.struct(F.lit("rural").alias("area"), (1 - F.col("urban_fraction")).alias("f")))
    return j.select("node", "technology", F.explode(parts).alias("p"), (F.col("value") * F.col("share")).alias("v")).select("node", "technology", "p.area", (F.col("v") * F.col("p.f")).alias("value"))


def district_heat_share(df: DataFrame, progress: float) -> DataFrame:
    """Today's share moves towards max(urban fraction, share) * potential by ``progress`` of the
    distance, never down; the urban fraction is raised to today's share."""
    urban = F.greatest("urban_fraction", "share")
    goal = F.greatest(urban * F.col("potential") - F.col("share"), F.lit(0.0))
    return df.withColumns({"urban_fraction": urban, "district_fraction": F.col("share") + progress * goal})


def cheapest_measure(curves: DataFrame, key: list[str], saving: float) -> DataFrame:
    """The cheapest retrofit measure that saves at least a share; the lesser name on a tie."""
    ok = curves.where(F.col("saving") >= saving)
    return ok.groupBy(*key).agg(F.min(F.struct("cost", "measure")).alias("m")).select(*key, "m.measure", "m.cost")


def port_shares(ports: DataFrame, nodes: DataFrame, country: str) -> DataFrame:
    """A country's port outflow by its nearest nodes, as shares of the country.

    Ports of one place and country have one nearest node, so their outflow is summed first."""
    from .spatial import nearest

    place = ports.groupBy(F.struct(country, "x", "y").alias("place")).agg(F.sum("outflow").alias("outflow"))
    near = nearest(place.select("place", "place.*"), nodes, country, "place", "node")
    s = place.join(near, "place").groupBy(F.col(f"place.{country}").alias(country), "node").agg(F.sum("outflow").alias("outflow"))
    return s.select(country, "node", normed(F.col("outflow"), country).alias("share"))


def emission_prices(gens: DataFrame, carriers: DataFrame, prices: DataFrame) -> DataFrame:
    """``gens`` at every snapshot with marginal_cost raised by the emission price times the carrier's
    intensity over the efficiency; carriers without an intensity keep theirs."""
    g = gens.join(carriers.select("carrier", "co2_emissions"), "carrier", "left").crossJoin(prices.select("snapshot", "price"))  # every asset has every snapshot
    extra = F.coalesce(F.col("price") * F.col("co2_emissions") / F.col("efficiency"), F.lit(0.0))
    return g.withColumn("marginal_cost", F.col("marginal_cost") + extra)
