"""Disaggregation to nodes: shares, fallback ladders, upsampling, capacity gaps, hydro."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import normed


def distribution_key(sites: DataFrame, group: str, node: str, amount: str, quantile: float = 0.2) -> DataFrame:
    """group, node, share: sites without an amount take the group's quantile; a group
    without any amount is shared evenly over its sites."""
    q = sites.groupBy(group).agg(F.expr(f"percentile({amount}, {quantile})").alias("_q"))
    s = sites.join(q, group).withColumn("_v", F.coalesce(amount, "_q"))
    n = F.count("*").over(W.partitionBy(group))
    s = s.withColumn("_s", F.coalesce(normed(F.col("_v"), group), 1 / n))
    return s.groupBy(group, node).agg(F.sum("_s").alias("share"))


def with_fallback(keys: DataFrame, population: DataFrame, group: str, node: str, weight: str) -> DataFrame:
    """Keys, and for groups that have none shares by population."""
    miss = population.join(keys.select(group).distinct(), group, "left_anti")
    return keys.unionByName(miss.select(group, node, normed(F.col(weight), group).alias("share")))


def disaggregate(totals: DataFrame, keys: DataFrame, group: str, value: str) -> DataFrame:
    """Totals per group times the shares of its nodes."""
    return keys.join(totals, group).withColumn(value, F.col(value) * F.col("share"))


def upsample(load: DataFrame, regions: DataFrame, country: str, value: str, gdp: str, pop: str, gdp_weight: float = 0.6) -> DataFrame:
    """Country series to regions by gdp_weight * gdp share + (1 - gdp_weight) * population share."""
    mixed = gdp_weight * F.coalesce(normed(F.col(gdp), country), F.lit(0.0)) + (1 - gdp_weight) * F.coalesce(normed(F.col(pop), country), F.lit(0.0))
    r = regions.select("*", mixed.alias("_m")).withColumn("share", normed(F.col("_m"), country)).select(country, "region", "share")
    return load.join(r, country).withColumn(value, F.col(value) * F.col("share"))


def capacity_gap(plants: DataFrame, statistics: DataFrame, group: str, node: str, potential: str, installed: str, target: str, least: float = 0.1) -> DataFrame:
    """Missing capacity per group, spread by potential; shares under ``least`` become 0."""
    have = plants.groupBy(group).agg(F.sum(installed).alias("_have"))
    gap = statistics.join(have, group, "left").select(group, F.greatest(F.col(target) - F.coalesce("_have", F.lit(0.0)), F.lit(0.0)).alias("_gap"))
    add = F.coalesce(normed(F.col(potential), group), F.lit(0.0)) * F.col("_gap")
    return plants.join(gap, group).select(group, node, F.when(add > least, add).otherwise(0.0).alias("added"))


def density_cut(df: DataFrame, country: str, density: str, population: str, rural: float, out: str = "urban") -> DataFrame:
    """Cells in rising density are rural while the running population is under the rural share;
    a cell that reaches it is urban."""
    w = W.partitionBy(country).orderBy(density)
    run = F.sum(population).over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(population).over(W.partitionBy(country))
    return df.withColumn(out, ~F.coalesce(F.try_divide(run, total) < rural, F.lit(False)))


def brownfield(assets: DataFrame, year: int, threshold: float = 10.0) -> DataFrame:
    """Assets carried into ``year``, frozen (not extendable) at their optimum.

    Infinite lifetimes and expired assets go, and so do extendable ones whose optimum is under
    the threshold.  The heat link of an extendable urban central CHP is held against the
    threshold of its electric link (the name with "electric" for "heat"): threshold *
    efficiency * p_nom_ratio of that link / its own efficiency.
    """
    chp = F.col("p_nom_extendable") & F.contains("name", F.lit("urban central")) & F.contains("name", F.lit("CHP")) & F.contains("name", F.lit("heat"))
    e = assets.select(F.col("name").alias("_e"), (F.col("efficiency") * F.col("p_nom_ratio")).alias("_x"))
    j = assets.withColumn("_to", F.when(chp, F.replace("name", F.lit("heat"), F.lit("electric"))))
    j = j.join(e, j["_to"] == e["_e"], "left")
    least = F.when(F.col("_to").isNotNull(), threshold * F.col("_x") / F.col("efficiency")).otherwise(F.lit(threshold))
    alive = (F.col("lifetime") < float("inf")) & (F.col("build_year") + F.col("lifetime") > year)
    small = F.col("p_nom_extendable") & F.coalesce(F.col("p_nom_opt") < least, F.lit(False))
    kept = j.where(alive & ~small).select(*assets.columns)
    return kept.withColumns({"p_nom": F.col("p_nom_opt"), "p_nom_extendable": F.lit(False)})


def vintage_bins(df: DataFrame, year: str, edges: list[int], out: str = "grouping_year") -> DataFrame:
    """The first grouping year at or after the given one."""
    fit = F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col(year))
    return df.withColumn(out, F.array_min(fit))


def hydro_inflow(inflow: DataFrame, plants: DataFrame, country: str, time: str, value: str) -> DataFrame:
    """A country's inflow split over its plants by rated power."""
    p = plants.select(country, "plant", normed(F.col("p_nom"), country).alias("share"))
    return inflow.join(p, country).select("plant", time, (F.col(value) * F.col("share")).alias("inflow"))


def everywhere(buses: DataFrame, carriers: DataFrame) -> DataFrame:
    """A plant without capacity of every carrier at every bus."""
    return buses.crossJoin(carriers).withColumn("p_nom", F.lit(0.0))  # the product is what is asked for
