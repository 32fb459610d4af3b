"""Network summary queries over long tables.

A network is: ``dispatch`` (component, name, carrier, bus_carrier, bus, snapshot, p, w,
marginal_cost), ``assets`` (component, name, carrier, bus, p_nom, p_nom_opt, capital_cost,
efficiency, p_nom_extendable, lifetime, build_year), ``ports`` for branches, ``prices``
(bus, snapshot, price) and ``loads``.  Everything stays long; pivots come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy_balance(dispatch: DataFrame, by: list[str]) -> DataFrame:
    """Signed energy by component, carrier, bus carrier (and more): sum of sign * p * w."""
    return dispatch.groupBy(*by).agg(F.sum(F.col("sign") * F.col("p") * F.col("w")).alias("energy"))


def ports_long(links: DataFrame, n: int) -> DataFrame:
    """Branch flows (bus0..busN, p0..pN) to one row per used port; p leaves the bus."""
    ports = F.array(*[F.struct(F.lit(i).alias("port"), F.col(f"bus{i}").alias("bus"), F.col(f"p{i}").alias("p")) for i in range(n)])
    keep = [c for c in links.columns if c not in {f"{k}{i}" for i in range(n) for k in ("bus", "p")}]
    return links.select(*keep, F.explode(ports).alias("x")).where("x.bus <> ''").select(*keep, "x.port", "x.bus", (-F.col("x.p")).alias("p"))


def costs(assets: DataFrame, dispatch: DataFrame, by: list[str]) -> DataFrame:
    """Capital and marginal costs with a ``cost`` level."""
    cap = assets.groupBy(*by).agg(F.sum(F.col("capital_cost") * F.col("p_nom_opt")).alias("value")).withColumn("cost", F.lit("capital"))
    mar = dispatch.groupBy(*by).agg(F.sum(F.abs("p") * F.col("w") * F.col("marginal_cost")).alias("value")).withColumn("cost", F.lit("marginal"))
    return cap.unionByName(mar)


def capacities(assets: DataFrame, by: list[str]) -> DataFrame:
    return assets.groupBy(*by).agg(F.sum("p_nom_opt").alias("p_nom_opt"))


def assign_location(df: DataFrame, ladder: list[str], default: str = "EU") -> DataFrame:
    """The first usable location: neither empty nor the default itself."""
    return df.withColumn("location", F.coalesce(*[F.when((F.col(c) != "") & (F.col(c) != default), F.col(c)) for c in ladder], F.lit(default)))


def wide(df: DataFrame, rows: list[str], column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, values).agg(F.sum(value))
