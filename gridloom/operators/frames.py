"""Label-aligned table algebra: lookups, overrides, alignment, shares, weighted means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align(left: DataFrame, right: DataFrame, on: list[str], fill: float | None = None) -> DataFrame:
    """Full outer join of two labelled tables; ``fill`` replaces what one side lacks."""
    out = left.join(right, on, "full_outer")
    if fill is None:
        return out
    value = [c for c in out.columns if c not in on]
    return out.select(*on, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in value])


def reindex(df: DataFrame, spine: DataFrame, on: list[str], fill=None) -> DataFrame:
    """The spine's labels, with values where there are any."""
    out = spine.join(df, on, "left")
    return out if fill is None else out.fillna(fill)


def exact_sum(x: Column) -> Column:
    """The sum of doubles whatever their order: added as decimals of 18 places, rounded once."""
    return F.sum(x.cast("decimal(38,18)"))


def lookup(df: DataFrame, mapping: DataFrame, key: str, map_key: str, value: str, out: str, keep_unmapped: bool = False) -> DataFrame:
    """``out`` = the mapping's value of ``key``; NULL, or the key itself, if unmapped.

    The join's strategy is left to the optimizer, which broadcasts checked small sides.
    """
    m = mapping.select(F.col(map_key).alias("_mk"), F.col(value).alias("_mv"))
    j = df.join(m, df[key] == m["_mk"], "left")
    got = F.coalesce("_mv", F.col(key).cast(m.schema["_mv"].dataType)) if keep_unmapped else F.col("_mv")
    return j.select(*[df[c] for c in df.columns if c != out], got.alias(out))


def update(df: DataFrame, other: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Overwrite where ``other`` has a non-null value for the same labels; adds no rows."""
    o = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = df.join(o, on, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def combine_first(a: DataFrame, b: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Union of labels; ``a``'s values first, ``b``'s where ``a`` has none."""
    o = b.select(*on, *[F.col(c).alias(f"_other_{c}") for c in cols])
    return a.select(*on, *cols).join(o, on, "full_outer").select(*on, *[F.coalesce(c, f"_other_{c}").alias(c) for c in cols])


def override(base: DataFrame, custom: DataFrame, key: str, param: str, value: str, wildcard: str = "all") -> DataFrame:
    """Layered parameters (key, param, value): custom rows add or replace, and a custom
    row for the wildcard key wins for every key."""
    own = custom.where(F.col(key) != wildcard)
    out = combine_first(own, base, [key, param], [value])
    every = custom.where(F.col(key) == wildcard).select(param, F.col(value).alias("_all"))
    keys = out.select(key).distinct()
    added = keys.crossJoin(F.broadcast(every.select(param, F.col("_all").alias(value))))  # one row per parameter named by the wildcard
    return combine_first(added, out, [key, param], [value])


def adjust(df: DataFrame, rules: DataFrame, on: list[str], value: str) -> DataFrame:
    """Apply (labels, mode, factor) rules: mode ``factor`` multiplies, ``absolute`` replaces."""
    j = df.join(rules.select(*on, "mode", "factor"), on, "left")
    new = F.when(F.col("mode") == "factor", F.col(value) * F.col("factor")).when(F.col("mode") == "absolute", F.col("factor")).otherwise(F.col(value))
    return j.select(*[new.alias(c) if c == value else F.col(c) for c in df.columns])


def normed(value: Column, *by: str) -> Column:
    """Share of the group's sum; NULL where that is 0."""
    return F.try_divide(value, F.sum(value).over(W.partitionBy(*by)))


def weighted_avg(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean, or the plain mean where the weights sum to 0."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total == 0, F.avg(value)).otherwise(F.try_divide(F.sum(value * weight), total))


def strategies(df: DataFrame, by: list[str], how: dict[str, str], weight: str | None = None, order: str | None = None) -> DataFrame:
    """Group by ``by`` (null keys dropped) with one strategy per column: sum, mean, min, max,
    first, last, any, all, join, weighted."""
    o = F.col(order) if order else None
    make = {
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "min": F.min, "max": F.max,
        "first": lambda c: F.min_by(c, o), "last": lambda c: F.max_by(c, o), "any": F.bool_or, "all": F.bool_and,
        "join": lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";"),
        "weighted": lambda c: weighted_avg(F.col(c), F.col(weight)),
    }
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    return keyed.groupBy(*by).agg(*[make[s](c).alias(c) for c, s in how.items()])


def clip(value: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds that keep NULL as NULL (greatest and least alone would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(value.isNotNull(), out)


def prefix_rollup(df: DataFrame, code: str, value: str, lengths: tuple[int, int]) -> DataFrame:
    """Sums over every prefix of a hierarchical code, from lengths[0] to lengths[1] characters."""
    lev = df.select(F.explode(F.sequence(F.lit(lengths[0]), F.lit(lengths[1]))).alias("level"), F.col(code).alias("_c"), value)
    return lev.where(F.length("_c") >= F.col("level")).groupBy("level", F.expr("substring(_c, 1, level)").alias("code")).agg(F.sum(value).alias(value))


def closest(df: DataFrame, value: str, options: list[tuple[float, str]], out: str) -> DataFrame:
    """The option whose number is nearest to ``value``; the earlier one on a tie."""
    arr = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (x, n) in enumerate(options)])
    ranked = F.transform(arr, lambda o: F.struct(F.abs(o["x"] - F.col(value)).alias("d"), o["i"].alias("i"), o["n"].alias("n")))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.array_min(ranked)["n"]))


def right_closed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Labels of (edges[i], edges[i+1]]; NULL outside."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, name in zip(edges, edges[1:], labels):
        out = out.when((value > lo) & (value <= hi), F.lit(name))
    return out


def dedup_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def gather(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` for each row of ``keys`` (repeated as keys are); a key without one is an error."""
    j = keys.join(df.withColumn("_hit", F.lit(True)), key, "left")
    miss = F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))).cast("boolean")
    return j.where(F.coalesce("_hit", miss)).drop("_hit")


def where(df: DataFrame, condition: Column, cols: list[str], other: Column | None = None) -> DataFrame:
    """Values where the condition holds; elsewhere, or where it is null, ``other`` (NULL without)."""
    out = F.lit(None) if other is None else other
    return df.select(*[F.when(condition, F.col(c)).otherwise(out).alias(c) if c in cols else F.col(c) for c in df.columns])


def select_columns(df: DataFrame, like: str | None = None, regex: str | None = None, items: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns whose name holds ``like``, matches ``regex`` somewhere, or is listed; ``keep`` ones first."""
    import re

    fits = lambda c: (like is not None and like in c) or (regex is not None and re.search(regex, c) is not None) or c in (items or [])
    keep = keep or []
    return df.select(*keep, *[c for c in df.columns if c not in keep and fits(c)])


def where_query(df: DataFrame, text: str, **values) -> DataFrame:
    """Rows of a predicate text such as ``carrier in @names & ~p_nom_extendable and p_nom > 10``:
    @name is a value or list given, == and & | ~ are comparison and logic, quotes are as in Python."""
    import re

    def lit(x) -> str:
        if isinstance(x, (list, tuple, set)):
            return "(" + ", ".join(lit(v) for v in x) + ")" if x else "(NULL)"
        return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)

    out = []
    for piece in re.split(r"""('(?:[^'\\\\]|\\\\.)*'|"(?:[^"\\\\]|\\\\.)*")""", text):
        if piece[:1] in ("'", '"'):
            out.append(lit(piece[1:-1]))
            continue
        piece = re.sub(r"@(\w+)", lambda m: lit(values[m[1]]), piece)
        piece = piece.replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
        out.append(re.sub(r"\bin\s*\[([^\]]*)\]", r"in (\1)", piece).replace("[", "(").replace("]", ")"))
    return df.where("".join(out))


def fill(df: DataFrame, key: list[str], time: str, value: str, how: str = "ffill") -> DataFrame:
    """NULLs take the last (``ffill``) or next (``bfill``) value of their group."""
    w = W.partitionBy(*key).orderBy(time)
    got = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0)) if how == "ffill" else F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(value, got)


def preferred_order(df: DataFrame, col: str, order: list[str], out: str = "rank") -> DataFrame:
    """A rank that puts listed values first, in their order, then the others by name."""
    place = F.element_at(F.create_map(*[F.lit(x) for kv in {v: i for i, v in enumerate(order)}.items() for x in kv]), F.col(col)) if order else F.lit(None).cast("int")
    keys = df.select(col).distinct().withColumn("_p", F.coalesce(place, F.lit(len(order))))
    # One row per distinct value: a label set, not records.
    ranked = keys.withColumn(out, F.row_number().over(W.orderBy("_p", col))).drop("_p")
    return df.join(ranked, col, "left")


def statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, distinct count, median, sample variance, population deviation and quartiles by group."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.countDistinct(value).alias("nunique"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.var_samp(value).alias("var"), F.stddev_pop(value).alias("std0"),
        F.expr(f"percentile({value}, 0.25)").alias("q25"), F.expr(f"percentile({value}, 0.75)").alias("q75"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Values that are not null, with their number of rows."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def key_sets(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """Distinct keys of the union, intersection, difference or symmetric_difference."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return {
        "union": lambda: x.union(y).distinct(), "intersection": lambda: x.intersect(y), "difference": lambda: x.exceptAll(y),
        "symmetric_difference": lambda: x.exceptAll(y).union(y.exceptAll(x)),
    }[how]()


def transpose(df: DataFrame, key: str, columns: list[str], values: list) -> DataFrame:
    """One row per column of ``columns`` and a column per listed key value."""
    long = df.unpivot([key], columns, "variable", "_v")
    return long.groupBy("variable").pivot(key, values).agg(F.first("_v"))


def linear_fill(df: DataFrame, key: list[str], x: str, y: str, out: str) -> DataFrame:
    """Missing ``y`` from the line fitted to the group's known rows."""
    line = df.groupBy(*key).agg(F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_c"))
    return df.join(line, key, "left").withColumn(out, F.coalesce(F.col(y), F.col("_m") * F.col(x) + F.col("_c"))).drop("_m", "_c")


def class_by_quantiles(df: DataFrame, value: str, low: float = 0.1, high: float = 0.9, names: tuple[str, str, str] = ("low", "mid", "high"), out: str = "class") -> DataFrame:
    """Three classes by two quantiles of the whole column."""
    q = df.agg(F.expr(f"percentile({value}, {low})").alias("_a"), F.expr(f"percentile({value}, {high})").alias("_b"))
    k = F.when(F.col(value).isNull(), F.lit(None)).when(F.col(value) <= F.col("_a"), names[0]).when(F.col(value) <= F.col("_b"), names[1]).otherwise(names[2])
    return df.crossJoin(F.broadcast(q)).withColumn(out, k).drop("_a", "_b")  # a single row


def equal_width_bins(df: DataFrame, group: str, value: str, n: int, margin: float = 1e-3, out: str = "bin") -> DataFrame:
    """Classes 1..n of equal width between the group's extremes, widened by a margin."""
    w = W.partitionBy(group)
    lo, hi = F.min(value).over(w) - margin, F.max(value).over(w) + margin
    return df.withColumns({"_lo": lo, "_hi": hi}).withColumn(out, F.width_bucket(value, "_lo", "_hi", F.lit(n)).cast("long")).drop("_lo", "_hi")


def subtotals(df: DataFrame, by: list[str], aggs: dict[str, Column], name: str = "tot") -> DataFrame:
    """Aggregates of every level of a hierarchy, with ``name`` for a level summed over."""
    g = df.rollup(*by).agg(*[v.alias(k) for k, v in aggs.items()], *[F.grouping(c).alias(f"_g{c}") for c in by])
    return g.select(*[F.when(F.col(f"_g{c}") == 1, name).otherwise(F.col(c)).alias(c) for c in by], *aggs)
