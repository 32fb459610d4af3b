"""Time series: spines, gaps, fills, as-of maps, resampling, weights, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshots(spark: SparkSession, ranges: list[tuple[str, str]], step: str = "1 hour", drop_leap_day: bool = False) -> DataFrame:
    """snapshot, idx over half-open ranges [start, end)."""
    r = spark.createDataFrame(ranges, "a string, b string").select(F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("b").alias("b"))
    s = r.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("snapshot"), "b").where("snapshot < b").select("snapshot").distinct()
    if drop_leap_day:
        s = s.where(~((F.month("snapshot") == 2) & (F.dayofmonth("snapshot") == 29)))
    return s.withColumn("idx", F.row_number().over(W.orderBy("snapshot")) - 1)  # one row per snapshot of a horizon


def gap_runs(df: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Adds ``gap_len``: the length of the run of NULLs that a row is in (0: not NULL)."""
    w = W.partitionBy(*key).orderBy(time)
    d = df.withColumn("_isl", F.sum(F.col(value).isNotNull().cast("long")).over(w))
    n = F.sum(F.col(value).isNull().cast("long")).over(W.partitionBy(*key, "_isl"))
    return d.withColumn("gap_len", F.when(F.col(value).isNull(), n).otherwise(0)).drop("_isl")


def interpolate(df: DataFrame, key: list[str], time: str, value: str, limit: int, out: str) -> DataFrame:
    """Linear over row positions, at most ``limit`` leading NULLs of every gap; a trailing
    gap is filled forward up to ``limit``."""
    w = W.partitionBy(*key).orderBy(time)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    d = df.withColumn("_i", F.row_number().over(w))
    there = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    d = d.withColumn("_p", F.last(there, True).over(back)).withColumn("_n", F.first(there, True).over(ahead))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    near = F.col("_i") - F.col("_p.i") <= limit
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(near & F.col("_n").isNotNull(), line).when(near, F.col("_p.v"))
    return d.withColumn(out, filled).drop("_i", "_p", "_n")


def shift_fill(df: DataFrame, key: list[str], time: str, value: str, shift: str, out: str) -> DataFrame:
    """NULLs take the value at time - shift, by timestamp."""
    past = df.select(*key, (F.col(time) + F.expr(f"interval {shift}")).alias(time), F.col(value).alias("_past"))
    return df.join(past, [*key, time], "left").withColumn(out, F.coalesce(value, "_past")).drop("_past")


def copy_slices(df: DataFrame, key: list[str], time: str, value: str, rules: DataFrame) -> DataFrame:
    """(key.., start, stop, delta): the rows of a key from start to stop take the values of delta
    earlier.  A rule whose slice is not wholly in the series changes nothing; of several rules for
    a row the one that starts last counts."""
    have = df.select(*key, F.col(time).alias("_t")).distinct()
    r = rules.withColumn("_id", F.monotonically_increasing_id())
    ends = r.select("_id", *key, F.explode(F.expr("array(start, stop, start - delta, stop - delta)")).alias("_t")).join(have, [*key, "_t"]).groupBy("_id").agg(F.countDistinct("_t").alias("_n"), F.count("*").alias("_m"))
    r = rules.withColumn("_id", F.monotonically_increasing_id()).join(ends.where("_m = 4").select("_id"), "_id", "left_semi")
    d = df.join(r, key, "left").where(F.col("start").isNull() | F.col(time).isNotNull())
    inside = F.col(time).between(F.col("start"), F.col("stop"))
    best = d.groupBy(*df.columns).agg(F.max(F.when(inside, F.struct("start", "delta"))).alias("_r"))
    past = df.select(*key, F.col(time).alias("_src"), F.col(value).alias("_v"))
    j = best.withColumn("_src", F.col(time) - F.col("_r.delta")).join(past, [*key, "_src"], "left")
    return j.select(*[F.when(F.col("_r").isNotNull(), F.col("_v")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in df.columns])


def substitute(df: DataFrame, key: str, time: str, value: str, rules: DataFrame) -> DataFrame:
    """(to, source, factor): a series that is missing, or NULL for over half of its rows, becomes
    factor times the source's."""
    null = df.groupBy(F.col(key).alias("to")).agg((F.avg(F.col(value).isNull().cast("double")) <= 0.5).alias("fine"))
    need = rules.join(null.where("fine").select("to"), "to", "left_anti")
    new = df.withColumnRenamed(key, "source").join(need, "source").select(F.col("to").alias(key), time, (F.col(value) * F.col("factor")).alias(value))
    return df.join(need.select(F.col("to").alias(key)), key, "left_anti").select(key, time, value).unionByName(new)


def asof(left: DataFrame, right: DataFrame, time: str, value: str, by: list[str] | None = None, bfill: bool = False) -> DataFrame:
    """``left`` with the latest value of ``right`` at or before its time (with ``bfill``,
    else the next one).  Both sides are sorted once per key; nothing is broadcast.  Give a
    key: without one, all rows are one series and one task."""
    by = by or []
    cols = [c for c in left.columns]
    u = left.select(*cols, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select(*by, time, value, F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = W.partitionBy(*by).orderBy(time, "_side")
    got = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if bfill:
        got = F.coalesce(got, F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return u.select(*cols, got.alias(value), "_side").where("_side = 1").drop("_side")


def bucket(time: Column, hours: int) -> Column:
    """The start of the n-hour bucket, counted from the epoch."""
    sec = F.unix_timestamp(time.cast("timestamp"))
    return F.timestamp_seconds(sec - F.pmod(sec, F.lit(3600 * hours))).cast("timestamp_ntz")


def nhour(df: DataFrame, key: list[str], time: str, hours: int, mean: list[str], total: list[str]) -> DataFrame:
    """n-hour buckets: means of values, sums of weights."""
    return df.groupBy(*key, bucket(F.col(time), hours).alias("bucket")).agg(*[F.avg(c).alias(c) for c in mean], *[F.sum(c).alias(c) for c in total])


def every_nth(df: DataFrame, idx: str, n: int, weights: list[str]) -> DataFrame:
    return df.where(F.col(idx) % n == 0).select(*[(F.col(c) * n).alias(c) if c in weights else F.col(c) for c in df.columns])


def leap_day_shift(df: DataFrame, time: str, weight: str) -> DataFrame:
    """Drop 29 February; the 1 March 00:00 row of the year gets its summed weight, overwritten."""
    leap = (F.month(time) == 2) & (F.dayofmonth(time) == 29)
    moved = df.where(leap).groupBy(F.year(time).alias("_y")).agg(F.sum(weight).alias("_w"))
    first = (F.month(time) == 3) & (F.dayofmonth(time) == 1) & (F.hour(time) == 0)
    j = df.where(~leap).join(moved, F.year(time) == F.col("_y"), "left")
    return j.select(*[F.when(first & F.col("_w").isNotNull(), F.col("_w")).otherwise(F.col(weight)).alias(c) if c == weight else F.col(c) for c in df.columns])


def week_hour(time: Column, zone: str | Column = "UTC") -> Column:
    """24 * weekday + hour in local time, Monday first."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, time)
    return (F.weekday(local) * 24 + F.hour(local)).cast("int")


def rolling_mean(df: DataFrame, key: list[str], time: str, value: str, n: int, out: str) -> DataFrame:
    """Trailing mean over n rows, the first n - 1 filled backward."""
    w = W.partitionBy(*key).orderBy(time)
    frame = w.rowsBetween(-(n - 1), 0)
    raw = F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
    d = df.withColumn("_r", raw)
    return d.withColumn(out, F.first("_r", True).over(w.rowsBetween(0, W.unboundedFollowing))).drop("_r")


def increments(df: DataFrame, key: list[str], time: str, value: str, out: str) -> DataFrame:
    """Non-negative change against the previous row; the first row keeps its value."""
    prev = F.lag(value).over(W.partitionBy(*key).orderBy(time))
    return df.withColumn(out, F.when(prev.isNull(), F.col(value)).otherwise(F.greatest(F.col(value) - prev, F.lit(0.0))))


def trapezoid(df: DataFrame, key: list[str], x: str, y: str, rates: list[float], base: float) -> DataFrame:
    """Discounted integral of y over x by rate: sum (y + y') / 2 * (x - x') of y / (1 + r)^(x - base)."""
    r = df.select(*key, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"), F.explode(F.array(*map(F.lit, rates))).alias("rate"))
    r = r.withColumn("_v", F.col("_y") / F.pow(1 + F.col("rate"), F.col("_x") - base))
    w = W.partitionBy(*key, "rate").orderBy("_x")
    area = (F.col("_v") + F.lag("_v").over(w)) / 2 * (F.col("_x") - F.lag("_x").over(w))
    return r.withColumn("_a", area).groupBy(*key, "rate").agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("total"))


def period_weights(df: DataFrame, start: str, years: str, rate: float) -> DataFrame:
    """Adds the objective weight of an investment period: sum of 1 / (1 + r)^t over its years."""
    t = F.sequence(F.col(start), F.col(start) + F.col(years) - 1)
    return df.withColumn("objective", F.aggregate(t, F.lit(0.0), lambda a, k: a + 1 / F.pow(F.lit(1.0 + rate), k)))


def cyclic_shift(df: DataFrame, key: list[str], idx: str, value: str, k: int, out: str) -> DataFrame:
    """The value k positions earlier, wrapping around the series."""
    n = F.count("*").over(W.partitionBy(*key))
    d = df.withColumn("_n", n)
    src = df.select(*key, F.col(idx).alias("_src"), F.col(value).alias(out))
    return d.withColumn("_src", F.pmod(F.col(idx) - k, F.col("_n"))).join(src, [*key, "_src"], "left").drop("_src", "_n")


def representative_days(df: DataFrame, time: str, days: DataFrame, weight: str) -> DataFrame:
    """Rows of representative days (day, size), weights times the cluster's size."""
    j = df.withColumn("_d", F.to_date(time)).join(days.select(F.col("day").alias("_d"), F.col("size").alias("_s")), "_d")
    return j.select(*[(F.col(c) * F.col("_s")).alias(c) if c == weight else F.col(c) for c in df.columns])


def expand_days(df: DataFrame, time: str, assignment: DataFrame) -> DataFrame:
    """Full chronology: each (day, rep_day) takes the hours of its representative day."""
    d = df.withColumn("_rep", F.to_date(time)).withColumn("_off", F.col(time) - F.date_trunc("day", time).cast("timestamp_ntz"))
    j = assignment.select(F.col("day"), F.col("rep_day").alias("_rep")).join(d, "_rep")
    full = F.col("day").cast("timestamp_ntz") + F.col("_off")
    return j.select(*[full.alias(time) if c == time else F.col(c) for c in df.columns])


def heatmap(df: DataFrame, spine: DataFrame, time: str, value: str, days: list) -> DataFrame:
    """hour x day matrix of a series carried forward over an hourly spine."""
    full = spine.select("snapshot").join(df.select(F.col(time).alias("snapshot"), value), "snapshot", "left")
    filled = full.withColumn("v", F.last(value, True).over(W.partitionBy().orderBy("snapshot").rowsBetween(W.unboundedPreceding, 0)))
    return filled.select(F.hour("snapshot").alias("hour"), F.date_format("snapshot", "MM-dd").alias("_day"), "v").groupBy("hour").pivot("_day", days).agg(F.first("v"))


def profile_times_total(df: DataFrame, totals: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """A profile normalised to its key's sum, times the key's total; NULL where the profile sums to 0."""
    share = F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(key)))
    return df.withColumn(value, share).join(totals.select(key, F.col(total).alias("_t")), key).withColumn(value, F.col(value) * F.col("_t")).drop("_t")


def scale_to_year(df: DataFrame, time: str, value: str, year: int, level: float) -> DataFrame:
    """Values relative to the mean of a year, times a level."""
    mean = df.where(F.year(time) == year).agg(F.avg(value).alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(value, F.try_divide(value, "_m") * level).drop("_m")  # a single row


def degree_days(df: DataFrame, key: list[str], time: str, temp: str, threshold: float) -> DataFrame:
    """key, year, hdd: degrees of the daily mean under a threshold, summed over the year."""
    d = df.groupBy(*key, F.to_date(time).alias("_d")).agg(F.avg(temp).alias("_t"))
    return d.groupBy(*key, F.year("_d").alias("year")).agg(F.sum(F.greatest(threshold - F.col("_t"), F.lit(0.0))).alias("hdd"))


def segments(df: DataFrame, key: list[str], time: str, features: list[str], k: int) -> DataFrame:
    """Contiguous segments per key (one series per group, such as a year): neighbours with
    the least increase of Ward's criterion merge until k are left.

    Returns key, segment, start, length and the features' means.
    """
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in key), "segment int", f"start {df.schema[time].dataType.simpleString()}", "length int", *(f"{c} double" for c in features)])

    def merge(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(time).reset_index(drop=True)
        x = pdf[features].to_numpy(float)
        top = np.abs(x).max(0)
        z = x / np.where(top > 0, top, 1)
        cuts, size, mean = list(range(len(z))), [1] * len(z), list(z)
        cost = [_ward(size[i], size[i + 1], mean[i], mean[i + 1]) for i in range(len(z) - 1)]
        while len(cuts) > k:
            i = int(np.argmin(cost))
            n = size[i] + size[i + 1]
            mean[i] = (mean[i] * size[i] + mean[i + 1] * size[i + 1]) / n
            size[i] = n
            del cuts[i + 1], size[i + 1], mean[i + 1], cost[i]
            if i > 0:
                cost[i - 1] = _ward(size[i - 1], size[i], mean[i - 1], mean[i])
            if i < len(cost):
                cost[i] = _ward(size[i], size[i + 1], mean[i], mean[i + 1])
        rows = []
        for s, (c, n) in enumerate(zip(cuts, size)):
            rows.append([*(pdf[g].iloc[0] for g in key), s, pdf[time].iloc[c], n, *x[c : c + n].mean(0)])
        return pd.DataFrame(rows, columns=[*key, "segment", "start", "length", *features])

    return df.groupBy(*key).applyInPandas(merge, schema)


def _ward(n: int, m: int, a, b) -> float:
    d = a - b
    return float(n * m / (n + m) * (d @ d))
