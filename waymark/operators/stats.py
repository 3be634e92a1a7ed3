"""Per-user and per-day statistics, and the distribution of one numeric column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..spec import BINS, TRIM

#: Values that are sorted in one place at most, and the accuracy of the quantiles that bracket them.
SORTED, QUANTILE_ACCURACY = 100_000, 10_000


def uid_metrics(detail: DataFrame, by: tuple = ("uid",)) -> DataFrame:
    """time, distance (nulls as 0) and cnt of each user."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    return detail.where(F.col("uid").isNotNull()).groupBy(*by).agg(total("time_value").alias("time"), total("dist_value").alias("distance"), F.count(F.lit(1)).alias("cnt"))


def day_stats(metrics: DataFrame, date: str = "date") -> DataFrame:
    """stat_date, metric (time, distance, count), max, min, avg and lower median over users: all days in one plan."""
    names = (("time", "time"), ("distance", "distance"), ("count", "cnt"))
    aggs = [f.alias(f"{m}_{s}") for m, c in names for s, f in (("max", F.max(c)), ("min", F.min(c)), ("avg", F.avg(c)), ("median", F.percentile_approx(c, 0.5)))]
    wide = metrics.groupBy(F.col(date).cast("string").alias("stat_date")).agg(*aggs)
    rows = ", ".join(f"'{m}', " + ", ".join(f"double({m}_{s})" for s in ("max", "min", "avg", "median")) for m, _ in names)
    return wide.selectExpr("stat_date", f"stack(3, {rows}) AS (metric, max_value, min_value, avg_value, median_value)")


def report_place() -> Column:
    return F.when(F.col("metric") == "time", 1).when(F.col("metric") == "distance", 2).when(F.col("metric") == "count", 3).otherwise(99)


def in_report_order(stats: DataFrame) -> DataFrame:
    """Sorted by date, then time, distance, count."""
    return stats.orderBy("stat_date", report_place())


def numeric(rows: DataFrame, column: str, skip_zero: bool = True) -> tuple:
    """(values, counts): the parsed values of a text column as `v`, and one row with skipped_zero and skipped_invalid. Blanks are
    left out and not counted; NaN counts as a value, as it parses."""
    text = F.trim(F.col(column).cast("string"))
    read = rows.select(text.alias("t"), text.try_cast("double").alias("v")).where("t IS NOT NULL AND t <> ''")
    zero = F.col("v") == 0.0 if skip_zero else F.lit(False)
    counts = read.agg(F.count_if(zero).alias("skipped_zero"), F.count_if(F.col("v").isNull()).alias("skipped_invalid"))
    return read.where(F.col("v").isNotNull() & ~zero).select("v"), counts


def nth_smallest(values: DataFrame, rank: int, total: int, column: str = "v", most: int = SORTED):
    """The value at a 1-based rank among `total` values. Each pass brackets it between two approximate quantiles and counts exactly
    what lies below, on and between them, until what is between has `most` rows at most. No task ever sorts more."""
    v, low, high, below, inside = F.col(column), None, None, 0, total
    rows = values
    while inside > most:
        share, slack = (rank - below) / inside, 2.0 / QUANTILE_ACCURACY
        low, high = rows.agg(F.percentile_approx(v, [max(0.0, share - slack), min(1.0, share + slack)], QUANTILE_ACCURACY)).first()[0]
        rows = values.where((v > low) & (v < high))
        under, on, inside = values.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high))).first()
        below = under + on
        if rank <= below:
            return low
        if rank > below + inside:
            return high
    return rows.orderBy(v).select(v).collect()[rank - below - 1][0]  # `most` rows at most


def nearest_rank(values: DataFrame, p: float, column: str = "v"):
    """The element at ceil(p n) of the sorted values; None without values."""
    n = values.count()
    return nth_smallest(values, max(1, math.ceil(p * n)), n, column) if n else None


def median(values: DataFrame, column: str = "v"):
    """The middle element, or the mean of the two; None without values."""
    n = values.count()
    return sum(nth_smallest(values, k, n, column) for k in ((n + 1) // 2, n // 2 + 1)) / 2 if n else None


def trim(values: DataFrame, share: float = TRIM) -> DataFrame:
    """Values up to the nearest-rank percentile."""
    return trimmed(values, share)[0]


def trimmed(values: DataFrame, share: float = TRIM) -> tuple:
    """Values up to the nearest-rank percentile, and one row with that bound (upper_bound) and the number beyond it (skipped_high)."""
    bound = F.lit(nearest_rank(values, share)).cast("double")
    above = values.agg(F.count_if(F.col("v") > bound).alias("skipped_high")).withColumn("upper_bound", bound)
    return values.where(F.col("v") <= bound).select("v"), above


def histogram(values: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, bin_left, bin_right, frequency: equal-width bins, empty ones included; the last is closed. Values that are all equal
    (to 1e-9 relative) make one bin. No values make no bin."""
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    flat = F.abs(F.col("hi") - F.col("lo")) <= F.lit(1e-9) * F.greatest(F.abs("hi"), F.abs("lo"))
    span = span.select("lo", "hi", F.when(flat, F.lit(1)).otherwise(F.lit(bins)).alias("n")).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("n"))
    at = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("w"))), F.col("n") - 1)).cast("int")
    counts = values.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))  # one row of bounds
    all_bins = span.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    right = F.when(F.col("bin") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("w"))
    out = all_bins.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_left"), right.alias("bin_right"))
    return out.join(counts, "bin", "left").select("bin", "bin_left", "bin_right", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def summary(values: DataFrame, counts: DataFrame) -> DataFrame:
    """metric, value, in the order of the report: count, min, max, mean, median (midpoint of two; null without values), the skipped_*
    of counts (one row), and without values its upper_bound, if it has one."""
    one = values.agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    one = one.withColumn("median", F.lit(median(values)).cast("double"))
    names = ["count", "min", "max", "mean", "median", *[c for c in ("skipped_invalid", "skipped_zero", "skipped_high", "upper_bound") if c in counts.columns]]
    rows = ", ".join(f"{k}, '{n}', double(`{n}`)" for k, n in enumerate(names))
    wide = one.crossJoin(F.broadcast(counts))  # one row each
    shown = wide.selectExpr("`count` AS _n", f"stack({len(names)}, {rows}) AS (_k, metric, value)")
    return shown.where("_n = 0 OR metric <> 'upper_bound'").orderBy("_k").select("metric", "value")


def running_mean(rows: DataFrame, value: str, by: tuple, order: tuple, name: str = "r_avg") -> DataFrame:
    """The mean of a value over the rows of its group up to each row."""
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
