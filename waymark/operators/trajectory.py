"""Trajectory operators on points (uid, stime, cid, ...): each takes and returns DataFrames, and none but the global rank runs
an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import euclid, haversine
from ..sources.shared import stored


def dedupe_latest(dim: DataFrame, key: str, order: str, tie: tuple = ()) -> DataFrame:
    """One row for each key: that of the greatest order, then of the greatest tie columns. An aggregate, so partly done before
    the shuffle; a window would ship and sort every version."""
    rest = [c for c in dim.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(order, *tie))
    return dim.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def enrich(points: DataFrame, dim: DataFrame, key: str = "cid", columns: tuple = ("lat", "lon")) -> DataFrame:
    """Left join of the dimension's columns; points without a match keep nulls. With several rows a key in dim, points fan out."""
    return points.join(dim.select(key, *columns), key, "left")


def fanout_stats(points: DataFrame, dim: DataFrame, key: str = "cid", column: str = "lat", places: int = 4) -> DataFrame:
    """For each key of the points, what `enrich` fans out to, without making those rows: n_rows, n_matched (rows that have the
    column) and the column's exact sum over them, as a sum of doubles depends on the order of rows. Each side is aggregated by key
    before the join: every point of a key meets every row of it in dim, so the numbers of points multiply counts and sums."""
    value, kind = F.round(column, places), f"decimal(18,{places})"
    exact = value.try_cast(kind)
    unfit = F.when(exact.isNull() & (F.abs(value) < float("inf")), value)  # an error, but only for a key that has points
    here = points.groupBy(key).agg(F.count(F.lit(1)).alias("_points"))
    there = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.count(column).alias("_set"), F.sum(exact).alias("_sum"), F.max(unfit).alias("_unfit"))
    wide = enrich(here, there, key, ("_rows", "_set", "_sum", "_unfit"))
    total = F.coalesce(F.col("_unfit").cast(kind), F.col("_points") * F.col("_sum")).cast("double")
    return wide.select(key, (F.col("_points") * F.coalesce("_rows", F.lit(1))).alias("n_rows"), (F.col("_points") * F.coalesce("_set", F.lit(0))).alias("n_matched"), total.alias(f"{column}_sum"))


def on_date(points: DataFrame, date=None) -> DataFrame:
    """Points of one date; all points without one."""
    return points if not date else points.where(F.col("date") == F.lit(date))


def index_points(points: DataFrame, by: tuple = ("uid",), order: tuple = ("stime",), tie: tuple = ()) -> DataFrame:
    """A 1-based bigint `index` along each group."""
    return points.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *tie)).cast("long"))


def standardise(points: DataFrame) -> DataFrame:
    """uid from uid or user_id as string, index, lat and lon with lenient casts; rows without uid, index or stime dropped."""
    user = next((c for c in ("uid", "user_id") if c in points.columns), None)
    if user is None:
        raise ValueError("the points have no uid or user_id column")
    missing = [c for c in ("index", "stime", "cid", "lat", "lon", "city", "province") if c not in points.columns]
    if missing:
        raise ValueError(f"the points have no columns {', '.join(missing)}")
    rows = points.where(F.col(user).isNotNull() & F.col("index").isNotNull() & F.col("stime").isNotNull())
    rows = rows.withColumns({"index": F.col("index").try_cast("long"), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "uid": F.col(user).cast("string")})
    return (rows if user == "uid" else rows.drop(user)).where(F.col("index").isNotNull())


def city_counts(points: DataFrame, by: tuple = ("uid",)) -> DataFrame:
    """Distinct cities of each group; null cities don't count, and groups without any city don't appear."""
    return points.where(F.col("city").isNotNull()).groupBy(*by).agg(F.countDistinct("city").alias("city_cnt"))


def multicity(points: DataFrame, by: tuple = ("uid",), more_than: int = 1) -> DataFrame:
    """Points of the groups with more cities than that: a semi-join, as the keys are distinct."""
    return points.join(city_counts(points, by).where(F.col("city_cnt") > more_than), list(by), "left_semi")


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def previous_deltas(points: DataFrame, by: tuple = ("uid",), order: tuple = ("index", "stime")) -> DataFrame:
    """time_value (seconds, never negative) and dist_value (metres; 0 where a coordinate is missing) to the previous point of the
    group; both null on its first point."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.struct("stime", "lat", "lon")).over(w)
    rows = points.withColumn("_p", before)
    first = F.col("_p.stime").isNull()
    dist = haversine(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))
    return rows.withColumns({
        "time_value": F.when(~first, F.greatest(seconds_between(F.col("_p.stime"), F.col("stime")).cast("double"), F.lit(0.0))),
        "dist_value": F.when(~first, F.coalesce(dist, F.lit(0.0))),
    }).drop("_p")


NEXT = ("move_vp_id", "stime", "grid_id", "cid", "province", "city", "date")


def next_step(points: DataFrame, by: tuple = ("uid", "move_id", "date"), order: tuple = ("stime", "move_vp_id"), columns: tuple = NEXT, stable_id: bool = False) -> DataFrame:
    """Each point with next_* of the following one; a group's last point is dropped. trajectory_id is the 32-bit hash of the keys
    (it can collide and skips nulls), or with stable_id a 64-bit one in which nulls count."""
    nxt = F.lead(F.struct(*columns)).over(Window.partitionBy(*by).orderBy(*order))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by]
    ident = F.xxhash64(*keys) if stable_id else F.hash(*by)
    rows = points.withColumn("_n", nxt).where(F.col("_n").isNotNull())
    return rows.select(ident.alias("trajectory_id"), "*", *[F.col(f"_n.{c}").alias(f"next_{c}") for c in columns]).drop("_n")


def attach_both_ends(steps: DataFrame, dim: DataFrame) -> DataFrame:
    """lon, lat of cid and next_lon, next_lat of next_cid, by two left joins."""
    here = dim.select("cid", "lon", "lat")
    there = dim.select(F.col("cid").alias("next_cid"), F.col("lon").alias("next_lon"), F.col("lat").alias("next_lat"))
    return steps.join(here, "cid", "left").join(there, "next_cid", "left")


def step_features(steps: DataFrame) -> DataFrame:
    """time (seconds, bigint, may be negative) and distance (metres, null unless all coordinates are set) of each step."""
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    return steps.withColumns({
        "time": seconds_between(ts("stime"), ts("next_stime")),
        "distance": haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"), "asin_guarded"),
    })


def day_features(points: DataFrame, order: tuple = ("stime", "move_vp_id")) -> DataFrame:
    """index, time_diff and space_diff to the next point of a user's day, and trajectory_id uid_date."""
    w = Window.partitionBy("uid", "date").orderBy(*order)
    rows = points.withColumn("index", F.row_number().over(w).cast("long")).withColumn("_n", F.lead(F.struct("stime", "lat", "lon")).over(w))
    return rows.withColumns({
        "time_diff": seconds_between(F.col("stime"), F.col("_n.stime")),
        "space_diff": haversine(F.col("lat"), F.col("lon"), F.col("_n.lat"), F.col("_n.lon"), "asin"),
        "trajectory_id": F.concat(F.col("uid"), F.lit("_"), F.col("date").cast("string")),
    }).drop("_n")


def trajectory_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("trajectory_id").agg(F.sum("time_diff").alias("time_diff"), F.sum("space_diff").alias("space_diff"), F.count(F.lit(1)).alias("traj_count"))


def global_rank(rows: DataFrame, by: str, tie: str, name: str, ranges: int | None = None) -> DataFrame:
    """1-based rank by descending `by`, then `tie`, without one sort of all rows in one task: the rows are sorted in ranges of both
    (so equal values of `by` part, too) and stored with their place, and a range's first rank is the number of rows before it."""
    key = (F.col(by).desc(), F.col(tie))
    dealt = rows.repartitionByRange(ranges, *key) if ranges else rows.repartitionByRange(*key)
    in_order = dealt.sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(in_order.withColumn("_range", F.shiftright("_at", 33)), "ranked")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), "_range").withColumn(name, (F.col("_first") + within + 1).cast("long")).drop("_range", "_first", "_at")


def trajectory_rank(points: DataFrame, key: str = "trajectory_id", order: str = "move_vp_id") -> DataFrame:
    """Points with x and y, with their trajectory's distance from first to last point and its rank by descending distance."""
    base = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = base.groupBy(key).agg(F.min_by(F.struct("x", "y"), order).alias("a"), F.max_by(F.struct("x", "y"), order).alias("b"))
    dist = ends.select(key, euclid(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")).alias("distance"))
    return base.join(global_rank(dist, "distance", key, "traj_rank"), key)


def first_users(points: DataFrame, n: int) -> DataFrame:
    """Points of the n first users in order of uid."""
    return points.join(points.select("uid").distinct().orderBy("uid").limit(n), "uid", "left_semi")
