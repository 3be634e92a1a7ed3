"""Queries over the test tables, each with the SQL that an independent engine runs on the same tables.

Doubles are rounded to three places in both, as the last bits of trigonometric functions differ between engines."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import formulas as fm, geo
from ..operators import raster as ras, rollout as roll, sequence as seq, stats, trajectory as tr
from ..sources import fixtures as fx
from ..spec import DEFAULT_GRID, EARTH_RADIUS_M, ProjSpec

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r3(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 3) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


# --- tables as SQL -----------------------------------------------------------------------------------------------------
_MV = """mv AS (SELECT CAST(user_id AS VARCHAR) AS uid, CAST(hour(ts) // 6 AS INTEGER) AS move_id, event_id AS move_vp_id, ts AS stime,
  json_extract_string(props, '$.k') AS grid_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cid, 'P' || CAST(length(event_type) % 3 AS VARCHAR) AS province,
  event_type AS city, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date FROM events)"""
_CELL = """cell AS (SELECT c_custkey % 120 AS cid, 27.5::DOUBLE + (c_acctbal + 1000) / 1500 AS lat, 115 + c_nationkey * 0.3::DOUBLE AS lon, c_custkey AS date
  FROM customer WHERE c_custkey % 10 <> 7)"""
_LATEST = "latest AS (SELECT cid, lat, lon, date FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY date DESC) AS rn FROM cell) WHERE rn = 1)"
_PTS = "pts AS (SELECT mv.*, l.lat, l.lon FROM mv LEFT JOIN latest l USING (cid))"
_DAY = "day AS (SELECT *, row_number() OVER (PARTITION BY uid, date ORDER BY stime, move_vp_id) AS index FROM pts)"
_EPOCH = "CAST(epoch(date_trunc('second', {0})) AS BIGINT)"


def _hav(lat1, lon1, lat2, lon2):
    return f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"


_DETAIL = f"""multi AS (SELECT uid, date FROM day WHERE city IS NOT NULL GROUP BY uid, date HAVING count(DISTINCT city) > 1),
lagged AS (SELECT day.*, lag(stime) OVER w AS ps, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM day JOIN multi USING (uid, date) WINDOW w AS (PARTITION BY uid, date ORDER BY index, stime)),
detail AS (SELECT uid, index, stime, cid, lat, lon, city, province, date,
  CASE WHEN ps IS NOT NULL THEN greatest(CAST({_EPOCH.format('stime')} - {_EPOCH.format('ps')} AS DOUBLE), 0.0) END AS time_value,
  CASE WHEN ps IS NOT NULL THEN coalesce({EARTH_RADIUS_M} * 2 * atan2(sqrt(a), sqrt(1 - a)), 0.0) END AS dist_value
  FROM (SELECT *, {_hav('plat', 'plon', 'lat', 'lon')} AS a FROM lagged)),
metrics AS (SELECT uid, date, sum(coalesce(time_value, 0)) AS time, sum(coalesce(dist_value, 0)) AS distance, count(*) AS cnt FROM detail GROUP BY uid, date)"""
_ALL = f"WITH {_MV}, {_CELL}, {_LATEST}, {_PTS}, {_DAY}, {_DETAIL}"
_STEPS = """steps AS (SELECT * FROM (SELECT mv.*, lead(move_vp_id) OVER w AS next_move_vp_id, lead(stime) OVER w AS next_stime, lead(grid_id) OVER w AS next_grid_id, lead(cid) OVER w AS next_cid,
  lead(province) OVER w AS next_province, lead(city) OVER w AS next_city, lead(date) OVER w AS next_date FROM mv
  WINDOW w AS (PARTITION BY uid, move_id, date ORDER BY stime, move_vp_id)) WHERE next_move_vp_id IS NOT NULL)"""
_TRIPS = f"""trips AS (SELECT *, CAST(abs(locx_o - locx_d) + abs(locy_o - locy_d) AS DOUBLE) AS distance FROM (SELECT move_vp_id AS id, CAST(cid % 50 AS INTEGER) AS locx_o, CAST(cid * 7 % 40 AS INTEGER) AS locy_o,
  CAST(next_cid % 50 AS INTEGER) AS locx_d, CAST(next_cid * 7 % 40 AS INTEGER) AS locy_d, ({_EPOCH.format('next_stime')} - {_EPOCH.format('stime')}) / 60.0 AS time FROM steps))"""
_RASTER = """raster AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS x, CAST(p_partkey // 50 AS INTEGER) AS y, p_size * 3 AS code FROM part),
layer AS (SELECT x, y, CAST((code & 36) <> 0 AS INTEGER) AS GSD, CAST((code & 8) <> 0 AS INTEGER) AS GG, CAST((code & 67) <> 0 AS INTEGER) AS TS, CAST((code & 3) <> 0 AS INTEGER) AS TG
  FROM raster WHERE x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 39)"""
_RAWPATHS = f"""ev AS (SELECT user_id, ts, event_id, CASE WHEN k % 10 = 0 THEN -1 ELSE k END AS rn_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
raw AS (SELECT user_id AS moi_id, row_number() OVER w - 1 AS rn_seq, rn_id, coalesce(lead(rn_id) OVER w, -1) AS next_rn_id, {_EPOCH.format('ts')} AS time, event_id AS row_id,
  CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day FROM ev WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))"""
_SPLIT = """p0 AS (SELECT moi_id * 100000000 + day AS path_id, rn_seq AS path_sequence, rn_id, next_rn_id, time FROM raw),
p1 AS (SELECT *, lead(time) OVER (PARTITION BY path_id ORDER BY path_sequence) - time AS time_diff FROM p0 WHERE NOT (rn_id = -1 AND next_rn_id = -1)),
p2 AS (SELECT *, sum(CAST(rn_id = -1 AS BIGINT)) OVER (PARTITION BY path_id ORDER BY path_sequence) AS part FROM p1 WHERE next_rn_id <> -1 AND time_diff IS NOT NULL),
split AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY path_id, part ORDER BY path_sequence) - 1 AS rn_seq, count(*) OVER (PARTITION BY path_id, part) AS n FROM p2 WHERE rn_id <> -1) WHERE n >= 2)"""
_SEGMENTS = """legs AS (SELECT path_id * 100 + part AS path_id, rn_seq, rn_id, next_rn_id, rn_id % 50 AS loc_x, rn_id * 7 % 40 AS loc_y, next_rn_id % 50 AS next_loc_x, next_rn_id * 7 % 40 AS next_loc_y,
  CAST(time_diff AS DOUBLE) / 50 AS time_diff, CAST(abs(rn_id - next_rn_id) AS DOUBLE) AS distance FROM split),
walk AS (SELECT path_id, rn_seq, time_diff AS t, distance AS d, rn_seq AS first FROM legs WHERE rn_seq = 0
  UNION ALL SELECT l.path_id, l.rn_seq, CASE WHEN w.t > 1000 THEN l.time_diff ELSE w.t + l.time_diff END, CASE WHEN w.t > 1000 THEN l.distance ELSE w.d + l.distance END, CASE WHEN w.t > 1000 THEN l.rn_seq ELSE w.first END
  FROM walk w JOIN legs l ON l.path_id = w.path_id AND l.rn_seq = w.rn_seq + 1),
segs AS (SELECT l.path_id, l.rn_seq, s.time_diff, s.distance, l.rn_id, l.next_rn_id, l.loc_x, l.loc_y, l.next_loc_x, l.next_loc_y
  FROM (SELECT path_id, first, max_by(t, rn_seq) AS time_diff, max_by(d, rn_seq) AS distance FROM walk GROUP BY path_id, first) s JOIN legs l ON l.path_id = s.path_id AND l.rn_seq = s.first)"""


# --- inputs ------------------------------------------------------------------------------------------------------------
def _latest(spark, d):
    return tr.dedupe_latest(fx.cells(spark, d), "cid", "date")


def _points(spark, d):
    return tr.enrich(fx.points(spark, d), _latest(spark, d))


def _day(spark, d):
    return tr.index_points(_points(spark, d), ("uid", "date"), ("stime",), ("move_vp_id",))


def _detail(spark, d):
    rows = tr.multicity(tr.standardise(_day(spark, d)), ("uid", "date"))
    return tr.previous_deltas(rows, ("uid", "date")).select("uid", "index", "stime", "cid", "lat", "lon", "city", "province", "date", "time_value", "dist_value")


def _steps(spark, d):
    return tr.next_step(fx.points(spark, d))


def _trips(spark, d):
    return fx.trips(_steps(spark, d))


def _layers(spark, d):
    return ras.grid_layers(fx.raster(spark, d), fx.GRID)


# --- trajectories ------------------------------------------------------------------------------------------------------
@query(f"WITH {_CELL}, {_LATEST} SELECT cid, round(lat, 3) AS lat, round(lon, 3) AS lon, date FROM latest")
def cell_latest(spark, d):
    return r3(_latest(spark, d))


@query(f"WITH {_MV}, {_CELL}, {_LATEST}, {_PTS} SELECT move_vp_id, uid, cid, round(lat, 3) AS lat, round(lon, 3) AS lon FROM pts")
def point_enrich(spark, d):
    return r3(_points(spark, d).select("move_vp_id", "uid", "cid", "lat", "lon"))


@query(f"WITH {_MV}, {_CELL} SELECT cid, count(*) AS n_rows, count(lat) AS n_matched, CAST(sum(CAST(round(lat, 4) AS DECIMAL(18, 4))) AS DOUBLE) AS lat_sum FROM mv LEFT JOIN cell USING (cid) GROUP BY cid")
def point_fanout(spark, d):
    return tr.fanout_stats(fx.points(spark, d), fx.cells(spark, d))


@query(f"WITH {_MV}, {_CELL}, {_LATEST}, {_PTS} SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY stime, move_vp_id) AS index, move_vp_id, cid, province, city, date FROM pts WHERE date = 20240105")
def day_points(spark, d):
    return tr.index_points(tr.on_date(_points(spark, d), 20240105), tie=("move_vp_id",)).select("uid", "index", "move_vp_id", "cid", "province", "city", "date")


@query(f"WITH {_MV} SELECT uid, date, count(DISTINCT city) AS city_cnt FROM mv WHERE city IS NOT NULL GROUP BY uid, date HAVING count(DISTINCT city) > 1")
def multicity_users(spark, d):
    return tr.city_counts(fx.points(spark, d), ("uid", "date")).where("city_cnt > 1")


@query(_ALL + " SELECT uid, index, cid, round(lat, 3) AS lat, round(lon, 3) AS lon, city, province, date, round(time_value, 3) AS time_value, round(dist_value, 3) AS dist_value FROM detail")
def multicity_detail(spark, d):
    return r3(_detail(spark, d).drop("stime"))


@query(_ALL + " SELECT uid, date, round(time, 3) AS time, round(distance, 3) AS distance, cnt FROM metrics")
def uid_metrics(spark, d):
    return r3(stats.uid_metrics(_detail(spark, d), ("uid", "date")))


@query(_ALL + """, wide AS (SELECT CAST(date AS VARCHAR) AS stat_date, 'time' AS metric, max(time) AS mx, min(time) AS mn, avg(time) AS av, quantile_disc(time, 0.5) AS md FROM metrics GROUP BY date
 UNION ALL SELECT CAST(date AS VARCHAR), 'distance', max(distance), min(distance), avg(distance), quantile_disc(distance, 0.5) FROM metrics GROUP BY date
 UNION ALL SELECT CAST(date AS VARCHAR), 'count', max(cnt), min(cnt), avg(cnt), quantile_disc(cnt, 0.5) FROM metrics GROUP BY date)
 SELECT stat_date, metric, round(CAST(mx AS DOUBLE), 3) AS max_value, round(CAST(mn AS DOUBLE), 3) AS min_value, round(av, 3) AS avg_value, round(CAST(md AS DOUBLE), 3) AS median_value FROM wide""")
def day_stats(spark, d):
    return r3(stats.in_report_order(stats.day_stats(stats.uid_metrics(_detail(spark, d), ("uid", "date")))))


@query(f"WITH {_MV}, {_STEPS} SELECT move_vp_id, uid, move_id, grid_id, cid, date, next_move_vp_id, next_grid_id, next_cid, next_province, next_city, next_date FROM steps")
def next_step(spark, d):
    return _steps(spark, d).select("move_vp_id", "uid", "move_id", "grid_id", "cid", "date", "next_move_vp_id", "next_grid_id", "next_cid", "next_province", "next_city", "next_date")


@query(f"""WITH {_MV}, {_CELL}, {_LATEST}, {_STEPS} SELECT move_vp_id, round(a.lon, 3) AS lon, round(a.lat, 3) AS lat, round(b.lon, 3) AS next_lon, round(b.lat, 3) AS next_lat,
 {_EPOCH.format('next_stime')} - {_EPOCH.format('stime')} AS time,
 round(CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN 2 * {EARTH_RADIUS_M} * asin(least(1.0, sqrt({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}))) END, 3) AS distance
 FROM steps LEFT JOIN latest a ON steps.cid = a.cid LEFT JOIN latest b ON steps.next_cid = b.cid""")
def od_enrich(spark, d):
    return r3(tr.step_features(tr.attach_both_ends(_steps(spark, d), _latest(spark, d))).select("move_vp_id", "lon", "lat", "next_lon", "next_lat", "time", "distance"))


_FEATURES = f"""features AS (SELECT uid || '_' || CAST(date AS VARCHAR) AS trajectory_id, uid, index, move_vp_id, {_EPOCH.format('ns')} - {_EPOCH.format('stime')} AS time_diff,
 2 * {EARTH_RADIUS_M} * asin(sqrt({_hav('lat', 'lon', 'nlat', 'nlon')})) AS space_diff
 FROM (SELECT *, lead(stime) OVER w AS ns, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM day WINDOW w AS (PARTITION BY uid, date ORDER BY stime, move_vp_id)))"""


@query(f"WITH {_MV}, {_CELL}, {_LATEST}, {_PTS}, {_DAY}, {_FEATURES} SELECT trajectory_id, uid, index, move_vp_id, time_diff, round(space_diff, 3) AS space_diff FROM features")
def day_features(spark, d):
    return r3(tr.day_features(_points(spark, d)).select("trajectory_id", "uid", "index", "move_vp_id", "time_diff", "space_diff"))


@query(f"WITH {_MV}, {_CELL}, {_LATEST}, {_PTS}, {_DAY}, {_FEATURES} SELECT trajectory_id, CAST(sum(time_diff) AS BIGINT) AS time_diff, round(sum(space_diff), 3) AS space_diff, count(*) AS traj_count FROM features GROUP BY trajectory_id")
def traj_summary(spark, d):
    return r3(tr.trajectory_summary(tr.day_features(_points(spark, d))))


@query(f"WITH {_MV}, c AS (SELECT uid, count(DISTINCT city) AS city_cnt FROM mv GROUP BY uid HAVING count(DISTINCT city) > 1) SELECT uid, city_cnt, count(*) AS n_points FROM mv JOIN c USING (uid) GROUP BY uid, city_cnt")
def cross_city_counts(spark, d):
    p = fx.points(spark, d)
    kept = tr.multicity(p).groupBy("uid").agg(F.count(F.lit(1)).alias("n_points"))
    return tr.city_counts(p).where("city_cnt > 1").join(kept, "uid").select("uid", "city_cnt", "n_points")


@query(f"""WITH {_MV}, b AS (SELECT uid || '_' || CAST(date AS VARCHAR) AS trajectory_id, move_vp_id, cid % 50 AS x, cid * 7 % 40 AS y FROM mv),
 e AS (SELECT trajectory_id, min_by(x, move_vp_id) AS ax, min_by(y, move_vp_id) AS ay, max_by(x, move_vp_id) AS bx, max_by(y, move_vp_id) AS by_ FROM b GROUP BY trajectory_id),
 q AS (SELECT trajectory_id, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS distance FROM e), o AS (SELECT *, row_number() OVER (ORDER BY distance DESC, trajectory_id) AS traj_rank FROM q)
 SELECT trajectory_id, move_vp_id, round(distance, 3) AS distance, traj_rank FROM b JOIN o USING (trajectory_id)""")
def traj_rank(spark, d):
    p = fx.points(spark, d).select(F.concat("uid", F.lit("_"), F.col("date").cast("string")).alias("trajectory_id"), "move_vp_id", (F.col("cid") % 50).alias("x"), (F.col("cid") * 7 % 40).alias("y"))
    return r3(tr.trajectory_rank(p).select("trajectory_id", "move_vp_id", "distance", "traj_rank"))


@query(f"WITH {_MV} SELECT uid, move_vp_id, cid FROM mv WHERE uid IN (SELECT DISTINCT uid FROM mv ORDER BY uid LIMIT 20)")
def topn_uid_points(spark, d):
    return tr.first_users(fx.points(spark, d), 20).select("uid", "move_vp_id", "cid")


@query(f"WITH {_MV} SELECT DISTINCT date FROM mv WHERE regexp_matches(CAST(date AS VARCHAR), '^[0-9]{{8}}$') ORDER BY date DESC LIMIT 14")
def latest_dates(spark, d):
    return fx.points(spark, d).select("date").where(F.col("date").cast("string").rlike(r"^\d{8}$")).distinct().orderBy(F.desc("date")).limit(14)


# --- geometry ----------------------------------------------------------------------------------------------------------
def _gk_sql() -> str:
    p = ProjSpec()
    radius, e, alpha, _ = geo._series(p)
    east = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)])
    north = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)])
    return f"""g0 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - {p.lon0!r}) AS dl FROM latest),
g1 AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM g0),
gk AS (SELECT cid, lon, lat, {p.false_easting!r} + {radius!r} * ({east}) AS x, {radius!r} * ({north}) AS y FROM g1)"""


_GK = f"WITH {_CELL}, {_LATEST}, {_gk_sql()} "


def _projected(spark, d):
    return _latest(spark, d).withColumn("p", geo.gk_forward(F.col("lon"), F.col("lat"))).select("cid", "lon", "lat", "p.x", "p.y")


@query(_GK + "SELECT cid, round(x, 3) AS x, round(y, 3) AS y FROM gk")
def gk_project(spark, d):
    return r3(_projected(spark, d).select("cid", "x", "y"))


@query(f"WITH {_CELL}, {_LATEST} SELECT cid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM latest")
def gk_inverse(spark, d):
    back = _projected(spark, d).withColumn("b", geo.gk_inverse(F.col("x"), F.col("y")))
    return back.select("cid", F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


def _cell_sql(cond_x: str, cond_y: str) -> str:
    g = DEFAULT_GRID
    one = lambda v, low, cond: f"CASE WHEN {cond} THEN CAST(floor(({v} - {low!r}) / {g.size!r}) AS INTEGER) END"
    return _GK + f"SELECT cid, {one('x', g.x_min, cond_x)} AS loc_x, {one('y', g.y_min, cond_y)} AS loc_y FROM gk"


_IN_X, _IN_Y = f"x BETWEEN {DEFAULT_GRID.x_min!r} AND {DEFAULT_GRID.x_max!r}", f"y BETWEEN {DEFAULT_GRID.y_min!r} AND {DEFAULT_GRID.y_max!r}"


def _cells(spark, d, bounds):
    return _projected(spark, d).withColumn("c", geo.grid_cell(F.col("x"), F.col("y"), DEFAULT_GRID, bounds)).select("cid", "c.loc_x", "c.loc_y")


@query(_cell_sql(_IN_X, _IN_Y))
def grid_closed(spark, d):
    return _cells(spark, d, "closed")


@query(_cell_sql(f"{_IN_X} AND {_IN_Y}", f"{_IN_X} AND {_IN_Y}"))
def grid_joint(spark, d):
    return _cells(spark, d, "joint")


@query(_cell_sql(f"x >= {DEFAULT_GRID.x_min!r} AND x < {DEFAULT_GRID.x_max!r}", f"y >= {DEFAULT_GRID.y_min!r} AND y < {DEFAULT_GRID.y_max!r}"))
def grid_halfopen(spark, d):
    return _cells(spark, d, "half_open")


# --- distribution ------------------------------------------------------------------------------------------------------
_VALUES = """v0 AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND value <> 0), bound AS (SELECT quantile_disc(v, 0.99) AS b FROM v0), v1 AS (SELECT v FROM v0, bound WHERE v <= b)"""


def _values(spark, d):
    values, counts = stats.numeric(fx.table(spark, d, "events").select(F.col("value").cast("string").alias("value")), "value")
    return stats.trim(values), counts


@query(f"WITH {_VALUES} SELECT count(*) AS n, round(max(v), 3) AS top FROM v1")
def trim_values(spark, d):
    return r3(_values(spark, d)[0].agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")))


@query(f"""WITH {_VALUES}, s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM v1), c AS (SELECT CAST(least(floor((v - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM v1, s GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 3) AS bin_left, round(CASE WHEN i = 49 THEN hi ELSE lo + (i + 1) * w END, 3) AS bin_right, coalesce(n, 0) AS frequency
 FROM (SELECT unnest(range(0, 50)) AS i) b CROSS JOIN s LEFT JOIN c ON c.bin = b.i""")
def hist_bins(spark, d):
    return r3(stats.histogram(_values(spark, d)[0]))


@query(f"""WITH {_VALUES}, a AS (SELECT count(*) AS c, min(v) AS mn, max(v) AS mx, avg(v) AS av, median(v) AS md FROM v1), z AS (SELECT count(*) AS z FROM events WHERE value = 0)
 SELECT 'count' AS metric, round(CAST(c AS DOUBLE), 3) AS value FROM a UNION ALL SELECT 'min', round(mn, 3) FROM a UNION ALL SELECT 'max', round(mx, 3) FROM a UNION ALL SELECT 'mean', round(av, 3) FROM a
 UNION ALL SELECT 'median', round(md, 3) FROM a UNION ALL SELECT 'skipped_zero', CAST(z AS DOUBLE) FROM z UNION ALL SELECT 'skipped_invalid', 0.0""")
def value_summary(spark, d):
    return r3(stats.summary(*_values(spark, d)))


# --- sequences ---------------------------------------------------------------------------------------------------------
def _split(spark, d):
    raw = fx.raw_paths(spark, d)
    paths = raw.select((F.col("moi_id") * 100000000 + F.col("day")).alias("path_id"), F.col("rn_seq").alias("path_sequence"), "rn_id", "next_rn_id", "time")
    return seq.split_paths(paths)


@query(f"WITH {_RAWPATHS}, {_SPLIT} SELECT path_id, path_sequence, CAST(part AS BIGINT) AS part, rn_seq, rn_id, next_rn_id, time, time_diff FROM split")
def split_paths(spark, d):
    return _split(spark, d).select("path_id", "path_sequence", "part", "rn_seq", "rn_id", "next_rn_id", "time", "time_diff")


def _legs(spark, d):
    s = _split(spark, d).withColumn("path_id", F.col("path_id") * 100 + F.col("part"))
    return s.select("path_id", "rn_seq", "rn_id", "next_rn_id", (F.col("rn_id") % 50).alias("loc_x"), (F.col("rn_id") * 7 % 40).alias("loc_y"), (F.col("next_rn_id") % 50).alias("next_loc_x"), (F.col("next_rn_id") * 7 % 40).alias("next_loc_y"),
                    (F.col("time_diff").cast("double") / 50).alias("time_diff"), F.abs(F.col("rn_id") - F.col("next_rn_id")).cast("double").alias("distance"))


@query(f"WITH RECURSIVE {_RAWPATHS}, {_SPLIT}, {_SEGMENTS} SELECT path_id, rn_seq, rn_id, round(time_diff, 3) AS time_diff, round(distance, 3) AS distance FROM segs")
def resample(spark, d):
    return r3(seq.resample(_legs(spark, d)).select("path_id", "rn_seq", "rn_id", "time_diff", "distance"))


@query(f"""WITH RECURSIVE {_RAWPATHS}, {_SPLIT}, {_SEGMENTS} SELECT path_id, rn_seq, rn_id, coalesce(lead(rn_id) OVER w, next_rn_id) AS next_rn_id, coalesce(lead(loc_x) OVER w, next_loc_x) AS next_loc_x,
 coalesce(lead(loc_y) OVER w, next_loc_y) AS next_loc_y, round(CASE WHEN time_diff > 0 THEN distance / time_diff ELSE 0 END, 3) AS velocity FROM segs WINDOW w AS (PARTITION BY path_id ORDER BY rn_seq)""")
def restitch(spark, d):
    return r3(seq.restitch(seq.resample(_legs(spark, d))).select("path_id", "rn_seq", "rn_id", "next_rn_id", "next_loc_x", "next_loc_y", "velocity"))


@query()
def rebuild_paths(spark, d):
    return seq.number_paths(seq.rebuild_paths(fx.raw_paths(spark, d))).select("path_id", "path_sequence", "moi_id", "row_id", "rn_id", "next_rn_id", "time")


@query(f"WITH {_MV}, o AS (SELECT uid, move_vp_id, city, row_number() OVER (PARTITION BY uid ORDER BY move_vp_id) - row_number() OVER (PARTITION BY uid, city ORDER BY move_vp_id) AS g FROM mv) SELECT uid, city, min(move_vp_id) AS first_order, count(*) AS n_rows FROM o GROUP BY uid, city, g")
def city_runs(spark, d):
    return seq.run_lengths(fx.points(spark, d), "city", "move_vp_id", ("uid",)).select("uid", "city", "first_order", "n_rows")


# --- raster, scores, rollouts ------------------------------------------------------------------------------------------
@query(f"WITH {_RASTER} SELECT x, y, GSD, GG, TS, TG FROM layer")
def layers(spark, d):
    return _layers(spark, d)


@query(f"WITH {_RASTER} SELECT x, y, (code & 2) <> 0 AS allow_tg, (code & 8) <> 0 AS allow_gg, (code & 36) <> 0 AS allow_gsd, (code & 66) <> 0 AS allow_ts FROM raster")
def permissions(spark, d):
    return fx.raster(spark, d).select("x", "y", *[ras.permitted(F.col("code"), m).alias(f"allow_{m.lower()}") for m in ("TG", "GG", "GSD", "TS")])


def _around(offsets: str) -> str:
    return f"""WITH {_MV}, {_STEPS}, {_TRIPS}, {_RASTER}, o AS ({offsets}), n AS (SELECT t.id, o.k, coalesce(l.TG, 0) AS v FROM trips t CROSS JOIN o LEFT JOIN layer l ON l.x = t.locx_o + o.dx AND l.y = t.locy_o + o.dy)
 SELECT id, string_agg(CAST(v AS VARCHAR), '' ORDER BY k) AS bits FROM n GROUP BY id"""


def _bits(spark, d, offsets):
    read = ras.neighbours(_trips(spark, d), _layers(spark, d), ("TG",), offsets, "locx_o", "locy_o")
    return read.select("id", F.array_join(F.transform("TG", lambda v: v.cast("string")), "").alias("bits"))


@query(_around("SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) v(k, dx, dy)"))
def neighbors8(spark, d):
    return _bits(spark, d, ras.OFFSETS_8)


@query(_around("SELECT k, k // 5 - 2 AS dx, k % 5 - 2 AS dy FROM (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS k)"))
def neighbors25(spark, d):
    return _bits(spark, d, ras.OFFSETS_25)


_SUPPORT = """sup AS (SELECT id, CAST(sum(coalesce(GSD, 0)) AS BIGINT) AS GSD, CAST(sum(coalesce(GG, 0)) AS BIGINT) AS GG, CAST(sum(coalesce(TS, 0)) AS BIGINT) AS TS, CAST(sum(coalesce(TG, 0)) AS BIGINT) AS TG FROM
 (SELECT id, locx_o AS x, locy_o AS y FROM trips UNION ALL SELECT id, locx_d, locy_d FROM trips) e CROSS JOIN (SELECT * FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) v(dx, dy)) o
 LEFT JOIN layer l ON l.x = e.x + o.dx AND l.y = e.y + o.dy GROUP BY id)"""


@query(f"WITH {_MV}, {_STEPS}, {_TRIPS}, {_RASTER}, {_SUPPORT} SELECT * FROM sup")
def support(spark, d):
    return ras.support(_trips(spark, d), _layers(spark, d))


@query(f"WITH {_MV}, {_STEPS}, {_TRIPS}, {_RASTER}, {_SUPPORT} SELECT id, round(distance / (time + 0.001), 3) AS speed, CAST(GSD AS DOUBLE) AS s_gsd, CAST(TG AS DOUBLE) AS s_tg FROM sup JOIN trips USING (id)")
def upper_state(spark, d):
    t = _trips(spark, d)
    state = fm.upper_state(F.col("distance"), F.col("time"), [F.col(m) for m in ("GSD", "GG", "TS", "TG")])
    rows = t.join(ras.support(t, _layers(spark, d)), "id").select("id", state.alias("s"))
    return r3(rows.select("id", F.col("s")[0].alias("speed"), F.col("s")[1].alias("s_gsd"), F.col("s")[4].alias("s_tg")))


_PATHCELLS = "cells AS (SELECT uid || '_' || CAST(date AS VARCHAR) AS id, move_vp_id AS seq, CAST(cid % 50 AS INTEGER) AS x, CAST(cid * 7 % 40 AS INTEGER) AS y FROM mv)"
_MATCH = f"""m0 AS (SELECT *, min(seq) OVER (PARTITION BY id) AS f FROM cells), match AS (SELECT id, count(*) FILTER (WHERE coalesce(TG, 0) = 1) AS matched, count(*) AS total FROM m0 LEFT JOIN layer USING (x, y) WHERE seq > f GROUP BY id)"""
_TIME = """tt0 AS (SELECT *, coalesce(lag(x) OVER w, last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px, coalesce(lag(y) OVER w, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py FROM cells WINDOW w AS (PARTITION BY id ORDER BY seq)),
 tt AS (SELECT id, sum(sqrt(pow(x - px, 2) + pow(y - py, 2)) / (200 / 60.0)) AS minutes FROM tt0 GROUP BY id)"""


def _pathcells(spark, d):
    return fx.points(spark, d).select(F.concat("uid", F.lit("_"), F.col("date").cast("string")).alias("id"), F.col("move_vp_id").alias("seq"), (F.col("cid") % 50).cast("int").alias("x"), (F.col("cid") * 7 % 40).cast("int").alias("y"))


def _match(spark, d):
    return ras.match_rate(_pathcells(spark, d), _layers(spark, d), "TG", fx.GRID.n_col, fx.GRID.n_row)


def _minutes(spark, d):
    return ras.travel_time(_pathcells(spark, d), F.lit(fx.SPEEDS["TG"][0] / 60.0))


@query(f"WITH {_MV}, {_RASTER}, {_PATHCELLS}, {_MATCH} SELECT id, matched, total, round(matched / (total + 0.0001), 3) AS rate FROM match")
def match_rate(spark, d):
    return r3(_match(spark, d))


@query(f"WITH {_MV}, {_PATHCELLS}, {_TIME} SELECT id, round(minutes, 3) AS minutes FROM tt")
def travel_time(spark, d):
    return r3(_minutes(spark, d))


_SCORED = f"""WITH {_MV}, {_RASTER}, {_PATHCELLS}, {_MATCH}, {_TIME}, scored AS (SELECT id, matched, total, matched / (total + 0.0001) AS rate, minutes, CAST(total AS DOUBLE) * 10 AS t_upper, minutes * 2 / (CAST(total AS DOUBLE) * 10 + 0.001) AS v FROM match JOIN tt USING (id)) """


def _scored(spark, d):
    rows = _match(spark, d).join(_minutes(spark, d), "id").withColumn("t_upper", F.col("total").cast("double") * 10)
    return rows.withColumn("v", fm.true_speed(F.col("minutes") * 2, F.col("t_upper")))


@query(_SCORED + "SELECT id, round((rate - 1) * abs(minutes - t_upper), 3) AS reward FROM scored")
def reward_base(spark, d):
    return r3(_scored(spark, d).select("id", fm.reward_base(F.col("rate"), F.col("minutes"), F.col("t_upper")).alias("reward")))


@query(_SCORED + "SELECT id, round(rate / abs(200 / 60.0 - v), 3) AS reward FROM scored")
def reward_velocity(spark, d):
    return r3(_scored(spark, d).select("id", fm.reward_velocity(F.col("rate"), F.lit(200 / 60.0), F.col("v")).alias("reward")))


@query(_SCORED + "SELECT id, round(rate / abs(v * 60 - 200) * 50, 3) AS reward, round(-abs((v * 60 - 200) / 50) * (1 - matched / (total + 0.1)), 3) AS penalty FROM scored")
def reward_zscore(spark, d):
    z = fm.z_score(F.col("v") * 60, F.lit(200.0), F.lit(50.0))
    return r3(_scored(spark, d).select("id", fm.reward_zscore(F.col("rate"), F.col("v"), F.lit(200.0), F.lit(50.0)).alias("reward"), fm.reward_penalty(z, F.col("matched"), F.col("total")).alias("penalty")))


@query(_SCORED + f"SELECT id, round(1000 * rate * exp(-0.5 * pow((v * 60 - 200) / 50, 2)) / CAST({50 * math.sqrt(2 * math.pi)!r} AS DOUBLE), 3) AS reward FROM scored")
def reward_pdf(spark, d):
    return r3(_scored(spark, d).select("id", (1000 * fm.reward_pdf(F.col("rate"), F.col("v"), F.lit(200.0), F.lit(50.0))).alias("reward")))


@query(_SCORED + "SELECT id, (SELECT m FROM (VALUES ('GSD', 60, 0), ('GG', 80, 1), ('TG', 200, 2), ('TS', 40, 3)) t(m, mean, k) ORDER BY abs(total % 25 * 17 - mean), k LIMIT 1) AS mode FROM scored")
def nearest_mode(spark, d):
    means = {m: mean for m, (mean, _) in fx.SPEEDS.items()}
    return _scored(spark, d).select("id", fm.nearest_mode((F.col("total") % 25 * 17).cast("double"), means).alias("mode"))


@query(f"""WITH {_MV}, {_PATHCELLS}, q AS (SELECT id, seq, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(x, 2) OVER w AS ox, lag(y, 2) OVER w AS oy FROM cells WINDOW w AS (PARTITION BY id ORDER BY seq))
 SELECT seq, round(((x - px) * (x - ox) + (y - py) * (y - oy)) / (sqrt((pow(x - px, 2) + pow(y - py, 2)) * (pow(x - ox, 2) + pow(y - oy, 2))) + 1), 3) AS turn FROM q""")
def turn_cosine(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("seq")
    rows = _pathcells(spark, d).withColumns({"p": F.lag(F.struct("x", "y")).over(w), "o": F.lag(F.struct("x", "y"), 2).over(w)})
    diff = lambda a: (F.col("x") - F.col(f"{a}.x"), F.col("y") - F.col(f"{a}.y"))
    return r3(rows.select("seq", fm.turn_cosine(*diff("p"), *diff("o")).cast("double").alias("turn")))


def _episodes(spark, d, **options):
    t = _trips(spark, d).select("id", F.col("locx_o").alias("loc_x"), F.col("locy_o").alias("loc_y"), F.col("locx_d").alias("next_loc_x"), F.col("locy_d").alias("next_loc_y"))
    return roll.rollout(t, _layers(spark, d), fx.GRID.n_col, fx.GRID.n_row, **options)


@query()
def rollout_greedy(spark, d):
    return r3(_episodes(spark, d))


@query()
def rollout_normalised(spark, d):
    return r3(_episodes(spark, d, hold=0.0, normalised=True))


@query()
def rollout_rates(spark, d):
    return r3(roll.rollout_summary(_episodes(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import extra  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extra  # noqa: F401

    return dict(_SQL)
