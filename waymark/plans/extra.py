"""More queries with their SQL: sources and sinks (written to the shared folder and read back), reports, rollouts."""

from __future__ import annotations

import pickle
import uuid

from pyspark.sql import Window, functions as F

from ..functions import geo
from ..operators import raster as ras, rollout as roll, sequence as seq, stats, trajectory as tr
from ..sources import files, fixtures as fx, tables as tb
from ..sources.shared import shared_folder
from ..spec import DEFAULT_GRID
from . import catalog as c
from .catalog import query, r3


def _place(spark) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _table(spark) -> str:
    return f"waymark_{uuid.uuid4().hex}"


_CELLS = f"WITH {c._CELL}, {c._LATEST} "

# --- sources and sinks -------------------------------------------------------------------------------------------------


@query(_CELLS + "SELECT cid, round(lat, 3) AS lat, round(lon, 3) AS lon FROM latest")
def table_in_database(spark, d):
    before, name, db = spark.catalog.currentDatabase(), _table(spark), _table(spark)
    tb.use_database(spark, db, _place(spark))
    try:
        tb.overwrite(c._latest(spark, d), name)
        rows = tb.load(spark, f"{db}.{name}")
    finally:
        tb.use_database(spark, before)
    return r3(rows.select("cid", "lat", "lon"))


@query(_CELLS + "SELECT cid, round(lat, 3) AS lat FROM latest WHERE date > 100")
def table_by_sql(spark, d):
    c._latest(spark, d).createOrReplaceTempView(name := _table(spark))
    return r3(tb.select_from(spark, name, "SELECT cid, lat FROM IDENTIFIER(:t) WHERE date > :low", low=100))


@query(_CELLS + "SELECT cid, date FROM latest")
def table_overwritten(spark, d):
    path = _place(spark)
    tb.overwrite(fx.cells(spark, d).select("cid", "date"), path)
    tb.overwrite(c._latest(spark, d).select("cid", "date"), path)
    return tb.load(spark, path)


@query(f"WITH {c._MV}, d AS (SELECT DISTINCT date FROM mv ORDER BY date DESC LIMIT 3) SELECT 'points_' || CAST(date AS VARCHAR) AS shard, uid, count(*) AS n FROM mv WHERE date IN (SELECT date FROM d) GROUP BY date, uid")
def shard_family(spark, d):
    points = fx.points(spark, d)
    dates = [r["date"] for r in points.select("date").distinct().orderBy(F.desc("date")).limit(4).collect()]
    family = f"fam{uuid.uuid4().hex}"
    tb.write_shards(points.select("uid", "date"), family, dates, _place(spark))
    out = None
    for name in tb.latest_shards(spark, family, 3):
        rows = tb.load(spark, tb.resolve_shard(spark, family, name[-8:])).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(F.lit(tb.renamed_shard(name, family, "points")).alias("shard"), "uid", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {c._MV}, w AS (SELECT date, count(*) AS n FROM mv GROUP BY date) SELECT date, n, CAST((SELECT sum(n) FROM w) AS BIGINT) AS written FROM w")
def written_by_date(spark, d):
    path = _place(spark)
    seen = tb.write_by_date(fx.points(spark, d).select("uid", "date"), path)
    counts = tb.load(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("written", F.lit(seen.get["rows"]).cast("long"))


@query(f"WITH {c._MV} SELECT uid, date, count(*) AS n FROM mv GROUP BY uid, date")
def table_sorted(spark, d):
    path = _place(spark)
    tb.write_sorted(fx.points(spark, d).groupBy("uid", "date").agg(F.count(F.lit(1)).alias("n")), path, ("date", "uid"))
    return tb.load(spark, path)


_ASKED = ("20240101", "20240102", "20231231")


@query(f"WITH {c._MV} SELECT '20231231' AS missing, date, count(*) AS n FROM mv WHERE date IN (20240101, 20240102) GROUP BY date")
def batch_of_dates(spark, d):
    rows, failed = tb.each_date(fx.points(spark, d), list(_ASKED), lambda p: p.groupBy("date").agg(F.count(F.lit(1)).alias("n")))
    return rows.select(F.lit(",".join(failed)).alias("missing"), "date", "n")


@query(f"WITH {c._MV} SELECT a AS stat_date FROM (VALUES ('20240101'), ('20240102'), ('20231231')) v(a) WHERE a NOT IN (SELECT CAST(date AS VARCHAR) FROM mv)")
def dates_without_rows(spark, d):
    return tb.missing_dates(fx.points(spark, d), list(_ASKED))


@query(f"WITH {c._MV} SELECT move_vp_id, uid, cid FROM mv WHERE FALSE")
def points_of_no_user(spark, d):
    return tb.empty(spark, "move_vp_id long, uid string, cid long")


@query(f"WITH {c._MV} SELECT CAST(uid AS INTEGER) AS uid, CAST(cid AS INTEGER) AS cid, city, count(*) AS n FROM mv GROUP BY uid, cid, city")
def csv_inferred(spark, d):
    path = _place(spark)
    tb.write_csv(fx.points(spark, d).select("uid", "cid", "city"), path)
    rows = tb.read_csv(spark, path, inferred=True, order="row_id")
    return rows.groupBy("uid", "cid", "city").agg(F.count("row_id").alias("n"))


@query("SELECT count(*) AS n, round(min(value), 3) AS low, round(max(value), 3) AS high FROM events WHERE value IS NOT NULL AND value <> 0")
def csv_numeric(spark, d):
    path = _place(spark)
    tb.write_csv(fx.table(spark, d, "events").select("value"), path)
    found = tb.first_existing(spark, (f"{path}-elsewhere", path))
    values, _ = stats.numeric(tb.read_csv(spark, found, required=("value",)), "value")
    return r3(values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))


@query(_CELLS + "SELECT 'cell ' || CAST(cid AS VARCHAR) AS name, round(lat, 3) AS lat, round(lon, 3) AS lon FROM latest")
def excel_sheet(spark, d):
    path = f"{_place(spark)}.xlsx"
    files.write_excel(c._latest(spark, d).select(F.concat(F.lit("cell "), "cid").alias("name"), "lat", "lon"), path)
    return r3(files.read_excel(spark, path))


@query("SELECT * FROM (VALUES ('GSD', 60.0::DOUBLE, 20.0::DOUBLE), ('GG', 80, 25), ('TS', 40, 15), ('TG', 200, 50)) v(mode, mean, std)")
def mode_speeds(spark, d):
    path = f"{_place(spark)}.pkl"
    files._put(spark, path, pickle.dumps({m: {"mean": a, "std": b} for m, (a, b) in fx.SPEEDS.items()}))
    return files.speed_table(spark, files.read_pickle(spark, path))


# --- reports -----------------------------------------------------------------------------------------------------------
_HIST = f"""WITH {c._VALUES}, s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w FROM v1), n AS (SELECT CAST(least(floor((v - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM v1, s GROUP BY 1)
 SELECT printf('%.6f', lo + i * w) AS bin_left, printf('%.6f', CASE WHEN i = 49 THEN hi ELSE lo + (i + 1) * w END) AS bin_right, CAST(coalesce(n, 0) AS VARCHAR) AS frequency
 FROM (SELECT unnest(range(0, 50)) AS i) b CROSS JOIN s LEFT JOIN n ON n.bin = b.i"""


@query(_HIST)
def histogram_csv(spark, d):
    path = _place(spark)
    tb.write_histogram_csv(stats.histogram(c._values(spark, d)[0]), path)
    return tb.read_csv(spark, path)


@query(f"""WITH {c._VALUES}, a AS (SELECT count(*) AS n, min(v) AS mn, max(v) AS mx, CAST(sum(CAST(v AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS av, median(v) AS md FROM v1), h AS (SELECT count(*) AS n FROM v0, bound WHERE v > b)
 SELECT metric, value FROM (SELECT 'count' AS metric, CAST(n AS VARCHAR) AS value FROM a UNION ALL SELECT 'min', printf('%.6f', mn) FROM a UNION ALL SELECT 'max', printf('%.6f', mx) FROM a
 UNION ALL SELECT 'median', printf('%.6f', md) FROM a UNION ALL SELECT 'skipped_high', CAST(n AS VARCHAR) FROM h
 UNION ALL SELECT 'skipped_zero', CAST(count(*) AS VARCHAR) FROM events WHERE value = 0 UNION ALL SELECT 'skipped_invalid', '0')""")
def summary_csv(spark, d):
    values, counts = stats.numeric(fx.table(spark, d, "events").select(F.col("value").cast("string").alias("value")), "value")
    kept, high = stats.trimmed(values)
    path = _place(spark)
    tb.write_summary_csv(stats.summary(kept, counts.crossJoin(F.broadcast(high))), path)  # one row each
    return tb.read_csv(spark, path).where("metric <> 'mean'")  # the last bits of a mean depend on the order of rows


@query(c._ALL + """, m AS (SELECT unnest(['time', 'distance', 'count']) AS metric, unnest([1, 2, 3]) AS k), d AS (SELECT DISTINCT CAST(date AS VARCHAR) AS stat_date FROM metrics)
 SELECT stat_date, metric, row_number() OVER (ORDER BY stat_date, k) AS place FROM d CROSS JOIN m""")
def report_order(spark, d):
    rows = stats.in_report_order(stats.day_stats(stats.uid_metrics(c._detail(spark, d), ("uid", "date"))))
    return rows.coalesce(1).select("stat_date", "metric", (F.monotonically_increasing_id() + 1).alias("place"))  # three rows a day


@query(_CELLS + "SELECT cid, CASE WHEN abs(v - round(v)) < 1e-9 THEN CAST(CAST(round(v) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', v) END AS label FROM (SELECT cid, CASE WHEN cid % 3 = 0 THEN CAST(cid AS DOUBLE) ELSE cid / 7.0 END AS v FROM latest)")
def number_labels(spark, d):
    v = F.when(F.col("cid") % 3 == 0, F.col("cid").cast("double")).otherwise(F.col("cid") / 7.0)
    return c._latest(spark, d).select("cid", tb.number_label(v).alias("label"))


# --- geometry, sequences, raster ---------------------------------------------------------------------------------------
_G = DEFAULT_GRID


_CENTRES = c._GK.rstrip() + ", cc AS (" + c._cell_sql(c._IN_X, c._IN_Y)[len(c._GK) :] + ")"


@query(_CENTRES + f" SELECT cid, round(CAST({_G.x_min!r} AS DOUBLE) + (loc_x + 0.5) * {_G.size!r}, 3) AS centre_x, round(CAST({_G.y_min!r} AS DOUBLE) + (loc_y + 0.5) * {_G.size!r}, 3) AS centre_y FROM cc")
def cell_centres(spark, d):
    rows = c._cells(spark, d, "closed").withColumn("at", geo.cell_centre(F.col("loc_x"), F.col("loc_y"), DEFAULT_GRID))
    return r3(rows.select("cid", F.col("at.x").alias("centre_x"), F.col("at.y").alias("centre_y")))


@query(f"WITH {c._MV}, {c._STEPS}, {c._TRIPS} SELECT id, CAST(abs(locx_d - locx_o) + abs(locy_d - locy_o) AS BIGINT) AS blocks FROM trips")
def manhattan_lengths(spark, d):
    length = geo.manhattan(F.col("locx_o"), F.col("locy_o"), F.col("locx_d"), F.col("locy_d"))
    return c._trips(spark, d).select("id", length.cast("long").alias("blocks"))


@query(f"""WITH {c._RAWPATHS}, p0 AS (SELECT moi_id * 100000000 + day AS path_id, rn_seq AS path_sequence, rn_id, next_rn_id, time FROM raw),
 p1 AS (SELECT *, lead(time) OVER (PARTITION BY path_id ORDER BY path_sequence) - time AS time_diff FROM p0 WHERE NOT (rn_id = -1 AND next_rn_id = -1)),
 p2 AS (SELECT *, sum(CAST(rn_id = -1 AS BIGINT)) OVER (PARTITION BY path_id ORDER BY path_sequence) AS cut FROM p1 WHERE next_rn_id <> -1 AND time_diff IS NOT NULL),
 p3 AS (SELECT *, dense_rank() OVER (ORDER BY path_id, cut) - 1 AS new_id FROM p2 WHERE rn_id <> -1),
 p4 AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY path_sequence) - 1 AS rn_seq, count(*) OVER (PARTITION BY new_id) AS n FROM p3)
 SELECT new_id AS path_id, rn_seq, rn_id, next_rn_id, time_diff FROM p4 WHERE n >= 2""")
def split_renumbered(spark, d):
    raw = fx.raw_paths(spark, d)
    paths = raw.select((F.col("moi_id") * 100000000 + F.col("day")).alias("path_id"), F.col("rn_seq").alias("path_sequence"), "rn_id", "next_rn_id", "time")
    return seq.split_paths(paths, renumber=True).select("path_id", "rn_seq", "rn_id", "next_rn_id", "time_diff")


@query(f"""WITH {c._MV}, o AS (SELECT uid, move_vp_id, city, row_number() OVER (PARTITION BY uid ORDER BY move_vp_id) - row_number() OVER (PARTITION BY uid, city ORDER BY move_vp_id) AS g FROM mv),
 r AS (SELECT uid, city, min(move_vp_id) AS first_order, count(*) AS n FROM o GROUP BY uid, city, g),
 e AS (SELECT *, first_value(city) OVER w AS fc, first_value(n) OVER w AS fn, first_value(first_order) OVER w AS ff, max(first_order) OVER (PARTITION BY uid) AS lf FROM r WINDOW w AS (PARTITION BY uid ORDER BY first_order))
 SELECT uid, city, first_order, CAST(n + CASE WHEN first_order = lf AND ff <> lf AND city = fc THEN fn ELSE 0 END AS BIGINT) AS n_rows FROM e""")
def city_runs_cyclic(spark, d):
    return seq.run_lengths(fx.points(spark, d), "city", "move_vp_id", ("uid",), cyclic=True).select("uid", "city", "first_order", "n_rows")


@query(f"""WITH {c._MV}, {c._STEPS}, {c._TRIPS}, {c._RASTER}, o AS (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS k), n AS (SELECT t.id, o.k, coalesce(l.GG, 0) AS v FROM trips t CROSS JOIN o LEFT JOIN layer l ON l.x = t.locx_o + o.k // 3 - 1 AND l.y = t.locy_o + o.k % 3 - 1)
 SELECT id, string_agg(CAST(v AS VARCHAR), '' ORDER BY k) AS bits FROM n GROUP BY id""")
def patches3(spark, d):
    read = ras.patches(c._trips(spark, d), c._layers(spark, d), "GG", 3, x="locx_o", y="locy_o")
    return read.select("id", F.array_join(F.transform(F.flatten("GG"), lambda v: v.cast("string")), "").alias("bits"))


def _feasible(spark, d, size):
    found = ras.feasible_actions(c._trips(spark, d), c._layers(spark, d), size=size, x="locx_o", y="locy_o")
    return found.select("id", F.array_join(F.transform("actions", lambda v: v.cast("string")), ",").alias("actions"))


_FEASIBLE = f"WITH {c._MV}, {c._STEPS}, {c._TRIPS}, {c._RASTER}"


@query(_FEASIBLE + """, o(k, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)),
 f AS (SELECT t.id, string_agg(CAST(o.k AS VARCHAR), ',' ORDER BY o.k) AS actions FROM trips t CROSS JOIN o JOIN layer l ON l.x = t.locx_o + o.dx AND l.y = t.locy_o + o.dy AND l.GG = 1 GROUP BY t.id)
 SELECT id, coalesce(actions, '') AS actions FROM trips LEFT JOIN f USING (id)""")
def feasible_actions3(spark, d):
    return _feasible(spark, d, 3)


@query(_FEASIBLE + """, o(cx, cy, k) AS (VALUES (0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 2, 2), (0, 2, 3), (0, 2, 4), (2, 0, 4), (2, 0, 5), (2, 0, 6), (2, 2, 6), (2, 2, 7), (2, 2, 0)),
 f AS (SELECT DISTINCT t.id, o.k FROM trips t CROSS JOIN o JOIN layer l ON l.x BETWEEN t.locx_o + o.cx AND t.locx_o + o.cx + 2 AND l.y BETWEEN t.locy_o + o.cy AND t.locy_o + o.cy + 2 AND l.GG = 1),
 a AS (SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS actions FROM f GROUP BY id) SELECT id, coalesce(actions, '') AS actions FROM trips LEFT JOIN a USING (id)""")
def feasible_actions5(spark, d):
    return _feasible(spark, d, 5)


@query(f"WITH {c._MV}, {c._RASTER}, {c._PATHCELLS}, m AS (SELECT id, count(*) FILTER (WHERE coalesce(TG, 0) = 1) AS matched, count(*) AS total FROM cells LEFT JOIN layer USING (x, y) GROUP BY id) SELECT id, matched, total, round(CASE WHEN total <= 2 THEN matched / (total + 0.1) ELSE 0 END, 3) AS rate FROM m")
def match_rate_limited(spark, d):
    return r3(ras.match_rate(c._pathcells(spark, d), c._layers(spark, d), "TG", fx.GRID.n_col, fx.GRID.n_row, skip_first=False, epsilon=0.1, most=2))


# --- rollouts and rebuilt paths ----------------------------------------------------------------------------------------
_NEAR = """own AS (SELECT px AS x, py AS y FROM (SELECT CAST(unnest(range(-30, 81)) AS INTEGER) AS px) CROSS JOIN (SELECT CAST(unnest(range(-30, 71)) AS INTEGER) AS py)),
 off(k, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)),
 near AS (SELECT own.x, own.y, list(coalesce(l.TG, 0) ORDER BY k) AS n FROM own CROSS JOIN off LEFT JOIN layer l ON l.x = own.x + dx AND l.y = own.y + dy GROUP BY own.x, own.y),
 spot AS (SELECT near.x, near.y, coalesce(l.GSD, 0) AS GSD, coalesce(l.GG, 0) AS GG, coalesce(l.TS, 0) AS TS, coalesce(l.TG, 0) AS TG, near.x BETWEEN 0 AND 49 AND near.y BETWEEN 0 AND 39 AS inside FROM near LEFT JOIN layer l USING (x, y))"""


def _walk(hold: float, normalised: bool, own_mode: bool) -> str:
    """The walks of the trips in `start` (id, ox, oy, gx, gy, mode) as a recursive table; the rows that are not live are their ends."""
    scale = "CASE WHEN first > 0 THEN CAST(left_ AS DOUBLE) / first ELSE 1.0 END" if normalised else "1.0::DOUBLE"
    pick = (
        "coalesce(list_filter(o, lambda z: NOT list_contains(seen, (ax + [1,1,0,-1,-1,-1,0,1][z.k + 1]) * 1000 + ay + [0,1,1,1,0,-1,-1,-1][z.k + 1]))[1].k, greatest(last, 0))"
        if own_mode else "CASE WHEN last >= 0 AND o[1].k = (last + 4) % 8 THEN o[2].k ELSE o[1].k END"
    )
    hit = "CASE mode WHEN 'GSD' THEN s.GSD WHEN 'GG' THEN s.GG WHEN 'TS' THEN s.TS ELSE s.TG END = 1" if own_mode else "s.TG = 1 AND s.inside AND steps >= 1"
    count = "1" if own_mode else "CAST(s.inside AND steps >= 1 AS INTEGER)"
    return f"""walk AS (SELECT id, mode, ox, oy, gx, gy, abs(gx) + abs(gy) AS first, 0 AS ax, 0 AS ay, -1 AS last, 0 AS steps, 0.0::DOUBLE AS reward, 0 AS matched, 0 AS total, 0.0::DOUBLE AS length, 0 AS ex, 0 AS ey, TRUE AS live, [0] AS seen FROM start
 UNION ALL SELECT id, mode, ox, oy, gx, gy, first, nx, ny, k, steps + 1, reward + (CASE WHEN n[k + 1] <> 0 THEN 0.65::DOUBLE * {scale} ELSE 0 END - CASE WHEN left_ > {hold} THEN {scale} ELSE 0 END + CASE WHEN left_ <= {hold} THEN 2 ELSE 0 END),
  matched + CAST({hit} AS INTEGER), total + {count}, length + CASE WHEN steps = 0 THEN 0 ELSE sqrt(pow(nx - ax, 2) + pow(ny - ay, 2)) END, CASE WHEN steps = 0 THEN nx ELSE ex END, CASE WHEN steps = 0 THEN ny ELSE ey END,
  left_ > {hold} AND steps + 1 < first + 10, {'list_append(seen, nx * 1000 + ny)' if own_mode else 'seen'}
 FROM (SELECT *, abs(nx - gx) + abs(ny - gy) AS left_ FROM (SELECT *, ax + [1,1,0,-1,-1,-1,0,1][k + 1] AS nx, ay + [0,1,1,1,0,-1,-1,-1][k + 1] AS ny FROM (SELECT *, {pick} AS k
  FROM (SELECT w.*, near.n, list_sort(list_transform([0,1,2,3,4,5,6,7], lambda q: {{'s': abs(ax + [1,1,0,-1,-1,-1,0,1][q + 1] - gx) + abs(ay + [0,1,1,1,0,-1,-1,-1][q + 1] - gy) - 0.1::DOUBLE * near.n[q + 1], 'k': q}})) AS o
   FROM walk w JOIN near ON near.x = ox + ax AND near.y = oy + ay WHERE w.live)))) JOIN spot s ON s.x = ox + nx AND s.y = oy + ny),
 ends AS (SELECT *, length + sqrt(pow(ax - ex, 2) + pow(ay - ey, 2)) AS closed, matched / (total + 0.0001) AS match_rate, steps <= first AS finished FROM walk WHERE NOT live)"""


_START = "start AS (SELECT id, locx_o AS ox, locy_o AS oy, locx_d - locx_o AS gx, locy_d - locy_o AS gy, 'TG' AS mode FROM trips)"
_ROLL = f"WITH RECURSIVE {c._MV}, {c._STEPS}, {c._TRIPS}, {c._RASTER}, {_NEAR}, {_START}, "
_EPISODE = "id, CAST(steps AS BIGINT) AS steps, round(reward, 3) AS reward, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, round(match_rate, 3) AS match_rate, finished, round(closed, 3) AS length"
c._SQL["rollout_greedy"] = _ROLL + _walk(1.5, False, False) + f" SELECT {_EPISODE} FROM ends"
c._SQL["rollout_normalised"] = _ROLL + _walk(0.0, True, False) + f" SELECT {_EPISODE} FROM ends"
c._SQL["rollout_rates"] = _ROLL + _walk(1.5, False, False) + " SELECT count(*) AS episodes, count(*) FILTER (WHERE finished) AS finished, round(count(*) FILTER (WHERE finished) / count(*), 3) AS finish_rate, round(avg(match_rate) FILTER (WHERE finished), 3) AS mean_match_rate FROM ends"


@query(_ROLL + _walk(1.5, False, False) + " SELECT id, CAST(steps AS BIGINT) AS steps FROM ends WHERE id % 5 <> 0")
def rollout_without_nan(spark, d):
    t = c._trips(spark, d)
    lost = F.when(F.col("id") % 5 == 0, F.when(F.col("id") % 2 == 0, F.lit(float("nan")))).otherwise(F.col("locx_o").cast("double"))
    trips = t.select("id", lost.alias("loc_x"), F.col("locy_o").alias("loc_y"), F.col("locx_d").alias("next_loc_x"), F.col("locy_d").alias("next_loc_y"))
    return roll.rollout(trips, c._layers(spark, d), fx.GRID.n_col, fx.GRID.n_row).select("id", "steps")


def _upper_sql(reward: str) -> str:
    return f"""WITH RECURSIVE {c._MV}, {c._STEPS}, {c._TRIPS}, {c._RASTER}, {_NEAR}, {c._SUPPORT},
 speeds(mode, mean, std) AS (VALUES ('GSD', 60, 20), ('GG', 80, 25), ('TS', 40, 15), ('TG', 200, 50)),
 start AS (SELECT id, locx_o AS ox, locy_o AS oy, locx_d - locx_o AS gx, locy_d - locy_o AS gy, (SELECT m FROM (VALUES ('GSD', sup.GSD, 0), ('GG', sup.GG, 1), ('TS', sup.TS, 2), ('TG', sup.TG, 3)) v(m, n, k) ORDER BY n DESC, k LIMIT 1) AS mode FROM trips JOIN sup USING (id)),
 {_walk(1.5, False, True)},
 e AS (SELECT t.id, s.uid || '_' || CAST(s.date AS VARCHAR) AS trajectory_id, ends.mode, steps, matched, total, CASE WHEN steps <= first + 10 THEN matched / (total + 0.1) ELSE 0 END AS match, closed / (mean / 60.0) AS t_lower,
  greatest(0, t.time) AS t_upper, t.distance / (t.time + 0.001) AS v, mean, std FROM ends JOIN trips t USING (id) JOIN speeds USING (mode) JOIN steps s ON s.move_vp_id = t.id),
 f AS (SELECT *, {reward} AS reward FROM e)
 SELECT trajectory_id, id, mode, CAST(steps AS BIGINT) AS steps, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, round(match, 3) AS match, round(t_lower, 3) AS t_lower, round(reward, 3) AS reward,
  round(avg(reward) OVER (PARTITION BY trajectory_id ORDER BY id), 3) AS r_avg FROM f"""


def _upper(spark, d, reward):
    keys = c._steps(spark, d).select(F.col("move_vp_id").alias("id"), F.concat("uid", F.lit("_"), F.col("date").cast("string")).alias("trajectory_id"))
    speeds = files.speed_table(spark, {m: {"mean": a, "std": b} for m, (a, b) in fx.SPEEDS.items()})
    return r3(roll.upper_rollout(c._trips(spark, d).join(keys, "id"), c._layers(spark, d), speeds, fx.GRID.n_col, fx.GRID.n_row, "trajectory_id", "id", reward=reward))


@query(_upper_sql("(match - 1) * abs(t_lower - t_upper)"))
def upper_rollout_base(spark, d):
    return _upper(spark, d, "base")


@query(_upper_sql("match"))
def upper_rollout_match(spark, d):
    return _upper(spark, d, "match")


@query(_upper_sql("CASE WHEN mean / 60.0 <> v THEN match / abs(mean / 60.0 - v) END"))
def upper_rollout_velocity(spark, d):
    return _upper(spark, d, "velocity")


@query(_upper_sql("CASE WHEN v * 60 <> mean THEN match / abs(v * 60 - mean) * std END"))
def upper_rollout_zscore(spark, d):
    return _upper(spark, d, "zscore")


@query(_upper_sql("match * exp(-0.5 * pow((v * 60 - mean) / std, 2)) / (std * sqrt(2 * pi()))"))
def upper_rollout_pdf(spark, d):
    return _upper(spark, d, "pdf")


@query(_upper_sql("-abs((v * 60 - mean) / std) * (1 - matched / (total + 0.1))"))
def upper_rollout_penalty(spark, d):
    return _upper(spark, d, "penalty")


c._SQL["rebuild_paths"] = f"""WITH RECURSIVE {c._RAWPATHS}, g AS (SELECT moi_id, list({{'id': row_id, 'here': rn_id, 'there': next_rn_id, 'seq': rn_seq, 'time': time}} ORDER BY row_id) AS r FROM raw GROUP BY moi_id),
 chain AS (SELECT moi_id, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS path, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS used FROM g
 UNION ALL SELECT moi_id, coalesce(follow, head), CASE WHEN follow IS NULL THEN path + 1 ELSE path END, CASE WHEN follow IS NULL THEN 0 ELSE step + 1 END, list_append(used, coalesce(follow, head))
 FROM (SELECT c.*, CASE WHEN c.pos > 0 THEN list_filter(range(1, len(r) + 1), lambda i: NOT list_contains(used, i) AND r[i].here = r[c.pos].there AND r[i].seq = r[c.pos].seq + 1 AND r[i].time >= r[c.pos].time)[1] END AS follow,
  list_filter(range(1, len(r) + 1), lambda i: NOT list_contains(used, i) AND r[i].seq = 0)[1] AS head FROM chain c JOIN g USING (moi_id)) WHERE coalesce(follow, head) IS NOT NULL),
 n AS (SELECT moi_id, max(path) + 1 AS n FROM chain GROUP BY moi_id), b AS (SELECT moi_id, coalesce(sum(n) OVER (ORDER BY moi_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n)
 SELECT CAST(base + path AS BIGINT) AS path_id, step AS path_sequence, moi_id, r[pos].id AS row_id, r[pos].here AS rn_id, r[pos].there AS next_rn_id, r[pos].time AS time FROM chain JOIN g USING (moi_id) JOIN b USING (moi_id) WHERE pos > 0"""
