import datetime as dt
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from waymark.operators import raster, rollout, sequence, stats, trajectory as tr
from waymark.plans import catalog
from waymark.sources import tables

T = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
POINTS = "uid string, index string, stime timestamp, cid long, lat double, lon double, city string, province string"


def test_multicity_and_deltas(spark):
    rows = [("a", "1", T(0), 1, 30.0, 120.0, "x", "p"), ("a", "2", T(60), 2, None, 120.0, "y", "p"), ("a", "3", T(30), 3, 31.0, 120.0, None, "p"), ("b", "1", T(0), 1, 30.0, 120.0, None, "p"), ("c", "1", T(0), 1, 30.0, 120.0, "x", "p"), ("a", "bad", T(5), 1, 1.0, 1.0, "x", "p"), (None, "1", T(0), 1, 1.0, 1.0, "x", "p")]
    std = tr.standardise(spark.createDataFrame(rows, POINTS))
    out = tr.previous_deltas(tr.multicity(std)).orderBy("uid", "index").collect()
    assert [(r.uid, r["index"], r.time_value, r.dist_value) for r in out] == [("a", 1, None, None), ("a", 2, 60.0, 0.0), ("a", 3, 0.0, 0.0)]
    with pytest.raises(ValueError):
        tr.standardise(spark.createDataFrame([(1,)], "x int"))


def test_dedupe_index_and_next(spark):
    dim = spark.createDataFrame([(1, 10, 1.0), (1, 11, None), (2, 5, 3.0), (2, 5, 4.0)], "cid long, date int, lat double")
    assert sorted(map(tuple, tr.dedupe_latest(dim, "cid", "date", ("lat",)).collect())) == [(1, 11, None), (2, 5, 4.0)]
    pts = spark.createDataFrame([("u", None, 1, T(0)), ("u", None, 2, T(0)), ("u", 1, 3, T(9))], "uid string, move_id int, move_vp_id long, stime timestamp")
    assert [r["index"] for r in tr.index_points(pts, tie=("move_vp_id",)).orderBy("move_vp_id").collect()] == [1, 2, 3]
    nxt = tr.next_step(pts, ("uid", "move_id"), columns=("move_vp_id",)).collect()
    assert [(r.move_vp_id, r.next_move_vp_id) for r in nxt] == [(1, 2)]
    same = pts.select(F.hash("uid", "move_id").alias("h"), F.hash("uid").alias("g")).where("move_vp_id = 1").first()
    assert same.h == same.g  # the 32-bit id skips nulls; the stable one doesn't
    assert tr.next_step(pts, ("uid", "move_id"), columns=("move_vp_id",), stable_id=True).first().trajectory_id != same.h


def test_fanout_stats_equal_the_fanned_out_rows(spark):
    rng = random.Random(7)
    pts = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 4, 5]),) for _ in range(200)], "cid long")
    some = lambda c: rng.choice([None, float("nan"), float("inf")] if c == 3 else [None, -0.00005, 31.23456, 99999999999999.0, float("nan")])
    rows = [(c, some(c), 0.0) for c in (None, 1, 2, 3, 9) for _ in range(rng.randrange(5, 30))] + [(4, None, 0.0)]
    dim = spark.createDataFrame(rows + [(9, 1e300, 0.0)], "cid long, lat double, lon double")
    exact = F.sum(F.round("lat", 4).cast("decimal(18,4)")).cast("double")
    want = tr.enrich(pts, dim).groupBy("cid").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lat").alias("n_matched"), exact.alias("lat_sum"))
    got = tr.fanout_stats(pts, dim)  # the value that fits no decimal is of a key without points
    assert got.dtypes == want.dtypes and len(want.collect()) == 6
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        tr.fanout_stats(pts, spark.createDataFrame([(1, 1.0, 0.0), (1, 1e300, 0.0)], dim.schema)).collect()
    assert tr.fanout_stats(pts.where("false"), dim).count() == 0
    assert {(r.n_matched, r.lat_sum) for r in tr.fanout_stats(pts, dim.where("false")).collect()} == {(0, None)}


def test_point_fanout_makes_no_row_a_pair(spark, tmp_path):
    n = 300_000  # points and cells of one cid: 9e10 pairs
    spark.range(n).selectExpr("id event_id", "timestamp_ntz'2024-01-01' ts", "id user_id", "'a' event_type", "'{\"k\": 0}' props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(n).selectExpr("id * 1200 c_custkey", "1 c_nationkey", "500.0D c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert [tuple(r) for r in catalog.queries()["point_fanout"](spark, str(tmp_path)).collect()] == [(0, n * n, n * n, n * n * 28.5)]
    finally:
        stop.cancel()


@pytest.mark.parametrize("n", [1, 7, 300])
def test_global_rank(spark, n):
    rng = random.Random(n)
    rows = [(i, float(rng.randrange(20))) for i in range(n)]
    got = {r.i: r.r for r in tr.global_rank(spark.createDataFrame(rows, "i long, v double"), "v", "i", "r", 16).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


@pytest.mark.parametrize("n", [1, 2, 99, 101, 300])
def test_distribution(spark, n):
    rng = random.Random(n)
    v = [round(rng.uniform(0.1, 50), 3) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    s = sorted(v)
    kept = [x for x in s if x <= s[math.ceil(0.99 * n) - 1]]
    trimmed = stats.trim(df)
    assert sorted(r.v for r in trimmed.collect()) == kept
    bins = stats.histogram(trimmed, 10).orderBy("bin").collect()
    lo, hi = kept[0], kept[-1]
    k = 1 if lo == hi else 10
    want = [0] * k
    for x in kept:
        want[0 if k == 1 else min(int((x - lo) / ((hi - lo) / 10)), 9)] += 1
    assert [b.frequency for b in bins] == want and bins[-1].bin_right == hi


def test_numeric_and_empty(spark):
    df = spark.createDataFrame([("1.5",), ("",), (" ",), ("0",), ("-0",), ("abc",), (None,)], "x string")
    values, counts = stats.numeric(df, "x")
    assert [r.v for r in values.collect()] == [1.5] and tuple(counts.first()) == (2, 1)
    none = df.where("false")
    assert stats.histogram(stats.numeric(none, "x")[0]).count() == 0
    got = {r.metric: r.value for r in stats.summary(*stats.numeric(none, "x")).collect()}
    assert got["count"] == 0 and got["min"] is None


def rebuilt(rows):
    """The rule, row by row."""
    used, out, path = set(), [], 0
    for s in rows:
        if s["rn_seq"] or s["row_id"] in used:
            continue
        cur, step = s, 0
        used.add(s["row_id"])
        while cur is not None:
            out.append((cur["row_id"], path, step))
            nxt = [r for r in rows if r["rn_id"] == cur["next_rn_id"] and r["rn_seq"] == cur["rn_seq"] + 1 and r["time"] >= cur["time"] and r["row_id"] not in used]
            cur, step = (nxt[0], step + 1) if nxt else (None, step)
            if cur:
                used.add(cur["row_id"])
        path += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuild_paths(spark, seed):
    rng = random.Random(seed)
    rows = [dict(moi_id=m, row_id=m * 100 + i, rn_seq=rng.randrange(4), rn_id=rng.randrange(3), next_rn_id=rng.randrange(3), time=rng.randrange(20)) for m in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "moi_id long, row_id long, rn_seq long, rn_id long, next_rn_id long, time long").repartition(3)
    got = sequence.number_paths(sequence.rebuild_paths(df)).collect()
    base, want = 0, set()
    for m in range(3):
        part = rebuilt([r for r in rows if r["moi_id"] == m])
        want |= {(i, base + p, s) for i, p, s in part}
        base += 1 + max(p for _, p, _ in part)
    assert {(r.row_id, r.path_id, r.path_sequence) for r in got} == want


def test_resample_and_restitch(spark):
    steps = [(1, i, 400.0, 1.0, i, i + 1, i, i, i + 1, i + 1) for i in range(4)] + [(2, 0, None, 1.0, 7, 8, 1, 1, 2, 2)]
    df = spark.createDataFrame(steps, "path_id long, rn_seq long, time_diff double, distance double, rn_id long, next_rn_id long, loc_x long, loc_y long, next_loc_x long, next_loc_y long")
    got = sequence.restitch(sequence.resample(df)).orderBy("path_id", "rn_seq").collect()
    assert [(r.path_id, r.rn_seq, r.time_diff, r.next_rn_id) for r in got] == [(1, 0, 1200.0, 3), (1, 3, 400.0, 4), (2, 0, None, 8)]
    assert got[0].velocity == 3 / 1200 and got[2].velocity == 0


def test_split_paths(spark):
    rows = [(1, 0, 5, 6, 0), (1, 1, 6, -1, 10), (1, 2, -1, 7, 20), (1, 3, 7, 8, 30), (1, 4, 8, 9, 45), (1, 5, 9, 9, 60), (1, 6, -1, -1, 70)]
    got = sequence.split_paths(spark.createDataFrame(rows, "path_id long, path_sequence long, rn_id long, next_rn_id long, time long")).orderBy("path_sequence").collect()
    assert [(r.path_sequence, r.part, r.rn_seq, r.time_diff) for r in got] == [(3, 1, 0, 15), (4, 1, 1, 15)]


def test_raster_and_rollout(spark):
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 64), (0, 1, 8), (1, 1, 36), (9, 9, 1)], "x int, y int, code int")
    layer = raster.layers(cells, 3, 2)
    assert {(r.x, r.y): (r.TG, r.TS, r.GG, r.GSD) for r in layer.collect()} == {(0, 0): (1, 1, 0, 0), (1, 0): (1, 1, 0, 0), (2, 0): (0, 1, 0, 0), (0, 1): (0, 0, 1, 0), (1, 1): (0, 0, 0, 1)}
    pt = spark.createDataFrame([(1, 1, 1)], "id long, x int, y int")
    assert raster.neighbours(pt, layer, ("TG",)).first().TG == [0, 0, 0, 0, 0, 1, 1, 0]
    assert raster.patches(pt, layer, "TG", 3).first().TG == [[1, 0, 0], [1, 0, 0], [0, 0, 0]]
    path = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 5, 5)], "id long, seq long, x int, y int")
    m = raster.match_rate(path, layer, "TG", 3, 2).first()
    assert (m.matched, m.total) == (1, 1)
    t = raster.travel_time(path, F.lit(1.0)).first().minutes
    assert abs(t - (1 + math.hypot(4, 5) + math.hypot(5, 5))) < 1e-9
    trips = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0), (2, 0.0, 0.0, float("nan"), 0.0), (3, 0.0, 0.0, 0.0, None)], "id long, loc_x double, loc_y double, next_loc_x double, next_loc_y double")
    e = rollout.rollout(trips, layer, 3, 2).collect()
    assert [(r.id, r.steps, r.finished) for r in e] == [(1, 1, True)] and abs(e[0].reward - 2.65) < 1e-9
    never = rollout.rollout(trips, layer, 3, 2, hold=0.0, policy=lambda s: (lambda a: (a.__setitem__((slice(None), 4), 1), a)[1])(__import__("numpy").zeros((len(s), 8)))).first()
    assert never.steps == 12 and not never.finished


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 20240101), ("b", 20240102), ("c", None)], "uid string, date int")
    seen = tables.write_by_date(df, f"{tmp_path}/out")
    assert seen.get["rows"] == 2 and tables.load(spark, f"{tmp_path}/out").count() == 2
    assert [r.stat_date for r in tables.missing_dates(df, ["20240101", "20240109"]).collect()] == ["20240109"]
    tables.write_shards(df, "fam", ["2024-01-01", "2024-01-02"])
    assert tables.latest_shards(spark, "fam", 1) == ["fam_20240102"] and tables.resolve_shard(spark, "fam", "20240101") == "fam_20240101"
    with pytest.raises(ValueError):
        tables.resolve_shard(spark, "fam", "19990101")
    (tmp_path / "v.csv").write_bytes("﻿time_value,dist_value\n1,\n0,x\n".encode())
    assert tables.read_csv(spark, f"{tmp_path}/v.csv", required=("time_value",)).count() == 2
