"""Files as tables, ranks without a global sort, streams of segments, policies."""

import io
import pickle
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import raster, rollout, sequence, stats, trajectory as tr
from waymark.sources import files, tables


def test_excel(spark, tmp_path):
    df = spark.createDataFrame([("a <b> & c", 1.5, 2), (None, None, 3), ("x", -2.0, None)], "name string, lat double, lon int")
    files.write_excel(df, f"{tmp_path}/t.xlsx")
    rows = files.read_excel(spark, f"{tmp_path}/t.xlsx")
    assert rows.dtypes == [("name", "string"), ("lat", "double"), ("lon", "double")]
    assert [tuple(r) for r in rows.collect()] == [("a <b> & c", 1.5, 2.0), (None, None, 3.0), ("x", -2.0, None)]
    with pytest.raises(ValueError, match="zone"):
        files.read_excel(spark, f"{tmp_path}/t.xlsx", required=("lat", "zone"))


def test_excel_with_shared_strings(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(f"{tmp_path}/s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>lat</t></si><si><r><t>l</t></r><r><t>on</t></r></si><si><t>n/a</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>31.5</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="C3"><v>120</v></c></row></sheetData></worksheet>')
    rows = files.read_excel(spark, f"{tmp_path}/s.xlsx")
    assert [tuple(r) for r in rows.collect()] == [(31.5, "n/a"), (None, "120")] and rows.columns == ["lat", "lon"]


def test_pickles(spark, tmp_path):
    (tmp_path / "r.pkl").write_bytes(pickle.dumps({(1, 2): (0, 0, 0, 0, 66), (3, 4): (0, 0, 0, 0, 8)}))
    cells = files.raster_table(spark, files.read_pickle(spark, f"{tmp_path}/r.pkl"))
    assert sorted(map(tuple, cells.collect())) == [(1, 2, 66), (3, 4, 8)]
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(io.BytesIO))
    with pytest.raises(pickle.UnpicklingError):
        files.read_pickle(spark, f"{tmp_path}/bad.pkl")
    speeds = files.speed_table(spark, {"TG": {"mean": 200, "std": 50}})
    got = files.with_speed(spark.createDataFrame([("TG",), ("GG",)], "mode string"), speeds).collect()
    assert {(r.mode, r.mean) for r in got} == {("TG", 200.0), ("GG", None)}


@pytest.mark.parametrize("most", [3, 50])
def test_ranks_by_brackets(spark, most):
    rng = random.Random(most)
    v = sorted([rng.choice([1.0, 2.0, rng.uniform(0, 9)]) for _ in range(400)])
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(3)
    for rank in (1, 2, 100, 200, 201, 399, 400):
        assert stats.nth_smallest(df, rank, 400, most=most) == v[rank - 1]
    assert stats.median(df) == (v[199] + v[200]) / 2 and stats.median(df.where("false")) is None


def test_summary_without_values(spark, tmp_path):
    df = spark.createDataFrame([("0",), ("x",)], "x string")
    values, counts = stats.numeric(df, "x")
    kept, high = stats.trimmed(values)
    rows = tables.summary_rows(stats.summary(kept, counts.crossJoin(high.withColumn("upper_bound", F.lit(2.5)))))
    assert [tuple(r) for r in rows.collect()] == [("count", "0"), ("skipped_invalid", "1"), ("skipped_zero", "1"), ("skipped_high", "0"), ("upper_bound", "2.500000")]


def test_segments_over_batches(spark):
    rng = random.Random(5)
    rows, want = [], []
    for p in range(4):
        t = d = first = None
        for i in range(120):
            dt, dd = rng.choice([10.0, 300.0, None if rng.random() < 0.02 else 40.0]), float(rng.randrange(5))
            rows.append((p, i, dt, dd, f"r{p}.{i}"))
            if first is None:
                t, d, first = dt, dd, i
            else:
                t, d = None if t is None or dt is None else t + dt, d + dd
            if t is not None and t > 1000:
                want.append((p, first, t, d, f"r{p}.{first}"))
                first = None
        if first is not None:
            want.append((p, first, t, d, f"r{p}.{first}"))
    df = spark.createDataFrame(rows, "path_id long, rn_seq long, time_diff double, distance double, tag string").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = sorted(map(tuple, sequence.resample(df).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == sorted(want)


def test_many_equal_distances_are_ranked_in_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    got = {r.i: r.r for r in tr.global_rank(rows, "v", "i", "r", 8).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((-(i if i % 3 == 0 else 0), i) for i in range(3000)), 1)}


def test_shards_of_dates_without_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 20240101)], "uid string, date int")
    names = tables.write_shards(df, "gaps", [20240101, 20240102], f"{tmp_path}/gaps")
    assert [spark.table(n).count() for n in names] == [1, 0] and spark.table(names[1]).columns == ["uid", "date"]
    with pytest.raises(RuntimeError):
        tables.each_date(df, ["20250101"], lambda x: x)
    with pytest.raises(ValueError):
        tables.empty(spark, "a int, A string")
    with pytest.raises(ValueError):
        tables.first_existing(spark, (f"{tmp_path}/nothing",))
    assert tables.renamed_shard("dataset_20240101", "dataset", "dataset_multicity") == "dataset_multicity_20240101"


def test_network_policy_and_walks_without_return(spark, tmp_path):
    w = np.zeros((12, 8))
    w[2, 0] = 1.0  # the farther east the goal, the better east
    np.savez(tmp_path / "w.npz", w0=np.eye(12), b0=np.zeros(12), w1=w, b1=np.zeros(8))
    policy = rollout.network_policy(rollout.load_weights(tmp_path / "w.npz"))
    layer = raster.layers(spark.createDataFrame([(x, 0, 2) for x in range(6)], "x int, y int, code int"), 6, 1)
    trips = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0, "TG")], "id long, loc_x double, loc_y double, next_loc_x double, next_loc_y double, mode string")
    r = rollout.rollout(trips, layer, 6, 1, hold=0.0, policy=policy).first()
    assert (r.steps, r.matched, r.total, r.finished, r.length) == (4, 3, 3, True, 6.0)
    flat = lambda s: np.tile(np.arange(8.0)[::-1], (len(s), 1))  # noqa: E731  always the first that is new
    r = rollout.rollout(trips, layer, 6, 1, hold=0.0, policy=flat, mode="mode", no_return=True).first()
    assert (r.steps, r.matched, r.total) == (4, 4, 4)
