import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import formulas as fm, geo
from waymark.spec import DEFAULT_GRID, JIANGSU_GRID

# Values of an independent evaluation: lon, lat, x, y, cell in the default extent.
CITIES = [(121.48, 31.23, 1501077.650, 3504336.444, (647, 492)), (118.78, 32.04, 1235842.478, 3572955.270, (382, 560)), (120.17, 30.25, 1384434.531, 3383734.279, (531, 371)), (117.27, 31.86, 1093908.281, 3543586.473, (240, 531))]


def test_projection_cells_and_inverse(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CITIES)], "i int, lon double, lat double")
    p = df.withColumn("p", geo.gk_forward(F.col("lon"), F.col("lat"))).select("*", "p.x", "p.y")
    p = p.withColumn("b", geo.gk_inverse(F.col("x"), F.col("y"))).withColumn("c", geo.grid_cell(F.col("x"), F.col("y"), DEFAULT_GRID))
    for r in p.orderBy("i").collect():
        lon, lat, x, y, cell = CITIES[r.i]
        assert abs(r.x - x) < 0.001 and abs(r.y - y) < 0.001
        assert abs(r.b.lon - lon) < 1e-9 and abs(r.b.lat - lat) < 1e-9
        assert (r.c.loc_x, r.c.loc_y) == cell


def test_projection_of_bad_input_is_null(spark):
    df = spark.createDataFrame([("200", "30"), ("abc", "30"), (None, "30"), ("110", "91")], "lon string, lat string")
    assert all(r.p is None for r in df.select(geo.gk_forward(F.col("lon"), F.col("lat")).alias("p")).collect())


@pytest.mark.parametrize("bounds,expected", [("closed", [(825, 944), (825, None), (0, 0)]), ("joint", [(825, 944), (None, None), (0, 0)]), ("half_open", [(None, None), (None, None), (0, 0)])])
def test_grid_boundaries(spark, bounds, expected):
    g = DEFAULT_GRID
    df = spark.createDataFrame([(0, g.x_max, g.y_max), (1, g.x_max, g.y_max + 1), (2, g.x_min, g.y_min)], "i int, x double, y double")
    got = df.withColumn("c", geo.grid_cell(F.col("x"), F.col("y"), g, bounds)).orderBy("i").collect()
    assert [(r.c.loc_x, r.c.loc_y) for r in got] == expected
    assert (g.n_col, g.n_row, JIANGSU_GRID.n_col, JIANGSU_GRID.n_row) == (825, 944, 564, 529)


def test_haversine_forms(spark):
    df = spark.createDataFrame([(31.0, 121.0, 32.0, 118.0), (32.0, 118.0, 31.0, 121.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    rows = df.select(*[geo.haversine(*map(F.col, "abcd"), f).alias(f) for f in ("atan2", "asin", "asin_guarded")]).collect()
    assert abs(rows[0].atan2 - rows[1].atan2) < 1e-6 and abs(rows[0].atan2 - rows[0].asin_guarded) < 1e-3 and abs(rows[0].asin - rows[0].atan2) < 1e-3
    assert rows[2].atan2 is None and rows[2].asin_guarded is None


def test_formulas(spark):
    one = spark.range(1)
    row = one.select(
        fm.normal_pdf(F.lit(1.0), F.lit(0.0), F.lit(2.0)).alias("pdf"), fm.velocity(F.lit(5.0), F.lit(0)).alias("v0"), fm.reward_velocity(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("div"),
        fm.nearest_mode(F.lit(70.0), {"GSD": 60, "GG": 80, "TG": 200, "TS": 40}).alias("tie"), fm.step_reward(F.lit(True), F.lit(1.0), F.lit(4.0), 1.5).alias("goal"),
    ).first()
    assert abs(row.pdf - math.exp(-0.125) / (2 * math.sqrt(2 * math.pi))) < 1e-12
    assert (row.v0, row["div"], row.tie) == (0.0, None, "GSD") and abs(row.goal - 2.65) < 1e-12
