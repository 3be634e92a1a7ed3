"""The test tables seen as the trajectory tables: signalling points, cells, paths, raster, trips, mode speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..spec import GridSpec

#: Raster of the fixtures, and mean and standard deviation of speeds in km/h by mode (made up).
GRID = GridSpec(0, 50, 0, 40, 1)
SPEEDS = {"GSD": (60, 20), "GG": (80, 25), "TS": (40, 15), "TG": (200, 50)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uid"), F.floor(F.hour("ts") / 6).cast("int").alias("move_id"), F.col("event_id").alias("move_vp_id"), F.col("ts").alias("stime"),
        cid.cast("string").alias("grid_id"), cid.alias("cid"), F.concat(F.lit("P"), F.pmod(F.length("event_type"), F.lit(3)).cast("string")).alias("province"), F.col("event_type").alias("city"), F.date_format("ts", "yyyyMMdd").cast("int").alias("date"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 7)
    return c.select((F.col("c_custkey") % 120).alias("cid"), (F.lit(27.5) + (F.col("c_acctbal") + 1000) / 1500).alias("lat"), (F.lit(115) + F.col("c_nationkey") * F.lit(0.3)).alias("lon"), F.col("c_custkey").alias("date"))


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    node = F.when(F.col("k") % 10 == 0, F.lit(-1)).otherwise(F.col("k")).cast("bigint")
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return e.withColumn("rn_id", node).select(
        F.col("user_id").alias("moi_id"), (F.row_number().over(day) - 1).cast("bigint").alias("rn_seq"), "rn_id", F.coalesce(F.lead("rn_id").over(day), F.lit(-1)).cast("bigint").alias("next_rn_id"),
        F.unix_timestamp("ts").alias("time"), F.col("event_id").alias("row_id"), F.date_format("ts", "yyyyMMdd").cast("bigint").alias("day"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 50).cast("int").alias("x"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), (F.col("p_size") * 3).cast("int").alias("code"))


def trips(steps: DataFrame) -> DataFrame:
    """One trip for each step: cells from cid, minutes and Manhattan distance."""
    at = lambda c: ((F.col(c) % 50).cast("int"), (F.floor(F.col(c) * 7) % 40).cast("int"))
    (xo, yo), (xd, yd) = at("cid"), at("next_cid")
    minutes = (F.unix_timestamp("next_stime") - F.unix_timestamp("stime")) / 60.0
    rows = steps.select(F.col("move_vp_id").alias("id"), xo.alias("locx_o"), yo.alias("locy_o"), xd.alias("locx_d"), yd.alias("locy_d"), minutes.alias("time"))
    return rows.withColumn("distance", (F.abs(F.col("locx_o") - F.col("locx_d")) + F.abs(F.col("locy_o") - F.col("locy_d"))).cast("double"))
