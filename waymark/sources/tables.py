"""Tables by name or path, date-sharded families, CSV sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .shared import _hadoop


def use_database(spark: SparkSession, name: str, location: str | None = None) -> SparkSession:
    """The session with a database as the current one; made first if a location for it is given."""
    if location:
        spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:db) LOCATION '" + location.replace("'", "\\'") + "'", args={"db": name})
    spark.catalog.setCurrentDatabase(name)
    return spark


def load(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a catalog table by name, or Parquet by path."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def select_from(spark: SparkSession, table: str, text: str, **values) -> DataFrame:
    """SQL on a table whose name is a parameter (:t), as are all values: nothing is pasted into the text."""
    return spark.sql(text, args={"t": table, **values})


def resolve_shard(spark: SparkSession, prefix: str, date: str) -> str:
    """prefix_date or prefix__date, whichever table exists."""
    for name in (tried := (f"{prefix}_{date}", f"{prefix}__{date}")):
        if spark.catalog.tableExists(name):
            return name
    raise ValueError(f"no table for {date}: tried {', '.join(tried)}")


def latest_shards(spark: SparkSession, prefix: str, n: int = 14) -> list:
    """The n latest tables of a date-sharded family, latest first. Names only: no data is read."""
    shape = re.compile(rf"^{re.escape(prefix)}_(\d{{8}})$")
    names = [t.name for t in spark.catalog.listTables() if shape.match(t.name)]
    return sorted(names, key=lambda x: x[-8:], reverse=True)[:n]


def first_existing(spark: SparkSession, paths: tuple) -> str:
    """The first of some paths that exists, in whatever store."""
    for p in paths:
        system, path = _hadoop(spark, p)
        if system.exists(path):
            return p
    raise ValueError(f"none of these exists: {', '.join(paths)}")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows, with a schema; its names must differ."""
    out = spark.createDataFrame([], ddl)
    if len({c.lower() for c in out.columns}) < len(out.columns):
        raise ValueError(f"columns repeat: {', '.join(out.columns)}")
    return out


def overwrite(df: DataFrame, target: str) -> None:
    """The rows as a table or Parquet path, in place of what was there."""
    writer = df.write.mode("overwrite")
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)


def write_sorted(df: DataFrame, target: str, by: tuple) -> None:
    """overwrite() with each file sorted and the files in ranges of `by`, so that readers skip by statistics; the order of a whole
    table is for the reader to ask for."""
    overwrite(df.repartitionByRange(*by).sortWithinPartitions(*by), target)


def write_by_date(df: DataFrame, target: str, date: str = "date") -> Observation:
    """One write for all dates, partitioned by date; null dates are left out. The observation has the row count, without a second
    run of the plan."""
    seen = Observation()
    rows = df.where(F.col(date).isNotNull()).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").partitionBy(date)
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)
    return seen


def write_shards(df: DataFrame, prefix: str, dates: list, folder: str | None = None, date: str = "date") -> list:
    """The same rows as tables prefix_YYYYMMDD, for readers of sharded families: one partitioned write into the folder, over which
    the tables are laid. The date column is kept in the files. Without a folder, one in the warehouse."""
    folder = folder or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/{prefix}"
    spark, days = df.sparkSession, [str(d).replace("-", "") for d in dates]
    day = F.replace(F.col(date).cast("string"), F.lit("-"), F.lit(""))
    wide = df.withColumn("_day", day).where(F.col("_day").isin(days))
    wide.repartition("_day", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("_day").parquet(folder)
    names = []
    for d in days:
        names.append(f"{prefix}_{d}")
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:t)", args={"t": names[-1]})
        system, path = _hadoop(spark, at := f"{folder}/_day={d}")
        if not system.exists(path):
            empty(spark, df.schema.simpleString()[7:-1].replace(":", " ")).write.parquet(at)
        spark.catalog.createTable(names[-1], path=at, source="parquet", schema=df.schema)
    return names


def renamed_shard(name: str, old: str, new: str) -> str:
    """The name of a shard's result: old_DATE becomes new_DATE."""
    if not re.fullmatch(rf"{re.escape(old)}__?\d{{8}}", name):
        raise ValueError(f"{name} is no table of {old}")
    return new + name[len(old) :]


def missing_dates(df: DataFrame, dates: list, date: str = "date") -> DataFrame:
    """Asked dates without rows: what a batch would report as failed."""
    asked = df.sparkSession.createDataFrame([(str(d),) for d in dates], "stat_date string")
    there = df.select(F.col(date).cast("string").alias("stat_date")).distinct()
    return asked.join(there, "stat_date", "left_anti")


def each_date(df: DataFrame, dates: list, run, date: str = "date") -> tuple:
    """run() of the rows of all asked dates in one plan, and the dates that have none; an error if that is all of them."""
    failed = [r["stat_date"] for r in missing_dates(df, dates, date).orderBy("stat_date").collect()]  # asked dates only
    if len(failed) == len({str(d) for d in dates}):
        raise RuntimeError(f"no rows for any of {', '.join(failed)}")
    return run(df.where(F.col(date).cast("string").isin([str(d) for d in dates]))), failed


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple = (), inferred: bool = False, order: str | None = None) -> DataFrame:
    """CSV with a header (a UTF-8 byte order mark is dropped); all columns are strings without a schema, unless types are inferred.
    order: the name of an added column that rises along the file, for operators to which the order of rows matters."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", inferred and not schema)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no columns {', '.join(lost)}")
    return df.withColumn(order, F.monotonically_increasing_id()) if order else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; as one file only what is small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def number_label(value: Column) -> Column:
    """An integer as such, any other number with two places."""
    whole = F.abs(value - F.round(value)) < 1e-9
    return F.when(whole, F.format_string("%d", F.round(value).cast("long"))).otherwise(F.format_string("%.2f", F.bround(value, 2)))


def histogram_rows(bins: DataFrame) -> DataFrame:
    edges = [F.format_string("%.6f", c).alias(c) for c in ("bin_left", "bin_right")]
    return bins.orderBy("bin").select(*edges, "frequency")


def write_histogram_csv(bins: DataFrame, path: str) -> None:
    write_csv(histogram_rows(bins), path, one_file=True)


def summary_rows(rows: DataFrame) -> DataFrame:
    """metric, value as text: counts as integers, all else with six places; what has no value has no row."""
    counted = F.col("metric").startswith("skipped") | (F.col("metric") == "count")
    return rows.where("value IS NOT NULL").select("metric", F.when(counted, F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.6f", "value")).alias("value"))


def write_summary_csv(rows: DataFrame, path: str) -> None:
    write_csv(summary_rows(rows), path, one_file=True)
