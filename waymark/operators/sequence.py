"""Path operators on ordered rows: rebuild, clean and split, resample, re-stitch."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


class _Waiting:
    """Rows in order with a time each: the first unused row that isn't earlier than some time, in a number of steps that grows with
    the logarithm of the rows. A tree holds the latest time of each span."""

    def __init__(self, rows: list, times: list):
        self.rows, size = rows, 1 << max(0, (len(rows) - 1).bit_length())
        self.size, self.latest = size, [float("-inf")] * (2 * size)
        self.latest[size : size + len(rows)] = times
        for k in range(size - 1, 0, -1):
            self.latest[k] = max(self.latest[2 * k], self.latest[2 * k + 1])

    def take(self, time):
        """That row, used from now on; None if there is none."""
        if not self.latest[1] >= time:
            return None
        k = 1
        while k < self.size:
            k = 2 * k if self.latest[2 * k] >= time else 2 * k + 1
        self.use(k - self.size)
        return self.rows[k - self.size]

    def use(self, place: int) -> None:
        k = place + self.size
        self.latest[k] = float("-inf")
        while k > 1:
            k //= 2
            self.latest[k] = max(self.latest[2 * k], self.latest[2 * k + 1])


def rebuild_paths(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Greedy chains: from each row with rn_seq 0, in order, the first unused row of the same moi_id with rn_id equal to the
    current next_rn_id, rn_seq one more and time not earlier follows. Rows never reached are dropped.

    Needs moi_id, rn_seq, rn_id, next_rn_id, time and an order column. Adds path_no (0-based along moi_id) and path_sequence. Each
    step takes logarithmic time, however often a node repeats. A group's rows are in one task."""
    schema = StructType([*rows.schema.fields, StructField("path_no", LongType()), StructField("path_sequence", LongType())])

    def chains(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        seq, here, there, time = (group[c].tolist() for c in ("rn_seq", "rn_id", "next_rn_id", "time"))
        by_key, place = defaultdict(list), []
        for i, key in enumerate(zip(here, seq)):
            place.append(len(by_key[key]))
            by_key[key].append(i)
        never = float("-inf")  # a row without a time follows nothing
        waiting = {k: _Waiting(v, [never if pd.isna(time[i]) else time[i] for i in v]) for k, v in by_key.items()}
        used, out, path = [False] * len(group), [], 0
        for start in range(len(group)):
            if seq[start] != 0 or used[start]:
                continue
            waiting[here[start], 0].use(place[start])
            at, step = start, 0
            while at is not None:
                used[at] = True
                out.append((at, path, step))
                after = waiting.get((there[at], seq[at] + 1)) if not pd.isna(there[at]) and not pd.isna(time[at]) else None
                at, step = after.take(time[at]) if after else None, step + 1
            path += 1
        picked = group.iloc[[i for i, _, _ in out]].copy()
        picked["path_no"], picked["path_sequence"] = [p for _, p, _ in out], [s for _, _, s in out]
        return picked

    return rows.groupBy("moi_id").applyInPandas(chains, schema)


def first_numbers(sizes: DataFrame, key: str, ranges: int = 256) -> DataFrame:
    """key and _first, the sum of _n over all smaller keys, of rows (key, _n).

    Keys are summed within ranges between approximate quantiles, so no task holds all of them."""
    cuts = sizes.agg(F.percentile_approx(key, F.lit([k / ranges for k in range(1, ranges)])).alias("_cuts"))
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c < F.col(key)))
    placed = sizes.crossJoin(F.broadcast(cuts)).select(key, "_n", below.alias("_range"))  # a single row
    totals = placed.groupBy("_range").agg(F.sum("_n").alias("_s"))  # at most `ranges` rows
    base = totals.select("_range", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(base), "_range")
    return first.select(key, (F.col("_base") + F.col("_in")).alias("_first"))


def number_paths(built: DataFrame) -> DataFrame:
    """path_id over all groups: the number of paths of smaller moi_id plus path_no."""
    first = first_numbers(built.groupBy("moi_id").agg((F.max("path_no") + 1).alias("_n")), "moi_id")
    return built.join(first, "moi_id").withColumn("path_id", F.col("_first") + F.col("path_no")).drop("_first")


def split_paths(paths: DataFrame, invalid: int = -1, renumber: bool = False) -> DataFrame:
    """Clean and split paths (path_id, path_sequence, rn_id, next_rn_id, time).

    Rows with both nodes invalid go; time_diff to the next row is taken; rows with an invalid next node or no time_diff go; a row
    with an invalid node ends a part and goes; parts of one row go. Adds part (0-based along path_id), rn_seq anew, time_diff.
    renumber: path_id is a new number over all parts from 0, in order of path and part, parts of one row counted."""
    path = Window.partitionBy("path_id").orderBy("path_sequence")
    rows = paths.where(~((F.col("rn_id") == invalid) & (F.col("next_rn_id") == invalid)))
    rows = rows.withColumn("time_diff", F.lead("time").over(path) - F.col("time"))
    rows = rows.where((F.col("next_rn_id") != invalid) & F.col("time_diff").isNotNull())
    rows = rows.withColumn("_cut", F.sum((F.col("rn_id") == invalid).cast("int")).over(path)).where(F.col("rn_id") != invalid)
    if renumber:
        rows = rows.withColumn("_no", F.dense_rank().over(Window.partitionBy("path_id").orderBy("_cut")) - 1)
        first = first_numbers(rows.groupBy("path_id").agg((F.max("_no") + 1).cast("long").alias("_n")), "path_id")
        rows = rows.join(first, "path_id").withColumn("_new", (F.col("_first") + F.col("_no")).cast("long")).drop("_first", "_no")
    part = Window.partitionBy("path_id", "_cut")
    rows = rows.withColumn("rn_seq", (F.row_number().over(part.orderBy("path_sequence")) - 1).cast("long")).withColumn("_size", F.count(F.lit(1)).over(part))
    rows = rows.where("_size >= 2").withColumnRenamed("_cut", "part").drop("_size")
    return rows.drop("path_id").withColumnRenamed("_new", "path_id") if renumber else rows


def resample(rows: DataFrame, by: str = "path_id", order: str = "rn_seq", threshold: float = 1000.0) -> DataFrame:
    """Segments: time_diff and distance are summed along a path until the time exceeds the threshold; the segment's first row is
    kept with the sums, and summing starts anew. What is left is a last segment.

    The rows pass through in order once: a task holds a batch and one open segment, however long a path is. A sum with a null is
    null, which exceeds nothing."""
    schema = StructType([StructField(f.name, DoubleType()) if f.name in ("time_diff", "distance") else f for f in rows.schema.fields])
    names = rows.columns
    at = {c: names.index(c) for c in (by, order, "time_diff", "distance")}

    def run(batches):
        open_row, key, t, d = None, None, 0.0, 0.0  # the open segment: its first row and sums
        for b in batches:
            keys, times, lengths = (b.column(at[c]).to_pylist() for c in (by, "time_diff", "distance"))
            firsts, sums_t, sums_d, carried, start = [], [], [], open_row, -1
            for i, k in enumerate(keys):
                if open_row is None or k != key:
                    if open_row is not None:
                        firsts.append(start)
                        sums_t.append(t)
                        sums_d.append(d)
                    open_row, key, start, t, d = True, k, i, times[i], lengths[i]
                else:
                    t = None if t is None or times[i] is None else t + times[i]
                    d = None if d is None or lengths[i] is None else d + lengths[i]
                if t is not None and t > threshold:
                    firsts.append(start)
                    sums_t.append(t)
                    sums_d.append(d)
                    open_row = None
            whole = pa.Table.from_batches([b])
            if carried is not None:  # the segment that was open before this batch has place -1, which is row 0 here
                whole, firsts = pa.concat_tables([carried, whole]), [f + 1 for f in firsts]
                start += 1
            if open_row is not None:
                open_row = whole.slice(start, 1).combine_chunks()
            yield from _segments(whole, firsts, sums_t, sums_d)
        if open_row is not None:
            yield from _segments(open_row, [0], [t], [d])

    def _segments(whole, firsts, sums_t, sums_d):
        out = whole.take(pa.array(firsts, pa.int64()))
        for c, sums in (("time_diff", sums_t), ("distance", sums_d)):
            out = out.set_column(at[c], c, pa.array(sums, pa.float64()))
        yield from out.combine_chunks().to_batches()

    doubles = rows.withColumns({c: F.col(c).cast("double") for c in ("time_diff", "distance")}).select(*names)
    return doubles.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


STITCHED = (("next_rn_id", "rn_id"), ("next_loc_x", "loc_x"), ("next_loc_y", "loc_y"), ("next_lat", "lat"), ("next_lon", "lon"))


def restitch(segments: DataFrame, by: str = "path_id", order: str = "rn_seq") -> DataFrame:
    """Each segment's next_* become the following segment's own values; the last one's stay. Adds velocity."""
    from ..functions.formulas import velocity

    w = Window.partitionBy(by).orderBy(order)
    pairs = [(n, c) for n, c in STITCHED if n in segments.columns and c in segments.columns]
    rows = segments.withColumn("_n", F.lead(F.struct(*[c for _, c in pairs])).over(w))
    rows = rows.withColumns({n: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(n)) for n, c in pairs}).drop("_n")
    return rows.withColumn("velocity", velocity(F.col("distance"), F.col("time_diff")))


def run_lengths(rows: DataFrame, value: str, order: str, by: tuple, cyclic: bool = False) -> DataFrame:
    """Consecutive rows of equal value in each group: value, run (0-based), first order and number of rows. cyclic: a group's last
    row is followed by its first, so a last run of the first run's value has that run's rows, too."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    runs = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    out = runs.groupBy(*by, "run", value).agg(F.min(order).alias("first_order"), F.count(F.lit(1)).alias("n_rows"))
    if not cyclic:
        return out
    along = Window.partitionBy(*by).orderBy("run")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(F.struct(value, "n_rows")).over(whole), F.max("run").over(whole)
    wraps = (F.col("run") > 0) & (F.col("run") == F.col("_l")) & (F.col(value) == F.col(f"_f.{value}"))
    out = out.withColumns({"_f": first, "_l": last})
    return out.withColumn("n_rows", F.col("n_rows") + F.when(wraps, F.col("_f.n_rows")).otherwise(F.lit(0))).drop("_f", "_l")
