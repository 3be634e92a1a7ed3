"""Raster operators: layers of a bitmask, neighbourhood reads, road support, match rates, travel times.

A raster is (x, y, code). It has at most one row a cell of a bounded grid, so joins may broadcast it; the hint is left to the
optimizer, which knows its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import euclid
from ..spec import ACTIONS, LAYER_BITS, MODES, PERMIT_BITS, GridSpec


def any_bit(code: Column, bits: tuple) -> Column:
    """Whether any of the bits is set."""
    return code.bitwiseAND(F.lit(sum(1 << b for b in set(bits)))) != 0


def layers(raster: DataFrame, n_col: int, n_row: int) -> DataFrame:
    """x, y and a 0/1 column for each mode; cells outside the grid are dropped."""
    inside = F.col("x").between(0, n_col - 1) & F.col("y").between(0, n_row - 1)
    return raster.where(inside).select("x", "y", *[any_bit(F.col("code"), LAYER_BITS[m]).cast("int").alias(m) for m in MODES])


def permitted(code: Column, mode: str) -> Column:
    return any_bit(code, PERMIT_BITS[mode])


OFFSETS_8 = ACTIONS
OFFSETS_25 = tuple((i, j) for i in range(-2, 3) for j in range(-2, 3))


def _near(layer: DataFrame, columns: tuple, offsets: tuple) -> DataFrame:
    """_x, _y, _k and the columns' values: what the raster's cells are to the cells around them. Only cells of the raster are
    read, so this grows with the raster and not with what looks at it."""
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)])
    wide = layer.select("x", "y", *columns, F.explode(spots).alias("o"))
    return wide.select((F.col("x") - F.col("o.dx")).alias("_x"), (F.col("y") - F.col("o.dy")).alias("_y"), F.col("o.k").alias("_k"), *columns)


def neighbours(points: DataFrame, layer: DataFrame, columns: tuple, offsets: tuple = OFFSETS_8, x: str = "x", y: str = "y", key: str = "id") -> DataFrame:
    """key and, for each layer column, the array of its values at the offsets of each point, in order; 0 where there is no cell.

    Each place's array is made once; the points then need one join on it."""
    places = F.sequence(F.lit(0), F.lit(len(offsets) - 1))
    array = lambda c: F.map_from_entries(F.collect_list(F.struct("_k", c)))  # noqa: E731  a value an offset at most
    cells = _near(layer, columns, offsets).groupBy("_x", "_y").agg(*[array(c).alias(c) for c in columns])
    fill = lambda c: F.transform(places, lambda k: F.coalesce(F.try_element_at(c, k), F.lit(0)))
    filled = [fill(c).alias(c) for c in columns]
    none = F.array_repeat(F.lit(0), len(offsets))
    at = points.select(key, F.col(x).cast("int").alias("_x"), F.col(y).cast("int").alias("_y"))
    return at.join(cells.select("_x", "_y", *filled), ["_x", "_y"], "left").select(key, *[F.coalesce(c, none).alias(c) for c in columns])


def patches(points: DataFrame, layer: DataFrame, column: str, grid: int = 5, **names) -> DataFrame:
    """key and a grid x grid array of arrays around each point."""
    half = grid // 2
    flat = neighbours(points, layer, (column,), tuple((i - half, j - half) for i in range(grid) for j in range(grid)), **names)
    rows = F.array(*[F.slice(F.col(column), i * grid + 1, grid) for i in range(grid)])
    return flat.withColumn(column, rows)


#: Of the 5 x 5 cells from a point on, the 3 x 3 cells at each corner and the actions that they allow.
CORNERS = (((0, 0), (0, 1, 2)), ((0, 2), (2, 3, 4)), ((2, 0), (4, 5, 6)), ((2, 2), (6, 7, 0)))


def feasible_actions(points: DataFrame, layer: DataFrame, column: str = "GG", size: int = 3, **names) -> DataFrame:
    """key and the sorted actions that lead to the layer: size 3, those whose cell is on it; size 5, those of each corner of the
    5 x 5 cells with a cell on it."""
    if size == 3:
        near = neighbours(points, layer, (column,), ACTIONS, **names)
        return near.withColumn(column, F.filter(F.transform(column, lambda v, k: F.when(v == 1, k)), lambda k: k.isNotNull())).withColumnRenamed(column, "actions")
    near = neighbours(points, layer, (column,), tuple((i, j) for i in range(5) for j in range(5)), **names)
    on = lambda a, b: F.exists(F.array(*[F.get(column, F.lit((a + i) * 5 + b + j)) for i in range(3) for j in range(3)]), lambda v: v == 1)
    allowed = [F.when(on(*at), F.array(*map(F.lit, actions))).otherwise(F.array().cast("array<int>")) for at, actions in CORNERS]
    return near.withColumn(column, F.array_sort(F.array_distinct(F.concat(*allowed)))).withColumnRenamed(column, "actions")


def support(trips: DataFrame, layer: DataFrame, key: str = "id") -> DataFrame:
    """key and, for each mode, the sum of the layer over the neighbours of a trip's start and end (locx_o, locy_o, locx_d, locy_d).

    The sum around each place is made once; a trip needs a join for its start and one for its end."""
    around = _near(layer, MODES, ACTIONS).groupBy("_x", "_y").agg(*[F.sum(m).alias(m) for m in MODES])
    ends = trips.select(key, "locx_o", "locy_o", "locx_d", "locy_d")
    for e in "od":
        own = around.select(F.col("_x").alias(f"locx_{e}"), F.col("_y").alias(f"locy_{e}"), *[F.col(m).alias(f"_{e}_{m}") for m in MODES])
        ends = ends.join(own, [f"locx_{e}", f"locy_{e}"], "left")
    total = lambda m: sum((F.coalesce(f"_{e}_{m}", F.lit(0)) for e in "od"), F.lit(0)).cast("long")
    return ends.select(key, *[total(m).alias(m) for m in MODES])


def match_rate(path: DataFrame, layer: DataFrame, column: str, n_col: int, n_row: int, by: str = "id", order: str = "seq", skip_first: bool = True, epsilon: float = 0.0001, most: int | None = None) -> DataFrame:
    """by, matched, total, rate = matched / (total + epsilon) of path cells on the layer; cells outside the grid don't count.
    most: a path of more cells has rate 0."""
    rows = path
    if skip_first:
        rows = rows.withColumn("_f", F.min(order).over(Window.partitionBy(by))).where(F.col(order) > F.col("_f"))
    inside = F.col("x").between(0, n_col - 1) & F.col("y").between(0, n_row - 1)
    hit = rows.join(layer.select("x", "y", F.col(column).alias("_on")), ["x", "y"], "left")
    out = hit.groupBy(by).agg(F.count_if(inside & (F.coalesce("_on", F.lit(0)) == 1)).alias("matched"), F.count_if(inside).alias("total"))
    rate = F.col("matched") / (F.col("total") + F.lit(epsilon))
    return out.withColumn("rate", rate if most is None else F.when(F.col("total") <= most, rate).otherwise(F.lit(0.0)))


def travel_time(path: DataFrame, speed: Column, by: str = "id", order: str = "seq", closed: bool = True) -> DataFrame:
    """by, minutes: the path's length over the speed. closed: with the edge from the last cell back to the first."""
    w = Window.partitionBy(by).orderBy(order)
    last = F.last(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.lag(F.struct("x", "y")).over(w)
    prev = F.coalesce(before, last) if closed else before
    rows = path.withColumn("_p", prev)
    length = F.coalesce(euclid(F.col("_p.x"), F.col("_p.y"), F.col("x"), F.col("y")), F.lit(0.0))
    return rows.groupBy(by).agg(F.sum(length / speed).alias("minutes"))


def grid_layers(raster: DataFrame, grid: GridSpec) -> DataFrame:
    return layers(raster, grid.n_col, grid.n_row)
