"""Connected components of a stored edge list: spanning forests of runs of edges, and alternating large-star and small-star steps
on DataFrames for what they leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, removed, stored

#: Edges that one task makes a forest of. So many or fewer in all need no steps.
RUN = 20_000


class Union(dict):
    """Disjoint sets; the smallest of each is its root."""

    def root(self, x):
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def _forest(batches):
    """Of edges (u, v): for runs of them (node, the smallest node that it reaches within the run), without the smallest."""

    def emit(union):
        rows = [(x, r) for x in union if (r := union.root(x)) != x]
        cols = np.array(rows, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["u", "v"])

    union, held = Union(), 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            union.join(u, v)
        held += b.num_rows
        if held >= RUN:
            yield emit(union)
            union, held = Union(), 0
    yield emit(union)


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v that connect the same nodes as those given."""
    return edges.select("u", "v").transform(in_batches, _forest, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(row)


def components(edges: DataFrame, store=stored) -> DataFrame:
    """From edges (u, v) of bigints: node, root, the smallest node that it reaches. Nodes without an edge don't appear.

    Each step only takes minima by key (with map-side combining) and joins on keys, so a hub is split by adaptive skew joins.
    At most RUN edges, at the start or after a step, are settled by one task.
    store: what keeps the result's table."""
    now = stored(forest(edges.where("u <> v")), "edges")
    state = _state(now)
    while state[0] > RUN:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        tied = least.select("u", F.col("m").alias("v"))
        old, now = now, stored(moved.unionByName(tied).distinct(), "edges")
        removed(old)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        old, now = now, stored(forest(now.coalesce(1)), "edges")
        removed(old)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = store(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    removed(now)
    return out
