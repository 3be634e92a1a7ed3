"""Policy rollouts over trips on a raster: the environment of a walker with eight actions, and that of a chooser of modes above it.

Each trip (id, loc_x, loc_y, next_loc_x, next_loc_y) is one episode. A policy maps states [dx, dy, goal_x, goal_y, n0..n7] to eight
scores; of the actions by descending score the first that isn't the reverse of the one before is taken. All live episodes of an
Arrow batch step together in numpy, so a task's memory is its batch and the raster's bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import formulas as fm
from ..spec import ACTIONS, MODES
from .raster import support
from .stats import running_mean

#: Cells of a raster whose bits every task may hold: 256 MB a layer. The default grid has 778,800.
MAX_CELLS = 1 << 31


def greedy_policy(states: np.ndarray) -> np.ndarray:
    """The default: the action after which least Manhattan distance is left, roads first among equals."""
    moves = np.array(ACTIONS)
    left = np.abs(states[:, None, 0] + moves[:, 0] - states[:, None, 2]) + np.abs(states[:, None, 1] + moves[:, 1] - states[:, None, 3])
    return -left + 0.1 * states[:, 4:12]


def load_weights(file) -> list:
    """(matrix, bias) of each layer of an .npz file with w0, b0, w1, b1 ... ; arrays only, nothing is unpickled."""
    with np.load(file, allow_pickle=False) as z:
        return [(z[f"w{k}"], z[f"b{k}"]) for k in range(len(z.files) // 2)]


def network_policy(layers: list) -> Callable:
    """The forward pass of a trained network with rectified hidden layers as a policy; a fixed number of weights, sent with the tasks."""

    def scores(states: np.ndarray) -> np.ndarray:
        x = states
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k < len(layers) - 1:
                x = np.maximum(x, 0)
        return x

    return scores


def set_bits(layer: DataFrame, column: str, n_col: int, n_row: int) -> np.ndarray:
    """One layer as bits, cell (x, y) at x * n_row + y. Eight cells make a byte before they travel."""
    if n_col * n_row > MAX_CELLS:
        raise ValueError(f"a grid of {n_col} x {n_row} cells is over {MAX_CELLS}")
    at = F.col("x").cast("long") * n_row + F.col("y")
    inside = F.col("x").between(0, n_col - 1) & F.col("y").between(0, n_row - 1)
    cells = layer.where((F.col(column) == 1) & inside).select(at.alias("at"))
    packed = cells.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftright(128, int(at & 7))")).alias("bits"))
    got = packed.toArrow()
    out = np.zeros(-(-n_col * n_row // 8), dtype=np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return out


def rollout(trips: DataFrame, layer: DataFrame, n_col: int, n_row: int, column: str = "TG", hold: float = 1.5, policy: Callable = greedy_policy, normalised: bool = False, mode: str | None = None, no_return: bool = False) -> DataFrame:
    """id, steps, reward, matched, total, match_rate, finished, length of each episode; trips with a null or NaN coordinate are skipped.

    An episode ends when the remaining Manhattan distance is at most hold, or after Manhattan distance + 10 steps. finished means
    no more steps than the Manhattan distance from start to goal. The match rate leaves out the first cell and cells outside. length
    is that of the path's cells after the start, with the edge from the last back to the first. normalised scales step rewards by
    the distance left over that at the start. The walker sees the layer `column`; matches are counted on it, or on the layer that
    the trip's column `mode` names. no_return: no cell is entered twice, instead of no step being reversed."""
    names = (column,) if mode is None else tuple(dict.fromkeys((column, *MODES)))
    held = trips.sparkSession.sparkContext.broadcast({c: set_bits(layer, c, n_col, n_row) for c in names})
    moves = np.array(ACTIONS)

    def on(bits, x, y):
        ok = (x >= 0) & (x < n_col) & (y >= 0) & (y < n_row)
        at = np.where(ok, x.astype(np.int64) * n_row + y, 0)
        return np.where(ok, (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1, 0)

    def episodes(batches):
        grids = held.value
        grid = grids[column]
        for b in batches:
            n = len(b)
            start = b[["loc_x", "loc_y"]].to_numpy(float)
            goal = b[["next_loc_x", "next_loc_y"]].to_numpy(float) - start
            at, first = np.zeros((n, 2)), np.abs(goal).sum(axis=1)
            limit, last = first + 10, np.full(n, -1)
            steps, reward, matched, total = np.zeros(n, int), np.zeros(n), np.zeros(n, int), np.zeros(n, int)
            length, entered = np.zeros(n), np.zeros((n, 2))
            seen = [np.zeros((n, 2))]
            live = np.arange(n)
            roads = lambda x, y: on(grid, x[:, None] + moves[:, 0], y[:, None] + moves[:, 1])
            near = roads(start[:, 0].astype(int), start[:, 1].astype(int))
            while len(live):
                states = np.hstack([at[live], goal[live], near[live]])
                order = np.argsort(-np.asarray(policy(states)), axis=1, kind="stable")
                if no_return:
                    ahead = at[live][:, None, :] + moves[order]  # by score
                    old = np.zeros(ahead.shape[:2], dtype=bool)
                    for s in seen:
                        old |= (ahead == s[live][:, None, :]).all(axis=2)
                    pick = np.where(old.all(axis=1), np.maximum(last[live], 0), order[np.arange(len(live)), np.argmin(old, axis=1)])
                else:
                    back = (last[live] + 4) % 8  # the opposite action, as ids run around the circle
                    pick = np.where((last[live] >= 0) & (order[:, 0] == back), order[:, 1], order[:, 0])
                steps[live] += 1
                before = at[live].copy()
                at[live] += moves[pick]
                if no_return:
                    seen.append(at.copy())
                new = steps[live] == 1
                entered[live[new]] = at[live[new]]
                length[live] += np.where(new, 0, np.sqrt(((at[live] - before) ** 2).sum(axis=1)))
                share = np.abs(at[live] - goal[live]).sum(axis=1)
                scale = np.divide(share, first[live], out=np.ones(len(live)), where=first[live] > 0) if normalised else np.ones(len(live))
                reward[live] += np.where(near[live, pick] != 0, 0.65 * scale, 0) - np.where(share > hold, scale, 0) + np.where(share <= hold, 2, 0)
                cell = (start[live] + at[live]).astype(int)
                inside = (cell[:, 0] >= 0) & (cell[:, 0] < n_col) & (cell[:, 1] >= 0) & (cell[:, 1] < n_row)
                count = inside & (steps[live] > 1) if mode is None else np.ones(len(live), dtype=bool)
                total[live] += count
                hit = on(grid, cell[:, 0], cell[:, 1])
                if mode is not None:
                    own = b["_mode"].to_numpy()[live]
                    hit = np.zeros(len(live), dtype=int)
                    for m in MODES:
                        hit = np.where(own == m, on(grids[m], cell[:, 0], cell[:, 1]), hit)
                matched[live] += count & (hit == 1)
                near[live] = roads(cell[:, 0], cell[:, 1])
                last[live] = pick
                live = live[(share > hold) & (steps[live] < limit[live])]
            length += np.sqrt(((at - entered) ** 2).sum(axis=1))
            yield pd.DataFrame({"id": b["id"], "steps": steps, "reward": reward, "matched": matched, "total": total, "match_rate": matched / (total + 0.0001), "finished": steps <= first, "length": length})

    coords = ("loc_x", "loc_y", "next_loc_x", "next_loc_y")
    rows = trips.select("id", *[F.col(c).cast("double").alias(c) for c in coords], *([F.col(mode).alias("_mode")] if mode else []))
    for c in coords:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    return rows.mapInPandas(episodes, "id long, steps long, reward double, matched long, total long, match_rate double, finished boolean, length double")


def rollout_summary(episodes: DataFrame) -> DataFrame:
    """episodes, finished, finish_rate, and the mean match rate of those finished."""
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("finished").alias("finished"),
        F.try_divide(F.count_if("finished"), F.count(F.lit(1))).alias("finish_rate"), F.avg(F.when(F.col("finished"), F.col("match_rate"))).alias("mean_match_rate"),
    )


def most_supported(state: Column) -> Column:
    """The default chooser: the mode with most roads at a trip's ends; the first in order wins a tie."""
    pairs = F.array(*[F.struct((-F.get(state, F.lit(k + 1))).alias("s"), F.lit(k).alias("k"), F.lit(m).alias("mode")) for k, m in enumerate(MODES)])
    return F.array_min(pairs)["mode"]


#: The reward of an upper step by variant, from its match rate, its minutes, the observed ones, the mode's mean and deviation.
REWARDS = {
    "base": lambda r: fm.reward_base(r["match"], r["t_lower"], r["t_upper"]),
    "match": lambda r: r["match"],
    "velocity": lambda r: fm.reward_velocity(r["match"], r["mean"] / 60, r["v"]),
    "zscore": lambda r: fm.reward_zscore(r["match"], r["v"], r["mean"], r["std"]),
    "pdf": lambda r: fm.reward_pdf(r["match"], r["v"], r["mean"], r["std"]),
    "penalty": lambda r: fm.reward_penalty(fm.z_score(r["v"] * 60, r["mean"], r["std"]), r["matched"], r["total"]),
}


def upper_rollout(trips: DataFrame, layer: DataFrame, speeds: DataFrame, n_col: int, n_row: int, by: str, order: str, choose: Callable = most_supported, reward: str = "base", policy: Callable = greedy_policy) -> DataFrame:
    """One row for each trip (id, by, order, locx_o, locy_o, locx_d, locy_d, time, distance): the mode that `choose` takes from its
    state, the walk of that mode, its match rate (0 if it needs more steps than allowed), minutes, reward, and the running mean of
    rewards along the trajectory. speeds: mode, mean, std."""
    state = fm.upper_state(F.col("distance"), F.col("time"), [F.col(m) for m in MODES])
    chosen = trips.join(support(trips, layer), "id").withColumn("mode", choose(state)).drop(*MODES)
    walks = chosen.select("id", "mode", F.col("locx_o").alias("loc_x"), F.col("locy_o").alias("loc_y"), F.col("locx_d").alias("next_loc_x"), F.col("locy_d").alias("next_loc_y"))
    steps = rollout(walks, layer, n_col, n_row, policy=policy, mode="mode", no_return=True).select("id", "steps", "matched", "total", "length")
    rows = chosen.join(steps, "id").join(F.broadcast(speeds), "mode")  # a handful of modes
    limit = F.abs(F.col("locx_o") - F.col("locx_d")) + F.abs(F.col("locy_o") - F.col("locy_d")) + 10
    rate = F.when(F.col("steps") <= limit, F.col("matched") / (F.col("total") + F.lit(0.1))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"match": rate, "t_lower": F.col("length") / (F.col("mean") / 60), "t_upper": F.greatest(F.lit(0.0), F.col("time")), "v": fm.true_speed(F.col("distance"), F.col("time"))})
    rows = rows.withColumn("reward", REWARDS[reward]({c: F.col(c) for c in ("match", "matched", "total", "t_lower", "t_upper", "v", "mean", "std")}))
    return running_mean(rows, "reward", (by,), (order,)).select(by, "id", "mode", "steps", "matched", "total", "match", "t_lower", "reward", "r_avg")
